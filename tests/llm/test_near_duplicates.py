from collections import Counter, defaultdict

import numpy as np
import xxhash

from vigilog.llm import simhash

from .test_similarity import slow_components, slow_set


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(codes, radius=3):
    """Least index reachable of each code."""
    group = list(range(len(codes)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(codes))]


def expected(rows):
    codes = [slow_fingerprint(r.text) for r in rows]
    groups = slow_groups(codes)
    least = {}
    for g, r in zip(groups, rows):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    return sorted(((r.doc_id, format(c, "016x"), least.get(g)) for r, c, g in zip(rows, codes, groups)), key=str)


def test_components(docs):
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == expected(docs.collect())


def test_edges(edges, nothing):
    got = sorted(map(tuple, simhash.near_duplicates(edges).collect()), key=str)
    assert got == expected(edges.collect())
    assert {g[1] for g in got if g[0] in (4, 5, 6)} == {"0" * 16}
    assert simhash.near_duplicates(nothing).count() == 0


def kept_rows(rows):
    """The least known doc_id of each group at 0.8 over five words, by all pairs; texts without words are one group."""
    sets = [slow_set(r.text, 5) for r in rows]
    empty = next((i for i, s in enumerate(sets) if not s), None)
    groups = [g if s else empty for g, s in zip(slow_components(sets), sets)]
    least = {}
    for g, r in zip(groups, rows):
        least[g] = min(least.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    return sorted((None if unknown else i for unknown, i in least.values()), key=str)


def test_one_row_of_each_group_stays(docs, edges, nothing):
    for frame in (docs, edges):
        kept = simhash.representatives(frame)
        assert kept.columns == frame.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == kept_rows(frame.collect())
    assert simhash.representatives(nothing).count() == 0


def pairs_by_prefixes(sets, percent=80):
    """All pairs at or above the similarity: sets that are similar share an element among their rarest ones."""
    count = Counter(x for s in sets for x in s)
    place, found = defaultdict(list), set()
    for i, s in sorted(enumerate(sets), key=lambda x: len(x[1])):
        prefix = sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in prefix for j in place[x]}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                found.add((min(i, j), max(i, j)))
        for x in prefix:
            place[x].append(i)
    return found


def test_recall_at_a_hundredth(spark):
    """Of the pairs that an exact search finds at 0.8 over five words, none keeps both rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    sets = [slow_set(r.text, 5) for r in rows]
    pairs = pairs_by_prefixes(sets)
    kept = {r.doc_id for r in simhash.representatives(docs).select("doc_id").collect()}
    assert sum(sets[i] != sets[j] for i, j in pairs) > 10
    assert not [(rows[i].doc_id, rows[j].doc_id) for i, j in pairs if rows[i].doc_id in kept and rows[j].doc_id in kept]
    near = {i for p in pairs for i in p}
    assert all(rows[i].doc_id in kept for i, s in enumerate(sets) if s and i not in near)


def test_representatives_are_found_by_vantage_trees(docs, monkeypatch):
    """The links of the stage come out of the trees over fingerprints: trees that find nothing leave only equal sets."""
    rows = docs.collect()
    sets = [slow_set(r.text, 5) for r in rows]
    frozen = simhash.Search(simhash.set_fingerprint, type("Blind", (), {"__init__": lambda self, codes: None, "near": lambda self, i, alive: np.zeros(0, np.int64)}))
    monkeypatch.setattr(simhash, "Search", lambda code, index: frozen)
    assert simhash.representatives(docs).count() == len({frozenset(s) for s in sets}) > len(kept_rows(rows))


def test_wide_trees_find_all_similar_sets():
    """Pairs at 0.8, small and large, lie within the radius, and the tree finds all codes within it."""
    rng = np.random.default_rng(3)
    for n in (4, 8, 40, 400):
        for _ in range(400):
            own = rng.integers(0, 2**63, n).astype(np.uint64)
            more = np.concatenate([own, rng.integers(0, 2**63, n // 4).astype(np.uint64)])
            assert (simhash.set_fingerprint(own) ^ simhash.set_fingerprint(more)).bit_count() <= simhash.WIDE
    codes = np.concatenate([clustered(600), clustered(600)[:50]])
    tree, alive = simhash.WideTree(codes), rng.random(len(codes)) < 0.7
    for i in range(0, len(codes), 7):
        assert tree.near(i, alive).tolist() == np.flatnonzero(alive & (np.bitwise_count(codes ^ codes[i]) <= simhash.WIDE)).tolist()
    assert simhash.set_fingerprint(np.zeros(0, np.uint64)) == 0


def clustered(n=1500):
    rng = np.random.default_rng(1)
    codes = []
    for base in rng.integers(0, 2**63, 4).tolist():
        for _ in range(n // 4):
            code = base
            for bit in rng.integers(0, 64, rng.integers(0, 8)).tolist():
                code ^= 1 << bit
            codes.append(code)
    return np.unique(np.array(codes, np.uint64))


def test_vantage_tree_groups_are_exact():
    codes = clustered()
    least = {}
    groups = slow_groups(codes.tolist())
    for g, c in zip(groups, codes.tolist()):
        least[g] = min(least.get(g, c), c)
    assert simhash.shard_groups(codes).tolist() == [least[g] for g in groups]


def test_triangle_bounds_prune():
    """Fingerprints of many groups that share a block: a query at radius 3 sees a small part of the tree."""
    rng = np.random.default_rng(6)
    block = np.uint64(0x1234)
    codes = np.unique(rng.integers(0, 2**48, 4000).astype(np.uint64) << np.uint64(16) | block)
    tree = simhash.VantageTree(codes)
    assert len(tree.nodes) > 500
    seen = 0

    alive = np.ones(len(codes), bool)
    for query in tree.codes[::100]:
        stack, visited = [tree.root], 0
        while stack:
            low, high, middle, inner, outer = tree.nodes[stack.pop()]
            visited += 1
            if inner >= 0:
                far = int(np.bitwise_count(query ^ tree.codes[low]))
                stack += [inner] * (far <= middle + 3) + [outer] * (far > middle - 3)
        seen += visited
        want = np.flatnonzero(np.bitwise_count(tree.codes ^ query) <= 3)
        assert np.array_equal(tree.within(np.array([query]), alive, 3), want)
    assert seen / len(tree.codes[::100]) < 0.9 * len(tree.nodes)


def test_hot_shards_dealt_again_give_the_same_components(spark):
    codes = clustered(400)
    nodes = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    whole, again = (set(map(tuple, simhash.components(simhash.links(nodes, most)).collect())) for most in (10_000, 2))
    assert whole == again and whole


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert sorted(map(tuple, simhash.components(chain).collect())) == [(i, 0) for i in range(1, 61)]
