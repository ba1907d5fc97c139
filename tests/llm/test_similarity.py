import random

import numpy as np
import pytest

from vigilog.llm import similarity


def slow_set(text, size=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def slow_components(sets, percent=80):
    """Least index reachable of each set, by all pairs."""
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def expected(rows, size=4):
    sets = [slow_set(r.text, size) for r in rows]
    groups = slow_components(sets)
    least = {}
    for g, r in zip(groups, rows):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(s), least.get(g), r.doc_id == least.get(g)) for r, s, g in zip(rows, sets, groups)), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_documents(docs):
    got = rows_of(similarity.near_duplicates(docs))
    assert got == expected(docs.collect())
    assert 0 < sum(not r[3] for r in got) < len(got)


def test_edges(edges, nothing):
    assert rows_of(similarity.near_duplicates(edges)) == expected(edges.collect())
    assert rows_of(similarity.near_duplicates(nothing)) == []


def family(n, seed, changes):
    """Texts that differ from one another by some words each, so that many pairs lie near the limit."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_families_near_the_limit(spark, block):
    """Large bands, in one block and in many, with components that only later links join."""
    texts = [t for s in range(3) for t in family(60, s, 7)] + ["a b", "a b c", "A B", "", None, "a b c d e", "a b c d e f"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(similarity.near_duplicates(frame, block=block))
    assert got == expected(frame.collect())
    assert len({r[2] for r in got}) > 10


def test_blocks_of_few_elements(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ELEMENTS", 700)
    frame = spark.createDataFrame(list(enumerate(family(50, 4, 6))), "doc_id long, text string")
    assert rows_of(similarity.near_duplicates(frame)) == expected(frame.collect())


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 3000):
        off = []
        for _ in range(40):
            both, own = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, (2, n)).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, own[i][: n // 8]])) for i in (0, 1))
            off.append(np.mean(similarity.sketch(a) == similarity.sketch(b)) - n / (n + 2 * (n // 8)))
        assert abs(np.mean(off)) < 0.03 and np.max(np.abs(off)) < 0.2
    assert (similarity.sketch(both) == similarity.sketch(both[::-1])).all()


def test_similarity_is_exact():
    a = np.arange(9, dtype=np.uint64)
    assert similarity.similar(np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64))
    assert not similarity.similar(a[:7], a)
    assert similarity.similar(a[:8], a)
