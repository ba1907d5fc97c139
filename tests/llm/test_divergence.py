import re
from collections import Counter, defaultdict

import numpy as np

from vigilog.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least=10, top=10):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(r.text or "")]
        counts[lang, source].update(words)
        counts[lang].update(words)
        found[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in found.items()}

    def shares(key, lang):
        n = sum(counts[key][t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[key][t] + 2) // (n + 2 * len(kept[lang])) for t in kept[lang]}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    p = {g: shares(g, g[0]) for g in groups}
    for lang, source in groups:
        mine, all_ = p[lang, source], shares(lang, lang)
        pairs = [(sum(f(mine[t], p[lang, s][t]) for t in kept[lang]), s) for g, s in groups if g == lang and s != source]
        terms = [(f(mine[t], all_[t]), t) for t in kept[lang] if counts[lang, source][t] > 0 and mine[t] > all_[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(order, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_all_documents(docs):
    got = rows_of(divergence.divergence(docs))
    assert got == expected(docs.collect())
    assert {r[2] for r in got} == {"pair", "term"}


def test_small_blocks_change_nothing(docs):
    assert rows_of(divergence.divergence(docs, 3, 4, block_rows=50)) == expected(docs.collect(), 3, 4)


def test_edges(spark, edges, nothing):
    for least in (1, 2, 100):
        assert rows_of(divergence.divergence(edges, least)) == expected(edges.collect(), least)
    assert rows_of(divergence.divergence(nothing)) == []
    texts = [("a", "x"), ("a é É b-c1d", "x"), (None, None), ("a", "z"), ("A a A", ""), ("b", "y")]
    frame = spark.createDataFrame([(t, g, s) for t, s in texts for g in (None, "", "q")], "text string, lang string, source string")
    for least in (1, 2):
        assert rows_of(divergence.divergence(frame, least)) == expected(frame.collect(), least)


def test_shares_are_exact_beyond_64_bits(spark):
    rng = np.random.default_rng(2)
    whole = rng.integers(1, 9 * 10**15, 500)
    count = np.minimum(rng.integers(0, 9 * 10**15, 500), whole - 2).clip(0)
    whole = np.maximum(whole, count + 2)
    want = [1 + 10**9 * (c + 2) // w for c, w in zip(count.tolist(), whole.tolist())]
    assert divergence.shares(count, whole).tolist() == want
    frame = spark.createDataFrame(list(zip(count.tolist(), whole.tolist())), "c long, w long")
    assert [r[0] for r in frame.select(divergence.share(frame.c, frame.w)).collect()] == want


def test_skyband_keeps_what_few_dominate():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 60, (3000, 2))
    band = divergence.Skyband(3)
    for at in range(0, 3000, 700):
        band.add(points[at : at + 700], list(range(at, min(at + 700, 3000))))
    want = [i for i, (a, b) in enumerate(points) if ((points[:i, 0] >= a) & (points[:i, 1] <= b)).sum() < 3]
    assert band.rows == want


def test_long_texts_are_split_at_ends_of_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_PART", 10)
    some = list(divergence.terms("Alpha beta, gamma1delta  " * 20 + "é" * 40))
    assert len(some) > 5 and [t for s in some for t in s] == [b"alpha", b"beta", b"gamma", b"delta"] * 20 + ["é".encode() * 40]
