import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from vigilog.llm import lattice, pages, pii, substrings

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    def good(kind, s):
        number = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(number)))
            return 16 <= len(number) <= 19 and total % 10 == 0
        return kind != "phone" or 8 <= len(number) <= 15

    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(kind, m[0])]


def test_base_spans_equal_the_patterns(docs):
    rng = np.random.default_rng(3)
    parts = ["a@b.c", "@", "x.y+z@d-e.f.g", "1.2.3.4", "300.1.1.1", ".", " ", "4111111111111111", "+1 (743) 555-3824", "+", "12", "-", "é", "a@b", "("]
    texts = ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(3000)] + [r.text for r in docs.collect()]
    for t in texts:
        assert pii.base_spans(t or "") == slow_base(t)


def test_found_spans(edges, nothing):
    got = sorted(map(tuple, pii.found_spans(edges, None).collect()), key=str)
    want = []
    for r in edges.collect():
        base = slow_base(r.text)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        want.append((r.doc_id, *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want, key=str)
    assert pii.fit(nothing) is None and pii.found_spans(nothing, None).count() == 0


def test_trees_add_what_the_patterns_miss(spark):
    rng = np.random.default_rng(9)

    def card(good=True):
        while True:
            number = "4" + "".join(map(str, rng.integers(0, 10, 15)))
            if pii.luhn(number) == good:
                return number

    def row(i):
        return (i, f"word{i} here {card()} and {card(False)} or 10.{i % 250}.3.{rng.integers(0, 400)} then +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} at {rng.integers(1, 10**9)} x{i}@mail.example.com end")

    train = spark.createDataFrame([row(i) for i in range(600)], "doc_id long, text string")
    model = pii.fit(train)
    first, second = card(), card()
    text = f"two numbers {first} {second} side by side, not {card(False)}"
    added = model.added([text, "nothing 123 here"], [pii.base_spans(text), []])
    assert pii.base_spans(text) == []
    assert [text[a:b] for _, a, b in sorted(added[0])] == [first, second] and added[1] == []
    clean = pii.redacted(spark.createDataFrame([(1, text, 3), (2, None, None)], "doc_id long, text string, n_chars long"), model).collect()
    assert clean[0].text.startswith("two numbers [CARD] [CARD] side") and clean[0].n_chars == len(clean[0].text)
    assert clean[1].text is None and clean[1].n_chars is None


def test_model_and_thresholds_come_from_all_documents(spark):
    """Eight thousand documents without numbers, and some with, all of which a sample by text hash would leave out."""
    digits = lambda i, n: str(i * 7919 % 10**n).zfill(n)
    given = [f"word{i} call +1 (743) 555-{digits(i, 4)} part {digits(i + 1, 4)} {digits(i + 2, 4)} end" for i in range(200)]
    few = spark.createDataFrame([(t,) for t in given], "text string").where("pmod(xxhash64(text), 2) = 1")
    docs = few.unionByName(spark.range(8000).selectExpr("concat('plain words ', repeat('x', cast(id % 50 AS INT))) AS text"))
    texts = [r.text for r in few.collect()]
    want = Counter(pii.weak_label(t, c, set(pii.base_spans(t))) for t in texts for c in pii.candidates(t))
    got = {r.y: r.n for r in pii.examples(docs).groupBy("y").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == {y: n for y, n in want.items() if y is not None} and set(got) == {0.0, 1.0}
    model = pii.fit(docs)
    assert model and model.least[3] < 1
    text = "all of +1 (743) 555-1234 here"
    assert model.trees.probability(np.array([pii.features(text, (3, 7, 24))]))[0] > model.least[3]


def test_thresholds_count_every_candidate():
    rng = np.random.default_rng(5)
    for _ in range(50):
        score, true = rng.integers(0, 40, 300), rng.random(300) < 0.995
        levels = np.unique(score)
        counts = [np.array([(score == v).sum() for v in levels]), np.array([(true & (score == v)).sum() for v in levels])]
        good = [v for v in levels if (score >= v).sum() >= 20 and true[score >= v].sum() >= 0.99 * (score >= v).sum()]
        want = max(0.5, min(good) * 1024 / pii.SCORE_LEVELS) if good else None
        assert pii._threshold(levels * 1024, *counts) == want


def test_weak_labels():
    def labels(text):
        base = set(pii.base_spans(text))
        return {text[a:b]: pii.weak_label(text, (k, a, b), base) for k, a, b in pii.candidates(text) if k == 3}

    assert labels("Tel. 0044 20 7946 0958 now")["0044 20 7946 0958"] == 1.0
    assert labels("phone: (555) 010-9999 now")["(555) 010-9999"] == 1.0
    assert labels("it is (555) 010-9999 now")["(555) 010-9999"] is None
    assert labels("order 7781 3342 now")["7781 3342"] == 0.0
    assert labels("at +44 20 7946 0958 now")["+44 20 7946 0958"] == 1.0


def test_numbers_of_many_groups_are_candidates():
    for text in ("0033 (0)1 23 45 67 89", "41 11 11 11 11 11 11 11"):
        assert any(f"x {text} y"[a:b] == text for _, a, b in pii.candidates(f"x {text} y"))


def test_trees_add_announced_numbers(spark):
    """Telephone numbers without a plus, announced by a word, are learned from weak labels; bare numbers stay."""
    rng = np.random.default_rng(12)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def row(i):
        return (i, f"word{i} call +1 (743) 555-{digits(4)} or phone 0044 20 {digits(4)} {digits(4)} part {digits(4)} {digits(4)} lot {digits(3)} {digits(3)} {digits(3)} end")

    model = pii.fit(spark.createDataFrame([row(i) for i in range(600)], "doc_id long, text string"))
    text = "Please phone 0044 20 7946 0958 about part 7781 3342."
    assert [text[a:b] for _, a, b in model.added([text], [pii.base_spans(text)])[0]] == ["0044 20 7946 0958"]


def test_taken_stretches():
    rng = np.random.default_rng(8)
    for _ in range(200):
        spans = [(0, int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 6), rng.integers(1, 8, 6))]
        taken, asked = pii.Taken(spans[:3]), spans[:3]
        for s in spans[3:]:
            assert taken.overlaps(s) == any(o[1] < s[2] and s[1] < o[2] for o in asked)
            if not taken.overlaps(s):
                taken.add(s)
                asked.append(s)


def test_many_numbers_take_linear_time():
    text = " ".join(f"10.{i % 256}.{i % 199}.7 4111111111111111 {i}" for i in range(20_000))
    model = pii.SpanModel(pii.BoostedTrees(), [0.0] * 4)
    base = pii.base_spans(text)
    taken, added = pii.Taken(base), model.added([text], [base])[0]
    assert len(base) >= 20_000 and added and not any(taken.overlaps(s) for s in added)


def slow_removal(rows, size):
    first, got = {}, []
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        words = (r.text or "").encode().split()
        for i in range(len(words) - size + 1):
            first.setdefault(tuple(words[i : i + size]), r.doc_id)
    for r in rows:
        words = (r.text or "").encode().split()
        gone = set()
        for i in range(len(words) - size + 1):
            if r.doc_id is not None and first[tuple(words[i : i + size])] < r.doc_id:
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(words) if i not in gone]
        got.append((r.doc_id, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(got, key=str)


def test_repeated_runs(docs, edges, nothing):
    for frame in (docs, edges):
        got = substrings.deduplicated(frame).drop("kept_text").collect()
        want = slow_removal(frame.collect(), 50)
        assert sorted(map(tuple, got), key=str) == want
        assert any(w[2] for w in want)
    assert substrings.deduplicated(nothing).count() == 0


def test_repeats_beyond_the_owner(spark):
    """Windows that third documents share although the owner of their anchor lacks them."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    shared = list(rng.choice(words, 70))
    around = [list(rng.choice(words, 60)) for _ in range(3)]
    texts = [
        shared, around[0] + shared, around[0] + shared + around[1], around[1][-20:] + shared[:55] + around[2], shared[5:60] + around[2], around[0][-30:] + shared + around[2], shared + shared,
    ]
    frame = spark.createDataFrame([(i * 3, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(map(tuple, substrings.deduplicated(frame).drop("kept_text").collect()), key=str) == slow_removal(frame.collect(), 50)


def test_automaton_matching():
    rng = np.random.default_rng(6)
    reference, asked = list(rng.integers(0, 3, 60)), list(rng.integers(0, 3, 200))
    runs = {tuple(reference[i:j]) for i in range(60) for j in range(i + 1, 61)}
    want = [max((n for n in range(1, i + 2) if tuple(asked[i + 1 - n : i + 1]) in runs), default=0) for i in range(200)]
    assert list(substrings.SuffixAutomaton(reference).matching(asked)) == want


def test_lattice_sums_all_segmentations():
    own = lattice.Lattice([b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba"], {0: 5, 1: 7, 2: 3, 3: 2, 4: 9, 6: 1}, 4)
    text = b" ababa"
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        parts = [text[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in own.score for p in parts):
            total += 10 ** sum(own.score[p] for p in parts)
    assert math.isclose(own.word(text[1:]), math.log10(total), rel_tol=1e-12)
    assert math.isclose(sum(10**s for s in own.score.values()) + 10**own.end, 1)


def test_scores(docs, edges, nothing):
    for frame in (docs, edges):
        rows = frame.collect()
        training, ends = Counter(), 0
        for r in rows:
            if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
                training.update(lattice.words_of(r.text))
                ends += 1
        n, v = training.total() + ends, len(training) + 1
        ids = {b: i for i, b in enumerate(lattice.piece_bytes("byte_bpe_50k.json"))}
        counts = Counter()
        for w, c in training.items():
            for i in lattice.encoder("byte_bpe_50k.json").ids(" " + w.decode()):
                counts[i] += c
        own = lattice.Lattice(list(ids), counts, ends)
        want = []
        for r in rows:
            words = lattice.words_of(r.text)
            base = sum(math.log10((training[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
            score = sum(map(own.word, words)) + own.end
            held = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2
            want.append((r.doc_id, held, len(words) + 1, sum(training[w] > 0 for w in words) + 1, n, round(base, 4), round(score, 4)))
        got = [(*tuple(r)[:5], round(r.base_score, 4), round(r.score, 4)) for r in lattice.scores(frame).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert lattice.scores(nothing).count() == 0


def test_hot_words_change_nothing(edges, monkeypatch):
    whole = sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6), r.n_known) for r in lattice.scores(edges).collect())
    monkeypatch.setattr(lattice, "HOT", 1)
    assert whole == sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6), r.n_known) for r in lattice.scores(edges).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>ad</p> --><div class="ad">Buy</div><article><h1>Head &amp; line</h1>
<p><b>First   part<br><p>Second&nbsp;part &lt;3 <script>no()</script>goes on</p><aside>side</aside><form>field</form>
<section id="comments"><p>Reader says</section></article><footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    assert pages.parse(PAGE).text() == "Head & line\nFirst part\nSecond part <3 goes on"
    assert pages.parse("").text() == "" and pages.parse("<p").text() == ""
    assert pages.parse("<article>a <p class='notice'>n <p>b</article>").text() == "a\nb"
    assert pages.parse("<main><div class=cookie-bar>c<div>d</div></div>x &#233;</main>").text() == "x é"
    assert pages.parse('<article>Story here.</article><div id="comments"><article class="comment-body"><p>Reader says hi</article></div>').text() == "Story here."
    assert pages.parse('<article><p>Story<div id="comments"><article class="comment-body"><p>Reader says hi at great length</article></div></article>').text() == "Story"
    assert pages.parse('<article>A</article><article class="comment"><p>Reader</p></article>').text() == "A"
    assert pages.parse('<div>x y</div><aside class="related"><article class="card"><p>Other teaser</article></aside>').text() == ""
    assert pages.parse('<aside class="related"><article class="card"><p>Other teaser</article></aside><main>M</main>').text() == "M"
    assert pages.parse('<main><p>a</p><div class="post-content share-friendly"><p>Body of text</div></main>').text() == "a\nBody of text"
    assert pages.parse('<main><p>a</p><div class="share-box"><p>Body of a long text</div><div class=share>tell</div></main>').text() == "a\nBody of a long text"
    assert pages.parse('<main><p>a long text of it</p><div class="share-box"><p>tell</div></main>').text() == "a long text of it"
    assert pages.parse('<div class="layout sidebar"><nav>n</nav><main>M<div class=sidebar>s</div></main></div>').text() == "M"
    assert pages.parse('<div class="has-sidebar no-ads"><main>M</main></div>').text() == "M"
    assert pages.parse("<nav>menu<article>M</article>").text() == "M" and pages.parse("<nav>menu<article>M</article></nav>").text() == ""
    assert pages.host_of("HTTPS://u:p@Www.Ex.org:80/a?b") == "www.ex.org" and pages.host_of(None) == ""


def test_host_boilerplate_of_unmarked_pages(spark):
    banner = " ".join(f"standing{i}" for i in range(12))
    page = lambda own: f"<body><div>{banner}</div><div>{own}</div><div>short tail</div></body>"
    rows = [
        (1, "http://a.org/1", page("one own text of the first page"), 1), (2, "http://a.org/2", page("another text for page two"), 2),
        (3, "http://b.org/1", page("only page of its host"), 3), (4, "http://b.org/1", page("only page of its host"), 3), (5, None, None, None),
        (6, "http://a.org/3", PAGE, 0), (7, "http://a.org/4", f"<article>{banner}</article>", 0), (None, "", "", 0),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {r.page_id: r.text for r in pages.main_text(frame).collect()}
    assert got[1] == "one own text of the first page\nshort tail" and got[2] == "another text for page two\nshort tail"
    assert got[3] == got[4] == f"{banner}\nonly page of its host\nshort tail"  # copies are one page
    assert got[5] == got[None] == "" and got[7] == banner
    assert all(r.n_chars == len(r.text) for r in pages.main_text(frame).collect())
    assert pages.main_text(frame.limit(0)).count() == 0


def test_suffix_order_of_hosts(spark):
    """The order of all suffixes against a plain suffix array of each host; ranges, copies and long tokens change nothing."""
    rng = np.random.default_rng(7)
    words = [b"a", b"b", "é".encode(), b"x" * 90, b"x" * 91]
    streams = [(f"h{i % 3}", [words[w] for w in rng.integers(0, 5, rng.integers(0, 60))]) for i in range(60)]
    shared = [words[w] for w in rng.integers(0, 5, 40)]
    streams += [(f"h{i % 3}", streams[i][1][:5] + shared[i : i + 30]) for i in range(9)] + streams[:10]
    rows = [(h, hash(tuple(t)) % 2**60, b" ".join(t)) for h, t in streams]
    frame = spark.createDataFrame(rows, "host string, page long, outside binary").repartition(4)
    for long in (4, 13):
        want = set()
        for host in ("h0", "h1", "h2"):
            own = {tuple(pages.short_tokens(t)) for h, t in streams if h == host}
            order = sorted((t[i:], t) for t in own for i in range(len(t)))
            for (one, p), (other, q) in itertools.combinations(order, 2):
                if p != q and len(one) >= long and one[:long] == other[:long]:
                    want.add((host, int(pages.long_runs(list(one[:long]), long)[0])))
        got = [tuple(r) for r in pages.repeated_runs(frame, long).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        for part in pages.ordered_suffixes(frame, long).rdd.glom().collect():
            keys = [(r.host, r.suffix.encode()) for r in part]
            assert keys == sorted(set(keys))


def test_articles_of_all_pages(spark, sf):
    frame = spark.read.parquet(f"{sf}/pages.parquet")
    for r in pages.main_text(frame).join(frame.select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub("<[^>]*>", " ", inside)
        assert r.text.split() == __import__("html").unescape(plain).split()
