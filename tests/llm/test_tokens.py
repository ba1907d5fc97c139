import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vigilog.llm import packing, token_counts
from vigilog.llm.common import vocabulary_path


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(vocabulary_path())
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(plain):
    rng = random.Random(5)
    letters = " \n\t\x1c abcdeé'stß19.,<|>-日語　 ’ǅ"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(80))) + rng.choice(["", "<|endoftext|>", " it's 12 "])
        assert token_counts.encoder("byte_bpe_50k.json").ids(text) == plain(text)


def test_long_documents_are_spliced(plain, docs):
    """Documents over a chunk are counted from spliced chunks, and equal the whole."""
    long = docs.where(f"length(text) > {token_counts.CHUNK}").collect()
    own = token_counts.encoder("byte_bpe_50k.json")
    assert long
    for r in long:
        assert own.ids(r.text) == own.spliced(r.text) == plain(r.text)


@pytest.mark.parametrize("chunk, overlap", [(20, 2), (50, 8), (7, 1)])
def test_spliced_chunks_equal_the_whole(plain, chunk, overlap):
    rng = random.Random(chunk)
    own = token_counts.Encoder(vocabulary_path(), chunk, overlap)
    for _ in range(300):
        text = "".join(rng.choice(" ab'c\n 1日<|endoftext|>") for _ in range(rng.randrange(400)))
        assert own.ids(text) == plain(text)
    assert own.ids("x" * 5_000 + " y") == plain("x" * 5_000 + " y")  # no stable place: the overlap widens to the end


def test_token_counts(edges, nothing, plain):
    got = sorted((r.asDict() for r in token_counts.token_counts(edges, limit=100).collect()), key=str)
    want = sorted(
        ({"doc_id": r.doc_id, "n_bytes": len((r.text or "").encode()), "n_tokens": len(plain(r.text)), "over_limit": len(plain(r.text)) > 100} for r in edges.collect()), key=str
    )
    assert got == want
    assert token_counts.token_counts(nothing).count() == 0


def check_packing(rows, texts, plain, size=2048):
    """Every id of every document in one piece, sequences gapless and within the size."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*plain(texts[doc]), 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size


def test_packing_keeps_all_ids(docs, plain):
    rows = packing.packed(docs).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, plain)
    tokens, windows = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert windows <= tokens / 2048 * 1.05 + 3


def test_packing_edges(edges, nothing):
    rows = packing.packed(edges).collect()
    ends = [(r.start, r.length) for r in rows if r.doc_id in (4, 5)]
    assert ends == [(0, 1)] * 3
    assert sum(r.doc_id is None for r in rows) == 2
    assert packing.packed(nothing).count() == 0


def test_level_array_takes_the_least_sum_of_squares():
    rng = random.Random(2)
    levels, windows = packing.LevelArray(16), {}
    for _ in range(500):
        length = rng.randrange(1, 17)
        before = levels.counts[1:16].copy()

        def after(level):
            c = before.copy()
            if level:
                c[level - 1] -= 1
            if level + length < 16:
                c[level + length - 1] += 1
            return int((c**2).sum())

        options = [0, *(h for h in range(1, 17 - length) if before[h - 1])]
        window, level = levels.place(length)
        assert windows.get(window, 0) == level and after(level) == min(map(after, options))
        windows[window] = level + length
