"""Exact removal of repeated word runs by suffix automata of reference documents.

A window is ``size`` consecutive words of one document. A window is removed where its words also start in a document
with a smaller doc_id. Comparing all documents with all automata would grow with the square of the input, so documents
meet only where they can match:

1. *Anchors.* In every window the ``ANCHOR``-word run with the least hash is its anchor: equal windows have equal
   anchors, and a text has about one anchor per 20 words. The owner of an anchor is the smallest doc_id that has it,
   found by one aggregation that combines before its shuffle. Only anchors that a larger document shares matter.
2. *Reference shards.* A document's windows go to the owners of their anchors; neighbouring windows of one owner go as
   one run of words. Each owner's text is a reference shard: its suffix automaton is built in the task to which the run
   is dealt, and the run is streamed through it for matching statistics. Where the match is at least a window long, the
   window is the owner's too. A shard is one document, so its size is bounded, and the runs of a hot owner can be spread
   over tasks without limit.
3. *The rest.* A window that has the owner's anchor but goes beyond what the owner shares can still equal a window of a
   third document; there too it is a rest, of the same owner. Rests are compared by a 128-bit hash of the window: the
   least doc_id of each hash, again combined before the shuffle.

The removed windows of a document are then joined to its text once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, ANCHOR = 50, 10
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    """XXH64 of each word; equal words are hashed once."""
    seen: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    for w in words:
        if w not in seen:
            seen[w] = digest(w, seed)
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, as a polynomial of the words' hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(words: list[bytes], size: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor hash of each window, in order."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    grams = run_hashes(word_hashes(words, 7), anchor)
    least, width, reach = grams, 1, size - anchor + 1
    while width < reach:  # minima over powers of two, then the two that overlap
        step = min(width, reach - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least.view(np.int64)


class SuffixAutomaton:
    """Suffix automaton of a word sequence."""

    def __init__(self, sequence: list):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        following, link, length = self.next, self.link, self.length
        for symbol in sequence:
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and symbol not in following[p]:
                following[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = following[p][symbol]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(following)
                    following.append(following[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and following[p].get(symbol) == q:
                        following[p][symbol] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

    def matching(self, sequence: list) -> Iterator[int]:
        """For each place: the length of the longest run ending there that the automaton's sequence contains."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            if (to := following[state].get(symbol)) is not None:
                state, matched = to, matched + 1
            else:
                matched = 0
            yield matched


def _spans(starts: np.ndarray) -> list[int]:
    """Window starts in order as a flat list of (first, last) of gapless stretches."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)]], 1).ravel().tolist()


def _inside(words: list[bytes], spans: list[int], size: int) -> np.ndarray:
    """Which words the windows starting in the (first, last) stretches cover."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, spans[::2], 1)
    np.add.at(edge, np.array(spans[1::2]) + size, -1)
    return edge.cumsum()[:-1] > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, copy (MD5 of the text), n_words, kept_sha256 (of all words) and the anchors of each row."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, digest, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = text.encode().split()
                count.append(len(words))
                digest.append(_digest(words))
                found.append(np.unique(anchors(words, size)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "copy", "n_words", "kept_sha256", "anchors"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(profile, f"doc_id {kind}, copy string, n_words long, kept_sha256 string, anchors array<long>")


def _runs(shared: DataFrame, kind: str, size: int) -> DataFrame:
    """(doc_id, copy, owner, first, words): the runs of windows that go to one owner."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners, firsts, texts = [], [], [], []
            own = zip(*(batch.column(i).to_pylist() for i in (2, 3)))
            for row, (text, table) in enumerate(own):
                words = text.encode().split()
                of = {x["anchor"]: x["owner"] for x in table}
                owner = [of.get(a) for a in anchors(words, size).tolist()]
                at = 0
                while at < len(owner):
                    to = at + 1
                    while to < len(owner) and owner[to] == owner[at]:
                        to += 1
                    if owner[at] is not None:
                        rows.append(row)
                        owners.append(owner[at])
                        firsts.append(at)
                        texts.append(b" ".join(words[at : to + size - 1]).decode())
                    at = to
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(owners, batch.schema.field(0).type), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "copy", "owner", "first", "words"])

    return shared.select("doc_id", "copy", "text", "table").mapInArrow(cut, f"doc_id {kind}, copy string, owner {kind}, first long, words string")


def _matched(dealt: DataFrame, kind: str, size: int) -> DataFrame:
    """(doc_id, copy, spans, rest): windows that the owner has, and hashes of those that it has not."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: tuple = (None, None)
        for batch in batches:
            spans, rests = [], []
            for owner, reference, first, run in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                words = run.encode().split()
                if built[0] != (owner, reference):
                    built = ((owner, reference), SuffixAutomaton((reference or "").encode().split()))
                length = np.fromiter(built[1].matching(words), np.int64, len(words))[size - 1 :]
                spans.append(_spans(first + np.flatnonzero(length >= size)))
                left = np.flatnonzero(length < size)
                pair = [run_hashes(word_hashes(words, seed), size)[left].view(np.int64).tolist() for seed in (1, 2)] if len(left) else [[], []]
                rests.append([{"at": first + int(i), "h": h, "k": k} for i, h, k in zip(left, *pair)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(rests, pa.list_(pa.struct([("at", pa.int64()), ("h", pa.int64()), ("k", pa.int64())])))],
                ["doc_id", "copy", "spans", "rest"],
            )

    return dealt.select("doc_id", "copy", "owner", "reference", "first", "words").mapInArrow(match, f"doc_id {kind}, copy string, spans array<long>, rest array<struct<at long, h long, k long>>")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, copy and text of every row; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.md5(text).alias("copy"), text.alias("text"))


def removed_windows(docs: DataFrame, rows: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The texts that share anchors, and (doc_id, copy, spans): the starts of their removed windows, as stretches.

    ``rows`` is the stored profile of ``docs``; ``copy`` tells texts of one doc_id apart.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    pairs = rows.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode("anchors").alias("anchor"))
    owners = pairs.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("largest")).where("owner < largest").select("anchor", "owner")
    shared = pairs.join(stored(owners, "owners"), "anchor").where("owner < doc_id")
    shared = stored(shared.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "owner")).alias("table")), "shared")
    ids = shared.select("doc_id").unionByName(shared.select(F.explode("table.owner").alias("doc_id"))).distinct()
    text = stored(_texts(docs).join(ids, "doc_id", "left_semi"), "texts")
    runs = stored(_runs(text.join(shared, "doc_id"), kind, size), "runs")
    owned = text.join(runs.select(F.col("owner").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # Stored, so that the join below shuffles both sides and the runs of a hot owner can be split among tasks.
    references = stored(owned.select(F.col("doc_id").alias("owner"), F.col("text").alias("reference")), "references")
    matched = stored(_matched(runs.join(references, "owner"), kind, size), "matched")
    rest = matched.select("doc_id", "copy", F.explode("rest").alias("r")).select("doc_id", "copy", "r.*")
    first = rest.groupBy("h", "k").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("largest")).where("least < largest").select("h", "k", "least")
    more = rest.join(first, ["h", "k"]).where("least < doc_id").groupBy("doc_id", "copy").agg(F.collect_set("at").alias("at"))
    stretches = more.select("doc_id", "copy", F.flatten(F.transform("at", lambda a: F.array(a, a))).alias("spans"))
    spans = matched.where(F.size("spans") > 0).select("doc_id", "copy", "spans").unionByName(stretches)
    return text, spans.groupBy("doc_id", "copy").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def deduplicated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words; null where nothing goes).

    Null and empty texts have no words. A null doc_id is in no order: such rows neither lose words nor take any from
    others. Rows of one doc_id don't take words from each other; repeated rows stay rows of their own. Other columns
    are ignored whatever their names; an empty table gives an empty table.
    """
    rows = stored(_profile(_texts(docs), size), "profile")
    text, gone = removed_windows(docs, rows, size)
    gone = stored(gone, "removed")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept = [], [], [], []
            for given, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = given.encode().split()
                left = [w for w, out in zip(words, _inside(words, spans, size)) if not out]
                total.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(_digest(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    changed = text.join(gone, ["doc_id", "copy"]).select("doc_id", "text", "spans").mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    same = rows.join(gone, ["doc_id", "copy"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return same.unionByName(changed)
