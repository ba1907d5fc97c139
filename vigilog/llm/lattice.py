"""Language-model scores by subword lattices: the probability of a text over all its segmentations.

The pieces are those of an existing vocabulary; their unigram scores are learned from the training documents (counts of
the pieces in the training words, smoothed). A text is its words, each with a space before it, and one end. Its
probability is the sum over all ways to cut it into pieces of the product of their scores, by a forward recursion in log
space. No piece has a space inside, so the recursion factors at word starts: a word's value is computed once, in the
table of words, and a text's score is the sum over its words and the end.

The table of words grows with the corpus and is never broadcast. Words that make up at least 1 / ``HOT`` of all training
tokens are; there can be at most ``HOT`` of them, whatever the corpus, and words of over ``HOT_BYTES`` bytes are not among
them. Each task adds up the frequent words of a document at once; only the others meet the table in a join, from which
the frequent, skewed keys are thereby gone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .token_counts import encoder

_LN10 = math.log(10)
HOT, HOT_BYTES = 1 << 18, 64
#: Added to the count of each piece.
SMOOTHING = 0.1
#: Distinct words a task counts before it hands them on.
COUNTER_WORDS = 200_000


def held_out() -> Column:
    """Documents that are scored but not learned from; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return (text or "").encode().lower().split()


def word_table(docs: DataFrame) -> DataFrame:
    """(word, c) for every word of all documents; c counts training documents only, so it may be 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            learned, other = seen
            words = [*learned, *(w for w in other if w not in learned)]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([learned[w] for w in words], pa.int64())], ["word", "c"])
            learned.clear()
            other.clear()
            return out

        for batch in batches:
            for text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[out].update(words_of(text))
            if len(seen[0]) + len(seen[1]) > COUNTER_WORDS:
                yield rows()
        yield rows()

    counted = docs.select("text", held_out().alias("out")).mapInArrow(count, "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def piece_bytes(vocabulary: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary, by id."""
    own = encoder(vocabulary).tokenizer
    # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    names = [own.id_to_token(i) for i in range(own.get_vocab_size())]
    return [b"" if n in special else bytes(letter[c] for c in n) for n in names]


def piece_counts(words: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, n): how often each piece occurs in the training words, at most one row a piece of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = encoder(vocabulary), Counter()
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in own.ids(" " + word):
                    total[piece] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["piece", "n"])

    return words.where("c > 0").select("word", "c").mapInArrow(count, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Log10 scores of pieces, and of all segmentations of a word together."""

    def __init__(self, pieces: list[bytes], counts: dict[int, int], ends: int, smoothing: float = SMOOTHING):
        usable = {p: counts.get(i, 0) for i, p in enumerate(pieces) if p and b" " not in p[1:]}
        total = math.log10(sum(usable.values()) + ends + smoothing * (len(usable) + 1))
        self.score = {p: math.log10(n + smoothing) - total for p, n in usable.items()}
        self.natural = {p: s * _LN10 for p, s in self.score.items()}
        self.end = math.log10(ends + smoothing) - total
        self.longest = max(map(len, self.score), default=1)

    def word(self, word: bytes) -> float:
        """Log10 of the summed probability of all segmentations of a space and the word."""
        return next(self.words([word]))

    def words(self, words: Iterable[bytes]) -> Iterator[float]:
        """The value of each word. Words that begin like the one before share its recursion so far: sort them."""
        known, longest, log, exp = self.natural, self.longest, math.log, math.exp
        before, forward = b"", [0.0]
        for word in words:
            text = b" " + word
            del forward[len(commonprefix((before, text))) + 1 :]
            for end in range(len(forward), len(text) + 1):
                paths = [forward[at] + known[p] for at in range(max(0, end - longest), end) if (p := text[at:end]) in known]
                best = max(paths)
                forward.append(best if len(paths) == 1 else best + log(sum([exp(x - best) for x in paths])))
            before = text
            yield forward[-1] / _LN10


def scored_words(words: DataFrame, lattice: Lattice, size: float) -> DataFrame:
    """word, c, base and value (log10 by the add-one base and by the lattice) of every word."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = list(lattice.words(w.encode() for w in batch.column(0).to_pylist()))
            base = np.log10((batch.column(1).to_numpy() + 1) / size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(value, pa.float64())], ["word", "c", "base", "value"])

    return words.select("word", "c").sortWithinPartitions("word").mapInArrow(score, "word string, c long, base double, value double")


def scores(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row a row of ``docs``.

    Null and empty texts are the end alone. A null doc_id counts as the empty text when documents are dealt to learning.
    Repeated rows and doc_ids are learned from and scored row by row; whole texts are read. Other columns are ignored
    whatever their names; an empty table gives an empty table.
    """
    words = stored(word_table(docs), "words")
    ends = docs.where(~held_out()).count()
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = n + ends, v + (ends > 0)
    size = n + 1 * (v + 1)
    lattice = Lattice(piece_bytes(vocabulary), {r[0]: r[1] for r in piece_counts(words, vocabulary).collect()}, ends)
    table = stored(scored_words(words, lattice, size), "scored-words")
    least = max(1, -(-n // HOT))
    hot = {r[0].encode(): (r[1], r[2]) for r in table.where((F.col("c") >= least) & (F.octet_length("word") <= HOT_BYTES)).select("word", "base", "value").collect()}
    end_base, end_value = math.log10((ends + 1) / size), lattice.end

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, known, base, value, rest, times = [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                own = Counter(words_of(text))
                tokens.append(own.total() + 1)
                frequent = [(c, *hot[w]) for w, c in own.items() if w in hot]
                other = [w for w in own if w not in hot]
                known.append(sum(c for c, _, _ in frequent) + (ends > 0))
                base.append(math.fsum(c * b for c, b, _ in frequent) + end_base)
                value.append(math.fsum(c * x for c, _, x in frequent) + end_value)
                rest.append([w.decode() for w in other])
                times.append([own[w] for w in other])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base_part", "value_part", "word", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    rows = stored(rows.mapInArrow(add_up, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base_part double, value_part double, word array<string>, times array<int>"), "sums")
    pairs = rows.select("row", F.explode(F.arrays_zip("word", "times")).alias("p")).select("row", "p.word", "p.times")
    others = pairs.join(table, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n"), F.sum(F.col("times") * F.col("base")).alias("b"), F.sum(F.col("times") * F.col("value")).alias("s")
    )
    zero = F.lit(0)
    return rows.drop("word", "times").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.coalesce("b", zero)).alias("base_score"), (F.col("value_part") + F.coalesce("s", zero)).alias("score"),
    )
