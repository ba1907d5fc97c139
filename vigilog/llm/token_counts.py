"""Exact token counts of whole documents, however long, by resynchronising overlapping chunks.

A cut is *proven stable* where the pre-tokenizer must end one piece and start another whatever stands around: a space
after a character that is no white space. No alternative of the byte-level pattern spans such a place and none looks
over it, and merges never leave a piece. A text longer than ``chunk`` is encoded in overlapping chunks with offsets; two
chunks are spliced at the first stable place inside the overlap at which both show a token boundary. If there is none,
the overlap is doubled, at last to the end of the text. The result equals encoding the whole text at once.

Texts that fit a chunk are encoded whole. If all their characters belong to long settled Latin blocks and no special
string occurs, the rank table of the same vocabulary gives the same ids in less time; other texts, and all that are cut, go
through the tokenizer file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tokenizer, vocabulary_path

#: Characters of one chunk of a long text, and of the first overlap.
CHUNK, OVERLAP = 16_384, 256
#: A space behind a character that no tokenizer takes for white space.
_STABLE_SPACE = re.compile(r"(?<![\s\x1c-\x1f]) ")
#: Outside these blocks the two libraries could class a character by different Unicode versions.
_UNSETTLED = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


def _rank_encoder(path: str):
    """The vocabulary as ranks, if its rank table lies beside the tokenizer file."""
    if not (table := Path(path).with_suffix(".tiktoken")).exists():
        return None
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, table.open("rb"))}
    return tiktoken.Encoding(table.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = tokenizer(path), chunk, overlap
        self.by_rank = _rank_encoder(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        if len(text) > self.chunk:
            return self.spliced(text)
        if self.by_rank and not _UNSETTLED.search(text) and not any(s in text for s in self.special):
            return self.by_rank(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """Ids and the offset in the whole text at which each token starts."""
        got = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return got.ids, [start + a for a, _ in got.offsets]

    def spliced(self, text: str) -> list[int]:
        """Encode overlapping chunks and join them where both agree on a stable boundary."""
        out: list[int] = []
        start, n = 0, len(text)
        while True:
            end, overlap = start + self.chunk, self.overlap
            while True:
                until = min(n, end + overlap)
                left, left_at = self._encoded(text, start, until)
                if until == n:
                    return out + left
                if cut := self._agreed(text, end, until, left_at):
                    break
                overlap *= 2
            out += left[: left_at.index(cut)]
            start = cut

    def _agreed(self, text: str, end: int, until: int, left_at: list[int]) -> int | None:
        """A stable place after ``end`` at which the left chunk and a chunk starting at ``end`` have a boundary."""
        _, right_at = self._encoded(text, end, until)
        common = set(left_at) & set(right_at)
        for found in _STABLE_SPACE.finditer(text, end + 1, until - 1):
            if (at := found.start()) in common:
                return at
        return None


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, chunk: int = CHUNK) -> Encoder:
    """One encoder a worker, vocabulary and size of chunks, loaded once."""
    if (vocabulary, chunk) not in _ENCODERS:
        _ENCODERS[vocabulary, chunk] = Encoder(vocabulary_path(vocabulary), chunk)
    return _ENCODERS[vocabulary, chunk]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text, one row a row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty (0 bytes, 0 tokens). Null and repeated doc_ids and repeated rows stay rows of their own;
    other columns of ``docs`` are ignored whatever their names. An empty table gives an empty table. No shuffle: rows
    are counted where they are read, and a huge text is held once with the ids of its chunks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [len(own.ids(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
