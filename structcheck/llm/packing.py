"""Harmonic packing of tokenized documents into sequences.

A document's ids and a closing id are cut into pieces. A piece of length L belongs to class ``floor(capacity / L)``: the
reciprocal-capacity class k holds the lengths above capacity/(k+1) up to capacity/k, and a bin of class k takes exactly
k pieces, whatever other classes hold. Each worker fills its bins by itself, in one pass over its rows; nothing is
shuffled. What would leave more than `waste` of a bin empty is cut: its head gets the greatest length of the next
class, and its short tail goes on. Bins still open at the end of a worker's rows (fewer pieces than k in each class, so
a bounded number) are filled together, longest piece first.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common  # noqa: F401  workers need no copy of this module

#: The split pattern of the byte-level vocabulary, and one that splits texts without two white spaces in a row alike
#: but needs no look-ahead, which makes it twice as fast.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
END_OF_TEXT = "<|endoftext|>"
LONG_RUN = 1000


def piece_lengths(n: int, capacity: int, waste: float = 0.03, least: int = 16) -> list[int]:
    """The lengths into which a document of `n` ids is cut, in order: full pieces, then what suits the classes."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > 0:
        k = capacity // n
        if n <= least or k * n >= capacity * (1 - waste):
            out.append(n)
            break
        head = capacity // (k + 1)
        out.append(head)
        n -= head
    return out


class Bins:
    """The open bins of one worker. A row is a piece: (doc, start, length, crc32, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next, self.open = capacity, first_id, {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at, n = 0, self.next
        self.next += 1
        for p in pieces:
            yield (*p, n, at)
            at += p[2]

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            yield from self._close(self.open.pop(k))

    def flush(self) -> Iterator[tuple]:
        bins: list[list[tuple]] = []
        room: list[tuple[int, int]] = []  # free ids and bin, ascending
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            i = bisect.bisect_left(room, (p[2], -1))
            if i < len(room):
                free, b = room.pop(i)
                bins[b].append(p)
            else:
                free, b = self.capacity, len(bins)
                bins.append([p])
            bisect.insort(room, (free - p[2], b))
        self.open = {}
        for held in bins:
            yield from self._close(held)


class Encoder:
    """Ids of a tokenizer file.

    With the same vocabulary as ranks, texts are encoded from these, which takes an eighth of the time; texts with a run
    of LONG_RUN or more white spaces, on which that library's look-ahead runs out of stack, go by the tokenizer file.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.full = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {END_OF_TEXT: len(ranks)}
            self.full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.single = tiktoken.Encoding("single", pat_str=PATTERN_SINGLE, mergeable_ranks=ranks, special_tokens=special)
            self.runs = re.compile(r"\s\s").search
            self.long_runs = re.compile(rf"\s{{{LONG_RUN}}}").search

    def __call__(self, text: str) -> list[int]:
        if self.full is None:
            return self.whole.encode(text, add_special_tokens=False).ids
        run = self.runs(text)
        if run and self.long_runs(text, run.start()):
            return self.whole.encode(text, add_special_tokens=False).ids
        if END_OF_TEXT in text:
            return self.full.encode(text, allowed_special="all")
        return (self.full if run else self.single).encode_ordinary(text)


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs every document; one row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer_path`: a tokenizer file, `ranks_path`: its vocabulary as ranks, see `Encoder`; both lie at the same place on
    each worker. Sequence ids are unique, not gapless: they
    count on from a number that each worker has for itself. A null text is an empty one and takes the closing id
    alone; null ids and repeated rows are packed like others; an empty table gives no sequences. Only the two named
    columns are read, so others cannot clash. Pieces of equal length share bins in the order of the rows. A worker holds
    the open bins and one document's ids at a time, whatever the length of its text.
    """
    name = "i"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = Encoder(tokenizer_path, ranks_path), Bins(capacity, TaskContext.get().partitionId() << 40)
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], [name, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        rows: list[tuple] = []
        for b in batches:
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                at = 0
                for n in piece_lengths(len(ids), capacity):
                    rows += bins.add((doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
                    at += n
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
        rows += bins.flush()
        if rows:
            yield batch(rows)

    given = docs.select(F.col(id_col).alias(name), F.col(text_col).alias("t"))
    kind = given.schema[name].dataType.simpleString()
    return given.mapInArrow(run, f"{name} {kind}, {SCHEMA}").withColumnRenamed(name, id_col)
