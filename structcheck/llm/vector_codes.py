"""Product codes of vectors: integer codebooks by rounds of means, entries found by annular norm pruning.

Components become integers and vectors are cut into equal parts, each of which is coded by an entry of its position's
codebook. Entries are sorted by norm. The entry whose norm is nearest gives a first distance; by the triangle inequality
no entry whose norm differs from the part's by more can be nearer, so a binary search finds the annulus that this
distance allows, and only its entries are evaluated, exactly, both edges included.

A codebook is bounded (`parts` x `entries` x width numbers) and is all that the driver holds. A round is one pass over
the vectors that adds up counts and sums within tasks; what is shuffled is one codebook a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite, matrix, written

#: Up to so many labels, sums are joined by a broadcast; beyond, by a shuffle that splits frequent labels.
BROADCAST_LABELS = 200_000


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """The greatest integers not above `scale` times each component."""
    return np.floor(x.astype(np.float64) * scale).astype(np.int64)


def largest(width: int) -> int:
    """The magnitude up to which scaled components give distances and products that fit 63 bits."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2 - 1


class Annuli:
    """The entries of one codebook by norm."""

    def __init__(self, book: np.ndarray):
        squared = (book * book).sum(1)
        self.order = np.argsort(squared, kind="stable")
        self.book, self.norm = book[self.order], np.sqrt(squared[self.order].astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of `x` the index of the nearest entry, the lowest of equally near ones, and the squared distance."""
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        above = np.minimum(np.searchsorted(self.norm, norm), len(self.norm) - 1)
        below = np.maximum(above - 1, 0)
        first = np.where(np.abs(norm - self.norm[below]) < np.abs(self.norm[above] - norm), below, above)
        reach = np.sqrt(((x - self.book[first]) ** 2).sum(1).astype(np.float64))
        reach += 1e-12 * (reach + norm) + 1e-12  # the roots are rounded; a wider annulus is still exact
        low, high = np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")
        n = high - low
        starts = np.cumsum(n) - n
        row = np.repeat(np.arange(len(x)), n)
        entry = np.arange(len(row)) + np.repeat(low - starts, n)
        d = ((x[row] - self.book[entry]) ** 2).sum(1)
        least = np.minimum.reduceat(d, starts)
        return np.minimum.reduceat(np.where(d == least[row], self.order[entry], len(self.norm)), starts), least


def assigned(x: np.ndarray, books: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (rows x parts) and squared distances summed over the parts."""
    width = x.shape[1] // len(books)
    found = [b.nearest(x[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.sum([f[1] for f in found], 0)


def refined(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round: each entry the mean, rounded down, of the parts nearest to it; unused ones stay."""
    parts, entries, width = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)  # bounded: parts x entries x width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = [Annuli(b) for b in shared.value]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if len(b):
                x = integers(matrix(b.column(0), parts * width), scale)
                index, _ = assigned(x, now)
                for p in range(parts):
                    count[p] += np.bincount(index[:, p], minlength=entries)
                    np.add.at(total[p], index[:, p], x[:, p * width : (p + 1) * width])
        used = np.flatnonzero(count.ravel())
        if len(used):
            slot, pos = np.repeat(used, width), np.tile(np.arange(width), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(pos), pa.array(np.repeat(count.ravel()[used], width)), pa.array(total.reshape(-1, width)[used].ravel())], ["slot", "pos", "n", "total"])

    partial = kept.select("v").mapInArrow(run, "slot long, pos long, n long, total long")
    sums = partial.groupBy("slot", "pos").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = books.reshape(-1, width).copy()
    for r in sums.collect():  # one row for each number of the codebooks
        out[r["slot"], r["pos"]] = int(r["total"]) // int(r["n"])
    shared.unpersist()
    return out.reshape(books.shape)


def encode(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> DataFrame:
    """Codes of vectors: id, code (two hex digits for each part), error, label_error, codebooks_sha256.

    A component x counts as floor(`scale` * x). Codebooks start as the parts of the `entries` smallest ids (ids that repeat
    by vector, null ids last) and take `rounds` rounds of `refined`. error: squared distances to the entries, over all
    parts; label_error: errors summed over the rows of a label, nulls together, null beyond a long; codebooks_sha256: of
    the final numbers by part, entry and position, comma-joined.

    Vectors that are null or hold null or non-finite components are dropped. The smallest id's vector gives the
    dimension; a vector of another one, or all where it is no multiple of `parts`, and vectors with a component whose
    squares could exceed a long, are returned with null code and error. Repeated rows are coded like others; an empty
    table gives an empty result. Only the three named columns are read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).filter(finite(vector_col="v"))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).select(F.size("v").alias("d")).collect()
    width = first[0]["d"] if first else 0
    fits = F.size("v") == width
    if not width or width % parts:
        fits = F.lit(False)
    fits &= F.forall("v", lambda x: F.abs(x) * scale < largest(width))
    kept, kind = rows.filter(fits), rows.schema["id"].dataType.simpleString()
    seeds = kept.orderBy(*order).limit(entries).select("v").collect()
    null = rows.filter(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not seeds:
        return null.select(F.col("id").alias(id_col), "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    start = integers(np.array([r["v"] for r in seeds]), scale)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refined(kept, books, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = kept.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = [Annuli(b) for b in shared.value]
        for b in batches:
            if len(b):
                index, error = assigned(integers(matrix(b.column(2), width), scale), now)
                codes = np.ascontiguousarray(digits[index]).view(f"<U{2 * parts}").ravel()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes.tolist(), pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    coded = written(kept.select("id", "label", "v").mapInArrow(run, f"id {kind}, label {label}, code string, error long"), "codes")
    sums = written(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "labels").withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    out = coded.unionByName(null).join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
