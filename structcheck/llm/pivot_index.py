"""Near-duplicate vectors by a pivot-permutation index.

Some vectors of the table serve as pivots; every vector is described by its nearest pivots in order. Inverted lists hold
the vectors that have two pivots both among their nearest, so that two vectors meet where they share two pivots or
more; each pair is counted in the list of its two smallest shared pivots alone and verified by its cosine in double
precision. Vectors equal in all components are one class and take part once, with their number.

The number of pivots grows with the root of the number of classes up to a bound, since with more pivots two vectors of
one cosine share fewer of their nearest. Beyond it lists grow with the table; long lists are cut into blocks and each
pair of blocks is a task of its own, so none is capped. The index is a filter: links between vectors that share fewer
than two pivots are not found; recall is measured by tests, also with as many pivots as the largest table has.
Vectors of each dimension are compared among themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import schema_with, written
from .components import components


def usable(column: str, dimension: int | None = None):
    """Whether a vector can have a cosine: components all finite, one not zero, and of the table's dimension."""
    c = F.col(column)
    ok = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(ok if dimension is None else ok & (F.size(c) == dimension), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row in order, ties to the smaller pivot."""
    out = np.empty((len(x), k), dtype=np.int32)
    for at in range(0, len(x), 1024):
        sims = unit(x[at : at + 1024]) @ pivots.T
        out[at : at + 1024] = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def describe(classes: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """node, copies, v and its nearest pivots."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # the pivots, whose number is bounded
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = nearest(matrix(b.column(2), width), shared.value, k)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], ["node", "copies", "v", "near"])

    given = classes.select("node", "copies", "v")
    return given.mapInArrow(run, schema_with(given, near=ArrayType(IntegerType())))


def compare(rows: DataFrame, width: int, k: int, count: int, cosine: float) -> DataFrame:
    """Links within tiles: node, links (copies included), root (the least node that the tile's links reach)."""
    given = rows.select("pair", "lo", "hi", "block", "node", "copies", "v", "near").repartition("pair", "lo", "hi").sortWithinPartitions("pair", "lo", "hi")

    def tile(pair: int, a: list[np.ndarray], b: list[np.ndarray], same: bool):
        (na, ca, va, pa_), (nb, cb, vb, pb) = a, b
        linked = unit(va) @ unit(vb).T >= cosine
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        q = pair % count
        vocabulary = np.unique(np.concatenate([pa_[pa_ < q], pb[pb < q]]))

        def below(p: np.ndarray) -> np.ndarray:
            return (p[:, :, None] == vocabulary).any(1).astype(np.float32)

        linked &= below(pa_) @ below(pb).T < 1.5
        labels_a, labels_b = na.copy(), nb.copy() if not same else None
        top = np.iinfo(np.int64).max
        while True:
            other = labels_a if same else labels_b
            new_a = np.minimum(labels_a, np.where(linked, other[None, :], top).min(1))
            if same:
                if (new_a == labels_a).all():
                    return [(na, linked @ cb, labels_a)]
            else:
                new_b = np.minimum(labels_b, np.where(linked.T, new_a[None, :], top).min(1))
                if (new_a == labels_a).all() and (new_b == labels_b).all():
                    return [(na, linked @ cb, labels_a), (nb, linked.T @ ca, labels_b)]
                labels_b = new_b
            labels_a = new_a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "links", "root"]
        held: list[np.ndarray] | None = None

        def done(cols: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = []
            for p, q in zip(starts, starts[1:]):
                if q - p > 1:
                    block, lo, hi = cols[3][p:q], cols[1][p], cols[2][p]
                    sides = [[c[p:q][block == x] for c in cols[4:]] for x in ((lo,) if lo == hi else (lo, hi))]
                    if all(len(s[0]) for s in sides):
                        found += tile(int(cols[0][p]), sides[0], sides[-1], lo == hi) or []
            if found:
                node, links, root = (np.concatenate(x) for x in zip(*found))
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names)

        for b in batches:
            if not len(b):
                continue
            cols = [*(b.column(i).to_numpy() for i in range(6)), matrix(b.column(6), width), matrix(b.column(7), k)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            last = int(change[-1]) if len(change) else 0
            yield from done(cols, np.concatenate([[0], change]))
            held = [c[last:] for c in cols]
        if held is not None:
            yield from done(held, np.array([0, len(held[0])]))

    return given.mapInArrow(run, "node long, links long, root long")


def pivot_count(many: int, most_pivots: int) -> int:
    """A power of two of at least twice the root of `many`, from 64 up to `most_pivots`; at most `many`."""
    return min(most_pivots, max(64, 1 << math.ceil(math.log2(2 * math.sqrt(many)))), many)


def neighbours(count: int) -> int:
    """Nearest pivots of a vector: one more among more than 512 pivots, which holds recall at cosine 0.9 above 0.9."""
    return 6 if count <= 512 else 7


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, k: int | None = None, block: int = 1024, most_pivots: int = 1024) -> DataFrame:
    """Links vectors of cosine `cosine` or more.

    Returns one row for each row of `vectors`: the id, n_links (other vectors linked directly), component_id (the
    smallest id that links reach, itself included), kept (whether that is its own). A vector that is null, empty or
    zero, or holds null or non-finite components, links with nothing; the others link within their dimension, each
    dimension by an index of its own. Null ids take part and are never the smallest unless all are null. The pivots
    are the usable vectors of least hash, see `pivot_count`; without `k`, `neighbours` says how many describe a vector.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    sizes = rows.filter(usable("v")).groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # one row for each dimension
    several = [r["d"] for r in sizes if r["count"] > 1]
    good = usable("v") & F.size("v").isin(several) if several else F.lit(False)
    out = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for width in several:
        out = out.unionByName(_of_width(rows.filter(usable("v", width)), width, cosine, k, block, most_pivots))
    return _shaped(out, id_col)


def _of_width(good: DataFrame, width: int, cosine: float, k: int | None, block: int, most_pivots: int) -> DataFrame:
    """id, n_links, component_id of usable vectors of one dimension."""
    classes = written(good.groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "classes")
    many = classes.count()
    count = pivot_count(many, most_pivots)
    k = min(k or neighbours(count), count)
    if count < 2:
        counted = classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root"))
    else:
        picked = classes.orderBy(F.xxhash64("v"), "node").limit(count).select("v").collect()  # the pivots
        described = written(describe(classes, unit(np.array([r["v"] for r in picked])), k), "described")
        pairs = F.array(*[F.least(F.col("near")[i], F.col("near")[j]).cast("long") * count + F.greatest(F.col("near")[i], F.col("near")[j]) for i, j in combinations(range(k), 2)])
        listed = described.select("node", F.explode(pairs).alias("pair"))
        sized = listed.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        met = listed.join(sized, "pair").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        met = met.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiled = met.select("pair", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")
        counted = written(compare(tiled.join(described, "node"), width, k, count, cosine), "links")
    linked = counted.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(counted, "node", "root")
    full = classes.join(linked, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = full.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = full.join(smallest, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return good.join(labels, "v").select("id", "n_links", "component_id")


def _shaped(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
