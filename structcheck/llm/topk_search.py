"""Exact top-k search by integer inner product over an impact-ordered index, score at a time.

Vectors of one dimension are dealt evenly into blocks; each block has an index of its own: for every dimension, posting
segments of the documents with one quantised component, in order of that component. For a query the impact of a segment
is its component times the query's, so segments of descending impact lie at one end of each dimension or the other.

A query takes the segments of all dimensions by descending impact, in rounds of falling least impact, and adds each
impact to the scores of the segment's documents. What a document can still gain in a dimension not met yet is below the
round's least impact, which bounds its score from above; the k-th best exact score of the documents that lead so far, or
the bar that an earlier block has set, is a proven lower bound of a member's score. Documents whose bound is below it
are out; the rest are possible members and are scored exactly. A query stops once scoring them costs less than the next
round, so no stop loses a member whatever the round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finite, matrix, written

#: What scoring one component of a possible member costs against adding one posting; both are measured in numpy.
EXACT_COST = 0.25
#: The first round takes impacts from this fraction of the highest one on.
FIRST = 512
#: Components up to this magnitude have a table of segment ends; larger ones are searched for.
TABLED = 1024


class ImpactIndex:
    """The posting segments of one block of integer vectors; `rank` orders documents of equal score."""

    def __init__(self, x: np.ndarray, rank: np.ndarray):
        self.x, self.rank = x, rank
        self.docs = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(x, self.docs.T, 0).T)
        self.peak = int(np.abs(x).max(initial=0))
        self.single, self.double = x.astype(np.float32), x.astype(np.float64)
        self.impacts = self.values.astype(np.float64)
        self.upto = None
        if self.peak <= TABLED:  # postings of a dimension with a component up to the given one, from -peak - 1 to peak
            steps = np.arange(-self.peak - 1, self.peak + 1)
            self.upto = np.stack([np.searchsorted(v, steps, "right") for v in self.values])

    def exact(self, q: np.ndarray, docs: np.ndarray) -> np.ndarray:
        bound = int(np.abs(q).sum()) * self.peak  # of all sums on the way, which a float holds exactly up to its digits
        for digits, x in ((24, self.single), (53, self.double)):
            if bound < 1 << digits:
                return (x[docs] @ q.astype(x.dtype)).astype(np.int64)
        return self.x[docs] @ q

    def ends(self, q: np.ndarray, least: int) -> np.ndarray:
        """For each dimension, how many postings have an impact of `least` (positive) or more, from the end where impacts are high."""
        w = np.where(q == 0, 1, q)
        last = np.where(q > 0, -(-least // w) - 1, least // w)  # impacts are high above it, or for negative q up to it
        if self.upto is not None:
            upto = self.upto[np.arange(len(q)), np.clip(last, -self.peak - 1, self.peak) + self.peak + 1]
        else:
            upto = np.array([np.searchsorted(v, x, "right") for v, x in zip(self.values, last)])
        return np.where(q > 0, len(self.x) - upto, np.where(q < 0, upto, 0))

    def top(self, q: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of highest score but `own`, ties by rank: their places and scores."""
        many, width = self.x.shape
        possible = np.arange(many)
        highest = int(np.abs(q).max(initial=0)) * self.peak
        # A sum holds a score and, in units of `unit`, how many postings gave it. Small blocks, and sums that doubles might
        # round, are scored exactly at once.
        unit = float(1 << (int(np.abs(q).sum()) * self.peak + 1).bit_length())
        if many > 4 * k and highest and unit * (width + 1) < 1 << 53:
            sums = np.zeros(many)
            done, least, bar = np.zeros(width, np.int64), max(1, highest // FIRST), None
            while True:
                ends = self.ends(q, least)
                docs, impacts = [], []
                for d in np.flatnonzero(ends > done):
                    part = slice(many - ends[d], many - done[d]) if q[d] > 0 else slice(done[d], ends[d])
                    docs.append(self.docs[d, part])
                    impacts.append(self.impacts[d, part] * float(q[d]))
                if docs:
                    weights = np.concatenate(impacts)
                    weights += unit
                    sums += np.bincount(np.concatenate(docs), weights, many)
                done = ends
                met = np.floor_divide(sums, unit)
                bound = sums - met * unit + (width - met) * (least - 1)  # impacts that are left are whole numbers below `least`
                lead = np.argpartition(-bound, 4 * k)[: 4 * k]
                lead = lead[lead != own] if own is not None else lead
                reached = np.partition(self.exact(q, lead), -k)[-k]
                bar = reached if bar is None else max(bar, reached)
                possible = np.flatnonzero(bound >= bar)
                if least == 1:
                    break
                least = max(1, least // 2)
                if len(possible) * width * EXACT_COST <= (self.ends(q, least) - done).sum():
                    break
        if own is not None:
            possible = possible[possible != own]
        scores = self.exact(q, possible)
        if len(possible) > k:
            keep = scores >= np.partition(scores, -k)[-k]
            possible, scores = possible[keep], scores[keep]
        order = np.lexsort((self.rank[possible], -scores))[:k]
        return possible[order], scores[order]


def search(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block: int = 16384, slice_rows: int = 1024
) -> DataFrame:
    """For each row for which `queries` holds, the `k` other rows of highest score: query_id, rank (from 1), id, score.

    A component x counts as floor(`scale` * x); the score is the inner product. Ties go to the smaller id, null ids last,
    then to any; all rows, if there are fewer than `k`. The query's own row is left out, another row of its id or
    vector is not. Vectors that are null or empty, or hold null or non-finite components, take no part, nor do those with
    a component so large that a score could exceed a long; vectors are compared within their dimension. An empty table
    or one without queries gives an empty result. `queries` may use any column; of others only the two named are read.

    Blocks of candidates meet slices of queries, and each such tile is a task's work: memory is that of a block, and
    neither a frequent vector nor a large table makes a tile larger.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(finite("v"))
    limit = F.sqrt(F.lit(float(1 << 62)) / F.size("v")) - 2
    rows = rows.filter(F.size("v") > 0).filter(F.forall("v", lambda x: F.abs(x) * scale < limit))
    rows = rows.select("id", "asks", F.size("v").alias("width"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.monotonically_increasing_id().alias("node"))
    rows = written(rows, "vectors")
    sizes = rows.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.ceil(F.count_if("asks") / slice_rows).alias("slices"))
    dealt = rows.join(sizes, "width").withColumn("h", F.xxhash64("node"))
    own = {"block": F.pmod("h", "blocks"), "slice": F.pmod(F.shiftright("h", 20), "slices")}
    columns = ["width", "block", "slice", F.lit(0).alias("kind"), "node", "id", "v"]
    found = dealt.filter("slices > 0").withColumn("block", own["block"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select(*columns)
    asked = dealt.filter("asks").withColumn("slice", own["slice"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns[3] = F.lit(1).alias("kind")
    tiles = found.unionByName(asked.select(*columns)).repartition("width", "block", "slice").sortWithinPartitions("width", "block", "slice", "kind", F.col("id").asc_nulls_last(), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query", "query_id", "id", "score", "place"]
        tile, held, index, nodes, ids = None, [], None, None, None
        for b in batches:
            if not len(b):
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), len(b)]
            for p, q in zip(cuts, cuts[1:]):
                width, asks, part = int(key[p, 0]), key[p, 3] == 1, b.slice(p, q - p)
                if tuple(key[p, :3]) != tile:
                    tile, held, index = tuple(key[p, :3]), [], None
                node, x = part.column(4).to_numpy(), matrix(part.column(6), width)
                if not asks:
                    held.append((node, part.column(5), x))
                    continue
                if not held:  # a block that no row was dealt to
                    continue
                if index is None:
                    nodes = np.concatenate([h[0] for h in held])
                    ids = pa.chunked_array([h[1] for h in held]).combine_chunks()
                    index, held = ImpactIndex(np.concatenate([h[2] for h in held]), np.arange(len(nodes))), [None]
                    place = {int(n): i for i, n in enumerate(nodes)}
                found = [index.top(row, k, place.get(int(n))) for n, row in zip(node, x)]
                n = [len(f[0]) for f in found]
                if sum(n):
                    at = np.concatenate([f[0] for f in found])
                    whose = pa.array(np.repeat(np.arange(len(node)), n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, n)), part.column(5).take(whose), ids.take(pa.array(at)), pa.array(np.concatenate([f[1] for f in found])), pa.array(nodes[at])], names)

    best = tiles.mapInArrow(run, f"query long, query_id {kind}, id {kind}, score long, place long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "place")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
