"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. At each level a row draws one number for each child of the node it has reached,
from a hash of the row's key and the child's name, and goes to the child with the least ``-ln(u) / weight``: an
exponential draw, so that a child gets its share of the weight and a change of one child's weight moves rows only into
it or out of it. The weight of an inner node is the sum of the shards below it; a change in one rack therefore moves
rows between regions only as far as that region's weight changed, and leaves the draws in all other subtrees as they
were. A new shard that is a region of its own takes rows only into itself.

Everything is DataFrame functions. The slot of a row in its shard comes from counts: rows fall into hash bins within
their shard, each bin is numbered by a window of its own and starts where the bins before it end, so that no task holds
a whole shard.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """`shards` equal shards, filling racks and regions in order."""
    return [Shard(f"region{i // (per_rack * racks)}", f"rack{i // per_rack}", i) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """`tree` and one more shard, in a region of its own."""
    new = max((s.shard for s in tree), default=-1) + 1
    return [*tree, Shard(f"grown{new}", f"grown{new}", new, weight)]


def draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of rate `weight`: 53 bits of the hash of key and node as a number between 0 and 1."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(weight)


def place(rows: DataFrame, key: Column, tree: list[Shard], shard_col: str) -> DataFrame:
    """Adds the shard of each row with the non-null text `key`; a child of weight 0 gets no rows."""
    if any(s.weight < 0 or not math.isfinite(s.weight) for s in tree) or not any(s.weight > 0 for s in tree):
        raise ValueError("weights are finite numbers from 0 on, one of them above 0")
    live = [s for s in tree if s.weight > 0]
    paths = [((s.region,), (s.region, s.rack), (s.region, s.rack, str(s.shard))) for s in live]
    weight: dict[tuple, float] = {}
    for s, path in zip(live, paths):
        for node in path:
            weight[node] = weight.get(node, 0.0) + s.weight
    columns = [free_name(rows, f"{shard_col}_{x}") for x in ("region", "rack", "leaf")]
    numbers = [{n: i for i, n in enumerate(dict.fromkeys(p[depth] for p in paths))} for depth in range(3)]
    for depth, column in enumerate(columns):
        parents = [()] if depth == 0 else list(numbers[depth - 1])
        winners = []
        for parent in parents:
            nodes = [n for n in numbers[depth] if n[:-1] == parent]
            drawn = [F.struct(draw(key, "/".join(n), weight[n]).alias("draw"), F.lit(numbers[depth][n]).alias("node")) for n in nodes]
            winner = F.least(*drawn)["node"] if len(drawn) > 1 else F.lit(numbers[depth][nodes[0]])
            winners.append(winner if depth == 0 else F.when(F.col(columns[depth - 1]) == numbers[depth - 1][parent], winner))
        rows = rows.withColumn(column, F.coalesce(*winners))
    leaves = [next(s.shard for s, p in zip(live, paths) if p[2] == n) for n in numbers[2]]
    shards = F.array(*map(F.lit, leaves))
    return rows.withColumn(shard_col, F.get(shards, F.col(columns[2]))).drop(*columns)


def with_slots(placed: DataFrame, shard_col: str, order: list[str], slot_col: str = "slot", rows_per_bin: int = 50_000) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in hash bins of about `rows_per_bin` rows, by `order` within a bin.

    `order` is also what the bins are hashed from. Rows equal in all of `order` are numbered in any order.
    The counts of the bins are as many rows as there are bins: rows over `rows_per_bin`.
    """
    bin_, before, n = free_name(placed, "bin"), free_name(placed, "before"), free_name(placed, "n")
    per_shard = placed.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bins = max(1, math.ceil(per_shard / rows_per_bin))
    binned = placed.withColumn(bin_, F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int"))
    counts = binned.groupBy(shard_col, bin_).agg(F.count(F.lit(1)).alias(n))
    total = Window.partitionBy(shard_col).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard_col, bin_, F.coalesce(F.sum(n).over(total), F.lit(0)).alias(before))
    in_bin = Window.partitionBy(shard_col, bin_).orderBy(*order)
    numbered = binned.withColumn(slot_col, F.row_number().over(in_bin).cast("long") - 1)
    return numbered.join(starts, [shard_col, bin_]).withColumn(slot_col, F.col(slot_col) + F.col(before)).drop(bin_, before)


def shard(docs: DataFrame, tree: list[Shard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every row by its id.

    Returns id, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32, shard, slot, grown_shard (the
    shard if `tree` had one more, in a region of its own). A null id is the key of its own; rows of one id share a
    shard. Only the two named columns are read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(8)).cast("long").alias("size"), F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    placed = place(place(rows, key, tree, "shard"), key, grown(tree), "grown_shard")
    return with_slots(written(placed, "sharding"), "shard", [id_col, "size", "text_crc32"])
