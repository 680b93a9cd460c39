"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces the edges by as many or fewer that join each node to the least node it knows of; a few steps make
every component a star. A node with very many edges costs a grouped minimum and a join, which Spark splits when skewed;
no component is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """For each node of `edges`, ``node`` and ``root``, the least node of its component.

    Edges have no direction; loops, repeated edges and edges with a null end are ignored.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    now = written(now, "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        out = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, now = now, written(out.filter(F.col("u") != F.col("v")).distinct(), "edges")
        discard(old)
        before, seen = seen, _digest(now)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
