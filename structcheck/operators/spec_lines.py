"""Names of constraints from the lines of a specification: an as-of lookup of violation lines in a second table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a line that names an invariant looks like, and how many lines further up one is sought.
NAMED = r"^\s*invariant\s+([A-Za-z_][A-Za-z0-9_]*)\s*:"
REACH = 10


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(spec, line, text) of the text files at `path`; lines count from 1, spec is the file's name without its ending.

    A file is split by one task; specifications are texts of some hundred lines.
    """
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    spec = F.regexp_replace("file", r"\.[^.]*$", "")
    return texts.select(spec.alias("spec"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "text")).select("spec", (F.col("at") + 1).alias("line"), "text")


def covering(lines: DataFrame, reach: int = REACH) -> DataFrame:
    """(spec, line, found): for each line of `lines` (spec, line, text) the name on it or the nearest one above, up to `reach`
    lines up; null where there is none. Of rows that repeat a line any one names it."""
    name = F.nullif(F.regexp_extract("text", NAMED, 1), F.lit(""))
    each = lines.filter(F.col("line").isNotNull()).groupBy("spec", "line").agg(F.max(name).alias("name"))
    near = Window.partitionBy("spec").orderBy(F.col("line").cast("long")).rangeBetween(-reach, 0)
    return each.select("spec", "line", F.last("name", ignorenulls=True).over(near).alias("found"))


def named(violations: DataFrame, lines: DataFrame, reach: int = REACH) -> DataFrame:
    """`violations` (spec, line, invariant and any other columns) with the invariant's name from `lines` where it is null.

    A violation that has a name keeps it; one without a line, or with a line that its specification does not have, stays
    nameless. Names are looked up by an equi-join on specification and line: a line that very many violations share is
    split like any frequent key, and the range search runs over the specification's own lines alone.
    """
    cover = covering(lines, reach).withColumnsRenamed({"spec": "__spec", "line": "__line", "found": "__found"})
    met = violations.join(cover.filter("__found IS NOT NULL"), (F.col("spec") == F.col("__spec")) & (F.col("line") == F.col("__line")), "left")
    return met.withColumn("invariant", F.coalesce("invariant", "__found")).select(*violations.columns)
