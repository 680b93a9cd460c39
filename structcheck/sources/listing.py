"""Lists of files, folders and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that no source root lies in, and how deep one may lie.
IGNORED = (".git", ".gradle", ".idea", "target", "build", "out", "node_modules")
DEEPEST = 10


def source_roots(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """(repo, root) from `files` (repo, path): the outermost ``src/main/java`` of each path, also ``src/test/java`` with
    `include_tests`; the repository itself, as an empty root, where there is none. Paths are relative, with slashes."""
    kind = "(?:main|test)" if include_tests else "main"
    root = F.regexp_extract("path", rf"^((?:[^/]+/)*?src/{kind}/java)/", 1)
    parts = F.split(root, "/")
    fine = (root != "") & (F.size(parts) <= DEEPEST) & ~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED)))
    found = files.select("repo", F.when(fine, root).alias("root")).distinct()
    repos = found.select("repo").distinct()
    return repos.join(found.filter("root IS NOT NULL"), "repo", "left").select("repo", F.coalesce("root", F.lit("")).alias("root"))


def addresses(lines: DataFrame) -> DataFrame:
    """The addresses of a list: `lines` (value) trimmed, without blank ones and those that start with #."""
    value = F.trim(F.regexp_replace("value", r"[\t\r]", " "))
    return lines.select(value.alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def existing(paths: DataFrame) -> DataFrame:
    """(item, extracted, reported) from `paths` (path): which output folders hold an extraction and which a report."""
    parts = F.regexp_extract("path", r"(?:^|/)([^/]+)/(extraction|report)\.json$", 1), F.regexp_extract("path", r"/(extraction|report)\.json$", 1)
    found = paths.select(parts[0].alias("item"), parts[1].alias("kind")).filter("kind <> ''")
    return found.groupBy("item").agg(F.max(F.col("kind") == "extraction").alias("extracted"), F.max(F.col("kind") == "report").alias("reported"))


def existing_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """`existing` of the files below a folder; only their names are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    return existing(found.select("path"))
