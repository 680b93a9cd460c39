"""Transitive closure of a parent relation, per repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structcheck.functions.tables import written

PAIR = ["cls", "anc", "repo"]


def _composed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a step of `a` and then one of `b`."""
    ahead = b.select("repo", F.col("cls").alias("anc"), F.col("anc").alias("far"))
    return a.join(ahead, ["anc", "repo"]).select("repo", "cls", F.col("far").alias("anc"))


def ancestors(parents: DataFrame) -> DataFrame:
    """All pairs (repo, cls, anc) such that `anc` is reached from `cls` by one or more steps of `parents` (repo, cls, parent).

    Path doubling: round k lengthens all pairs found so far by the walks of exactly 2**k steps, so that the number of
    rounds is the logarithm of the longest path and, where a class has one parent, a pair is made once. A round without
    a new pair is the last: of the shortest walks, no length is left out. Cycles are allowed: a class on one is its own
    ancestor. The rounds run when this is called, each is written once and part of the result; an empty relation has an
    empty closure.
    """
    leap = written(parents.select("repo", "cls", F.col("parent").alias("anc")).distinct(), "closure")
    parts = [leap]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        leap = leap if len(parts) == 1 else written(_composed(leap, leap).distinct(), "closure")
        new = written(_composed(leap, known).distinct().join(known, PAIR, "left_anti"), "closure")
        if new.isEmpty():
            return known
        parts.append(new)


#: Peeling goes on while a round takes away an edge of so many.
PEELED = 16


def on_cycles(parents: DataFrame) -> DataFrame:
    """(repo, cls) of the classes that are reached from themselves by `parents` (repo, cls, parent).

    An edge of a cycle starts at a class that is a parent and ends at one that has a parent, so other edges are taken away,
    round by round, while many go; the closure is made of those that are left. Rounds run when this is called.
    """
    edges = written(parents.select("repo", "cls", "parent").distinct(), "edges")
    n, gone = edges.count(), True
    while n and gone:
        from_parents = edges.join(edges.select("repo", F.col("parent").alias("cls")).distinct(), ["cls", "repo"], "left_semi")
        left = written(from_parents.join(edges.select("repo", F.col("cls").alias("parent")).distinct(), ["parent", "repo"], "left_semi"), "edges")
        m = left.count()
        edges, n, gone = left, m, (n - m) * PEELED >= n
    return ancestors(edges).filter(F.col("cls") == F.col("anc")).select("repo", "cls")


def first_parent(parents: DataFrame) -> DataFrame:
    """(repo, cls, parent): the parent of least `ord`."""
    return parents.groupBy("repo", "cls").agg(F.min_by("parent", "ord").alias("parent"))


def with_self(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The reflexive closure: `pairs` and each class with itself."""
    return pairs.unionByName(classes.select("repo", "cls", F.col("cls").alias("anc"))).distinct()
