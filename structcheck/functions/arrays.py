"""Functions on arrays within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once a row however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running `combine`, a sum or a maximum, of an array of numbers.

    Step s combines each number with the one 2**s places before it, so a long array takes a logarithm of steps, none of
    which copies it for each element.
    """
    def step(acc: Column, s: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= s, combine(x, F.get(acc, (i - s).cast("int")))).otherwise(x))

    powers = F.array(*[F.lit(2**i) for i in range(31)])
    return let(values.cast("array<bigint>"), lambda w: F.aggregate(F.filter(powers, lambda s: s < F.size(w)), w, step))


def length(values: Column) -> Column:
    """The size of an array, 0 for null."""
    return F.coalesce(F.greatest(F.size(values), F.lit(0)), F.lit(0))
