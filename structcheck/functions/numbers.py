"""Numbers and times of progress and catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least_zero(value: Column) -> Column:
    """`value`, 0 if it is negative; null stays null."""
    return F.when(value < 0, F.lit(0)).otherwise(value)


def percent(done: Column, total: Column) -> Column:
    """Rounded share of `total` in percent, at most 100; 0 where the total is not positive."""
    return F.when(total > 0, F.least(F.lit(100), F.round(done * 100.0 / total)).cast("int")).otherwise(F.lit(0))


def page_count(rows: Column, size: int) -> Column:
    """Pages of `size` rows that hold `rows`, one at least."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(size)).cast("int"))


def instant(text: Column) -> Column:
    """An ISO instant such as 2024-01-31T10:00:00Z as a timestamp; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.try_to_timestamp(text))


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def day(text: Column) -> Column:
    """A date given as year-month-day; null for anything else."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d\d-\d\d$"), F.trim(text).try_cast("date"))
