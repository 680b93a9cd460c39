"""Repository catalogue: search with pushed predicates, order, limit, pages and selection."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SORTS = {"STARS": "stars", "FORKS": "forks", "UPDATED": "pushed_at"}
RANGES = (("stars", "min_stars", "max_stars"), ("forks", "min_forks", "max_forks"), ("size", "min_size", "max_size"))


@dataclass(frozen=True)
class Criteria:
    """What a search asks for; a ValueError says what is not allowed.

    `fork` and `archived`: EXCLUDE, INCLUDE or ONLY. `owner` may have ``user:`` or ``org:`` before the name. Dates are
    compared as text of the form year-month-day.
    """

    keywords: str | None = None
    language: str | None = None
    owner: str | None = None
    topic: str | None = None
    licenses: tuple[str, ...] = ()
    min_stars: int | None = None
    max_stars: int | None = None
    min_forks: int | None = None
    max_forks: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    created_after: str | None = None
    pushed_after: str | None = None
    fork: str = "INCLUDE"
    archived: str = "INCLUDE"
    sort: str | None = None
    descending: bool = True
    limit: int = 100

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 1000:
            raise ValueError("a limit is from 1 to 1000")
        for _, low, high in RANGES:
            a, b = getattr(self, low), getattr(self, high)
            if any(x is not None and x < 0 for x in (a, b)) or (a is not None and b is not None and a > b):
                raise ValueError("a range has bounds from 0 on, in order")
        if any(x not in ("EXCLUDE", "INCLUDE", "ONLY") for x in (self.fork, self.archived)):
            raise ValueError("forks and archived ones are excluded, included or asked for alone")
        texts = (self.keywords, self.language, self.owner, self.topic, self.created_after, self.pushed_after)
        if not (any(texts) or self.licenses or any(getattr(self, x) is not None for _, *ends in RANGES for x in ends)):
            raise ValueError("a search needs a predicate")


def license_names(text: str) -> tuple[str, ...]:
    """The licences of a text such as ``mit OR apache-2.0, bsd``."""
    return tuple(t for t in re.split(r"[\s,;|]+", text) if t and t.upper() not in ("OR", "AND"))


def search(catalog: DataFrame, c: Criteria) -> DataFrame:
    """Rows of `catalog` that meet all criteria; all of them, unordered.

    Columns that a criterion needs must exist: name, language, license, stars, size; for others owner, topics, forks,
    fork, archived, created_at, pushed_at. Keywords are sought in the name and, if they exist, description and readme.
    """
    found = catalog
    if c.keywords:
        texts = [F.lower(F.col(x)) for x in ("name", "description", "readme") if x in catalog.columns]
        for word in c.keywords.split():
            met = F.lit(False)
            for t in texts:
                met |= F.coalesce(t.contains(word.lower()), F.lit(False))
            found = found.filter(met)
    if c.language:
        found = found.filter(F.col("language") == c.language)
    if c.owner:
        found = found.filter(F.lower("owner") == re.sub("^(?i:user|org):", "", c.owner).lower())
    if c.topic:
        found = found.filter(F.array_contains("topics", c.topic))
    if c.licenses:
        found = found.filter(F.col("license").isin(*c.licenses))
    for column, low, high in RANGES:
        if (x := getattr(c, low)) is not None:
            found = found.filter(F.col(column) >= x)
        if (x := getattr(c, high)) is not None:
            found = found.filter(F.col(column) <= x)
    for column, day in (("created_at", c.created_after), ("pushed_at", c.pushed_after)):
        if day:
            found = found.filter(F.substring(column, 1, 10) >= day)
    for column, mode in (("fork", c.fork), ("archived", c.archived)):
        if mode != "INCLUDE":
            found = found.filter(F.col(column) if mode == "ONLY" else ~F.col(column))
    return found


def top(found: DataFrame, c: Criteria, tie: str = "id") -> DataFrame:
    """The first `limit` rows by the sort asked for, ties by `tie`; without a sort any `limit` rows, unordered."""
    if not c.sort:
        return found.limit(c.limit)
    order = F.col(SORTS.get(c.sort, c.sort))
    return found.orderBy(order.desc() if c.descending else order.asc(), tie).limit(c.limit)


def page(found: DataFrame, number: int, size: int, *order) -> DataFrame:
    """Page `number`, from 0, of `size` rows."""
    return found.orderBy(*order).offset(number * size).limit(size)


def inverted(rows: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    """The rows that are not selected."""
    return rows.join(selected.select(key), key, "left_anti")
