"""Repository catalogue pages: search results of a paged JSON interface, from files or from an address."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = (
    "total_count long, items array<struct<id:long,name:string,full_name:string,description:string,language:string,"
    "stargazers_count:long,forks_count:long,size:long,fork:boolean,archived:boolean,created_at:string,pushed_at:string,"
    "owner:struct<login:string>,license:struct<spdx_id:string>,topics:array<string>>>"
)
ROW = (
    "id long, name string, description string, language string, stars long, forks long, size long, fork boolean, archived boolean, "
    "created_at string, pushed_at string, owner string, license string, topics array<string>"
)


def defaults(item: Column) -> list[Column]:
    """The columns of ROW from an item: text that is missing is empty, numbers are 0, flags false, dates null."""
    text = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    number = lambda c, n: F.coalesce(item[c], F.lit(0)).cast("long").alias(n)
    return [
        number("id", "id"), text(item["name"], "name"), text(item["description"], "description"), text(item["language"], "language"),
        number("stargazers_count", "stars"), number("forks_count", "forks"), number("size", "size"),
        F.coalesce(item["fork"], F.lit(False)).alias("fork"), F.coalesce(item["archived"], F.lit(False)).alias("archived"),
        item["created_at"].alias("created_at"), item["pushed_at"].alias("pushed_at"), text(item["owner"]["login"], "owner"),
        text(item["license"]["spdx_id"], "license"), F.coalesce(item["topics"], F.array().cast("array<string>")).alias("topics"),
    ]


def scan(pages: DataFrame, size: int = 100, limit: int = 1000) -> DataFrame:
    """`pages` (page from 0, value): the rows of the pages in order, up to the first short page, the total and `limit`.

    One row for each item: pos (its place among all) and the columns of ROW. The number of pages is small, as `limit` is
    1000 at most; what lies behind the first short page is never read by such an interface and left out here.
    """
    read = pages.select("page", F.from_json("value", PAGE).alias("p"))
    n = F.coalesce(F.size("p.items"), F.lit(0))
    ends = read.agg(F.min(F.when(n < size, F.col("page"))).alias("short"), F.max("p.total_count").alias("total")).first()
    kept = read if ends["short"] is None else read.filter(F.col("page") <= ends["short"])
    rows = kept.select("page", F.posexplode("p.items").alias("i", "item")).withColumn("pos", F.col("page").cast("long") * size + F.col("i"))
    return rows.filter(F.col("pos") < min(limit, limit if ends["total"] is None else ends["total"])).select("pos", *defaults(F.col("item")))


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.address = options["path"]
        self.size, self.limit = int(options.get("size", 100)), int(options.get("limit", 1000))
        if not 1 <= self.size <= 100 or not 1 <= self.limit <= 1000:
            raise ValueError("a page has 1 to 100 rows, a search 1 to 1000")

    def _page(self, number: int) -> dict:
        with urllib.request.urlopen(self.address.format(page=number, size=self.size), timeout=45) as f:
            return json.load(f)

    def partitions(self) -> list[InputPartition]:
        """A partition for each page that the total of the first one tells."""
        total = min(self.limit, int(self._page(0).get("total_count", 0)))
        return [_Page(i) for i in range(-(-total // self.size))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        text, left = lambda x: x or "", self.limit - partition.number * self.size
        for x in (self._page(partition.number).get("items") or [])[:left]:
            yield (
                int(x.get("id") or 0), text(x.get("name")), text(x.get("description")), text(x.get("language")), int(x.get("stargazers_count") or 0),
                int(x.get("forks_count") or 0), int(x.get("size") or 0), bool(x.get("fork")), bool(x.get("archived")), x.get("created_at"),
                x.get("pushed_at"), text((x.get("owner") or {}).get("login")), text((x.get("license") or {}).get("spdx_id")), x.get("topics") or [],
            )


class CatalogPages(DataSource):
    """``spark.read.format("catalog_pages").load(address)``, with {page} and {size} in the address; options size, limit.

    The search service is asked for a page by the task that reads it, for the first page also when the plan is made.
    """

    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
