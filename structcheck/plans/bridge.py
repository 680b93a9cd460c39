"""The relational instance over the driver's tables, in DataFrame form and as SQL. No logic but renaming and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structcheck.functions.tables import dealt_by_size, shuffled, written
from structcheck.functions.text import yes_no
from structcheck.operators.rules import Instance

#: The same views for DuckDB.
VIEWS = """
cls AS (SELECT p_brand AS repo, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS rn, 'C' || p_partkey AS cls, p_type || '_' || p_size AS cid, p_name AS name, CASE WHEN p_size > 35 THEN 'Yes' ELSE 'No' END AS is_abstract, p_size AS size FROM part),
par AS (SELECT c.repo, c.cls, p.cls AS parent, e.ord FROM (SELECT repo, cls, (rn - 1) // 2 AS to_rn, 1 AS ord FROM cls WHERE rn > 0 UNION ALL SELECT repo, cls, rn - 1, 2 FROM cls WHERE rn > 0 AND rn % 7 = 0 UNION ALL SELECT repo, cls, 5, 1 FROM cls WHERE rn = 0 AND CAST(substr(repo, 7) AS INT) % 5 = 0) e JOIN cls c ON c.repo = e.repo AND c.cls = e.cls JOIN cls p ON p.repo = e.repo AND p.rn = e.to_rn),
met0 AS (SELECT repo, cls, rn, l_linenumber AS ln, l_quantity AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS seq, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS mid, 'm' || (l_suppkey % 20) AS member_name, l_returnflag AS return_type, CASE WHEN l_linenumber = 1 THEN '_' WHEN l_linenumber < 4 THEN l_returnflag ELSE l_returnflag || ', ' || l_linestatus END AS param_types, CASE WHEN l_discount > 0.02 THEN 'Yes' ELSE 'No' END AS is_inheritable, CASE WHEN l_linenumber = 7 THEN 'Static' ELSE 'Instance' END AS scope, CASE WHEN l_tax > 0.07 THEN 'Yes' ELSE 'No' END AS is_abstract FROM lineitem JOIN cls ON k = l_partkey),
met AS (SELECT *, 'M' || substr(cls, 2) || '_' || seq AS method, rn * 10000 + seq AS ord FROM met0),
att AS (SELECT repo, cls, 'A' || k || '_' || j AS attribute, rn * 10 + j AS ord, CAST(k // 3 + j AS VARCHAR) AS aid, 'a' || CASE WHEN j = 0 THEN size % 7 ELSE k % 5 END AS member_name, CASE WHEN j = 0 THEN 'String' ELSE 'int' END AS type, CASE WHEN size % 3 = 0 THEN 'No' ELSE 'Yes' END AS is_inheritable, CASE WHEN size % 11 = 0 THEN 'Static' ELSE 'Instance' END AS scope FROM cls CROSS JOIN (VALUES (0), (1)) t(j)),
bin AS (SELECT repo, 'B' || substr(method, 2) AS binding, cls AS implementer, method AS target, 'Y' || substr(method, 2) AS body FROM met WHERE q > 2
  UNION ALL SELECT repo, 'BX' || substr(method, 2), cls, method, 'Y' || substr(method, 2) FROM met WHERE q > 2 AND ln = 5
  UNION ALL SELECT m.repo, 'BP' || substr(method, 2), p.parent, method, 'Y' || substr(method, 2) FROM met m JOIN par p ON p.repo = m.repo AND p.cls = m.cls AND p.ord = 1 WHERE q > 2 AND ln = 4),
bod AS (SELECT repo, 'Y' || substr(method, 2) AS body FROM met WHERE q > 1),
lm AS (SELECT repo, cls, method FROM met UNION ALL SELECT m.repo, p.parent, m.method FROM met m JOIN par p ON p.repo = m.repo AND p.cls = m.cls AND p.ord = 2 WHERE ln = 6),
la AS (SELECT repo, cls, attribute FROM att),
obj AS (SELECT DISTINCT repo, 'O' || l_orderkey AS object, CAST(l_orderkey // 3 AS VARCHAR) AS oid, cls
  FROM lineitem JOIN cls ON k = l_partkey WHERE l_linenumber = 1 OR (l_linenumber = 2 AND l_quantity > 45)),
im AS (SELECT DISTINCT p.repo, p.cls, m.method FROM par p JOIN met m ON m.repo = p.repo AND m.cls = p.parent WHERE q >= 25 UNION SELECT repo, cls, method FROM met WHERE ln = 6 AND q > 40),
ia AS (SELECT DISTINCT p.repo, p.cls, a.attribute FROM par p JOIN att a ON a.repo = p.repo AND a.cls = p.parent UNION SELECT repo, cls, attribute FROM att WHERE ord % 10 = 1 AND scope = 'Static')
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return p.select(
        F.col("p_brand").alias("repo"), F.col("p_partkey").alias("k"), rn.alias("rn"), F.concat(F.lit("C"), F.col("p_partkey")).alias("cls"),
        F.concat_ws("_", "p_type", "p_size").alias("cid"), F.col("p_name").alias("name"), yes_no(F.col("p_size") > 35).alias("is_abstract"), F.col("p_size").alias("size"),
    )


def parents(cls: DataFrame) -> DataFrame:
    rn = F.col("rn")
    to = F.array(
        F.when(rn > 0, F.struct(F.floor((rn - 1) / 2).cast("int").alias("rn"), F.lit(1).alias("ord"))),
        F.when((rn > 0) & (rn % 7 == 0), F.struct((rn - 1).alias("rn"), F.lit(2).alias("ord"))),
        F.when((rn == 0) & (F.substring("repo", 7, 10).cast("int") % 5 == 0), F.struct(F.lit(5).alias("rn"), F.lit(1).alias("ord"))),
    )
    edges = cls.select("repo", "cls", F.explode(F.filter(to, lambda e: e.isNotNull())).alias("e")).select("repo", "cls", F.col("e.rn").alias("rn"), F.col("e.ord").alias("ord"))
    return edges.join(shuffled(cls.select("repo", "rn", F.col("cls").alias("parent"))), ["rn", "repo"]).select("repo", "cls", "parent", "ord")


def methods(spark: SparkSession, sf_dir: str, cls: DataFrame) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem")
    line = dealt_by_size(line, line.count(), "l_partkey").join(shuffled(cls.select("repo", "cls", "rn", F.col("k").alias("l_partkey"))), "l_partkey")
    seq = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice"))
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    rows = line.select(
        "repo", "cls", "rn", F.col("l_partkey").alias("k"), n.alias("ln"), F.col("l_quantity").alias("q"), seq.alias("seq"), (F.col("l_orderkey") * 10 + n).cast("string").alias("mid"), F.concat(F.lit("m"), F.col("l_suppkey") % 20).alias("member_name"), flag.alias("return_type"),
        F.when(n == 1, "_").when(n < 4, flag).otherwise(F.concat(flag, F.lit(", "), F.col("l_linestatus"))).alias("param_types"), yes_no(F.col("l_discount") > 0.02).alias("is_inheritable"), F.when(n == 7, "Static").otherwise("Instance").alias("scope"), yes_no(F.col("l_tax") > 0.07).alias("is_abstract"),
    )
    return rows.withColumn("method", F.concat(F.lit("M"), F.substring("cls", 2, 20), F.lit("_"), F.col("seq"))).withColumn("ord", F.col("rn").cast("long") * 10000 + F.col("seq"))


def attributes(cls: DataFrame) -> DataFrame:
    rows = cls.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    j, size = F.col("j"), F.col("size")
    return rows.select(
        "repo", "cls", F.concat(F.lit("A"), F.col("k"), F.lit("_"), j).alias("attribute"), (F.col("rn").cast("long") * 10 + j).alias("ord"), (F.floor(F.col("k") / 3) + j).cast("string").alias("aid"), F.concat(F.lit("a"), F.when(j == 0, size % 7).otherwise(F.col("k") % 5)).alias("member_name"),
        F.when(j == 0, "String").otherwise("int").alias("type"), yes_no(size % 3 != 0).alias("is_inheritable"), F.when(size % 11 == 0, "Static").otherwise("Instance").alias("scope"),
    )


def objects(spark: SparkSession, sf_dir: str, cls: DataFrame) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem").filter("l_linenumber = 1 OR (l_linenumber = 2 AND l_quantity > 45)")
    met = line.join(shuffled(cls.select("repo", "cls", F.col("k").alias("l_partkey"))), "l_partkey")
    order = F.col("l_orderkey")
    return met.select("repo", F.concat(F.lit("O"), order).alias("object"), F.floor(order / 3).cast("long").cast("string").alias("oid"), "cls").distinct()


def instance(spark: SparkSession, sf_dir: str, keep: bool | tuple[str, ...] = ()) -> Instance:
    """All relations. With `keep`, the named ones of classifiers, parents, methods and attributes, or all four, are written
    once and the others are read from them."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df, name) if keep is True or keep and name in keep else df

    cls = kept(classifiers(spark, sf_dir), "classifiers")
    par, met, att = kept(parents(cls), "parents"), kept(methods(spark, sf_dir, cls).drop("k"), "methods"), kept(attributes(cls), "attributes")
    first, second = (par.filter(F.col("ord") == i).select("repo", "cls", "parent") for i in (1, 2))

    def tail(prefix: str):
        return F.concat(F.lit(prefix), F.substring("method", 2, 40))

    bound = met.filter("q > 2")
    binding = bound.select("repo", tail("B").alias("binding"), F.col("cls").alias("implementer"), F.col("method").alias("target"), tail("Y").alias("body"))
    twice = bound.filter("ln = 5").select("repo", tail("BX").alias("binding"), F.col("cls").alias("implementer"), F.col("method").alias("target"), tail("Y").alias("body"))
    above = bound.filter("ln = 4").join(first, ["cls", "repo"]).select("repo", tail("BP").alias("binding"), F.col("parent").alias("implementer"), F.col("method").alias("target"), tail("Y").alias("body"))
    shared = met.filter("ln = 6").join(second, ["cls", "repo"]).select("repo", F.col("parent").alias("cls"), "method")
    up = par.select("repo", F.col("cls").alias("child"), F.col("parent").alias("cls"))
    im = up.join(met.filter("q >= 25").select("repo", "cls", "method"), ["cls", "repo"]).select("repo", F.col("child").alias("cls"), "method").unionByName(met.filter("ln = 6 AND q > 40").select("repo", "cls", "method")).distinct()
    ia = up.join(att.select("repo", "cls", "attribute"), ["cls", "repo"]).select("repo", F.col("child").alias("cls"), "attribute").unionByName(att.filter("ord % 10 = 1 AND scope = 'Static'").select("repo", "cls", "attribute")).distinct()
    return Instance(
        classifier=cls.select("repo", "cls", F.col("rn").alias("ord"), "cid", "name", "is_abstract"),
        method=met.select("repo", "method", "ord", "mid", "member_name", "return_type", "param_types", "is_inheritable", "scope", "is_abstract"),
        attribute=att.select("repo", "attribute", "ord", "aid", "member_name", "type", "is_inheritable", "scope"),
        body=met.filter("q > 1").select("repo", tail("Y").alias("body")),
        binding=binding.unionByName(twice).unionByName(above),
        parents=par,
        local_methods=met.select("repo", "cls", "method").unionByName(shared),
        local_attributes=att.select("repo", "cls", "attribute"),
        inherited_methods=im,
        inherited_attributes=ia,
        objects=objects(spark, sf_dir, cls),
    )
