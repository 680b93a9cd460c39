"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_blocks, licenses, ngram_join, packing, piece_lattice, pivot_index, secrets, sharding, token_alignment, topk_search, toxicity, vector_codes, winnowing
from .common import table


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = toxicity.score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "text")
    sampled = piece_lattice.round_trip(docs, path)
    return sampled.select("doc_id", "n_pieces", "ids_crc32", (F.col("back_crc32") == F.col("text_crc32")).alias("lossless"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), sharding.even_tree(24))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    confirmed = F.filter("findings", lambda f: f["confirmed"])
    named = F.transform(confirmed, lambda f: F.concat_ws(":", f["line"].cast("string"), f["family"]))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_paragraphs"), F.size(confirmed).cast("long").alias("n_confirmed"), F.array_join(named, ",").alias("licenses"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("found")).alias("spans"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, percent=90, bits=20)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), *paths)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_sharding": op3_sharding,
        "op4_neardup": op4_neardup,
        "op5_fingerprints": op5_fingerprints,
        "op6_packing": op6_packing,
        "op7_licenses": op7_licenses,
        "op8_html": op8_html,
        "op9_secrets": op9_secrets,
        "op10_ngram_join": op10_ngram_join,
        "op11_alignment": op11_alignment,
        "op12_topk": op12_topk,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": pipeline,
    }


#: SQL for the operators that it can express.
FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
OP12 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {FINITE}),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def _assign(n: int) -> str:
    """The nearest entry of each part in round n."""
    return f"""d{n} AS (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts p JOIN b{n} b ON b.part = p.part),
 a{n} AS (SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM d{n} GROUP BY vec_id, part)"""


def _update(n: int) -> str:
    return f"""s{n} AS (SELECT p.part, a.entry, i AS pos, sum(p.x[i]) AS total, count(*) AS n FROM parts p JOIN a{n} a ON a.vec_id = p.vec_id AND a.part = p.part CROSS JOIN (SELECT unnest(generate_series(1, w)) AS i FROM width) GROUP BY ALL),
 b{n+1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (SELECT part, entry, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY pos) AS x FROM s{n} GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)"""


OP13 = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {FINITE}),
 width AS (SELECT max(len(x)) // 16 AS w FROM v),
 parts AS (SELECT vec_id, part, x[part * w + 1 : (part + 1) * w] AS x FROM v, width, (SELECT unnest(generate_series(0, 15)) AS part)),
 seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64),
 b0 AS (SELECT p.part, s.entry, p.x FROM parts p JOIN seeds s ON s.vec_id = p.vec_id),
 {_assign(0)}, {_update(0)}, {_assign(1)}, {_update(1)}, {_assign(2)},
 c AS (SELECT a.vec_id, v.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 a JOIN v ON v.vec_id = a.vec_id GROUP BY ALL),
 h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""


def oracle_sql() -> dict[str, str]:
    return {"op12_topk": OP12, "op13_vector_codes": OP13}
