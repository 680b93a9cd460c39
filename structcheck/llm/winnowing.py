"""Document fingerprints by winnowing over word k-grams.

The words of a text are its runs without ASCII white space; a character of a script that is written without spaces is
a word of its own, wherever it stands. Words are hashed to 64 bits, each run of `k` words has a rolling hash (a cyclic
polynomial: the hashes of its words rotated by their distance from its end, xor-ed), and of every `w` successive k-gram
hashes the least is chosen, the rightmost of equal ones. A fingerprint is the chosen hashes with the positions of their
k-grams. Two texts that share a passage of ``w + k - 1`` words share the hash that its full window chooses: the match
guarantee. A gap between chosen positions is at most `w`.

Everything is DataFrame functions: hashes, windows and choices are arrays within a row. Rolling hashes and windows grow
by doubling: a run of 2, 4, 8 ... words has its hash from two of half its length, and the least of 2, 4, 8 ... hashes
comes from two windows of half the width, so that neither costs `k` or `w` steps a position.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Blocks of scripts without spaces (Thai, Lao, Myanmar, Khmer, kana, Han and their extensions).
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
FINGERPRINT = "struct<hash:array<bigint>,at:array<int>>"


def words(text: Column) -> Column:
    """The words of a text in order."""
    plain = F.split(text, r"\s+")
    split = F.split(text, rf"\s+|(?<=[{UNSPACED}])|(?=[{UNSPACED}])")
    return F.array_remove(F.when(text.rlike(f"[{UNSPACED}]"), split).otherwise(plain), "")


def _rotated(x: Column, by: int) -> Column:
    return x if by % 64 == 0 else F.shiftleft(x, by % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - by % 64))


def rolling(hashed: Column, k: int) -> Column:
    """The rolling hash of each run of `k` elements; the array must have at least `k`."""
    def joined(a: Column, b: Column, head: int, tail: int) -> Column:
        """Of runs of head + tail elements, from those of `head` and of `tail`."""
        return F.transform(F.sequence(F.lit(0), F.size(b) - head - 1), lambda i: _rotated(F.get(a, i), tail).bitwiseXOR(F.get(b, i + head)))

    def step(done: Column | None, have: int, power: Column, width: int) -> Column:
        """`done`: the hashes of runs of `have` elements; `power`: those of runs of `width`; left is the rest of `k`."""
        if k & width:
            done, have = (power, width) if done is None else (joined(done, power, have, width), have + width)
        if have == k:
            return done
        return let(F.struct(done.alias("done") if have else F.lit(0).alias("done"), joined(power, power, width, width).alias("power")), lambda x: step(x["done"] if have else None, have, x["power"], 2 * width))

    return step(None, 0, hashed, 1)


def _least(g: Column, w: int) -> Column:
    """For each `w` successive elements, a power of two, the place of the least, the rightmost of equal ones."""
    def step(at: Column, s: int) -> Column:
        def better(j: Column) -> Column:
            a, b = F.get(at, j), F.get(at, j + s)
            return F.when(F.get(g, b) <= F.get(g, a), b).otherwise(a)

        m = F.transform(F.sequence(F.lit(0), F.size(at) - s - 1), better)
        return m if 2 * s == w else let(m, lambda x: step(x, 2 * s))

    every = F.sequence(F.lit(0), F.size(g) - 1)
    return every if w == 1 else let(every, lambda x: step(x, 1))


def choices(text: Column, k: int = 5, w: int = 16) -> Column:
    """The choices of a text in order, as FINGERPRINT; both arrays are empty for a text without words.

    With fewer than `k` words the whole is one k-gram; with fewer than `w` k-grams all are one window.
    """
    if w & (w - 1) or w < 1 or k < 1:
        raise ValueError("w is a power of two, k at least 1")

    def grams(h: Column) -> Column:
        many = F.transform(rolling(h, k), lambda x: F.xxhash64(x))
        return F.when(F.size(h) >= k, many).otherwise(F.array(F.xxhash64(h)))

    def chosen(g: Column) -> Column:
        last = F.size(g) - 1 - F.array_position(F.reverse(g), F.array_min(g)).cast("int") + 1
        at = F.when(F.size(g) >= w, F.array_distinct(_least(g, w))).otherwise(F.array(last))
        return let(at, lambda a: F.struct(F.transform(a, lambda i: F.get(g, i)).alias("hash"), a.alias("at")).cast(FINGERPRINT))

    none = F.struct(F.array().alias("hash"), F.array().alias("at")).cast(FINGERPRINT)
    hashed = F.transform(words(text), lambda x: F.xxhash64(x))
    return let(hashed, lambda h: F.when(F.size(h) == 0, none).otherwise(let(grams(h), chosen)))


def as_text(chosen: Column) -> Column:
    """``hash:position``, comma-joined."""
    return F.array_join(F.zip_with(chosen["hash"], chosen["at"], lambda h, i: F.concat_ws(":", h.cast("string"), i.cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the hashes of two fingerprints; 1 for two empty ones."""
    return let(F.struct(F.array_distinct(a["hash"]).alias("a"), F.array_distinct(b["hash"]).alias("b")), lambda p: let(
        F.struct(F.size(F.array_intersect(p["a"], p["b"])).alias("both"), (F.size(p["a"]) + F.size(p["b"])).alias("all")),
        lambda n: F.when(n["all"] == 0, F.lit(1.0)).otherwise(n["both"] / (n["all"] - n["both"])),
    ))


def with_next(docs: DataFrame, carried: list[str], rows_per_bucket: int = 4000, most_buckets: int = 50_000) -> DataFrame:
    """Adds ``next_`` columns, the `carried` ones of the next row by id (null ids first, ties by text); after the last comes the first.

    `docs`: i (an integer id), t (a non-null text) and the carried columns. The ids are dealt to buckets bounded by quantiles that are ids of
    the table; the rows at a bound also close the bucket before, so that each bucket is a window of its own. The bounds
    are at most `most_buckets` numbers.
    """
    stats = docs.agg(F.count(F.lit(1)).alias("rows"), F.min("i").alias("least"), F.count_if(F.isnull("i")).alias("nulls")).first()
    buckets = max(1, min(most_buckets, stats["rows"] // rows_per_bucket))
    cuts = docs.agg(F.percentile_approx("i", [b / buckets for b in range(1, buckets)], max(10_000, 10 * buckets)).alias("q")).first()["q"] if buckets > 1 else []
    cuts = sorted(set(cuts or []) - {stats["least"]})
    wrap = F.isnull("i") if stats["nulls"] else F.col("i") == F.lit(stats["least"])
    bucket = F.lit(0)
    if cuts:
        bounds = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
        steps = F.array(*[F.lit(2**s) for s in reversed(range(len(cuts).bit_length()))])
        bucket = F.coalesce(F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(cuts)) & (F.get(bounds, lo + s - 1) <= F.col("i")), lo + s).otherwise(lo)), F.lit(0))
    at_bound = F.col("b") > 0
    at_bound &= F.get(bounds, F.col("b") - 1) == F.col("i") if cuts else F.lit(False)
    here = F.struct(F.col("b").alias("b"), F.lit(0).alias("extra"))
    copies = F.filter(F.array(
        here,
        F.when(at_bound, F.struct((F.col("b") - 1).alias("b"), F.lit(1).alias("extra"))),
        F.when(wrap, F.struct(F.lit(len(cuts)).alias("b"), F.lit(2).alias("extra"))),
    ), lambda c: c.isNotNull())
    dealt = docs.withColumn("b", bucket).withColumn("c", F.explode(copies)).select("i", *carried, F.col("c.b").alias("b"), F.col("c.extra").alias("extra"))
    order = Window.partitionBy("b").orderBy((F.col("extra") == 2).cast("int"), "i", "t", "extra")
    ahead = [F.lead(c).over(order).alias(f"next_{c}") for c in carried]
    return dealt.select("i", "extra", *carried, *ahead).filter(F.col("extra") == 0).drop("extra")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, w: int = 16) -> DataFrame:
    """The fingerprint of each text: `id_col`, fingerprint (FINGERPRINT), n_chars.

    A null text counts as empty; null ids and repeated rows are rows like others. Only the two named columns are read; an
    empty table gives an empty result. A text is taken whole, so a row needs memory for some numbers a word.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), choices(t, k, w).alias("fingerprint"), F.char_length(t).cast("long").alias("n_chars"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, w: int = 16) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text, with their likenesses.

    The edited text is the text whose last floor(n/2) code points are replaced by the first as many (or all) of the
    next row's. A null text counts as empty; null ids come first; of repeated ids the next is the next by text. A
    table of one row is its own next, an empty one gives an empty result. Only the two named columns are read. The rows
    of one id are one window.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_next(docs.select(F.col(id_col).alias("i"), t.alias("t")).withColumn("f", choices(F.col("t"), k, w)), ["t", "f"])
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("t"), F.lit(1), n - half), F.substr(F.col("next_t"), F.lit(1), half))
    texts = rows.select("i", "f", "next_f", n.cast("long").alias("n_chars"), let(edited, lambda x: F.struct(F.sha2(x, 256).alias("sha"), choices(x, k, w).alias("f"))).alias("e"))
    f, g = F.col("f"), F.col("e.f")
    return texts.select(
        F.col("i").alias(id_col), "n_chars", F.col("e.sha").alias("edited_sha256"), as_text(f).alias("fingerprint"), as_text(g).alias("edited_fingerprint"),
        likeness(f, g).alias("near_edited"), likeness(f, F.col("next_f")).alias("near_next"),
    )
