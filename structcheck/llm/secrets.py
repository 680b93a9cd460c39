"""Secret scan: base patterns, and multipart credentials linked by an interval join.

Three base kinds are found in every text, each leftmost and non-overlapping: ``assign`` (a named secret with a value of
eight or more characters), ``access`` (an access identifier) and ``hex`` (a run of 32 or more hexadecimal digits).

Weak parts say little alone: ``key`` (a bare token of 20 or more characters that mixes letter cases and digits, as secret keys do), ``endpoint``
(a URL or a named host) and ``user`` (a named account). A weak part becomes a span of kind ``link_key``,
``link_endpoint`` or ``link_user`` only when a part of a complementary role lies within `scope` characters: an
identifier (``access`` or ``user``) needs a secret, a bare key needs an identifier, an endpoint needs both. The parts of
a text are matched by an interval join: each part falls into the buckets of ``scope + 1`` characters that it covers, the
other side is offered to the neighbouring buckets too, and the join keeps intervals whose gap is at most `scope`.

Everything is DataFrame functions. Positions come from splitting a text at the matches: the pieces between and the
matches themselves have lengths in code points, whose running sum gives each span. Nothing grows with the square of a
text's parts: sums are taken in a logarithm of steps, overlaps looked up by halving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A weak part has the span of the whole match.
WEAK = {
    "key": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9])(?=[A-Z0-9+/=_-]*+[a-z])(?=[a-z0-9+/=_-]*+[A-Z])[A-Za-z0-9+/=_-]{20,}+",
    "endpoint": r"""(?:https?|jdbc:[a-z]{2,20}|postgres|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{3,}|(?i:endpoint|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""",
    "user": r"""(?i:username|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{2,}""",
}
#: kind: the roles of which each must have a part nearby.
NEEDS = {"key": ["identifier"], "user": ["secret"], "endpoint": ["identifier", "secret"]}
ROLES = {"assign": "secret", "key": "secret", "hex": "secret", "access": "identifier", "user": "identifier", "endpoint": "place"}
POWERS = [2**i for i in range(31)]
SPAN = "array<struct<start:bigint,end:bigint,kind:string>>"


def scanned(values: Column, combine) -> Column:
    """The running `combine` of an array of numbers, in as many steps as its length has binary digits.

    Step s combines each number with the one 2**s places before it, so that no step copies an array for each element.
    """
    def step(acc: Column, s: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= s, combine(x, F.get(acc, (i - s).cast("int")))).otherwise(x))

    wide = values.cast("array<bigint>")
    return let(wide, lambda w: F.aggregate(F.filter(F.array(*map(F.lit, POWERS)), lambda s: s < F.size(w)), w, step))


def spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """The matches of `pattern` in `text`, as spans in code points with `end` exclusive.

    With `least`, a match whose second group is shorter is dropped after matching, so that it still consumes its text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.transform(found, lambda m: F.char_length(m).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found, lambda v: F.char_length(v) >= least)

    def placed(p: Column) -> Column:
        ends = scanned(F.zip_with(F.transform(F.slice(p["between"], 1, F.size(p["sizes"])), lambda g: F.char_length(g).cast("long")), p["sizes"], lambda g, m: g + m), lambda x, y: x + y)
        rows = F.zip_with(ends, p["sizes"], lambda e, m: F.struct((e - m).alias("start"), e.alias("end"), F.lit(kind).alias("kind")))
        return let(F.struct(rows.alias("rows"), p["kept"].alias("kept")), lambda q: F.filter(q["rows"], lambda x, i: F.get(q["kept"], i)))

    out = let(F.struct(between.alias("between"), sizes.alias("sizes"), kept.alias("kept")), placed)
    return F.when(text.rlike(pattern), out.cast(SPAN)).otherwise(F.array().cast(SPAN))


def clear_of(spans_: Column, others: Column) -> Column:
    """The spans that overlap none of `others`: of these, sorted, those that start before a span's end are a prefix,
    found by halving, and the greatest end in it tells."""
    def told(o: Column) -> Column:
        steps = F.array(*map(F.lit, reversed(POWERS)))

        def free(x: Column) -> Column:
            before = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((s <= F.size(o["starts"]) - lo) & (F.get(o["starts"], lo + s - 1) < x["end"]), lo + s).otherwise(lo))
            return let(before, lambda n: (n == 0) | (F.get(o["ends"], n - 1) <= x["start"]))

        return F.filter(spans_, free)

    in_order = F.array_sort(others)
    return let(in_order, lambda y: let(F.struct(F.transform(y, lambda s: s["start"]).alias("starts"), scanned(F.transform(y, lambda s: s["end"]), F.greatest).alias("ends")), told))


def as_text(spans_: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined in their order."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans_: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the place of their kind in `kinds`, then by end."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"])).cast(SPAN)


def gates(text: Column) -> Column:
    """Which kinds a text can have at all, by cheap tests that miss none: struct of base and weak.

    Weak parts count only beside an identifier or a named account, so other texts need no search for them.
    """
    low = F.lower(text)
    assign = F.lit(False)
    for word in ("passw", "secret", "token", "api_key", "apikey"):
        assign |= low.contains(word)
    access, hexa = text.contains("AKIA"), text.rlike(HEX)
    user = low.contains("user") | low.contains("login") | low.contains("account")
    return F.struct(assign.alias("assign"), access.alias("access"), hexa.alias("hex"), (access | user).alias("weak"))


BASE_KINDS = ["assign", "access", "hex"]
LINK_KINDS = ["link_key", "link_endpoint", "link_user"]


def some_part(gate: Column) -> Column:
    return gate["assign"] | gate["access"] | gate["hex"] | gate["weak"]


def linked(parts: DataFrame, key: list[str], scope: int) -> DataFrame:
    """The weak parts that have their complements within `scope` characters: `key`, start, end, kind.

    `parts`: `key`, start, end, kind. An equi-join on key and bucket with a range condition; each side is one row for
    each part, so that a text costs its parts times the parts within three buckets.
    """
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    first, last = F.floor(F.col("start") / (scope + 1)), F.floor((F.col("end") - 1) / (scope + 1))
    weak = parts.filter(F.col("kind").isin(list(NEEDS))).withColumn("bucket", F.explode(F.sequence(first, last))).withColumn("role", F.explode(F.element_at(needs, F.col("kind"))))
    other = parts.select(
        *key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.element_at(roles, F.col("kind")).alias("role"),
        F.explode(F.sequence(first - 1, last + 1)).alias("bucket"),
    ).filter(F.col("role") != "place")
    apart = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    overlap = (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    met = weak.join(other, [*key, "role", "bucket"]).filter((apart <= scope) & ~overlap).select(*key, "start", "end", "kind", "role").distinct()
    want = F.element_at(F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.lit(len(v)))]), F.col("kind"))
    return met.groupBy(*key, "start", "end", "kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == want).drop("n")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """Adds ``base`` and ``found``, the base spans and all spans of each row; other columns but the text are kept out.

    Returns `id_col`, ``text_key`` (a digest of the text), ``base`` and ``found``, one row for each row of `docs`.
    A null or empty text has no spans; a null id is an id like any other; repeated rows get equal spans, since parts
    are joined by id and text digest; an empty table gives an empty result. Extra columns cannot clash: only the two
    named are read.
    """
    t, ident = F.coalesce(F.col("t"), F.lit("")), "i"
    rows = docs.select(F.col(id_col).alias(ident), F.col(text_col).alias("t")).select(ident, t.alias("t"))
    none = F.array().cast(SPAN)
    gated = rows.withColumn("g", gates(F.col("t")))
    base = F.concat(*[F.when(F.col(f"g.{k}"), spans(F.col("t"), p, k, least)).otherwise(none) for k, p, least in (("assign", ASSIGN, 8), ("access", ACCESS, 0), ("hex", HEX, 0))])
    weak = F.concat(*[spans(F.col("t"), p, k) for k, p in WEAK.items()])
    raw = gated.select(
        ident, F.when(some_part(F.col("g")), F.sha2("t", 256)).otherwise(F.lit("")).alias("text_key"),
        base.alias("base"), F.when(F.col("g.weak"), weak).otherwise(none).alias("weak"),
    )
    apart = F.when(F.size("weak") > 0, clear_of(F.col("weak"), F.col("base"))).otherwise(none)
    found = written(raw.withColumn("weak", apart), "secrets")
    key = ["text_key"]
    parts = found.filter(F.size("weak") > 0).select("text_key", F.concat("base", "weak").alias("p")).dropDuplicates(["text_key"]).select("text_key", F.explode("p").alias("p")).select("text_key", "p.*")
    extra = linked(parts, key, scope).groupBy("text_key").agg(F.collect_list(F.struct("start", "end", F.concat(F.lit("link_"), F.col("kind")).alias("kind"))).cast(SPAN).alias("extra"))
    kinds = [*BASE_KINDS, *LINK_KINDS]
    alone = found.filter(F.size("weak") == 0).withColumn("extra", none)
    out = found.filter(F.size("weak") > 0).join(extra, "text_key", "left").select(*alone.columns).unionByName(alone)
    return out.select(F.col(ident).alias(id_col), "text_key", ordered(F.col("base"), kinds).alias("base"), ordered(F.concat("base", F.coalesce("extra", none)), kinds).alias("found"))


def merged(spans_: Column) -> Column:
    """Spans in order, those that touch or overlap made one: structs of start and end."""
    def joined(y: Column) -> Column:
        def heads(ends: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(y) - 1), lambda i: (i == 0) | (F.get(y, i)["start"] > F.get(ends, i - 1)))
            return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(y, i)["start"].alias("start"), F.get(ends, F.coalesce(F.get(f, k + 1), F.size(y)) - 1).alias("end"))))

        return let(scanned(F.transform(y, lambda s: s["end"]), F.greatest), heads)

    return let(F.array_sort(spans_), joined)


def masked(text: Column, spans_: Column, mask: str) -> Column:
    """`text` with `mask` for each of `spans_`, of which there is at least one.

    A text is cut at every so many spans first, as many as the root of their number, and each part at its own spans, so
    that a position is sought within one part only.
    """
    def cut(t: Column, first: Column, spans__: Column) -> Column:
        """The text from position `first` to the end of the last span, masked."""
        return F.array_join(F.transform(spans__, lambda s, i: let(F.when(i == 0, first).otherwise(F.get(spans__, i - 1)["end"]), lambda at: F.concat(F.substr(t, (at - first + 1).cast("int"), (s["start"] - at).cast("int")), F.lit(mask)))), "")

    def parts(m: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(m))).cast("int")

        def part(k: Column) -> Column:
            some, first = F.slice(m, k * width + 1, width), F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(m, k * width - 1)["end"])
            return let(F.struct(some.alias("some"), first.alias("first")), lambda p: let(
                F.substr(text, (p["first"] + 1).cast("int"), (F.element_at(p["some"], -1)["end"] - p["first"]).cast("int")), lambda t: cut(t, p["first"], p["some"])
            ))

        body = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / width).cast("int")), part), "")
        return F.concat(body, F.substr(text, (F.element_at(m, -1)["end"] + 1).cast("int")))

    return let(merged(spans_), parts)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300, mask: str = "[secret]") -> DataFrame:
    """`docs` with every span of `scan` replaced by `mask`; overlapping spans become one.

    Rows, columns and clean texts stay as they are; a null text stays null, an empty one empty. Only rows with a part are
    shuffled, by a digest of the text, so null ids and repeated rows are rows like others. Names of helper columns give
    way to those of `docs`; an empty table stays empty; a text of any length is masked whole.
    """
    found = scan(docs, id_col, text_col, scope).filter(F.size("found") > 0).select("text_key", "found").dropDuplicates(["text_key"])
    key, spans_ = free_name(docs, "key"), free_name(docs, "found")
    text = F.col(text_col)
    some = some_part(gates(F.coalesce(text, F.lit(""))))
    joined = docs.filter(some).withColumn(key, F.sha2(text, 256)).join(found.select(F.col("text_key").alias(key), F.col("found").alias(spans_)), key, "left")
    return joined.withColumn(text_col, F.when(F.col(spans_).isNotNull(), masked(text, F.col(spans_), mask)).otherwise(text)).select(*docs.columns).unionByName(docs.filter(~some))
