"""Text, URL and signature functions, all built from SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(value: Column) -> Column:
    """Whether a textual or boolean flag is true; missing is false."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def param_signature(types: Column) -> Column:
    """Parameter types joined by a comma and a space, ``_`` for none."""
    return F.coalesce(F.nullif(F.array_join(types, ", "), F.lit("")), F.lit("_"))


def method_key(name: Column, params: Column) -> Column:
    """``name(sorted,types)``, or the bare name where no types are given; null without a name.

    Types are separated by commas; braces around them are dropped, and of an entry ``name = "Type"`` the type counts.
    """
    given = F.split(F.translate(params, "{}", ""), ",")
    typed = lambda x: F.when(x.contains("="), F.trim(F.replace(F.regexp_replace(x, "^[^=]*=", ""), F.lit('"'), F.lit("")))).otherwise(x)
    parts = F.array_sort(F.transform(F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: x != ""), typed))
    none = params.isNull() | (params == "") | (params == "{}")
    return F.when(none, name).otherwise(F.concat(name, F.lit("("), F.array_join(parts, ","), F.lit(")")))


def lossy_params(params: Column) -> Column:
    """Parameter types as the line format keeps them: up to the first comma."""
    return F.split(params, ",")[0]


def identifier(name: Column) -> Column:
    return F.translate(name, ".-", "__")


def repository_url(url: Column, hosts: list[str] | None = None) -> Column:
    """The normalised URL of an acceptable repository address, else null.

    Acceptable: https, no port but 443, no user, query or fragment, exactly two path segments; ``.git`` is dropped.
    """
    t = F.trim(url)
    m = [F.regexp_extract(t, r"^(?i:https)://([A-Za-z0-9.-]+)(?::443)?/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?i:\.git)?/?$", i) for i in (1, 2, 3)]
    ok = (m[0] != "") & (m[2] != "")
    if hosts:
        ok &= F.lower(m[0]).isin(hosts)
    return F.when(ok, F.concat(F.lit("https://"), F.lower(m[0]), F.lit("/"), m[1], F.lit("/"), m[2]))


def language_of(path: Column) -> Column:
    """The language of a file by its extension."""
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(ext == "java", "JAVA").when(ext == "py", "PYTHON").when(ext.isin("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx"), "CPP")
