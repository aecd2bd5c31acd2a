"""Scalar parsers for keyword values, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal(s: Column) -> Column:
    """A number whose decimal mark may be a comma; null if it is none."""
    return F.regexp_replace(F.trim(s), ",", ".").try_cast("double")


def pair(s: Column) -> Column:
    """struct<a, b> of "a,b"; four parts are two numbers with decimal commas; else null."""
    p = F.split(s, ",")
    num = lambda *k: F.concat_ws(".", *(F.trim(F.get(p, F.lit(i))) for i in k)).try_cast("double")
    a = F.when(F.size(p) == 2, num(0)).when(F.size(p) == 4, num(0, 1))
    b = F.when(F.size(p) == 2, num(1)).when(F.size(p) == 4, num(2, 3))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def numbers(s: Column) -> Column:
    """Comma-separated numbers, with parentheses or without; parts that are none are left out."""
    parts = F.split(F.regexp_replace(s, r"[()]", ""), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def spillover(s: Column) -> Column:
    """struct<n, names, matrix values by rows> of "n,name1..,v11,v12.."; null if counts disagree."""
    p = F.split(F.regexp_replace(F.trim(s), r"\s*,\s*", ","), ",")
    n = F.get(p, F.lit(0)).try_cast("int")
    fits = (n > 0) & (F.size(p) == 1 + n + n * n)
    values = F.transform(F.slice(p, n + 2, n * n), lambda x: x.try_cast("double"))
    return F.when(fits, F.when(~F.exists(values, lambda x: x.isNull()), F.struct(n.alias("n"), F.slice(p, F.lit(2), n).alias("names"), values.alias("values"))))


def display(s: Column) -> Column:
    """struct<kind, low, high> of "Linear|Logarithmic,low,high"; null if malformed."""
    p = F.split(s, ",")
    low, high = decimal(F.get(p, F.lit(1))), decimal(F.get(p, F.lit(2)))
    ok = (F.size(p) == 3) & F.get(p, F.lit(0)).isin("Linear", "Logarithmic") & low.isNotNull() & high.isNotNull()
    return F.when(ok, F.struct(F.get(p, F.lit(0)).alias("kind"), low.alias("low"), high.alias("high")))


def keyword_kind(key: Column) -> Column:
    """parameter, gate, region, fixed or other, by a key's shape."""
    k = F.upper(key)
    return (
        F.when(k.rlike(r"^\$P[0-9]+[A-Z]"), "parameter").when(k.rlike(r"^\$G[0-9]+[A-Z]"), "gate")
        .when(k.rlike(r"^\$R[0-9]+[A-Z]"), "region").when(k.startswith("$") | (k == "GUID"), "fixed").otherwise("other")
    )


def keyword_number(key: Column) -> Column:
    return F.regexp_extract(key, r"^\$?[PGRpgr]([0-9]+)", 1).try_cast("int")


def keyword_suffix(key: Column) -> Column:
    return F.upper(F.regexp_extract(key, r"^\$?[PGRpgr][0-9]+(.+)$", 1))


def bytes_of_bits(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("int")
