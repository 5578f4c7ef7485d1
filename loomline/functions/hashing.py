"""Hashes that Spark has no function for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of ASCII text as a bigint, by a fold over the characters."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(FNV_BASIS).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * FNV_PRIME).bitwiseAND(0xFFFFFFFF))


def fnv1a_udf():
    """32-bit FNV-1a over UTF-16 units, for any text."""
    from loomline.operators.metrics import fnv1a as one

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else one(t))

    return run


def quoted(c: Column) -> Column:
    """A text as a JSON string of ASCII alone: other characters are escaped by their UTF-16 units, in lower case."""
    hexed = lambda n: F.lower(F.lpad(F.hex(n), 4, "0"))

    def escaped(x: Column) -> Column:
        code = F.ascii(x).cast("bigint")
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        out = F.when(x.isin('"', "\\"), F.concat(F.lit("\\"), x))
        for sign, name in (("\b", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t")):
            out = out.when(x == sign, F.lit("\\" + name))
        out = out.when((code >= 32) & (code < 127), x)
        return out.when(code > 0xFFFF, F.concat(F.lit("\\u"), hexed(high), F.lit("\\u"), hexed(low))).otherwise(F.concat(F.lit("\\u"), hexed(code)))

    plain = c.rlike(r"^[ !#-\[\]-~]*$")
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(chars, escaped), "")), F.lit('"'))


def ir_id(prefix: Column | str, *parts: Column) -> Column:
    """``prefix:`` and the first 24 hex digits of the sha256 of prefix and parts as a compact JSON array of ASCII."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    array = F.concat(F.lit("["), F.concat_ws(",", *[quoted(c) for c in (head, *parts)]), F.lit("]"))
    return F.concat(head, F.lit(":"), F.substring(F.sha2(array, 256), 1, 24))


def colour_index(c: Column, colours: int = 5) -> Column:
    return fnv1a(c) % colours
