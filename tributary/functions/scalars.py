"""Scalar keys, digests, slots and comparison helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolution of sampling and split slots.
UNITS = 10_000


def typed_key(c: Column, kind: str) -> Column:
    """Scalar key that keeps types apart: b0/b1, n<number>, s<text>; null has none.

    Numbers of up to 20 integer and 18 fractional digits are equal however they
    are spelled; beyond that their text decides.
    """
    if kind == "boolean":
        return F.when(c, "b1").when(~c, "b0")
    if kind == "string":
        return F.concat(F.lit("s"), c)
    exact = c.try_cast("decimal(38,18)")
    return F.when(c.isNotNull(), F.concat(F.lit("n"), F.coalesce(exact.cast("string"), c.cast("string"))))


def record_id(c: Column) -> Column:
    """Digest of a record id; strings and numbers differ, blank strings and nulls have none."""
    text = c.cast("string")
    return F.when(F.trim(text) != "", F.sha2(F.concat(F.lit("id:"), text), 256))


def draw_key(domain: str, seed: str, rid: Column) -> Column:
    """Hash that orders and splits records: domain, length of the seed, seed, id."""
    return F.sha2(F.concat(F.lit(f"{domain}:{len(seed.encode())}:{seed}:"), rid.cast("string")), 256)


def slot(key: Column) -> Column:
    """0..9999, uniform over hex digests: the top 48 bits scaled down."""
    top = F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint")
    return F.shiftright(top * UNITS, 48).cast("int")


def missing(c: Column, kind: str) -> Column:
    """Null or, for texts, empty."""
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def content_hash(*columns: str) -> Column:
    """Digest of a record's values under their sorted names; field order and null fields do not change it."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def json_kind(shape: Column) -> Column:
    """null, boolean, number, string, array or object, of what schema_of_variant says."""
    return (
        F.when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean").when(shape == "STRING", "string").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("number")
    )


def number_key(text: Column) -> Column:
    """Equal for numbers of one value however they are spelled, at any size: digits without outer zeros, and the power of ten."""
    unsigned = F.regexp_replace(text, "^-", "")
    mantissa, power = F.regexp_extract(unsigned, "^([0-9.]+)", 1), F.regexp_extract(unsigned, "[eE]([+-]?[0-9]+)$", 1)
    fraction = F.length(F.regexp_extract(mantissa, r"\.([0-9]*)$", 1))
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    exponent = F.when(power == "", F.lit(0)).otherwise(power.try_cast("bigint")) + F.length(digits) - F.length(short) - fraction
    return F.when(short == "", "0e0").otherwise(F.concat(F.when(text.startswith("-"), "-").otherwise(""), short, F.lit("e"), exponent.cast("string")))
