"""Deterministic subsets and samples."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.scalars import UNITS, draw_key, json_kind, number_key, slot

MAX_CLAUSES, MAX_VALUES = 64, 256


def clause(df: DataFrame, field: str, op: str, value=None) -> Column:
    """exists, missing, is_null, eq, in, lt, lte, gt, gte; number tests hold for numbers only and never fail."""
    there = field in df.columns
    if op in ("exists", "missing"):
        return F.lit(there == (op == "exists"))
    if not there:
        return F.lit(False)
    c, t = F.col(f"`{field}`"), df.schema[field].dataType
    number = isinstance(t, T.NumericType)
    if op == "is_null":
        return c.isNull()

    def same(v) -> Column:
        if v is None:
            return c.isNull()
        fits = isinstance(v, bool) if isinstance(t, T.BooleanType) else isinstance(v, (int, float)) and not isinstance(v, bool) if number else isinstance(v, str) and isinstance(t, T.StringType)
        return F.coalesce(c == F.lit(v), F.lit(False)) if fits else F.lit(False)

    if op == "eq":
        return same(value)
    if op == "in":
        if len(value) > MAX_VALUES:
            raise ValueError(f"at most {MAX_VALUES} values")
        out = F.lit(False)
        for v in value:
            out = out | same(v)
        return out
    tests = {"lt": c.__lt__, "lte": c.__le__, "gt": c.__gt__, "gte": c.__ge__}
    if op not in tests:
        raise ValueError(f"no test {op}")
    return F.coalesce(tests[op](F.lit(value)), F.lit(False)) if number else F.lit(False)


def record_clause(field: str, op: str, value=None, text: str = "text", record: str = "value") -> Column:
    """The same tests on JSON records (their text, and the parsed variant): a field is there where the record has it, null or not, and counts by the type it has in that record."""
    place = "$['%s']" % field.replace("'", "\\'")
    there = F.coalesce(F.array_contains(F.json_object_keys(text), field), F.lit(False))
    kind = json_kind(F.schema_of_variant(F.try_variant_get(record, place, "variant")))
    if op in ("exists", "missing"):
        return there if op == "exists" else ~there
    no = F.lit(False)
    if op == "is_null":
        return there & F.coalesce(kind == "null", no)
    shown = F.try_variant_get(record, place, "string")

    def same(v) -> Column:
        if v is None:
            return there & F.coalesce(kind == "null", no)
        if isinstance(v, bool):
            return F.coalesce((kind == "boolean") & (shown == str(v).lower()), no)
        if isinstance(v, (int, float)):
            return F.coalesce((kind == "number") & (number_key(shown) == number_key(F.lit(repr(v)))), no)
        return F.coalesce((kind == "string") & (shown == v), no)

    if op == "eq":
        return same(value)
    if op == "in":
        if len(value) > MAX_VALUES:
            raise ValueError(f"at most {MAX_VALUES} values")
        return functools.reduce(lambda a, v: a | same(v), value, no)
    number = F.when(kind == "number", F.try_variant_get(record, place, "decimal(38,18)"))
    wide = F.when(kind == "number", F.try_variant_get(record, place, "double"))
    tests = {"lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
    if op not in tests:
        raise ValueError(f"no test {op}")
    exact = F.lit(repr(value)).try_cast("decimal(38,18)")
    return F.coalesce(getattr(number, tests[op])(exact), getattr(wide, tests[op])(F.lit(float(value))), no)


def subset_records(lines: DataFrame, clauses: list[tuple]) -> DataFrame:
    """Lines of inspection that are records and meet all clauses."""
    if len(clauses) > MAX_CLAUSES:
        raise ValueError(f"at most {MAX_CLAUSES} clauses")
    lines = lines.where("kind = 'object'")
    for c in clauses:
        lines = lines.where(record_clause(*c))
    return lines


def subset(df: DataFrame, clauses: list[tuple]) -> DataFrame:
    """Rows that meet all clauses (field, op[, value])."""
    if len(clauses) > MAX_CLAUSES:
        raise ValueError(f"at most {MAX_CLAUSES} clauses")
    for c in clauses:
        df = df.where(clause(df, *c))
    return df


def sample(df: DataFrame, id_col: str, seed: str, rate: int) -> DataFrame:
    """The rows whose slot lies below rate of 10,000; the full rate keeps all."""
    return df if rate >= UNITS else df.where(slot(draw_key("sample", seed, F.col(id_col))) < rate)
