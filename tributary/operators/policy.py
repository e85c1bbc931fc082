"""Field rules over records, their violations, and the roll-up into findings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tributary.operators.graph import beside

SAMPLES = 20
KINDS = ("string", "number", "boolean", "array", "object")
MAX_FIELDS, MAX_PATTERNS, MAX_UNIQUE = 256, 64, 4


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.ArrayType):
        return "array"
    return "object" if isinstance(t, (T.StructType, T.MapType)) else "number"


def _types(rule: dict) -> tuple[str, ...]:
    t = rule.get("type")
    return () if t is None else (t,) if isinstance(t, str) else tuple(t)


def validate(rules: dict[str, dict]) -> None:
    """Reject contradicting or oversized rule sets before any row is read."""
    if len(rules) > MAX_FIELDS or sum("pattern" in r for r in rules.values()) > MAX_PATTERNS or sum(bool(r.get("unique")) for r in rules.values()) > MAX_UNIQUE:
        raise ValueError("too many rules")
    for name, r in rules.items():
        types = _types(r)
        if ("min" in r or "max" in r) and types not in ((), ("number",)):
            raise ValueError(f"{name}: a range needs numbers")
        if "pattern" in r and types not in ((), ("string",)):
            raise ValueError(f"{name}: a pattern needs strings")
        if r.get("unique") and {"array", "object"} & set(types):
            raise ValueError(f"{name}: only scalars can be unique")
        if "min" in r and "max" in r and r["min"] > r["max"]:
            raise ValueError(f"{name}: empty range")
        if not set(types) <= set(KINDS):
            raise ValueError(f"{name}: no type {', '.join(sorted(set(types) - set(KINDS)))}")
        if "pattern" in r:
            try:
                re.compile(r["pattern"])
            except re.error as e:
                raise ValueError(f"{name}: {e}") from None
        for v in r.get("enum", ()):
            fits = {"string": isinstance(v, str), "boolean": isinstance(v, bool), "number": isinstance(v, (int, float)) and not isinstance(v, bool)}
            if not any(fits.get(t, False) for t in types or fits):
                raise ValueError(f"{name}: {v!r} is no {' or '.join(types) or 'scalar'}")


def violations(df: DataFrame, id_col: str, rules: dict[str, dict]) -> DataFrame:
    """(rid, field, code): one row for each broken rule; a wrong type stops the further rules of that value."""
    return grouped_violations(df, id_col, rules).drop("group")


def grouped_violations(df: DataFrame, id_col: str, rules: dict[str, dict]) -> DataFrame:
    """violations with group: the repeated value that a broken uniqueness is about, null for other rules."""
    validate(rules)
    codes, flagged = [], df
    none = F.lit(None).cast("string")
    for k, (name, r) in enumerate(sorted(rules.items())):
        broken = lambda code, cond, name=name, group=none: F.when(cond, F.struct(F.lit(name).alias("field"), F.lit(code).alias("code"), group.alias("group")))
        if name not in df.columns:
            if r.get("required"):
                codes.append(broken("REQUIRED", F.lit(True)))
            continue
        c, kind = F.col(f"`{name}`"), _kind(df.schema[name].dataType)
        if not r.get("nullable", True):
            codes.append(broken("NULL", c.isNull()))
        if r.get("type") and kind not in _types(r):
            codes.append(broken("TYPE", c.isNotNull()))
            continue
        if "enum" in r:
            codes.append(broken("ENUM", c.isNotNull() & ~c.isin(*r["enum"])))
        if "min" in r or "max" in r:
            low = c < r["min"] if "min" in r else F.lit(False)
            codes.append(broken("RANGE", low | (c > r["max"] if "max" in r else F.lit(False))))
        if "pattern" in r:
            codes.append(broken("PATTERN", c.isNotNull() & ~c.rlike(r["pattern"])))
        if r.get("unique"):
            counts = df.where(c.isNotNull()).groupBy(c.alias(f"_u{k}")).agg(F.count(F.lit(1)).alias(f"_n{k}")).where(F.col(f"_n{k}") > 1)
            flagged = flagged.join(counts, c == F.col(f"_u{k}"), "left")
            codes.append(broken("UNIQUE", F.col(f"_n{k}").isNotNull(), group=c.cast("string")))
    found = flagged.select(F.col(id_col).cast("string").alias("rid"), F.explode(F.array_compact(F.array(*codes))).alias("x"))
    return found.select("rid", "x.field", "x.code", "x.group")


def roll_up(found: DataFrame, changed: DataFrame | None = None, samples: int = SAMPLES) -> DataFrame:
    """(field, code, total, gated, sample_ids, truncated): a finding where a gated record breaks the rule.

    changed: only these ids gate (all do without it), and with one member of a
    group of equal values all its members (where found has their group). Totals
    count all violations; the samples are the smallest gated ids.
    """
    if changed is None:
        gate = found.withColumn("gated", F.lit(True))
    else:
        ids = changed.select(F.col("rid").alias("_rid")).distinct().withColumn("_own", F.lit(True))
        gate = found.join(ids, F.col("rid") == F.col("_rid"), "left").withColumn("gated", F.coalesce("_own", F.lit(False)))
        if "group" in found.columns:
            groups = gate.where("group is not null and gated").select(F.col("field").alias("_f"), F.col("group").alias("_g")).distinct().withColumn("_any", F.lit(True))
            gate = gate.join(beside(groups), (F.col("field") == F.col("_f")) & (F.col("group") == F.col("_g")), "left").withColumn("gated", F.col("gated") | F.coalesce("_any", F.lit(False)))
    ids = gate.where("gated").select("field", "code", "rid").distinct()
    ranked = ids.withColumn("k", F.row_number().over(Window.partitionBy("field", "code").orderBy("rid"))).where(F.col("k") <= samples)
    picked = ranked.groupBy("field", "code").agg(F.array_sort(F.collect_list("rid")).alias("sample_ids"))
    totals = gate.groupBy("field", "code").agg(F.count(F.lit(1)).alias("total"), F.count_if("gated").alias("gated")).where("gated > 0")
    return totals.join(picked, ["field", "code"]).select("field", "code", "total", "gated", "sample_ids", (F.col("gated") > F.size("sample_ids")).alias("truncated"))


def evaluate(df: DataFrame, id_col: str, rules: dict[str, dict], changed: DataFrame | None = None) -> DataFrame:
    """The findings of a policy over whole records; changed: (rid) of the records that gate."""
    return roll_up(grouped_violations(df, id_col, rules), changed)
