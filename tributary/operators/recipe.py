"""Recipes: ordered row steps over one table, as one lazy plan.

Steps run in the written order on every row that is still alive. A bad value
must fail the recipe even where a later filter would drop its row, so rows carry
``__alive`` and ``__error`` instead of being filtered on the way, and Catalyst
fuses all narrow steps into one pass; dedupe is the only shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tributary.functions.scalars import missing

MAX_STEPS, MAX_FIELDS = 64, 1024
_BLANK = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
_NUMBER = r"^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"


class RecipeError(ValueError):
    pass


def _kind(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    return "string" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "number"


@dataclass
class State:
    """A table on its way through the steps; order gives rows their source order."""

    df: DataFrame
    fields: list[str]
    order: list[Column] = field(default_factory=list)

    def set(self, name: str, value: Column, error: Column | None = None, what: str = "") -> None:
        live = F.col("__alive") & F.col("__error").isNull()
        cols = {name: value}
        if error is not None:
            cols["__error"] = F.when(live & error, F.lit(what)).otherwise(F.col("__error"))
        self.df = self.df.withColumns(cols)

    def kill(self, keep: Column, counter: str, error: Column | None = None, what: str = "") -> None:
        live = F.col("__alive") & F.col("__error").isNull()
        cols = {"__alive": F.col("__alive") & (F.coalesce(keep, F.lit(False)) | ~live), counter: F.col(counter) | (live & ~F.coalesce(keep, F.lit(False)))}
        if error is not None:
            cols["__error"] = F.when(live & F.coalesce(error, F.lit(False)), F.lit(what)).otherwise(F.col("__error"))
        self.df = self.df.withColumns(cols)


def _need(fields: list[str], names: list[str], step: int) -> None:
    lost = [n for n in names if n not in fields]
    if lost:
        raise RecipeError(f"step {step}: no field {', '.join(lost)}")


def _compare(s: State, name: str, op: str, value) -> tuple[Column, Column]:
    """(condition, type error): texts bytewise, numbers by value, false before true; a text cell is read as the literal's type."""
    c, kind = F.col(f"`{name}`"), _kind(s.df, name)
    ops = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
    if op not in ops:
        raise RecipeError(f"no predicate {op}")
    apply = lambda a, b: getattr(a, ops[op])(b)
    no = F.lit(False)
    if value is None:  # '' equals null, any other value is greater
        rank = F.when(missing(c, kind), 0).otherwise(1)
        return apply(rank, F.lit(0)), no
    if isinstance(value, bool):
        read = c if kind == "boolean" else F.when(c == "true", True).when(c == "false", False) if kind == "string" else F.lit(None).cast("boolean")
        return apply(read, F.lit(value)), read.isNull()
    if isinstance(value, (int, float)):
        if kind == "number":
            return apply(c, F.lit(value)), c.isNull()
        read = F.when(c.rlike(_NUMBER), c.try_cast("double")) if kind == "string" else F.lit(None).cast("double")
        # digits are compared exactly where both sides fit 20 of them before and 18 behind the point
        exact, want = F.when(c.rlike(_NUMBER), c.try_cast("decimal(38,18)")), F.lit(str(value)).try_cast("decimal(38,18)")
        same = F.lit(str(value)).try_cast("decimal(38,18)").cast("double") == F.lit(float(value))
        return F.when(exact.isNotNull() & want.isNotNull() & same, apply(exact, want)).otherwise(apply(read, F.lit(value))), read.isNull()
    read = c if kind == "string" else F.lit(None).cast("string")
    return apply(read, F.lit(value)), read.isNull()


def _cast(c: Column, to: str) -> Column:
    """Strict reading of a text; null where it can't be read."""
    if to == "string":
        return c
    if to == "integer":
        return F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("bigint"))
    if to == "number":
        return F.when(c.rlike(_NUMBER), c.try_cast("double"))
    if to == "boolean":
        return F.when(c == "true", True).when(c == "false", False)
    raise RecipeError(f"no type {to}")


def _same(c: Column, kind: str, value) -> Column:
    """Whole-value equality of one type."""
    if value is None:
        return c.isNull()
    fits = {"string": str, "boolean": bool, "number": (int, float)}[kind]
    if not isinstance(value, fits) or (kind == "number" and isinstance(value, bool)):
        return F.lit(False)
    return F.coalesce(c == F.lit(value), F.lit(False))


def run_step(s: State, step: dict, number: int) -> None:
    op, df = step["op"], s.df
    names = list(step.get("fields") or ([step["field"]] if "field" in step else []) or step.get("by") or [])
    _need(s.fields, names, number)
    if op == "select":
        s.fields = names
    elif op == "rename":
        old, new = step["from"], step["to"]
        _need(s.fields, [old], number)
        if old != new:
            if new in s.fields:
                raise RecipeError(f"step {number}: {new} exists")
            s.df = df.drop(new).withColumnRenamed(old, new)
            s.fields = [new if f == old else f for f in s.fields]
    elif op == "filter":
        keep, bad = _compare(s, names[0], step["predicate"], step.get("value"))
        s.kill(keep, "__filtered", bad, f"step {number}: {names[0]} can't be compared")
    elif op == "cast":
        for n in names:
            if _kind(df, n) != "string":
                raise RecipeError(f"step {number}: {n} is no text")
            value = _cast(F.col(f"`{n}`"), step["to"])
            s.set(n, value, value.isNull(), f"step {number}: {n} is no {step['to']}")
    elif op in ("trim", "case"):
        for n in names:
            if _kind(df, n) != "string":
                raise RecipeError(f"step {number}: {n} is no text")
            c = F.col(f"`{n}`")
            s.set(n, F.regexp_replace(c, _BLANK, "") if op == "trim" else F.lower(c) if step["mode"] == "lower" else F.upper(c), c.isNull(), f"step {number}: {n} is null")
    elif op == "replace":
        n = names[0]
        c = F.col(f"`{n}`")
        s.set(n, F.when(_same(c, _kind(df, n), step["from"]), F.lit(step["to"])).otherwise(c))
    elif op == "fill":
        for n in names:
            c = F.col(f"`{n}`")
            s.set(n, F.when(missing(c, _kind(df, n)), F.lit(step["value"])).otherwise(c))
    elif op == "drop_missing":
        gone = [missing(F.col(f"`{n}`"), _kind(df, n)) for n in names]
        cond = gone[0]
        for g in gone[1:]:
            cond = cond | g if step.get("mode", "any") == "any" else cond & g
        s.kill(~cond, "__filtered")
    elif op == "dedupe":
        live = F.col("__alive") & F.col("__error").isNull()
        w = Window.partitionBy(live, *(F.col(f"`{n}`") for n in names)).orderBy(*s.order)
        s.df = df.withColumn("__first", F.row_number().over(w) == 1)
        if step.get("keep", "first") == "error":
            s.set("__first", F.col("__first"), ~F.col("__first"), f"step {number}: repeated {', '.join(names)}")
        s.kill(F.col("__first"), "__repeated")
        s.df = s.df.drop("__first")
    else:
        raise RecipeError(f"step {number}: no operation {op}")


def prepare(df: DataFrame, steps: list[dict], order: list[Column | str]) -> DataFrame:
    """All rows with __alive, __error, __filtered, __repeated after the steps; fields are checked before any row is read."""
    if len(steps) > MAX_STEPS or len(df.columns) > MAX_FIELDS:
        raise RecipeError("too many steps or fields")
    s = State(df.withColumns({"__alive": F.lit(True), "__error": F.lit(None).cast("string"), "__filtered": F.lit(False), "__repeated": F.lit(False), **{f"__order{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}}), list(df.columns), [F.col(f"__order{k}") for k in range(len(order))])
    for k, step in enumerate(steps, 1):
        run_step(s, step, k)
    return s.df.select(*(f"`{f}`" for f in s.fields), "__alive", "__error", "__filtered", "__repeated")


def apply_recipe(df: DataFrame, steps: list[dict], order: list[Column | str], strict: bool = True, id_field: str | None = None) -> DataFrame:
    """Rows that survive the steps. strict: one aggregate pass first, which raises on the first bad value. id_field: null or repeated ids of what survives raise too."""
    done = prepare(df, steps, order)
    if strict:
        bad = done.agg(F.min("__error")).first()[0]
        if bad:
            raise RecipeError(bad)
    out = done.where("__alive").drop("__alive", "__error", "__filtered", "__repeated")
    if id_field:
        check_unique(out, id_field)
    return out


def counters(df: DataFrame, steps: list[dict], order: list[Column | str]) -> DataFrame:
    """source_rows, output_rows, filtered_rows, duplicate_rows in one pass."""
    done = prepare(df, steps, order)
    return done.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if("__alive").alias("output_rows"), F.count_if("__filtered").alias("filtered_rows"), F.count_if("__repeated").alias("duplicate_rows"))


def check_unique(df: DataFrame, id_field: str) -> None:
    """Fail where an output id is null or repeated."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_field).alias("d")).first()
    if row["n"] != row["d"]:
        raise RecipeError(f"{id_field} is null or repeated")
