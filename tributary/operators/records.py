"""Keyed records: profiles, id health, diffs, changed sets, field patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.scalars import content_hash

_KINDS = {"string": "string", "boolean": "boolean"}


def profile_fields(df: DataFrame) -> DataFrame:
    """(field, kind, present, nulls, empty_strings): one pass of conditional counts, then one row a field."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        parts.append(F.struct(F.lit(name).alias("field"), F.lit(_KINDS.get(kind, "number")).alias("kind"), F.count(c).alias("present"), F.count_if(c.isNull()).alias("nulls"), (F.count_if(c == "") if kind == "string" else F.lit(0).cast("bigint")).alias("empty_strings")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def id_health(df: DataFrame, id_col: str) -> DataFrame:
    """records, null_ids, blank_ids, duplicate_ids (occurrences after the first)."""
    text = F.col(id_col).cast("string")
    per = df.groupBy(text.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    good = F.col("k").isNotNull() & (F.trim("k") != "")
    return per.agg(
        F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(F.trim("k") == "", F.col("n"))), F.lit(0)).alias("blank_ids"),
        F.coalesce(F.sum(F.when(good, F.col("n") - 1)), F.lit(0)).alias("duplicate_ids"),
    )


def index(df: DataFrame, id_col: str, line_col: str | None = None) -> DataFrame:
    """(rid, content, line) of each record."""
    names = [c for c in df.columns if c != line_col]
    line = F.col(line_col).cast("bigint") if line_col else F.lit(None).cast("bigint")
    return df.select(F.col(id_col).cast("string").alias("rid"), content_hash(*names).alias("content"), line.alias("line"))


def diff(before: DataFrame, after: DataFrame, id_col: str, line_col: str | None = None) -> DataFrame:
    """(rid, change): added, removed, modified, moved (only the line differs), unchanged; one full outer join on the id."""
    a, b = index(before, id_col, line_col).alias("a"), index(after, id_col, line_col).alias("b")
    change = F.when(F.col("a.rid").isNull(), "added").when(F.col("b.rid").isNull(), "removed").when(F.col("a.content") != F.col("b.content"), "modified").when(~F.col("a.line").eqNullSafe(F.col("b.line")), "moved").otherwise("unchanged")
    return a.join(b, F.col("a.rid") == F.col("b.rid"), "full_outer").select(F.coalesce("a.rid", "b.rid").alias("rid"), change.alias("change"))


def changed(before: DataFrame, after: DataFrame, id_col: str) -> DataFrame:
    """Ids of after that are new or whose content differs."""
    a, b = index(before, id_col).select(F.col("rid").alias("_r"), F.col("content").alias("_c")), index(after, id_col)
    return b.join(a, (F.col("rid") == F.col("_r")) & (F.col("content") == F.col("_c")), "left_anti").select("rid")


def patch(df: DataFrame, id_col: str, rid: str, field: str, before, after) -> DataFrame:
    """Set one field of one record (None removes its value), where it still holds the value seen before; the id can't be changed."""
    if field == id_col:
        raise ValueError("the id field is fixed")
    hit = (F.col(id_col).cast("string") == rid) & F.col(field).eqNullSafe(F.lit(before))
    return df.withColumn(field, F.when(hit, F.lit(after)).otherwise(F.col(field)))


def diff_checked(before: DataFrame, after: DataFrame, id_col: str, line_col: str | None = None) -> DataFrame:
    """diff, where both sides have ids that are neither null nor blank nor repeated; else an error."""
    for side, df in (("before", before), ("after", after)):
        seen = id_health(df, id_col).first()
        if seen["null_ids"] or seen["blank_ids"] or seen["duplicate_ids"]:
            raise ValueError(f"{side}: ids are null, blank or repeated")
    return diff(before, after, id_col, line_col)


def locate(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """(finding_id, rid, line) of every record that a finding names."""
    named = findings.select("finding_id", F.explode("sample_ids").alias("rid"))
    return named.join(facts, "rid").select("finding_id", "rid", "line")
