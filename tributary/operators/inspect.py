"""Inspection of raw records: what lines and ids are wrong, what fields hold, and the review that gates on it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.scalars import json_kind, number_key  # noqa: F401
from tributary.operators import policy, records
from tributary.sources.readers import with_ordinals

SHOWN, MAX_LINE, MAX_FIELDS, MAX_NAME = 20, 16 << 20, 10_000, 4096
# Item codes of an inspection, and the review code, message and counter of each structural fault.
MESSAGES = {
    "INVALID_UTF8": "line is not valid UTF-8", "INVALID_JSON": "line is not valid JSON", "NON_OBJECT_RECORD": "record must be a JSON object", "MISSING_ID": "record is missing the configured ID field",
    "NULL_ID": "record ID is null", "INVALID_ID": "record ID must be a non-empty string or a number", "DUPLICATE_ID": "record ID duplicates a prior record", "MISSING_ID_FIELD": "schema is missing the configured ID field",
}
FAULTS = (
    ("JSONL_INVALID_RECORD", "invalid_records", "JSONL contains invalid or non-object records"), ("JSONL_MISSING_ID", "missing_ids", "records are missing the configured ID field"), ("JSONL_NULL_ID", "null_ids", "record IDs contain null values"),
    ("JSONL_INVALID_ID", "invalid_ids", "record IDs must be strings or numbers"), ("JSONL_DUPLICATE_ID", "duplicate_ids", "record IDs are not unique"),
)
CHANGES = (
    ("added", "RECORD_ADDED", "records were added"), ("removed", "RECORD_REMOVED", "records were removed"), ("modified", "RECORD_MODIFIED", "record content changed"), ("moved", "RECORD_MOVED", "records moved to different physical lines"),
)


def parsed_lines(spark: SparkSession, paths: list[str], id_field: str, root: str | None = None) -> DataFrame:
    """One row a physical line: path, line (from 1), text, value (variant), state, key.

    state: ok, blank, or the code of the fault of the line or its id; key tells
    ids of one type and value apart from all others. Nothing fails on a bad line.
    """
    lines = with_ordinals(spark.read.option("lineSep", "\n").text(paths), root)
    valid = F.is_valid_utf8("value")
    text = F.when(valid, F.regexp_replace("value", "\r$", ""))
    rows = lines.select(F.col("_path").alias("path"), (F.col("_row") + 1).alias("line"), valid.alias("valid"), text.alias("text"))
    rows = rows.withColumn("blank", F.regexp_replace("text", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "") == "").withColumn("value", F.when(~F.col("blank"), F.try_parse_json("text")))
    rows = rows.withColumn("kind", json_kind(F.schema_of_variant("value")))
    there = F.array_contains(F.json_object_keys("text"), id_field)
    place = "$['%s']" % id_field.replace("'", "\\'")
    given = F.when(F.col("kind") == "object", F.try_variant_get("value", place, "variant"))
    rows = rows.withColumn("id_kind", F.when(F.col("kind") == "object", F.when(there, json_kind(F.schema_of_variant(given))).otherwise("missing"))).withColumn("id", F.try_variant_get("value", place, "string"))
    good = (F.col("id_kind") == "number") | ((F.col("id_kind") == "string") & (F.regexp_replace("id", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "") != ""))
    rows = rows.withColumn("key", F.when(good, F.when(F.col("id_kind") == "number", F.concat(F.lit("n"), number_key(F.col("id")))).otherwise(F.concat(F.lit("s"), F.col("id")))))
    alone = F.concat(F.lit("-"), "path", F.lit(":"), F.col("line").cast("string"))  # rows without a key repeat none
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy(F.coalesce("key", alone)).orderBy("path", "line")) > 1)
    state = (
        F.when(~F.col("valid"), "INVALID_UTF8").when(F.col("blank"), "blank").when(F.col("value").isNull(), "INVALID_JSON").when(F.col("kind") != "object", "NON_OBJECT_RECORD").when(F.col("id_kind") == "missing", "MISSING_ID")
        .when(F.col("id_kind") == "null", "NULL_ID").when(F.col("key").isNull(), "INVALID_ID").when(F.col("again"), "DUPLICATE_ID").otherwise("ok")
    )
    return rows.withColumn("state", state).select("path", "line", "text", "value", "kind", "state", "key")


def health(lines: DataFrame) -> DataFrame:
    """One row: records, blank_lines, invalid_records, missing_ids, null_ids, invalid_ids, duplicate_ids, findings."""
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    bad = ("INVALID_UTF8", "INVALID_JSON", "NON_OBJECT_RECORD")
    return lines.agg(
        F.count_if(~F.col("state").isin("blank", *bad)).alias("records"), n("blank").alias("blank_lines"), n(*bad).alias("invalid_records"), n("MISSING_ID").alias("missing_ids"), n("NULL_ID").alias("null_ids"),
        n("INVALID_ID").alias("invalid_ids"), n("DUPLICATE_ID").alias("duplicate_ids"), F.count_if(~F.col("state").isin("ok", "blank")).alias("findings"),
    )


def items(lines: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(path, line, code, message) of the first faults in line order."""
    message = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    return lines.where("state not in ('ok', 'blank')").orderBy("path", "line").limit(shown).select("path", "line", F.col("state").alias("code"), message[F.col("state")].alias("message"))


def field_profile(lines: DataFrame) -> DataFrame:
    """(field, present, nulls, kinds) of the top-level fields of all records, kinds sorted."""
    objects = lines.where("kind = 'object'").select("value")
    cells = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("value").outer()).select(F.col("key").alias("field"), F.col("value").alias("cell"))).select("field", json_kind(F.schema_of_variant("cell")).alias("kind"))
    return cells.groupBy("field").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("kind") == "null").alias("nulls"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def inspect_jsonl(spark: SparkSession, paths: list[str], id_field: str) -> dict:
    """What a review starts from: health, the first items, the profile of fields; files are never refused for bad lines."""
    lines = parsed_lines(spark, paths, id_field)
    profile = [r.asDict() for r in field_profile(lines).orderBy("field").limit(MAX_FIELDS).collect()]
    return {"adapter": "jsonl", "id_field": id_field, **health(lines).first().asDict(), "items": [r.asDict() for r in items(lines).collect()], "fields": profile}


def tabular_health(df: DataFrame, id_field: str) -> DataFrame:
    """One row: records, missing_ids, null_ids, invalid_ids, duplicate_ids, findings, of a table; a table without the id field misses every id and has one finding."""
    if id_field not in df.columns:
        zero = F.lit(0).cast("bigint")
        return df.agg(F.count(F.lit(1)).alias("records"), F.count(F.lit(1)).alias("missing_ids"), zero.alias("null_ids"), zero.alias("invalid_ids"), zero.alias("duplicate_ids"), F.lit(1).cast("bigint").alias("findings"))
    seen = records.id_health(df, id_field)
    return seen.select("records", F.lit(0).cast("bigint").alias("missing_ids"), "null_ids", F.col("blank_ids").alias("invalid_ids"), "duplicate_ids", (F.col("null_ids") + F.col("blank_ids") + F.col("duplicate_ids")).alias("findings"))


def inspect_table(df: DataFrame, id_field: str, source: dict) -> dict:
    """Health and profile of a CSV or Parquet table, and the recipe to start from."""
    out = {"adapter": "tabular", "id_field": id_field, **tabular_health(df, id_field).first().asDict(), "fields": [r.asDict() for r in records.profile_fields(df).orderBy("field").collect()]}
    out["recipe"] = {"kind": "prepare", "schema_version": 1, "source": source, "output": {"format": "jsonl"}, "id_field": id_field, "steps": []}
    return out


# ---- the review of a record set ----


def structural_findings(facts: DataFrame) -> DataFrame:
    """(severity, code, message, sample_ids, evidence) for each structural fault that health counts."""
    rows = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.col(name).alias("n")) for code, name, message in FAULTS))
    found = facts.select(F.explode(rows).alias("x")).where("x.n > 0")
    return found.select(F.lit("error").alias("severity"), "x.code", "x.message", F.array().cast("array<string>").alias("sample_ids"), F.to_json(F.struct(F.col("x.n").alias("count"))).alias("evidence"))


def change_findings(diff: DataFrame, bytes_changed: bool, shown: int = 100) -> DataFrame:
    """The same for what a diff (rid, change) tells; bytes_changed: do the files differ?

    A finding lists its records among the first shown changes in id order.
    """
    spark = diff.sparkSession
    table = F.broadcast(spark.createDataFrame(CHANGES, "change string, code string, message string"))
    counts = diff.groupBy("change").agg(F.count(F.lit(1)).alias("n")).join(table, "change")
    first = diff.where("change <> 'unchanged'").orderBy("rid").limit(shown).groupBy("change").agg(F.array_sort(F.collect_list("rid")).alias("sample_ids"))
    found = counts.join(first, "change", "left").select(F.lit("info").alias("severity"), "code", "message", F.coalesce("sample_ids", F.array().cast("array<string>")).alias("sample_ids"), F.to_json(F.struct(F.col("n").alias("count"))).alias("evidence"))
    same = diff.agg(F.count_if(F.col("change") != "unchanged").alias("n")).where("n = 0")
    only = same.where(F.lit(bytes_changed)).select(F.lit("info").alias("severity"), F.lit("RECORD_BYTES_ONLY_CHANGED").alias("code"), F.lit("JSONL bytes changed while canonical records remained equivalent").alias("message"), F.array().cast("array<string>").alias("sample_ids"), F.lit('{"count":1}').alias("evidence"))
    return found.union(only)


def quality_findings(rolled: DataFrame) -> DataFrame:
    """The same for the roll-up of a policy."""
    facts = F.to_json(F.struct("field", F.col("code").alias("rule"), F.col("total").alias("total_violations"), F.col("gated").alias("gated_violations"), F.col("truncated").alias("samples_truncated")))
    return rolled.select(F.lit("error").alias("severity"), F.concat(F.lit("JSONL_POLICY_"), "code").alias("code"), F.lit("record values violate the pinned quality policy").alias("message"), "sample_ids", facts.alias("evidence"))


def review_records(before: DataFrame | None, after: DataFrame, id_col: str, rules: dict | None = None, mode: str = "full", bytes_changed: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """All findings of a record set: structural faults of facts (health), changes against before, broken rules.

    mode: full gates on all records, changed_only on new and modified ones.
    """
    found = structural_findings(facts) if facts is not None else None
    add = lambda more: more if found is None else found.union(more)
    if before is not None:
        found = add(change_findings(records.diff(before, after, id_col), bytes_changed))
    if rules:
        if mode not in ("full", "changed_only") or (mode == "changed_only" and before is None):
            raise ValueError("changed_only needs the state before")
        gate = records.changed(before, after, id_col) if mode == "changed_only" else None
        found = add(quality_findings(policy.evaluate(after, id_col, rules, gate)))
    if found is None:
        raise ValueError("nothing to review")
    return found


def status(findings: DataFrame) -> str:
    """fail with any error, else pass."""
    return "fail" if not findings.where("severity = 'error'").isEmpty() else "pass"


def write_inspection(report: dict, target: str) -> None:
    """The report as sorted JSON, written once."""
    from tributary.plans.control import publish_text

    publish_text(target, json.dumps(report, sort_keys=True, ensure_ascii=False))
