"""Findings: canonical order, ids, pages, summaries and what to do about them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_PAGE, MAX_SUMMARY = 200, 50
_RANK = {"error": 0, "warning": 1, "info": 2}
# What remedies a code, and how risky that is.
REMEDIES = {
    "JSONL_POLICY_NULL": ("fill", "low"), "JSONL_POLICY_TYPE": ("cast", "medium"), "JSONL_POLICY_ENUM": ("replace", "medium"), "JSONL_POLICY_RANGE": ("inspect", "medium"),
    "JSONL_POLICY_PATTERN": ("inspect", "medium"), "JSONL_POLICY_UNIQUE": ("dedupe", "high"), "JSONL_POLICY_REQUIRED": ("fill", "low"),
    "EXACT_DUPLICATE_GROUP": ("dedupe", "high"), "CROSS_SPLIT_EXACT_LEAKAGE": ("move", "high"), "NEAR_DUPLICATE_GROUP": ("inspect", "medium"), "CROSS_SPLIT_NEAR_LEAKAGE": ("move", "high"),
    "JSONL_INVALID_RECORD": ("repair", "high"), "JSONL_MISSING_ID": ("fill", "high"), "JSONL_NULL_ID": ("fill", "high"), "JSONL_INVALID_ID": ("repair", "high"), "JSONL_DUPLICATE_ID": ("dedupe", "high"),
    "AMBIGUOUS_MATCH": ("inspect", "medium"), "LABEL_DISTRIBUTION_CHANGED": ("inspect", "medium"), "MEDIA_DISTRIBUTION_CHANGED": ("inspect", "medium"),
    "INVALID_LAYOUT": ("move", "medium"), "IMAGE_DECODE_FAILED": ("repair", "high"), "IMAGE_DECODE_SKIPPED": ("inspect", "medium"), "UNEXPECTED_CHANNELS": ("inspect", "medium"),
}
#: What each remedy asks for.
INSTRUCTIONS = {
    "fill": "give the field a value in every record named", "cast": "write the value in the type that the rule names", "replace": "use one of the values that the rule allows", "inspect": "look at the records named and decide",
    "dedupe": "keep one record of each group", "move": "put all members of a group into one split", "repair": "mend or remove the records named",
}


def with_ids(findings: DataFrame) -> DataFrame:
    """Add finding_id: a digest of the content, and the occurrence among equal ones."""
    fields = [c for c in ("severity", "code", "message", "sample_ids", "evidence") if c in findings.columns]
    digest = F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 20)
    n = F.row_number().over(Window.partitionBy("_digest").orderBy(*fields))  # equal ones differ in nothing
    return findings.withColumn("_digest", digest).withColumn("finding_id", F.concat_ws("_", F.lit("fnd"), "_digest", n.cast("string"))).drop("_digest")


def ordered(findings: DataFrame) -> DataFrame:
    rank = F.create_map(*(x for s, r in _RANK.items() for x in (F.lit(s), F.lit(r))))
    last = [c for c in ("evidence", "finding_id") if c in findings.columns]
    return findings.orderBy(rank[F.col("severity")], "code", "sample_ids", "message", *last)


def page(findings: DataFrame, offset: int = 0, limit: int = 50, severities: tuple[str, ...] = (), codes: tuple[str, ...] = ()) -> DataFrame:
    """One page in canonical order."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset 0 or more, limit 1 to {MAX_PAGE}")
    if severities:
        findings = findings.where(F.col("severity").isin(*severities))
    if codes:
        findings = findings.where(F.col("code").isin(*codes))
    return ordered(findings).offset(offset).limit(limit)


def page_with_more(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> tuple[list, bool]:
    """(rows of a page, are there more?) of anything in a total order: diffs, logs, locations."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset 0 or more, limit 1 to {MAX_PAGE}")
    rows = df.orderBy(*order).offset(offset).limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def find(findings: DataFrame, finding_id: str) -> DataFrame:
    """The finding of an id."""
    return with_ids(findings).where(F.col("finding_id") == finding_id)


def explain(findings: DataFrame, limit: int = 20, budget: int = 50_000) -> dict:
    """What a reader needs first: counts by severity and code, and the first findings that fit a budget of characters."""
    severities = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {"severities": severities, "codes": [r.asDict() for r in summary(findings).collect()], "findings": [], "truncated": sum(severities.values()) > limit}
    for r in ordered(with_ids(findings)).limit(limit).collect():
        row = r.asDict(recursive=True)
        if len(json.dumps([*out["findings"], row], default=str)) > budget:
            out["truncated"] = True
            break
        out["findings"].append(row)
    return out


def summary(findings: DataFrame) -> DataFrame:
    """(severity, code, n), most frequent codes first."""
    return findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(MAX_SUMMARY)


def remediation(findings: DataFrame) -> DataFrame:
    """(code, action, risk, n): a remedy for each code found; unknown codes are to be inspected."""
    spark = findings.sparkSession
    table = spark.createDataFrame([(c, *x) for c, x in sorted(REMEDIES.items())], "code string, action string, risk string")
    counts = findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(table), "code", "left").select("code", F.coalesce("action", F.lit("inspect")).alias("action"), F.coalesce("risk", F.lit("medium")).alias("risk"), "n")


def decision(findings: DataFrame) -> dict:
    """What to do next: seal where no error stands, fix where each error has a remedy, else inspect; with a step a code."""
    steps = [{**r.asDict(), "instruction": INSTRUCTIONS[r["action"]]} for r in remediation(findings).orderBy("code").collect()]  # one row a code
    errors = {r["code"] for r in findings.where("severity = 'error'").select("code").distinct().collect()}
    todo = [s for s in steps if s["code"] in errors]
    return {"decision": "seal" if not errors else "inspect" if any(s["action"] == "inspect" for s in todo) else "fix", "steps": steps}
