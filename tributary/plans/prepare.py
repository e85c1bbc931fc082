"""Recipes and bounded SQL as accepted plans: what was reviewed is what is written, once, as canonical JSONL."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tributary.operators import recipe
from tributary.plans import control
from tributary.plans.documents import parse_recipe
from tributary.plans.sqlpolicy import transform
from tributary.sources import readers, sinks


def recipe_rows(spark: SparkSession, text: str, source: str) -> tuple[DataFrame, dict, dict]:
    """(rows, parsed recipe, step counters) of a recipe over a file or folder, in its files' order."""
    doc = parse_recipe(text)
    s = doc["source"]
    rows = readers.read_files(spark, source, s["format"], tuple(s.get("include", ())), tuple(s.get("ignore", ())), s.get("delimiter", ","))
    rows = readers.with_ordinals(rows, source)
    if doc["generated_source_id"]:
        rows = readers.with_row_id(rows, doc["generated_source_id"])
    order = ["_path", "_row"]
    counts = recipe.counters(rows, doc["steps"], order).first().asDict()
    out = recipe.apply_recipe(rows, doc["steps"], order, id_field=doc["id_field"])
    return out.drop("_path", "_row"), doc, counts


def plan_prepare(spark: SparkSession, text: str, source: str, path: str) -> dict:
    """Record what a recipe gives over a source: counters and the identity of its rows."""
    rows, doc, counts = recipe_rows(spark, text, source)
    facts = sinks.check_output(rows, doc["id_field"])
    return control.plan(rows, {"kind": "prepare", "recipe": text, "source": source, "counters": counts, "rows": facts["rows"]}, path)


def plan_transform(spark: SparkSession, sql: str, inputs: dict[str, str], id_field: str, path: str, params: list | None = None) -> dict:
    """The same for bounded SQL over named files or folders."""
    tables = {a: readers.read_files(spark, p) for a, p in inputs.items()}
    out = transform(spark, sql, tables, id_field, params)
    facts = sinks.check_output(out, id_field)
    return control.plan(out, {"kind": "transform", "sql": sql, "inputs": inputs, "id_field": id_field, "params": params or [], "rows": facts["rows"]}, path)


def apply(spark: SparkSession, path: str, accept: str, output: str) -> dict:
    """Run an accepted plan again, check that it still gives the same rows, and write them; a retry of a finished one gives its receipt."""
    body = json.loads(Path(path).read_text())
    if body["plan_id"] != accept:
        raise control.ControlError("PLAN_NOT_ACCEPTED", accept)
    spec = body["spec"]
    if spec["kind"] == "prepare":
        rows, doc, _ = recipe_rows(spark, spec["recipe"], spec["source"])
        id_field = doc["id_field"]
    else:
        rows = transform(spark, spec["sql"], {a: readers.read_files(spark, p) for a, p in spec["inputs"].items()}, spec["id_field"], spec["params"] or None)
        id_field = spec["id_field"]
    if control.table_id(rows) != body["result"]:
        raise control.ControlError("RESULT_CHANGED", "the inputs are not those of the plan")
    facts = sinks.write_jsonl(rows, id_field, output)
    receipt = {"plan_id": accept, "output": output, "rows": facts["rows"], "bytes": facts["bytes"], "lines": [facts["line_sum"], facts["line_xor"]]}
    receipt["receipt_id"] = control.artifact_id("receipt", receipt)
    control.publish_text(f"{path}.receipt", json.dumps(receipt, sort_keys=True))
    return receipt


def info(path: str) -> dict:
    """A plan and, once it is applied, its receipt."""
    body = json.loads(Path(path).read_text())
    done = Path(f"{path}.receipt")
    return {"plan_id": body["plan_id"], "spec": body["spec"], "receipt": json.loads(done.read_text()) if done.exists() else None}
