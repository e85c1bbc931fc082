"""One-line tasks end to end: planned, authorised once, run to a bundle, and resumed where they stopped."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from tributary.plans import dsl
from tributary.plans.control import ControlError, artifact_id, publish_text, table_id
from tributary.sources import sinks

STATES = ("planned", "authorized", "written", "completed")


def _rows(spark: SparkSession, text: str):
    return dsl.run_task(spark, text)


def _id(text: str) -> str:
    task = dsl.compile_task(text)
    return task.id_field or task.group or (dsl.RESERVED if task.source_id == "auto" else task.source_id)


def plan(spark: SparkSession, text: str, folder: str) -> dict:
    """What a task would give: its compiled form, its rows' identity; nothing is written but the plan."""
    task = dsl.compile_task(text)
    rows = _rows(spark, text)
    body = {"task": text, "splits": task.splits, "id_field": _id(text), "result": table_id(rows)}
    body["plan_id"] = artifact_id("run", body)
    publish_text(Path(folder) / "plan.json", json.dumps(body, sort_keys=True))
    return body


def _plan(folder: str) -> dict:
    path = Path(folder) / "plan.json"
    if not path.exists():
        raise ControlError("NO_PLAN", folder)
    return json.loads(path.read_text())


def authorize(folder: str, plan_id: str) -> dict:
    """Accept a plan by its id; what runs afterwards is that plan and no other."""
    if _plan(folder)["plan_id"] != plan_id:
        raise ControlError("PLAN_NOT_ACCEPTED", plan_id)
    body = {"plan_id": plan_id}
    publish_text(Path(folder) / "authorization.json", json.dumps(body, sort_keys=True))
    return body


def state(folder: str) -> str:
    names = {"authorized": "authorization.json", "completed": "receipt.json"}
    found = "planned"
    for s, n in names.items():
        if (Path(folder) / n).exists():
            found = s
    return found


def resume(spark: SparkSession, folder: str, target: str) -> dict:
    """Run an authorised plan, or take up a run that broke; a finished one gives its receipt again."""
    body, done = _plan(folder), Path(folder) / "receipt.json"
    if done.exists():
        return json.loads(done.read_text())
    if not (Path(folder) / "authorization.json").exists():
        raise ControlError("NOT_AUTHORIZED", body["plan_id"])
    rows = _rows(spark, body["task"])
    if table_id(rows) != body["result"]:
        raise ControlError("RESULT_CHANGED", "the source is not that of the plan")
    if not sinks.exists(spark, target):
        sinks.write_bundle(rows, body["id_field"], target)
    manifest = sinks.read_manifest(spark, target)
    receipt = {"plan_id": body["plan_id"], "output": target, "bundle": table_id(manifest), "records": sum(r["records"] for r in manifest.select("records").collect())}
    receipt["receipt_id"] = artifact_id("receipt", receipt)
    publish_text(done, json.dumps(receipt, sort_keys=True))
    return receipt
