"""Pipelines: planned from a YAML file, applied phase by phase with a journal, so that a broken run is taken up where it stopped."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tributary.operators import export, policy, records
from tributary.plans.control import ControlError, artifact_id, publish_text, table_id
from tributary.plans.documents import parse_pipeline
from tributary.plans.sqlpolicy import transform
from tributary.plans.workspace import Workspace
from tributary.sources import readers, sinks

#: The phases of an application, in order; each has a journal record once it is done.
PHASES = ("planned", "transformed", "revision_prepared", "prepared", "head_committed", "delivery_committed", "completed")


def _input(spark: SparkSession, base: Path, x: dict) -> DataFrame:
    path = str(base / x["path"])
    if x["format"] == "csv":
        return readers.read_csv(spark, [path], empty_as_null=True)
    return readers.read_parquet(spark, [path]) if x["format"] == "parquet" else readers.read_jsonl(spark, [path])


def plan(spark: SparkSession, config: str, path: str) -> dict:
    """Check a pipeline file and record it with the identity of its inputs."""
    spec, base = parse_pipeline(Path(config).read_text()), Path(config).resolve().parent
    inputs = {x["alias"]: table_id(_input(spark, base, x)) for x in spec["inputs"]}
    body = {"spec": spec, "base": str(base), "inputs": inputs}
    body["plan_id"] = artifact_id("pipeline", body)
    publish_text(path, json.dumps(body, sort_keys=True))
    return body


class Application:
    """The application of an accepted plan; apply() may be called again after any failure."""

    def __init__(self, spark: SparkSession, path: str, accept: str):
        self.spark, self.body = spark, json.loads(Path(path).read_text())
        if self.body["plan_id"] != accept:
            raise ControlError("PLAN_NOT_ACCEPTED", accept)
        self.spec, self.base = self.body["spec"], Path(self.body["base"])
        self.journal = Path(f"{path}.journal")
        self._done("planned", {"plan_id": accept})

    def _done(self, phase: str, facts: dict) -> dict:
        publish_text(self.journal / f"{PHASES.index(phase)}-{phase}.json", json.dumps(facts, sort_keys=True))
        return facts

    def facts(self, phase: str) -> dict | None:
        path = self.journal / f"{PHASES.index(phase)}-{phase}.json"
        return json.loads(path.read_text()) if path.exists() else None

    def phase(self) -> str:
        """The last phase done."""
        return [p for p in PHASES if self.facts(p) is not None][-1]

    def _workspace(self) -> Workspace:
        root, t = str(self.base / self.spec["target"]["state"]), self.spec["transform"]
        if self.spec["target"]["mode"] == "create" or not (Path(root) / "workspace.json").exists():
            return Workspace.init(self.spark, root, t["id_field"])
        return Workspace(self.spark, root)

    def apply(self) -> dict:
        """Run what is left of the phases; returns the receipt."""
        if self.facts("completed"):
            return self.facts("completed")
        spec, spark, t, e = self.spec, self.spark, self.spec["transform"], self.spec["export"]
        work = self._workspace()
        if not self.facts("transformed"):
            tables = {x["alias"]: _input(spark, self.base, x) for x in spec["inputs"]}
            for alias, df in tables.items():
                if table_id(df) != self.body["inputs"][alias]:
                    raise ControlError("INPUT_CHANGED", alias)
            out = transform(spark, t["sql"], tables, t["id_field"], t["params"] or None)
            sinks.check_output(out, t["id_field"])
            self._done("transformed", {"table": work.put(out), "base": work.revisions.head()})
        table, base = (self.facts("transformed")[k] for k in ("table", "base"))
        rows = work.get(table)
        if not self.facts("revision_prepared"):
            rules = spec["policy"]
            if rules:
                before = work.materialize(base) if base else None
                gate = records.changed(before, rows, t["id_field"]) if rules["mode"] == "changed_only" and before is not None else None
                found = policy.evaluate(rows, t["id_field"], rules["rules"], gate)
                if not found.isEmpty():
                    raise ControlError("QUALITY", f"{found.count()} findings")
            self._done("revision_prepared", {"table": table})
        target = str(self.base / spec["output"])
        if not self.facts("prepared"):
            assigned = export.assign(rows, t["id_field"], e["seed"], e["weights"])
            sharded = export.shard(assigned, t["id_field"], e["max_records"])
            staged = f"{target}.prepared-{self.body['plan_id'][-12:]}"
            if not sinks.exists(spark, staged):
                sinks.write_bundle(sharded, t["id_field"], staged)
            self._done("prepared", {"staged": staged})
        if not self.facts("head_committed"):
            if work.revisions.head() != base and (work.revisions.head() is None or work.revisions.show(work.revisions.head())["content"] != {"table": table}):
                raise ControlError("HEAD_MOVED", str(work.revisions.head()))
            head = work.revisions.head() if work.revisions.head() != base else work.revisions.commit({"table": table}, spec["name"], base)
            self._done("head_committed", {"revision": head})
        if not self.facts("delivery_committed"):
            staged = self.facts("prepared")["staged"]
            if sinks.exists(spark, staged):
                fs, path = sinks._path(spark, target)
                if fs.exists(path) or not fs.rename(sinks._path(spark, staged)[1], path):
                    raise ControlError("OUTPUT_EXISTS", target)
            self._done("delivery_committed", {"output": target})
        manifest = sinks.read_manifest(spark, target)
        body = {"plan_id": self.body["plan_id"], "table": table, "revision": self.facts("head_committed")["revision"], "output": target, "bundle": table_id(manifest)}
        body["receipt_id"] = artifact_id("receipt", body)
        return self._done("completed", body)


def info(path: str) -> dict:
    """Phase and receipt of a plan's application, without touching data."""
    done = sorted(p.stem for p in Path(f"{path}.journal").glob("*.json"))
    body = json.loads(Path(path).read_text())
    receipt = Path(f"{path}.journal") / f"{len(PHASES) - 1}-{PHASES[-1]}.json"
    return {"plan_id": body["plan_id"], "name": body["spec"]["name"], "phase": done[-1].partition("-")[2] if done else None, "receipt": json.loads(receipt.read_text()) if receipt.exists() else None}


def lineage(path: str, consumptions: list[str] = ()) -> list[dict]:
    """The chain of a pipeline: inputs, transform, revision, bundle, and what consumed it."""
    body, state = json.loads(Path(path).read_text()), info(path)
    chain = [{"kind": "input", "alias": a, "id": artifact_id("table", x)} for a, x in sorted(body["inputs"].items())]
    chain.append({"kind": "transform", "id": body["plan_id"], "sql": body["spec"]["transform"]["sql"]})
    if state["receipt"]:
        r = state["receipt"]
        chain += [{"kind": "revision", "id": r["revision"]}, {"kind": "bundle", "id": artifact_id("bundle", r["bundle"]), "output": r["output"]}]
        for c in consumptions:
            done = json.loads(Path(c).read_text())
            chain.append({"kind": "consumption", "id": done["receipt_id"], "split": done["split"]})
    return chain


def gc(spark: SparkSession, path: str, dry: bool = True) -> list[str]:
    """Staged bundles of a finished application that nothing needs any more."""
    facts = Path(f"{path}.journal") / f"{PHASES.index('prepared')}-prepared.json"
    if not facts.exists() or not info(path)["receipt"]:
        return []
    staged = json.loads(facts.read_text())["staged"]
    if not sinks.exists(spark, staged):
        return []
    if not dry:
        fs, p = sinks._path(spark, staged)
        fs.delete(p, True)
    return [staged]
