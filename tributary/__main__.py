"""Command line: every command prints one JSON object and ends with 0, or 1 and an error."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

COMMANDS: dict = {}


def command(*arguments: str, **flags):
    """Register a command; arguments are positional names, flags optional ones with their defaults."""

    def put(f):
        COMMANDS[f.__name__.replace("_", "-")] = (f, arguments, flags)
        return f

    return put


def _spark():
    from tributary.session import local_session

    return local_session()


def _table(spark, path: str):
    from tributary.sources import readers

    return readers.read_files(spark, path)


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


@command("source", "id_field")
def inspect(a) -> dict:
    from tributary.operators import inspect as I
    from tributary.sources import readers

    spark = _spark()
    files = readers.list_files(a.source)
    kind = readers.infer_kind(files)
    if kind == "jsonl":
        return I.inspect_jsonl(spark, files, a.id_field)
    return I.inspect_table(_table(spark, a.source), a.id_field, {"format": kind})


@command("before", "after", "id_field", offset=0, limit=50)
def record_diff(a) -> dict:
    from tributary.operators import records
    from tributary.operators.findings import page_with_more

    spark = _spark()
    found = records.diff_checked(_table(spark, a.before), _table(spark, a.after), a.id_field)
    rows, more = page_with_more(found.where("change <> 'unchanged'"), ["rid"], int(a.offset), int(a.limit))
    return {"summary": {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}, "changes": [r.asDict() for r in rows], "has_more": more}


@command("root")
def snapshot(a) -> dict:
    from tributary.sources import readers

    files = readers.file_manifest(_spark(), a.root)
    return {"files": _rows(readers.unchanged(_spark(), a.root, files).orderBy("path"))}


@command("before", "after")
def snapshot_diff(a) -> dict:
    from tributary.operators import review
    from tributary.plans.control import artifact_id, table_id
    from tributary.sources import readers

    spark = _spark()
    before, after = (readers.file_manifest(spark, r) for r in (a.before, a.after))
    found = review.manifest_diff(before, after)
    return {"change_id": artifact_id("change", table_id(found)), "summary": review.file_changes(before, after).first().asDict(), "changes": _rows(found.where("change <> 'unchanged'").orderBy("path"))}


@command("recipe", "source", "plan")
def prepare_plan(a) -> dict:
    from tributary.plans import prepare

    return prepare.plan_prepare(_spark(), Path(a.recipe).read_text(), a.source, a.plan)


@command("sql", "id_field", "plan", input=None)
def transform_plan(a) -> dict:
    from tributary.plans import prepare

    return prepare.plan_transform(_spark(), a.sql, _inputs(a), a.id_field, a.plan)


def _inputs(a) -> dict[str, str]:
    return dict(x.split("=", 1) for x in (a.input or "").split(",") if x)


def _apply(a) -> dict:
    from tributary.plans import prepare

    return prepare.apply(_spark(), a.plan, a.plan_id, a.output)


@command("plan", "plan_id", "output")
def prepare_apply(a) -> dict:
    return _apply(a)


@command("plan", "plan_id", "output")
def transform_apply(a) -> dict:
    return _apply(a)


@command("plan")
def transform_info(a) -> dict:
    from tributary.plans import prepare

    return prepare.info(a.plan)


@command("sql", "id_field", "output", input=None)
def transform(a) -> dict:
    from tributary.plans.sqlpolicy import transform as run
    from tributary.sources import sinks

    spark = _spark()
    out = run(spark, a.sql, {k: _table(spark, v) for k, v in _inputs(a).items()}, a.id_field)
    return sinks.write_jsonl(out, a.id_field, a.output)


@command("policy", "source", "id_field", before=None)
def check(a) -> dict:
    from tributary.operators import findings, inspect as I
    from tributary.plans.documents import parse_policy

    spark, doc = _spark(), parse_policy(Path(a.policy).read_text())
    before = _table(spark, a.before) if a.before else None
    found = I.review_records(before, _table(spark, a.source), a.id_field, doc["rules"], doc["mode"])
    return {"status": I.status(found), **findings.explain(found), "plan": findings.decision(found)}


@command("view", "source", "id_field")
def view_check(a) -> dict:
    from tributary.operators import views
    from tributary.plans.control import table_id
    from tributary.plans.documents import parse_view

    doc = parse_view(Path(a.view).read_text())
    rows = views.subset(_table(_spark(), a.source), doc["clauses"])
    rows = views.sample(rows, a.id_field, doc["sample"][1], doc["sample"][0]) if doc["sample"] else rows
    return {"records": rows.count(), "identity": table_id(rows)}


@command("source", "id_field", "output", split="train=8,val=1,test=1", seed="0", max_records=10000)
def export(a) -> dict:
    from tributary.operators import export as E
    from tributary.sources import sinks

    weights = {k: float(v) for k, v in (x.split("=") for x in a.split.split(","))}
    rows = E.shard(E.assign(_table(_spark(), a.source), a.id_field, a.seed, weights), a.id_field, int(a.max_records))
    return {"shards": _rows(sinks.write_bundle(rows, a.id_field, a.output).orderBy("split", "shard"))}


@command("bundle")
def export_info(a) -> dict:
    from tributary.sources import sinks

    return {"shards": _rows(sinks.read_manifest(_spark(), a.bundle).orderBy("split", "shard"))}


@command("bundle", "split", "plan", consumer="python")
def consume_plan(a) -> dict:
    from tributary.plans.consumption import plan_consumption

    return plan_consumption(_spark(), a.bundle, a.split, a.consumer, a.plan)


@command("plan", "run_dir")
def consume_info(a) -> dict:
    from tributary.plans.consumption import Consumption

    run = Consumption(_spark(), a.plan, a.run_dir)
    return {"covered": run.covered(), "shards": len(run.plan["shards"]), "receipt": run.receipt()}


@command("task", "folder")
def run_plan(a) -> dict:
    from tributary.plans import run

    return run.plan(_spark(), a.task, a.folder)


@command("folder", "plan_id")
def run_authorize(a) -> dict:
    from tributary.plans import run

    return run.authorize(a.folder, a.plan_id)


@command("folder", "output")
def run_resume(a) -> dict:
    from tributary.plans import run

    return run.resume(_spark(), a.folder, a.output)


@command("config", "plan")
def pipeline_plan(a) -> dict:
    from tributary.plans import pipeline

    return pipeline.plan(_spark(), a.config, a.plan)


@command("plan", "plan_id")
def pipeline_apply(a) -> dict:
    from tributary.plans import pipeline

    return pipeline.Application(_spark(), a.plan, a.plan_id).apply()


@command("plan")
def pipeline_info(a) -> dict:
    from tributary.plans import pipeline

    return pipeline.info(a.plan)


@command("plan", really=False)
def pipeline_gc(a) -> dict:
    from tributary.plans import pipeline

    return {"staged": pipeline.gc(_spark(), a.plan, not a.really)}


@command("plan", consumed=None)
def lineage(a) -> dict:
    from tributary.plans import pipeline

    return {"chain": pipeline.lineage(a.plan, [x for x in (a.consumed or "").split(",") if x])}


def _workspace(root: str):
    from tributary.plans.workspace import Workspace

    return Workspace(_spark(), root)


@command("root", "id_field")
def init(a) -> dict:
    from tributary.plans.workspace import Workspace

    return Workspace.init(_spark(), a.root, a.id_field).status()


@command("root")
def status(a) -> dict:
    return _workspace(a.root).status()


@command("root", "message")
def changeset_begin(a) -> dict:
    return _workspace(a.root).begin(a.message)


@command("root", "source")
def changeset_stage(a) -> dict:
    work = _workspace(a.root)
    return work.stage(_table(work.spark, a.source))


@command("root", policy=None)
def changeset_check(a) -> dict:
    from tributary.operators import findings
    from tributary.plans.documents import parse_policy

    doc = parse_policy(Path(a.policy).read_text()) if a.policy else {"rules": None, "mode": "full"}
    return findings.explain(_workspace(a.root).check(doc["rules"], doc["mode"]))


@command("root")
def seal(a) -> dict:
    return {"revision": _workspace(a.root).seal()}


@command("root", offset=0, limit=50)
def log(a) -> dict:
    return {"revisions": _workspace(a.root).revisions.log(int(a.offset), int(a.limit))}


@command("root", "output", revision=None)
def materialize(a) -> dict:
    return _workspace(a.root).export(a.output, a.revision)


@command("root", "rid", "field", "value", "expected")
def patch(a) -> dict:
    work = _workspace(a.root)
    if not work.status()["changeset"]:
        work.begin(f"patch {a.rid}.{a.field}")
    return work.patch(a.rid, a.field, json.loads(a.value), json.loads(a.expected))


@command("root", "done")
def patch_undo(a) -> dict:
    return _workspace(a.root).undo(json.loads(a.done))


@command("root", "revision", "plan", include="", ignore="")
def import_plan(a) -> dict:
    from tributary.sources import imports

    return imports.plan_import(_spark(), a.root, a.revision, a.plan, *(tuple(x for x in v.split(",") if x) for v in (a.include, a.ignore)))


@command("plan", "plan_id", "root")
def import_apply(a) -> dict:
    from tributary.sources import imports

    return imports.apply_import(_spark(), a.plan, a.plan_id, a.root)


@command()
def capabilities(a) -> dict:
    from tributary.plans.schemas import capabilities as c

    return c()


@command()
def agent_skill(a) -> dict:
    from tributary.plans.schemas import guide

    return {"text": guide()}


@command("root")
def repository_install(a) -> dict:
    from tributary.plans.control import publish_text
    from tributary.plans.schemas import GUIDE, guide

    publish_text(Path(a.root) / GUIDE, guide())
    return {"installed": GUIDE}


@command("root")
def repository_check(a) -> dict:
    from tributary.plans.schemas import GUIDE, guide

    path = Path(a.root) / GUIDE
    return {"state": "missing" if not path.exists() else "current" if path.read_text() == guide() else "outdated"}


@command("name")
def artifact_schema(a) -> dict:
    from tributary.plans.schemas import artifact_schemas

    return artifact_schemas()[a.name]


@command("name")
def describe(a) -> dict:
    _, arguments, flags = COMMANDS[a.name]
    return {"command": a.name, "arguments": list(arguments), "options": {k: v for k, v in flags.items()}}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tributary")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments, flags) in sorted(COMMANDS.items()):
        p = sub.add_parser(name)
        for x in arguments:
            p.add_argument(x)
        for k, v in flags.items():
            flag = f"--{k.replace('_', '-')}"
            p.add_argument(flag, dest=k, **({"action": "store_true"} if v is False else {"default": v}))
    a = parser.parse_args(argv)
    try:
        out, code = COMMANDS[a.command][0](a), 0
    except (ValueError, RuntimeError, OSError, KeyError) as e:
        out, code = {"error": {"code": getattr(e, "code", type(e).__name__), "message": str(e)}}, 1
    print(json.dumps(out, sort_keys=True, default=str, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
