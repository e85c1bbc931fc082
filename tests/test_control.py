"""Sinks, inspection, documents, workspaces, consumption, runs, pipelines, imports, media and the command line, on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import export, findings, inspect, policy, records, review
from tributary.plans import control, documents, pipeline, prepare, run, schemas, sqlpolicy
from tributary.plans.consumption import Consumption, plan_consumption
from tributary.plans.workspace import Workspace
from tributary.sources import imports, media, readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_output(spark, tmp_path):
    t = spark.createDataFrame([(2, "b", -0.0, True, None), (1, "\u00e9\n", 1.5, False, "x")], "id int, text string, v double, flag boolean, Nothing string")
    facts = sinks.write_jsonl(t, "id", str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ['{"Nothing":"x","flag":false,"id":1,"text":"\u00e9\\n","v":1.5}', '{"Nothing":null,"flag":true,"id":2,"text":"b","v":0.0}']
    assert facts["bytes"] == sum(len(x.encode()) + 1 for x in lines)
    assert sinks.write_jsonl(t.repartition(3), "id", str(tmp_path / "out")) == facts  # the same again is fine
    bad = {
        "DUPLICATE_ID": t.union(t), "NULL_ID": t.withColumn("id", F.lit(None).cast("int")), "NON_FINITE": t.withColumn("v", F.lit(float("nan"))), "FIELD_TYPE": t.withColumn("v", F.array("id")), "MISSING_ID_FIELD": t.drop("id"),
        "OUTPUT_EXISTS": t.withColumn("text", F.lit("y")),
    }
    for code, df in bad.items():
        with pytest.raises(sinks.OutputError) as e:
            sinks.write_jsonl(df, "id", str(tmp_path / ("out" if code == "OUTPUT_EXISTS" else code)))
        assert e.value.code == code
    for bound, code in (({"max_rows": 1}, "OUTPUT_ROWS"), ({"max_bytes": 10}, "OUTPUT_BYTES"), ({"max_line": 10}, "OUTPUT_LINE")):
        with pytest.raises(sinks.OutputError) as e:
            sinks.write_jsonl(t, "id", str(tmp_path / "bounded"), **bound)
        assert e.value.code == code
    assert sinks.write_jsonl(t.limit(0), "id", str(tmp_path / "none"))["rows"] == 0
    assert not [p for p in tmp_path.iterdir() if ".part-" in p.name]


def test_bundles_and_their_consumption(spark, tmp_path):
    target, weights = str(tmp_path / "bundle"), {"a/b": 1, "y": 3}
    t = export.shard(export.assign(spark.range(300).withColumn("text", F.concat(F.lit("line\n"), F.col("id").cast("string"))), "id", "s", weights), "id", 40)
    manifest = sinks.write_bundle(t, "id", target)
    assert manifest.agg(F.sum("records")).first()[0] == 300 and {r["split"] for r in manifest.collect()} == {"a/b", "y"}
    sound = sinks.verify_bundle(spark, target, "id", "s", weights, 40)
    assert set(sound.first()) == {0}
    assert sinks.verify_bundle(spark, target, "id", "other", weights, 40).first()["wrong_split"] > 0
    plan = plan_consumption(spark, target, "y", "python", str(tmp_path / "consume.json"))
    first = Consumption(spark, str(tmp_path / "consume.json"), str(tmp_path / "run"))
    reader = first.records()
    for _ in range(50):
        next(reader)
    assert first.covered() == [0] and first.finish() is None  # the second shard was not read to its end
    again = Consumption(spark, str(tmp_path / "consume.json"), str(tmp_path / "run"))
    seen = [r["id"] for w in (0, 1) for r in again.records(w, 2)]
    assert len(seen) == len(set(seen)) == sum(s["records"] for s in plan["shards"]) and again.receipt()["records"] == len(seen)
    assert again.finish() == again.receipt()
    with pytest.raises(control.ControlError):
        list(again.records())
    with pytest.raises(ValueError):
        next(sinks.generator_dataset(spark, target, "y", 2, 2))
    file = next(iter((tmp_path / "bundle" / "shards").rglob("*.txt")))
    file.write_text(file.read_text().replace("line", "lime", 1))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert sinks.verify_bundle(spark, target, "id", "s", weights, 40).first()["changed_files"] == 1


def test_inspection_of_bad_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b'{"id":1,"a":null}\r\n{"id":1.0,"b":[1]}\n\n  \n{"id":"1"}\n{"id":" "}\n{"id":null}\n{"x":2}\n[1]\nnull\n{bad\n\xff\xfe\n{"id":true}\n{"id":"1","a":"t"}\n{"id":10e-1}\n{"id":100}\n{"id":1e2}\n')
    got = inspect.inspect_jsonl(spark, [str(path)], "id")
    assert {k: got[k] for k in ("records", "blank_lines", "invalid_records", "missing_ids", "null_ids", "invalid_ids", "duplicate_ids", "findings")} == {"records": 11, "blank_lines": 2, "invalid_records": 4, "missing_ids": 1, "null_ids": 1, "invalid_ids": 2, "duplicate_ids": 4, "findings": 12}
    assert [(i["line"], i["code"]) for i in got["items"]][:3] == [(2, "DUPLICATE_ID"), (6, "INVALID_ID"), (7, "NULL_ID")]
    assert {f["field"]: (f["present"], f["nulls"], f["kinds"]) for f in got["fields"]} == {"a": (2, 1, "null,string"), "b": (1, 0, "array"), "id": (10, 1, "boolean,null,number,string"), "x": (1, 0, "number")}
    found = inspect.structural_findings(inspect.health(inspect.parsed_lines(spark, [str(path)], "id")))
    assert rows(found.select("code", "evidence"))[0] == ("JSONL_DUPLICATE_ID", '{"count":4}') and inspect.status(found) == "fail"
    keys = spark.createDataFrame([("0",), ("-0.0",), ("1",), ("1.00",), ("10e-1",), ("1e2",), ("100",), ("12345678901234567890123.5",)], "n string").select(inspect.number_key(F.col("n")))
    assert [r[0] for r in keys.collect()] == ["0e0", "0e0", "1e0", "1e0", "1e0", "1e2", "1e2", "123456789012345678901235e-1"]
    table = inspect.inspect_table(spark.createDataFrame([(1, "a"), (1, ""), (None, None)], "id int, v string"), "id", {"format": "csv"})
    assert (table["null_ids"], table["duplicate_ids"], table["recipe"]["id_field"]) == (1, 1, "id")
    assert inspect.tabular_health(spark.range(3), "nothing").first()["missing_ids"] == 3


def test_gate_of_unique_groups(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, None)], "id int, v string")
    changed = spark.createDataFrame([("2",)], "rid string")
    got = policy.evaluate(t, "id", {"v": {"unique": True, "nullable": False}}, changed).collect()
    assert [(r["code"], r["total"], r["gated"], r["sample_ids"], r["truncated"]) for r in got] == [("UNIQUE", 4, 2, ["1", "2"], False)]


def test_documents():
    good = {"kind": "prepare", "schema_version": 1, "source": {"format": "csv"}, "output": {"format": "jsonl"}, "id_field": "id", "steps": [{"op": "cast", "field": "v", "type": "integer"}]}
    assert documents.parse_recipe(json.dumps(good))["steps"] == [{"op": "cast", "field": "v", "to": "integer"}]
    for change in ({"kind": "x"}, {"steps": [{"op": "cast", "field": "v"}]}, {"steps": [{"op": "melt"}]}, {"more": 1}, {"source": {"format": "xml"}}, {"steps": [{"op": "trim", "fields": []}]}):
        with pytest.raises(documents.DocumentError):
            documents.parse_recipe(json.dumps(good | change))
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', "[]", "{"):
        with pytest.raises(documents.DocumentError):
            documents.parse_json(text)
    rules = documents.parse_policy('{"schema_version":1,"adapter":"jsonl","mode":"changed_only","fields":{"v":{"types":["number"],"minimum":1},"w":{"types":["string","number"]}}}')
    assert rules == {"mode": "changed_only", "rules": {"v": {"type": "number", "min": 1}, "w": {"type": ("string", "number")}}}
    for field in ({"types": ["string"], "minimum": 1}, {"pattern": "("}, {"types": ["date"]}, {"types": ["string"], "enum": [1]}, {"unknown": 1}):
        with pytest.raises(documents.DocumentError):
            documents.parse_policy(json.dumps({"schema_version": 1, "adapter": "jsonl", "mode": "full", "fields": {"v": field}}))
    view = documents.parse_view('{"schema_version":1,"predicates":[{"field":"a","op":"in","value":[1,"x"]},{"field":"b","op":"exists"}],"sample":{"rate_bps":500,"seed":"s"}}')
    assert view == {"clauses": [("a", "in", [1, "x"]), ("b", "exists")], "sample": (500, "s")}
    for clause in ({"field": "a", "op": "lt", "value": "x"}, {"field": "a", "op": "like", "value": "x"}, {"field": "a", "op": "exists", "value": 1}):
        with pytest.raises(documents.DocumentError):
            documents.parse_view(json.dumps({"schema_version": 1, "predicates": [clause]}))
    for text in ("a: &x 1\nb: *x", "a: !!python/none 1", "a: 2020-01-01", "a: 1\na: 2", "1: a", "- a", ""):
        with pytest.raises(documents.DocumentError):
            documents.parse_yaml(text)


def test_workspace(spark, tmp_path):
    work = Workspace.init(spark, str(tmp_path / "w"), "id")
    work.begin("first")
    with pytest.raises(control.ControlError):
        work.begin("second")
    with pytest.raises(control.ControlError):
        work.seal()  # nothing staged
    t = spark.createDataFrame([("a", 5), ("b", 1)], "id string, score long")
    work.stage(t)
    assert "JSONL_POLICY_RANGE" in [r["code"] for r in work.check({"score": {"type": "number", "max": 1}}).collect()]
    with pytest.raises(control.ControlError):
        work.seal()  # the check failed
    done = work.patch("a", "score", 1, 5)
    assert work.check({"score": {"type": "number", "max": 1}}).count() == 0
    one = work.seal()
    work.begin("undo")
    with pytest.raises(control.ControlError):
        work.patch("a", "score", 7, 6)  # it is not 6
    work.undo(done)
    assert rows(work.check().select("code", "sample_ids")) == [("RECORD_MODIFIED", ["a"])]
    two = work.seal()
    assert work.revisions.reachable() == [two, one]
    assert rows(work.materialize(one)) == [("a", 1), ("b", 1)] and rows(work.materialize()) == [("a", 5), ("b", 1)]
    assert work.export(str(tmp_path / "old"), one)["rows"] == 2
    work.begin("dropped")
    work.stage(t.limit(1))
    held = work.gc()
    work.abandon()
    assert not held and len(work.gc(dry=False)) == 1 and not work.gc()
    with control.locked(work.revisions.root), pytest.raises(control.ControlError) as e:
        work.revisions.commit({}, "x", two)
    assert e.value.code == "LOCKED"


def test_runs_and_pipelines(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,v\n" + "".join(f"r{k},{k % 5}\n" for k in range(200)))
    text, folder = f"from '{tmp_path}/in.csv' format csv source-id-field id prepare filter v gt 1 export train 80 val 10 test 10 id-field id", str(tmp_path / "run")
    plan = run.plan(spark, text, folder)
    with pytest.raises(control.ControlError):
        run.resume(spark, folder, str(tmp_path / "out"))
    with pytest.raises(control.ControlError):
        run.authorize(folder, "run_other")
    run.authorize(folder, plan["plan_id"])
    receipt = run.resume(spark, folder, str(tmp_path / "out"))
    assert receipt["records"] == 120 and run.resume(spark, folder, str(tmp_path / "out")) == receipt and run.state(folder) == "completed"
    (tmp_path / "p.yaml").write_text(
        "schema_version: 1\npipeline: {name: numbers}\ntarget: {dataset: numbers, state: state, mode: create}\ninputs: [{alias: source, path: in.csv, format: csv}]\n"
        "transform: {sql: 'SELECT id, CAST(v AS BIGINT) AS v FROM source ORDER BY id', id_field: id}\n"
        "validate: {quality_policy: {schema_version: 1, adapter: jsonl, mode: full, fields: {v: {types: [number], maximum: 4}}}}\nexport: {split: [train=7, val=3], max_shard_records: 50}\ndelivery: {output: delivered}\n"
    )
    path = str(tmp_path / "plan.json")
    plan = pipeline.plan(spark, str(tmp_path / "p.yaml"), path)
    broken = pipeline.Application(spark, path, plan["plan_id"])
    (tmp_path / "delivered").mkdir()
    with pytest.raises(control.ControlError) as e:
        broken.apply()
    assert e.value.code == "OUTPUT_EXISTS" and broken.phase() == "head_committed"
    (tmp_path / "delivered").rmdir()
    receipt = pipeline.Application(spark, path, plan["plan_id"]).apply()
    assert pipeline.info(path) == {"plan_id": plan["plan_id"], "name": "numbers", "phase": "completed", "receipt": receipt}
    assert sinks.read_manifest(spark, str(tmp_path / "delivered")).agg(F.sum("records")).first()[0] == 200
    plan_consumption(spark, str(tmp_path / "delivered"), "val", "python", str(tmp_path / "c.json"))
    c = Consumption(spark, str(tmp_path / "c.json"), str(tmp_path / "crun"))
    assert len(list(c.records())) == c.receipt()["records"]
    assert [x["kind"] for x in pipeline.lineage(path, [str(tmp_path / "crun" / "receipt.json")])] == ["input", "transform", "revision", "bundle", "consumption"]
    assert pipeline.gc(spark, path) == []
    with pytest.raises(control.ControlError):
        pipeline.Application(spark, path, "pipeline_other")


def test_prepare_and_transform_plans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,x\n2,\n")
    (tmp_path / "in" / "b.csv").write_text("k,v\n1,y\n3,z\n")
    text = json.dumps({"kind": "prepare", "schema_version": 1, "source": {"format": "csv"}, "output": {"format": "jsonl"}, "id_field": "k", "generated_source_id": "row", "steps": [{"op": "dedupe", "by": ["k"], "keep": "first"}, {"op": "drop_missing", "fields": ["v"]}, {"op": "select", "fields": ["k", "v"]}]})
    plan = prepare.plan_prepare(spark, text, str(tmp_path / "in"), str(tmp_path / "p.json"))
    assert plan["spec"]["counters"] == {"source_rows": 4, "output_rows": 2, "filtered_rows": 1, "duplicate_rows": 1}
    receipt = prepare.apply(spark, str(tmp_path / "p.json"), plan["plan_id"], str(tmp_path / "out"))
    assert receipt["rows"] == 2 and prepare.apply(spark, str(tmp_path / "p.json"), plan["plan_id"], str(tmp_path / "out")) == receipt
    assert rows(spark.read.json(str(tmp_path / "out"))) == [("1", "x"), ("3", "z")]
    second = prepare.plan_transform(spark, "SELECT k AS id, COUNT(*) AS n FROM a GROUP BY k ORDER BY id", {"a": str(tmp_path / "in")}, "id", str(tmp_path / "t.json"))
    (tmp_path / "in" / "b.csv").write_text("k,v\n1,y\n4,z\n")
    for path, plan_id, code in (("p.json", plan["plan_id"], "RESULT_CHANGED"), ("t.json", second["plan_id"], "RESULT_CHANGED"), ("t.json", "plan_x", "PLAN_NOT_ACCEPTED")):
        with pytest.raises(control.ControlError) as e:
            prepare.apply(spark, str(tmp_path / path), plan_id, str(tmp_path / "other"))
        assert e.value.code == code
    assert prepare.info(str(tmp_path / "t.json"))["receipt"] is None


def test_imports(spark, tmp_path):
    root = tmp_path / "hub"
    (root / "data" / "deep").mkdir(parents=True)
    for name, body in (("a.csv", "id,text\n1,x\n"), ("z.csv", "id,text\n2,y\n"), ("deep/b.csv", "id,text\n3,z\n"), ("notes.md", "#")):
        (root / "data" / name).write_text(body)
    plan = imports.plan_import(spark, str(root), "r1", str(tmp_path / "import.json"), ("data/*.csv",))
    assert [f["path"] for f in plan["files"]] == ["data/a.csv", "data/z.csv"]
    imports.apply_import(spark, str(tmp_path / "import.json"), plan["plan_id"], str(root))
    receipt = str(tmp_path / "import.json.receipt")
    assert rows(imports.read_receipt(spark, receipt)) == [("1", "x"), ("2", "y")] and rows(imports.read_receipt(spark, receipt, ("data/z.csv",))) == [("2", "y")]
    (root / "data" / "z.csv").write_text("id,text\n2,Y\n")
    with pytest.raises(readers.SourceError) as e:
        imports.read_receipt(spark, receipt)
    assert e.value.code == "IMPORT_CHANGED"
    for bad in ("../x", "/x", "a[", ""):
        with pytest.raises(readers.SourceError):
            readers.glob_pattern(bad)


def test_strict_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("id,v\n1,2\n")
    (tmp_path / "a" / "2.csv").write_text("id,w\n1,2\n")
    for folder, body, code in ((None, None, "SHARD_SCHEMA"), ("b", '{"id":1}\n\n{"id":2}\n', "JSONL_BLANK_LINE"), ("c", '{"id":1}\n{"x":2}\n', "JSONL_KEYS"), ("d", '{"id":1,"id":2}\n', "JSONL_REPEATED_MEMBER")):
        if folder:
            (tmp_path / f"{folder}.jsonl").write_text(body)
        with pytest.raises(readers.SourceError) as e:
            readers.read_files(spark, str(tmp_path / (f"{folder}.jsonl" if folder else "a")))
        assert e.value.code == code
    with pytest.raises(readers.SourceError):
        readers.list_files(str(tmp_path), max_files=1)
    assert readers.row_counts({"a": spark.range(3), "b": spark.range(4)}, 7) == {"a": 3, "b": 4}
    with pytest.raises(readers.SourceError):
        readers.row_counts({"a": spark.range(3)}, 2)
    before = readers.file_manifest(spark, str(tmp_path / "a"))
    before = spark.createDataFrame(before.collect(), before.schema)
    readers.unchanged(spark, str(tmp_path / "a"), before)
    (tmp_path / "a" / "2.csv").write_text("id,v\n1,2\n")
    with pytest.raises(readers.SourceError):
        readers.unchanged(spark, str(tmp_path / "a"), before)
    assert rows(readers.read_files(spark, str(tmp_path / "a"))) == [("1", "2"), ("1", "2")]


def test_media(spark):
    rng = np.random.default_rng(1)
    plane = np.clip(np.cumsum(np.cumsum(rng.normal(0, 3, (96, 64)), axis=0), axis=1) % 256, 0, 255).astype(np.uint8)
    again = np.clip(plane.astype(int) + rng.integers(-2, 3, plane.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, (40, 40)).astype(np.uint8)
    t = spark.createDataFrame([("a", 64, 96, bytearray(plane.tobytes())), ("b", 64, 96, bytearray(again.tobytes())), ("c", 40, 40, bytearray(other.tobytes())), ("d", 9, 9, bytearray(b"x")), ("e", None, None, None)], "content_hash string, width int, height int, luma binary")
    hashes = {r["content_hash"]: r["perceptual_hash"] for r in media.with_hashes(t).collect()}
    apart = lambda x, y: (int(hashes[x], 16) ^ int(hashes[y], 16)).bit_count()
    assert apart("a", "b") <= 6 < 12 < apart("a", "c") and hashes["d"] is None and hashes["e"] is None and all(int(hashes[k], 16).bit_count() == 32 for k in "abc")
    bits = spark.createDataFrame([("ffffffffffffffff",), ("0000000100000002",)], "h string").select(media.hash_bits(F.col("h"))).collect()
    assert [r[0] for r in bits] == [-1, (1 << 32) + 2]
    files = media.layout(spark.createDataFrame([("train/x/a.JPEG", 5, "a"), ("train/x/b.png", 5, "q"), ("train/x/c.webp", 5, "c"), ("x.png", 5, "z")], "path string, size long, content_hash string"))
    known = media.with_media(files, spark.createDataFrame([("a", 64, 96, 3, "JPEG"), ("c", 40, 40, 1, "WEBP")], "content_hash string, width int, height int, channels int, media_format string"))
    assert rows(media.scan_findings(known).select("code", "severity", "sample_ids")) == [("IMAGE_DECODE_FAILED", "error", ["train/x/b.png"]), ("INVALID_LAYOUT", "error", ["x.png"]), ("UNEXPECTED_CHANNELS", "warning", ["train/x/c.webp"])]


def test_reports_and_decisions(spark):
    found = spark.createDataFrame([("info", "RECORD_ADDED", "m", ["a"]), ("error", "JSONL_POLICY_NULL", "n<", ["b"]), ("error", "JSONL_POLICY_NULL", "n<", ["b"])], "severity string, code string, message string, sample_ids array<string>")
    ids = [r["finding_id"] for r in findings.with_ids(found).collect()]
    assert len(set(ids)) == 3 and findings.find(found, ids[0]).count() == 1
    out = findings.explain(found, limit=2)
    assert out["severities"] == {"info": 1, "error": 2} and len(out["findings"]) == 2 and out["truncated"] and out["findings"][0]["severity"] == "error"
    assert findings.explain(found, budget=10)["findings"] == [] and findings.decision(found)["decision"] == "fix" and findings.decision(found.where("severity = 'info'"))["decision"] == "seal"
    assert "n&lt;" in sinks.report_html(found, {"records": 3}) and json.loads(sinks.report_json(found, {}))["findings"][0]["code"] == "JSONL_POLICY_NULL"
    page, more = findings.page_with_more(spark.range(5), ["id"], 1, 3)
    assert [r["id"] for r in page] == [1, 2, 3] and more


def test_sql_policy_holes(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "a int, s string")
    spark.range(7).createOrReplaceTempView("t")
    for sql in ("SELECT a AS id, (SELECT COUNT(*) FROM t) AS n FROM t", "SELECT COUNT(*) AS id FROM t UNION ALL SELECT COUNT(*) AS id FROM t", "SELECT a AS id FROM (SELECT MAX(a) AS a FROM t) AS q"):
        with pytest.raises(sqlpolicy.PolicyError) as e:
            sqlpolicy.transform(spark, sql, {"t": t}, "id")
        assert e.value.code == "ORDER"
    with pytest.raises(sqlpolicy.PolicyError) as e:
        sqlpolicy.transform(spark, "SELECT SUM(s) AS id FROM t", {"t": t}, "id")
    assert e.value.code == "TYPE"
    assert rows(sqlpolicy.transform(spark, "SELECT SUM(CAST(TRY_CAST(s AS DOUBLE) AS BIGINT)) AS id FROM t", {"t": t}, "id")) == [(None,)]
    out = sqlpolicy.transform(spark, "SELECT ROUND(SUM(a) / COUNT(*), 1) AS id FROM t", {"t": t}, "id")
    assert spark.table("t").count() == 7 and rows(out) == [(1.5,)]  # the caller's view is back
    spark.catalog.dropTempView("t")


def test_assignment_against_brute_force():
    import random

    rng = random.Random(3)

    def every(items, used, chosen):
        if not items:
            yield chosen
            return
        yield from every(items[1:], used, chosen)
        a, b = items[0]
        if ("a", a) not in used and ("b", b) not in used:
            yield from every(items[1:], used | {("a", a), ("b", b)}, chosen | {(a, b)})

    for _ in range(60):
        costs = {(a, b): rng.randrange(4) for a in range(rng.randrange(1, 5)) for b in range(rng.randrange(1, 5)) if rng.random() < 0.7}
        if not costs:
            continue
        ranked = [((-len(s), sum(costs[p] for p in s)), s) for s in every(list(costs), frozenset(), frozenset())]
        best = min(k for k, _ in ranked)
        solutions = [s for k, s in ranked if k == best]
        pairs, loose = review.assignment(costs)
        assert (-len(pairs), sum(costs[p] for p in pairs)) == best
        assert loose == {p for p in pairs if any(p not in s for s in solutions)}


def test_greedy_by_rounds_gives_the_same(spark):
    import random

    rng = random.Random(4)
    pairs = spark.createDataFrame([(a, b, rng.randrange(6)) for a in range(30) for b in range(30) if rng.random() < 0.2], "a int, b int, distance long")
    assert rows(review.greedy_match(pairs)) == rows(review.greedy_match(pairs, alone=0))


def test_near_pairs_with_several_tables(spark, monkeypatch):
    import random

    monkeypatch.setattr(review, "BUCKET", 4)
    monkeypatch.setattr(review, "CAP", 16)
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = [s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & (1 << 64) - 1 for s in seeds for _ in range(6)]
    t = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "id long, bits long")
    assert len(review.key_masks(len(values), 6)) > 6
    want = sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(values) for j, y in enumerate(values) if (x ^ y).bit_count() <= 6)
    assert rows(review.near_pairs(t, t, 6)) == want
    named = t.withColumn("content_hash", F.col("id").cast("string")).withColumn("split", F.lit("s"))
    label = list(range(len(values)))
    for i, j, _ in want:
        for k, x in enumerate(label):
            if x == max(label[i], label[j]):
                label[k] = min(label[i], label[j])
    got = {r["id"]: r["component"] for r in review.near_components(named, 6).collect()}
    assert {k: got.get(k, k) for k in range(len(values))} == dict(enumerate(label))


def test_command_line(capsys, spark, tmp_path):
    from tributary.__main__ import main

    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("id,v\n1,x\n2,z\n")
    assert main(["inspect", str(tmp_path / "a.csv"), "id"]) == 0 and json.loads(capsys.readouterr().out)["records"] == 2
    assert main(["record-diff", str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "id"]) == 0
    assert json.loads(capsys.readouterr().out)["changes"] == [{"change": "modified", "rid": "2"}]
    assert main(["transform", "SELECT id, v FROM a ORDER BY id", "id", str(tmp_path / "o"), "--input", f"a={tmp_path}/a.csv"]) == 0
    capsys.readouterr()
    assert main(["status", str(tmp_path / "nowhere")]) == 1 and json.loads(capsys.readouterr().out)["error"]["code"] == "NO_WORKSPACE"
    assert main(["capabilities"]) == 0 and "record-diff" in json.loads(capsys.readouterr().out)["commands"]
    assert main(["repository-check", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out)["state"] == "missing"
    assert main(["repository-install", str(tmp_path)]) == 0 and main(["repository-check", str(tmp_path)]) == 0 and '"current"' in capsys.readouterr().out
    assert set(schemas.artifact_schemas()) >= {"prepare-recipe", "quality-policy", "subset-view", "pipeline-config"}
    with pytest.raises(ValueError):
        records.diff_checked(spark.range(2).union(spark.range(1)), spark.range(2), "id")
