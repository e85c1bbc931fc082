import pytest
from pyspark.sql import functions as F

from tributary.operators import export, policy, recipe, records, review, views
from tributary.operators.matching import Matching
from tributary.plans import control, dsl
from tributary.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_recipe_errors_survive_later_filters(spark):
    t = spark.createDataFrame([(1, "5"), (2, "x")], "id int, v string")
    with pytest.raises(recipe.RecipeError):
        recipe.apply_recipe(t, [{"op": "cast", "field": "v", "to": "integer"}, {"op": "filter", "field": "id", "predicate": "eq", "value": 1}], ["id"])
    out = recipe.apply_recipe(t, [{"op": "filter", "field": "id", "predicate": "eq", "value": 1}, {"op": "cast", "field": "v", "to": "integer"}], ["id"])
    assert rows(out) == [(1, 5)]
    with pytest.raises(recipe.RecipeError):
        recipe.prepare(t, [{"op": "select", "fields": ["nothing"]}], ["id"])


def test_dedupe_does_not_depend_on_partitions(spark):
    t = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("k"))
    a, b = (recipe.apply_recipe(x, [{"op": "dedupe", "by": ["k"]}], ["id"]) for x in (t.repartition(5), t.repartition(1, "k")))
    assert rows(a) == rows(b) == [(k, k) for k in range(7)]


def test_diff_mirrors(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "id int, v string")
    swap = {"added": "removed", "removed": "added"}
    there = {r["rid"]: r["change"] for r in records.diff(a, b, "id").collect()}
    back = {r["rid"]: swap.get(r["change"], r["change"]) for r in records.diff(b, a, "id").collect()}
    assert there == back == {"1": "unchanged", "2": "modified", "3": "removed", "4": "added"}


def test_policy_and_views_on_nulls_and_empty(spark):
    t = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], "id int, v string")
    found = policy.violations(t, "id", {"v": {"nullable": False, "unique": True}})
    assert rows(found) == [("1", "v", "NULL"), ("2", "v", "UNIQUE"), ("3", "v", "UNIQUE")]
    assert policy.violations(t.limit(0), "id", {"v": {"nullable": False}}).count() == 0
    with pytest.raises(ValueError):
        policy.validate({"v": {"type": "string", "min": 1}})
    assert rows(views.subset(t, [("v", "is_null")])) == [(1, None)]


def test_split_units_and_shards(spark):
    assert export.split_units({"a": 1, "b": 1, "c": 1}) == {"a": 3334, "b": 3333, "c": 3333}
    with pytest.raises(ValueError):
        export.split_units({"a": 1, "b": 1e-9})
    t = export.shard(export.assign(spark.range(1000), "id", "s", {"x": 1, "y": 3}), "id", 100)
    got = {r["split"]: (r["n"], r["p"]) for r in t.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("position").alias("p")).collect()}
    assert all(n == p for n, p in got.values()) and 0.6 < got["y"][0] / 1000 < 0.9


def test_matching(spark):
    pairs = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 11, 2)], "a int, b int, distance long")
    assert rows(review.greedy_match(pairs)) == [(1, 11, 1)]
    assert rows(review.optimal_match(pairs)) == [(1, 12, 2, False), (2, 11, 2, False)]
    even = spark.createDataFrame([(1, 11, 1), (1, 12, 1)], "a int, b int, distance long")
    assert [r["ambiguous"] for r in review.optimal_match(even).collect()] == [True]


def _sparse(seed, lefts, rights, edges, cost):
    """(a, b, distance) of up to edges random pairs, sorted."""
    import random

    rng = random.Random(seed)
    return sorted((a, b, rng.randint(0, cost)) for a, b in {(rng.randrange(lefts), rng.randrange(rights)) for _ in range(edges)})


def test_matching_in_arrays_against_all_matchings():
    import numpy as np

    def every(pairs):
        if not pairs:
            yield ()
            return
        (a, b, d), rest = pairs[0], pairs[1:]
        yield from every(rest)
        for m in every([p for p in rest if p[0] != a and p[1] != b]):
            yield ((a, b, d), *m)

    for seed in range(150):
        pairs = _sparse(seed, 1 + seed % 5, 1 + seed % 4, 9, (0, 1, 3, 20)[seed % 4])
        found = Matching(np.unique([p[0] for p in pairs], return_inverse=True)[1], np.unique([p[1] for p in pairs], return_inverse=True)[1], np.array([p[2] for p in pairs]))
        got, loose = [pairs[k] for k in found.chosen()], found.loose()
        rank = lambda m: (-len(m), sum(d for *_, d in m))
        best = min(map(rank, every(pairs)))
        assert len({a for a, *_ in got}) == len({b for _, b, _ in got}) == len(got) and rank(got) == best
        assert [any(p not in m for m in every(pairs) if rank(m) == best) for p in got] == loose.tolist()


def test_optimal_match_of_one_large_component_and_any_company(spark):
    # 8,000 nodes a side in one component: a search for each node does not end in time
    import time

    import pandas as pd

    pairs = _sparse(5, 8000, 8000, 80_000, 17)
    t = spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b", "distance"]))
    began = time.time()
    got = rows(review.optimal_match(t))
    assert time.time() - began < 60
    assert len(got) == len({a for a, *_ in got}) == len({b for _, b, *_ in got}) and {g[:3] for g in got} <= set(pairs)
    small = pd.DataFrame([(100 * k + a, 100 * k + b, d) for k in range(60) for a, b, d in _sparse(k % 7, 4, 4, 8, 2)], columns=["a", "b", "distance"])
    small = spark.createDataFrame(small)
    want = rows(review.optimal_match(small, together=1))
    assert want == rows(review.optimal_match(small.repartition(5), together=1 << 20)) and {g[0] // 100 for g in want} == set(range(60))
    twice = spark.createDataFrame([("x", "y", 2), ("x", "y", 5), ("z", "y", 3)], "a string, b string, distance int")
    assert rows(review.optimal_match(twice)) == [("x", "y", 2, False)]
    assert review.optimal_match(twice.limit(0)).count() == 0


def test_near_pairs_against_brute_force(spark):
    import random

    rng = random.Random(1)
    values = [rng.getrandbits(20) for _ in range(150)]
    t = spark.createDataFrame(list(enumerate(values)), "id long, bits long")
    want = sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(values) for j, y in enumerate(values) if (x ^ y).bit_count() <= 3)
    assert rows(review.near_pairs(t, t, 3)) == want


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    out = review.components(e, spark.range(21).withColumnRenamed("id", "node"))
    assert {r["component"] for r in out.collect()} == {0}


def test_components_in_one_task_and_by_rounds(spark):
    import random

    from tributary.operators import graph

    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(500, 560)] + [(700, 700), (None, 3)]
    label = {x: x for p in pairs for x in p if x is not None}
    for _ in label:
        for a, b in pairs:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
    want = {k: v for k, v in label.items() if k != v}
    e = spark.createDataFrame(pairs, "a long, b long")
    for small in (0, graph.SMALL):
        assert {r["node"]: r["component"] for r in graph.components(e, small=small).collect()} == want
    named = e.select(F.concat(F.lit("é"), F.lpad(F.col("a").cast("string"), 4, "0")).alias("a"), F.concat(F.lit("é"), F.lpad(F.col("b").cast("string"), 4, "0")).alias("b"))
    assert {r["node"]: r["component"] for r in graph.components(named).collect()} == {f"é{k:04d}": f"é{v:04d}" for k, v in want.items()}
    assert graph.components(e.limit(0)).count() == 0


def test_task_language(spark):
    task = dsl.compile_task("from events format parquet source-id-field event_id prepare filter value > 1, dedupe by user_id aggregate by event_type n=count(), top=max(value) export train 70 val 20 test 10")
    assert [s["op"] for s in task.steps] == ["filter", "dedupe"] and task.splits["val"] == 20
    for bad, code in (("from a join b", "UNSUPPORTED_TASK"), ("from a source-id-field x export train 50", "SPLITS"), ("from a export", "SYNTAX")):
        with pytest.raises(dsl.TaskError) as e:
            dsl.compile_task(bad)
        assert e.value.code == code
    t = spark.createDataFrame([(k, "ab"[k % 2], float(k)) for k in range(10)], "event_id int, event_type string, value double")
    out = dsl.run_task(spark, "from t source-id-field event_id prepare filter value > 1 aggregate by event_type n=count(), top=max(value) export", t)
    assert sorted((r["event_type"], r["n"], r["top"]) for r in out.collect()) == [("a", 4, 8.0), ("b", 4, 9.0)]


def test_task_grammar(spark):
    task = dsl.compile_task("from 'd a.csv' format csv source-id-field auto prepare select a,b, filter a gte 1.5, rename a to c, cast c as integer, case b,c lower, replace b x to 'it\\'s', fill b with null, drop-missing all b,c, dedupe by b keep error transform `SELECT * FROM source ORDER BY id` export train 80 val 10 test 10 id-field id")
    assert [s["op"] for s in task.steps] == ["select", "filter", "rename", "cast", "case", "replace", "fill", "drop_missing", "dedupe"]
    assert task.source == "d a.csv" and task.steps[0]["fields"] == ["a", "b", dsl.RESERVED] and task.steps[1]["value"] == 1.5
    assert task.steps[5]["to"] == "it's" and task.steps[6]["value"] is None and task.steps[7]["mode"] == "all" and task.steps[8]["keep"] == "error"
    with pytest.raises(dsl.TaskError):
        dsl.compile_task("from a source-id-field x prepare rename x to y export id-field x")


def test_phrases(spark, tmp_path):
    from tributary.plans.phrases import PHRASES

    for phrase, _ in PHRASES:
        filled = phrase.replace("<path>", "data.csv").replace("<fields>", "id,name，score")
        for part in ("field", "name", "metric", "value"):
            filled = filled.replace(f"<{part}>", part)
        assert dsl.compile_task(filled).source == "data.csv"
    assert dsl.compile_task("把 books.csv 填充 author 空值为 D'Arcy").steps[0]["value"] == "D'Arcy"
    task = dsl.compile_task("把 rain.parquet 过滤 depth 小于 2.5")
    assert task.steps[0]["predicate"] == "lt" and task.steps[0]["value"] == 2.5 and task.id_field == dsl.RESERVED
    assert dsl.compile_task("统计 rain.csv 每个 station 的 depth 均值").aggregates == [("depth_avg", "avg", "depth")]
    for bad in ("画一张 rain.csv 的图", "整理 s3://bucket/rain.csv", "把 rain.csv 和 snow.csv 连接", "把 rain.csv 改名"):
        with pytest.raises(dsl.TaskError) as e:
            dsl.compile_task(bad)
        assert e.value.code == "UNSUPPORTED_TASK"
    for day in ("1", "2"):
        (tmp_path / f"d={day}").mkdir()
        (tmp_path / f"d={day}" / "a.csv").write_text("k,v\nx,%s\ny,b\nx,z\n" % day)
    out = dsl.run_task(spark, f"把 {tmp_path} 按 k 去重").collect()
    assert sorted((r["k"], r["v"]) for r in out) == [("x", "1"), ("y", "b")]
    whole = dsl.run_task(spark, f"整理 {tmp_path}")
    assert whole.count() == 6 and whole.select(dsl.RESERVED).distinct().count() == 6


def test_row_numbers_of_split_text(spark, tmp_path):
    spark.range(5000).selectExpr("id", "repeat('x', 100) as t").coalesce(1).write.json(str(tmp_path / "j"))
    path = next(p for p in (tmp_path / "j").iterdir() if p.suffix == ".json")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        out = readers.with_ordinals(spark.read.json(str(path)), str(path))
        assert out.rdd.getNumPartitions() > 4 and out.where("_row <> id").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_shards_by_bytes(spark):
    t = spark.createDataFrame([(k, (k * 37) % 50) for k in range(300)], "id long, bytes long").union(spark.createDataFrame([(900, 500), (901, None)], "id long, bytes long"))
    t = export.assign(t, "id", "s", {"x": 1, "y": 1})
    got = sorted(tuple(r) for r in export.shard_by_bytes(t, "id", 7, 120).collect())
    size = {r["id"]: r["bytes"] or 0 for r in t.collect()}
    want, state = [], {}
    for split, rid, position, _ in sorted(got, key=lambda r: (r[0], r[2])):
        shard, n, held = state.get(split, (0, 0, 0))
        if n and (n == 7 or held + size[rid] > 120):
            shard, n, held = shard + 1, 0, 0
        state[split] = (shard, n + 1, held + size[rid])
        want.append((split, rid, position, shard))
    assert got == sorted(want) and len(got) == 302


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"x\ny"\n2,\n')
    assert rows(readers.read_files(spark, str(tmp_path))) == [("1", "x\ny"), ("2", "")]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n')
    with pytest.raises(readers.SourceError) as e:
        readers.read_files(spark, str(tmp_path))
    assert e.value.code == "MIXED_FORMAT"
    assert readers.file_manifest(spark, str(tmp_path)).count() == 2


def test_control(spark, tmp_path):
    t = spark.range(10)
    plan = control.plan(t, {"what": "range"}, str(tmp_path / "p.json"))
    with pytest.raises(control.ControlError):
        control.apply(t, str(tmp_path / "p.json"), "plan_other", str(tmp_path / "out"))
    receipt = control.apply(t.repartition(3), str(tmp_path / "p.json"), plan["plan_id"], str(tmp_path / "out"))
    assert control.apply(t, str(tmp_path / "p.json"), plan["plan_id"], str(tmp_path / "out")) == receipt
    revisions = control.Revisions(str(tmp_path / "state"))
    first = revisions.commit({"n": 1}, "one", None)
    with pytest.raises(control.ControlError):
        revisions.commit({"n": 2}, "two", None)
    second = revisions.commit({"n": 2}, "two", first)
    assert [r["revision"] for r in revisions.log()] == [second, first]


def test_streaming_gate(spark, tmp_path):
    from tributary.streaming.gate import gate

    spark.createDataFrame([(1, "a"), (2, None)], "id int, v string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in"))
    q = gate(stream, "id", {"v": {"nullable": False}}, lambda b, e: seen.append("ok"), lambda f, e: seen.extend(r["code"] for r in f.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == ["NULL"]


def test_sample_findings(spark):
    """Moves, re-encodings and ambiguous pairs are told by path, content and perceptual matches."""
    schema = "path string, content_hash string, label string, split string, bits long"
    before = spark.createDataFrame([("a", "1", "x", "s", 0), ("b", "2", "x", "s", 255 << 20), ("c", "3", "x", "s", 1), ("p", "4", "x", "s", 127 << 40), ("q", "5", "x", "s", 127 << 40), ("z", "9", "x", "s", None)], schema)
    after = spark.createDataFrame([("m/a", "1", "y", "s", 0), ("m/b", "2b", "x", "t", 255 << 20 | 1), ("c", "3c", "x", "s", 3), ("r", "6", "x", "s", 127 << 40), ("t", "7", "x", "s", 127 << 40), ("n", "8", "x", "s", None)], schema)
    got = sorted((r["code"], tuple(r["sample_ids"]), r["distance"]) for r in review.sample_findings(before, after).collect())
    assert got == [
        ("AMBIGUOUS_MATCH", ("p", "q", "r", "t"), 0), ("LABEL_CHANGED", ("a", "m/a"), None), ("PROBABLE_REENCODE", ("b", "m/b"), 1), ("PROBABLE_REENCODE", ("c", "c"), 1), ("SAMPLE_ADDED", ("n",), None),
        ("SAMPLE_MOVED", ("a", "m/a"), None), ("SAMPLE_MOVED", ("b", "m/b"), None), ("SAMPLE_REMOVED", ("z",), None), ("SPLIT_CHANGED", ("b", "m/b"), None),
    ]
    near = before.withColumnRenamed("path", "id")
    assert sorted((r["members"], r["code"]) for r in review.near_groups(near).collect()) == [(2, "NEAR_DUPLICATE_GROUP"), (2, "NEAR_DUPLICATE_GROUP")]
    assert review.near_groups(near.withColumn("split", near["id"])).where("code = 'CROSS_SPLIT_NEAR_LEAKAGE'").count() == 2
