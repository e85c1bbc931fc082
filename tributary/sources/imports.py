"""Imports from a hub's local tree: a plan selects and pins files, applying it verifies them, a receipt lets later reads trust them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.sources.readers import EXTENSIONS, SourceError, file_manifest, glob_pattern, read_csv, read_jsonl, read_parquet

#: Files that an import takes where no pattern says otherwise, and how many and how large they may be.
DEFAULT = ("arrow", "csv", "json", "jsonl", "parquet")
MAX_FILES, MAX_TOTAL = 10_000, 1 << 40


def select_files(manifest: DataFrame, include: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a manifest (path, size, content_hash) that an import takes: patterns first, then what they ignore, in order of path."""
    wanted = F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*DEFAULT) if not include else F.lit(False)
    for p in include:
        wanted = wanted | F.regexp_like("path", F.lit(glob_pattern(p)))
    for p in ignore:
        wanted = wanted & ~F.regexp_like("path", F.lit(glob_pattern(p)))
    return manifest.where(wanted).orderBy("path")


def plan_import(spark: SparkSession, root: str, revision: str, path: str, include: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> dict:
    """Pin the files of a tree at a revision; nothing is copied."""
    from tributary.plans.control import artifact_id, publish_text

    chosen = select_files(file_manifest(spark, root), include, ignore)
    facts = chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    if not facts["n"]:
        raise SourceError("EMPTY_SOURCE", root)
    if facts["n"] > MAX_FILES or facts["total"] > MAX_TOTAL:
        raise SourceError("SOURCE_TOO_LARGE", f"{facts['n']} files, {facts['total']} bytes")
    files = [r.asDict() for r in chosen.collect()]  # at most MAX_FILES
    body = {"revision": revision, "include": list(include), "ignore": list(ignore), "files": files}
    body["plan_id"] = artifact_id("import", body)
    publish_text(path, json.dumps(body, sort_keys=True))
    return body


def apply_import(spark: SparkSession, path: str, accept: str, root: str) -> dict:
    """Verify a fetched tree against the plan; the receipt names its files for later reads."""
    from tributary.plans.control import ControlError, artifact_id, publish_text

    body = json.loads(Path(path).read_text())
    if body["plan_id"] != accept:
        raise ControlError("PLAN_NOT_ACCEPTED", accept)
    _verify(spark, body["files"], root)
    receipt = {"plan_id": accept, "root": root, "revision": body["revision"], "files": body["files"]}
    receipt["receipt_id"] = artifact_id("receipt", receipt)
    publish_text(f"{path}.receipt", json.dumps(receipt, sort_keys=True))
    return receipt


def _verify(spark: SparkSession, files: list[dict], root: str) -> None:
    want = spark.createDataFrame([(f["path"], f["size"], f["content_hash"]) for f in files], "path string, want_size long, want_hash string")
    bad = want.join(file_manifest(spark, root), "path", "left").where(~F.col("want_hash").eqNullSafe(F.col("content_hash")) | ~F.col("want_size").eqNullSafe(F.col("size"))).orderBy("path").first()
    if bad:
        raise SourceError("IMPORT_CHANGED", bad["path"])


def read_receipt(spark: SparkSession, path: str, only: tuple[str, ...] = ()) -> DataFrame:
    """The rows of an import's files, hashed again first; only: these of its paths."""
    body = json.loads(Path(path).read_text())
    files = [f for f in body["files"] if not only or f["path"] in only]
    if not files or (only and len(files) != len(set(only))):
        raise SourceError("NOT_IN_RECEIPT", ", ".join(sorted(set(only) - {f["path"] for f in files})))
    _verify(spark, files, body["root"])
    kinds = {EXTENSIONS.get(Path(f["path"]).suffix) for f in files}
    if len(kinds) != 1 or None in kinds:
        raise SourceError("MIXED_FORMAT", ", ".join(sorted(map(str, kinds))))
    paths = [str(Path(body["root"]) / f["path"]) for f in files]
    kind = kinds.pop()
    return read_csv(spark, paths) if kind == "csv" else read_parquet(spark, paths, as_text=True) if kind == "parquet" else read_jsonl(spark, paths)
