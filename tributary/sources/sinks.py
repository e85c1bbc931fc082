"""Sinks: canonical JSONL, sharded training bundles, reports, and what reads a bundle back.

Rows are written by executors through Spark into a folder beside the target and
moved there in one rename, so a killed write leaves nothing at the target and a
retry starts clean. A target that exists is left alone: the same content counts
as done, any other is an error.
"""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.scalars import draw_key, slot
from tributary.operators.export import choose_split, split_units

MAX_ROWS, MAX_BYTES, MAX_FIELDS, MAX_LINE = 2_000_000_000, 1 << 44, 256, 16 << 20


class OutputError(ValueError):
    """An output outside its contract; code names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


# ---- files ----


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, name)
    return fs.exists(path)


def publish(spark: SparkSession, write, target: str) -> None:
    """Let write(folder) fill a folder beside target, then rename it there; a target that appears meanwhile wins."""
    fs, path = _path(spark, target)
    part = f"{target.rstrip('/')}.part-{uuid.uuid4().hex}"
    _, part_path = _path(spark, part)
    try:
        write(part)
        if path.getParent() is not None:
            fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(part_path, path):
            raise OutputError("OUTPUT_EXISTS", target)
    finally:
        fs.delete(part_path, True)


# ---- canonical lines ----


def _canonical(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, F.lit(0).cast(t)).otherwise(c)  # one zero
    return c


def check_fields(df: DataFrame, id_field: str) -> None:
    """Names unique, few enough and of scalar types; the id among them."""
    if len(df.columns) > MAX_FIELDS or len(set(df.columns)) != len(df.columns):
        raise OutputError("FIELDS", "too many or repeated fields")
    if id_field not in df.columns:
        raise OutputError("MISSING_ID_FIELD", id_field)
    for f in df.schema.fields:
        if not isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.NullType)):
            raise OutputError("FIELD_TYPE", f"{f.name} is {f.dataType.simpleString()}")


def canonical_lines(df: DataFrame, id_field: str) -> DataFrame:
    """df with _line: one JSON object, keys sorted, nulls kept, no negative zero."""
    check_fields(df, id_field)
    columns = [_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name.encode())]
    return df.withColumn("_line", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def output_facts(df: DataFrame, id_field: str) -> DataFrame:
    """One row: rows, bytes, longest, null_ids, repeated_ids, not_finite, and two sums that tell the lines apart from any others."""
    lines = canonical_lines(df, id_field)
    floats = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    odd = F.lit(False)
    for c in floats:
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    size, digest = F.octet_length("_line") + 1, F.xxhash64("_line")
    facts = lines.select(F.col(f"`{id_field}`").cast("string").alias("id"), odd.alias("odd"), size.alias("size"), digest.alias("digest"))
    per = facts.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("odd").cast("int")).alias("odd"), F.sum("size").alias("size"), F.max("size").alias("longest"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("sum"), F.bit_xor("digest").alias("xor"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per.agg(
        zero(F.sum("n")).alias("rows"), zero(F.sum("size")).alias("bytes"), zero(F.max("longest")).alias("longest"), zero(F.sum(F.when(F.col("id").isNull(), F.col("n")))).alias("null_ids"),
        zero(F.sum(F.when(F.col("id").isNotNull(), F.col("n") - 1))).alias("repeated_ids"), zero(F.sum("odd")).alias("not_finite"),
        zero(F.sum("sum")).cast("string").alias("line_sum"), zero(F.bit_xor("xor")).alias("line_xor"),
    )


def check_output(df: DataFrame, id_field: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_line: int = MAX_LINE) -> dict:
    """The facts of an output within its contract, else OutputError: ids unique and not null, numbers finite, sizes bounded."""
    facts = output_facts(df, id_field).first().asDict()
    for field, code in (("null_ids", "NULL_ID"), ("repeated_ids", "DUPLICATE_ID"), ("not_finite", "NON_FINITE")):
        if facts[field]:
            raise OutputError(code, f"{facts[field]} rows")
    for field, code, most in (("rows", "OUTPUT_ROWS", max_rows), ("bytes", "OUTPUT_BYTES", max_bytes), ("longest", "OUTPUT_LINE", max_line)):
        if facts[field] > most:
            raise OutputError(code, f"{facts[field]} is more than {most}")
    return facts


def write_jsonl(df: DataFrame, id_field: str, target: str, order: list | None = None, **bounds) -> dict:
    """Write canonical lines in order (of the id where none is given) as a folder of text parts; returns the checked facts.

    The same content at target already is fine, other content an error.
    """
    facts = check_output(df, id_field, **bounds)
    spark = df.sparkSession
    if exists(spark, target):
        old = spark.read.text(f"{target}/*.txt").agg(F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64("value"))).first()
        if (old[0], old[1] or "0", old[2] or 0) != (facts["rows"], facts["line_sum"], facts["line_xor"]):
            raise OutputError("OUTPUT_EXISTS", target)
        return facts
    lines = canonical_lines(df, id_field).orderBy(*(order or [F.col(f"`{id_field}`")])).select("_line")
    publish(spark, lambda part: lines.write.text(part), target)
    return facts


# ---- training bundles ----


def write_bundle(sharded: DataFrame, id_field: str, target: str) -> DataFrame:
    """Write rows that bear split, shard and position as canonical lines, a file a shard, and their manifest; returns the manifest.

    A shard is written by one task in the order of position. manifest: split,
    shard, records, bytes, file (below target), content_hash (SHA-256 of the file).
    """
    spark = sharded.sparkSession
    fields = sharded.drop("split", "shard", "position", "split_key", "slot")
    check_output(fields, id_field)
    lines = _with_line(sharded, id_field)
    parts = lines.select("split", "shard", "position", F.col("_line").alias("value")).repartition("split", "shard").sortWithinPartitions("split", "shard", "position")

    def write(part: str) -> None:
        parts.select("split", "shard", "value").write.partitionBy("split", "shard").text(f"{part}/shards")
        _manifest(spark, f"{part}/shards").coalesce(1).write.parquet(f"{part}/manifest")

    publish(spark, write, target)
    return read_manifest(spark, target)


def _with_line(sharded: DataFrame, id_field: str) -> DataFrame:
    """sharded with _line of its own fields, those of the assignment left out."""
    own = [f for f in sharded.schema.fields if f.name not in ("split", "shard", "position", "split_key", "slot")]
    columns = [_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(own, key=lambda f: f.name.encode())]
    return sharded.withColumn("_line", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def _manifest(spark: SparkSession, shards: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(shards)
    name = F.regexp_extract("path", r"(split=[^/]*/shard=[^/]*/[^/]*)$", 1)
    return files.select(
        F.url_decode(F.regexp_extract(name, r"split=([^/]*)/", 1)).alias("split"), F.regexp_extract(name, r"shard=([^/]*)/", 1).cast("bigint").alias("shard"),
        (F.length("content") - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")))).cast("bigint").alias("records"),
        F.col("length").alias("bytes"), name.alias("file"), F.sha2("content", 256).alias("content_hash"),
    )


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/manifest")


def read_shards(spark: SparkSession, target: str) -> DataFrame:
    """(split, shard, line_no, value) of a bundle's files; a shard's file is read from its begin."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(f"{target}/shards")
    split = F.url_decode(F.regexp_extract("path", r"/split=([^/]*)/", 1))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\n$", "")
    return files.select(split.alias("split"), F.regexp_extract("path", r"/shard=([^/]*)/", 1).cast("bigint").alias("shard"), F.posexplode(F.split(text, "\n")).alias("line_no", "value"))


def verify_bundle(spark: SparkSession, target: str, id_field: str, seed: str, weights: dict[str, float], max_records: int) -> DataFrame:
    """(changed_files, wrong_split, wrong_order, repeated, oversize, miscounted): all zero for a sound bundle; everything is recomputed from the files."""
    kept = read_manifest(spark, target).select("file", F.col("content_hash").alias("h"), "records")
    now = _manifest(spark, f"{target}/shards").select("file", "content_hash", F.col("records").alias("n"))
    files = kept.join(now, "file", "full_outer").agg(F.count_if(~F.col("h").eqNullSafe(F.col("content_hash"))).alias("changed_files"), F.count_if(~F.col("records").eqNullSafe(F.col("n"))).alias("miscounted"), F.count_if(F.col("n") > max_records).alias("oversize"))
    rid = F.variant_get(F.parse_json("value"), f"$['{id_field}']", "string")
    rows = read_shards(spark, target).withColumn("rid", rid).withColumn("key", draw_key("split", seed, F.col("rid")))
    order = F.struct("shard", "line_no")
    counted = rows.agg(F.count_if(choose_split(slot(F.col("key")), split_units(weights)) != F.col("split")).alias("wrong_split"))
    edges = rows.groupBy("split", "shard").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max_by("key", order).alias("last"), F.min_by("key", order).alias("first"))
    from pyspark.sql.window import Window

    inner = rows.withColumn("p", F.lag("key").over(Window.partitionBy("split", "shard").orderBy("line_no"))).agg(F.count_if(F.col("p") > F.col("key")).alias("x"))
    outer = edges.withColumn("p", F.lag("last").over(Window.partitionBy("split").orderBy("shard"))).agg(F.count_if(F.col("p") > F.col("first")).alias("y"))
    twice = rows.groupBy("rid").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    one = files.crossJoin(counted).crossJoin(inner).crossJoin(outer).crossJoin(twice)  # one row each
    return one.select("changed_files", "wrong_split", (F.col("x") + F.col("y")).alias("wrong_order"), "repeated", "oversize", "miscounted")


def worker_shards(manifest: DataFrame, split: str, worker: int, workers: int) -> DataFrame:
    """The shards of a split that a worker reads: every workers-th of them in order."""
    from pyspark.sql.window import Window

    if workers < 1 or not 0 <= worker < workers:
        raise ValueError("worker index and count are invalid")
    place = F.row_number().over(Window.orderBy("shard")) - 1  # one row a shard of one split
    return manifest.where(F.col("split") == split).withColumn("place", place).where(F.pmod("place", F.lit(workers)) == worker).drop("place")


def iter_shard(spark: SparkSession, target: str, file: str) -> Iterator[dict]:
    """Records of one shard in order, fetched a partition at a time."""
    for row in spark.read.text(f"{target}/shards/{file}").coalesce(1).toLocalIterator():
        yield json.loads(row["value"])


def torch_dataset(spark: SparkSession, target: str, split: str):
    """A torch IterableDataset over a split's shards, dealt to the loader's workers; needs torch."""
    try:
        from torch.utils.data import IterableDataset, get_worker_info
    except ImportError as e:
        raise RuntimeError("torch is not installed") from e

    class Shards(IterableDataset):
        def __iter__(self):
            info = get_worker_info()
            worker, workers = (info.id, info.num_workers) if info else (0, 1)
            for row in worker_shards(read_manifest(spark, target), split, worker, workers).orderBy("shard").collect():
                yield from iter_shard(spark, target, row["file"])

    return Shards()


def generator_dataset(spark: SparkSession, target: str, split: str, worker: int = 0, workers: int = 1) -> Iterator[dict]:
    """Records of a worker's shards in order: what from_generator constructors of dataset libraries take."""
    for row in worker_shards(read_manifest(spark, target), split, worker, workers).orderBy("shard").collect():
        yield from iter_shard(spark, target, row["file"])


# ---- reports ----


def report_json(findings: DataFrame, summary: dict, target: str | None = None) -> str:
    """Findings with ids, in canonical order, as one sorted JSON document; written once where target is given."""
    from tributary.operators.findings import ordered, with_ids

    rows = [r.asDict(recursive=True) for r in ordered(with_ids(findings)).collect()]  # a report is read by people: findings are few
    text = json.dumps({"summary": summary, "findings": rows}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    if target:
        from tributary.plans.control import publish_text

        publish_text(target, text)
    return text


def report_html(findings: DataFrame, summary: dict, title: str = "Review") -> str:
    """The same as a page: counts, then findings by severity."""
    body = json.loads(report_json(findings, summary))
    cell = lambda x: html.escape(", ".join(map(str, x)) if isinstance(x, list) else str(x))
    head = "".join(f"<li>{cell(k)}: {cell(v)}</li>" for k, v in sorted(body["summary"].items()))
    names = ("severity", "code", "message", "sample_ids", "finding_id")
    rows = "".join("<tr>" + "".join(f"<td>{cell(f.get(n, ''))}</td>" for n in names) + "</tr>" for f in body["findings"])
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{cell(title)}</title></head><body><h1>{cell(title)}</h1><ul>{head}</ul><table><tr>{''.join(f'<th>{n}</th>' for n in names)}</tr>{rows}</table></body></html>"
