"""Sources: CSV, Parquet and JSONL files and folders, file snapshots, generated row ids."""

from __future__ import annotations

import csv
import os
import re
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

EXTENSIONS = {".csv": "csv", ".parquet": "parquet", ".jsonl": "jsonl", ".ndjson": "jsonl"}
MAX_PATTERNS, MAX_FILES, MAX_TOTAL, MAX_CELL, MAX_LINE = 64, 10_000, 8 << 30, 4 << 20, 16 << 20


class SourceError(ValueError):
    """A source that can't be read as asked; code names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def glob_pattern(glob: str) -> str:
    """A regular expression of a glob: * and ? stay within a folder, ** spans folders, [..] is a set; checked before use."""
    if not glob or glob.startswith("/") or ".." in glob.split("/") or "\\" in glob:
        raise SourceError("PATTERN", glob)
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out.append("(?:[^/]+/)*")
            k += 2
        elif glob.startswith("**", k):
            out.append(".*")
            k += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", k + 2)
            if end < 0:
                raise SourceError("PATTERN", glob)
            body = glob[k + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def list_files(root: str, include: tuple[str, ...] = (), ignore: tuple[str, ...] = (), kind: str | None = None, max_files: int = MAX_FILES, max_total: int | None = None) -> list[str]:
    """Regular files under root in byte order of their relative paths; links are not followed; too many files or bytes are an error."""
    if max(len(include), len(ignore)) > MAX_PATTERNS:
        raise SourceError("TOO_MANY_PATTERNS", f"at most {MAX_PATTERNS} globs")
    wanted_by, ignored_by = ([re.compile(glob_pattern(p)) for p in ps] for ps in (include, ignore))
    base, found, total = Path(root), [], 0
    if base.is_file():
        return [str(base)]
    for folder, folders, names in os.walk(base, followlinks=False):
        folders.sort()
        for name in names:
            path = Path(folder, name)
            inner = path.relative_to(base).as_posix()
            if path.is_symlink() or name.startswith((".", "_")):
                continue
            wanted = any(p.match(inner) for p in wanted_by) if include else (EXTENSIONS.get(path.suffix) == kind if kind else path.suffix in EXTENSIONS)
            if wanted and not any(p.match(inner) for p in ignored_by):
                found.append((inner.encode(), str(path)))
                total += path.stat().st_size
                if len(found) > max_files or (max_total is not None and total > max_total):
                    raise SourceError("SOURCE_TOO_LARGE", f"more than {max_files} files or {max_total} bytes")
    return [p for _, p in sorted(found)]


def infer_kind(files: list[str], declared: str | None = None) -> str:
    """Format by extension; mixed or contradicting formats are errors."""
    kinds = {EXTENSIONS.get(Path(f).suffix) for f in files}
    if len(kinds) > 1:
        raise SourceError("MIXED_FORMAT", ", ".join(sorted(map(str, kinds))))
    found = next(iter(kinds), None) or declared
    if declared and found != declared:
        raise SourceError("SOURCE_FORMAT_MISMATCH", f"declared {declared}, found {found}")
    if found is None:
        raise SourceError("UNKNOWN_FORMAT", "no known extension")
    return found


def read_csv(spark: SparkSession, paths: list[str], delimiter: str = ",", empty_as_null: bool = False) -> DataFrame:
    """Header required, every cell a string, ragged rows fail; an empty cell is '' (or null for SQL inputs)."""
    if len(delimiter.encode()) != 1:
        raise SourceError("DELIMITER", "one ASCII character")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in csv_header(spark, paths, delimiter)])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("sep", delimiter).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(paths)
    for c in df.columns:  # a longer cell fails where it is read
        df = df.withColumn(c, F.when(F.octet_length(f"`{c}`") <= MAX_CELL, F.col(f"`{c}`")).otherwise(F.when(F.col(f"`{c}`").isNotNull(), F.raise_error(F.lit(f"a cell of {c} is longer than {MAX_CELL} bytes")).cast("string"))))
    return df if empty_as_null else df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def csv_header(spark: SparkSession, paths: list[str], delimiter: str = ",") -> list[str]:
    """The one header of all files, read from their first lines in one job; files that differ are an error."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "k").alias("value")).select("value").distinct().limit(2).collect()
    heads = {tuple(next(csv.reader([r["value"].rstrip("\r").lstrip("\ufeff")], delimiter=delimiter), ())) for r in first}
    if len(heads) != 1:
        raise SourceError("SHARD_SCHEMA" if heads else "EMPTY_SOURCE", "shards differ in their headers" if heads else "no header")
    names = list(heads.pop())
    if len(set(names)) != len(names) or "" in names:
        raise SourceError("HEADER", "names are empty or repeated")
    return names


def _flat(schema: T.StructType) -> None:
    for f in schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType)):
            raise SourceError("NESTED_FIELD", f.name)


def read_parquet(spark: SparkSession, paths: list[str], as_text: bool = False) -> DataFrame:
    """Flat columns; as_text gives decimals, dates and times as exact text, as recipes see them."""
    df = spark.read.option("recursiveFileLookup", True).parquet(*paths)
    _flat(df.schema)
    if not as_text:
        return df
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.DateType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" +00:00"))
        shown.append(c.alias(f.name))
    return df.select(*shown)


def read_jsonl(spark: SparkSession, paths: list[str], same_keys: bool = False) -> DataFrame:
    """Flat scalars, blank lines skipped, fields united by name; same_keys: every line must have one key set."""
    if same_keys:
        lines = spark.read.option("lineSep", "\n").text(paths)
        keys = F.array_join(F.array_sort(F.json_object_keys("value")), "\u0000")
        parsed = F.try_parse_json("value")  # null for repeated members too
        row = lines.agg(F.count_distinct(keys).alias("n"), F.count_if(keys.isNull()).alias("bad"), F.count_if(parsed.isNull() & keys.isNotNull()).alias("twice"), F.count_if(F.trim(F.regexp_replace("value", "\r$", "")) == "").alias("blank"), F.coalesce(F.max(F.octet_length("value")), F.lit(0)).alias("longest")).first()
        for code, wrong in (("JSONL_BLANK_LINE", row["blank"]), ("JSONL_LINE_TOO_LONG", row["longest"] > MAX_LINE), ("JSONL_KEYS", row["n"] > 1 or row["bad"]), ("JSONL_REPEATED_MEMBER", row["twice"])):
            if wrong:
                raise SourceError(code, "lines differ in their keys, repeat them, or are no objects")
    df = spark.read.option("mode", "FAILFAST").json(paths)
    _flat(df.schema)
    return df


def read_files(spark: SparkSession, root: str, kind: str | None = None, include: tuple[str, ...] = (), ignore: tuple[str, ...] = (), delimiter: str = ",") -> DataFrame:
    """A file or a folder of shards that share one ordered schema."""
    files = list_files(root, include, ignore, kind)
    if not files:
        raise SourceError("EMPTY_SOURCE", root)
    kind = infer_kind(files, kind)
    if kind == "csv":
        return read_csv(spark, files, delimiter)
    return read_parquet(spark, files, as_text=True) if kind == "parquet" else read_jsonl(spark, files, same_keys=True)


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content_hash) of every regular file below root."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.replace("path", F.lit(base), F.lit("")).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


#: Blocks of files up to this number have their row counts broadcast; beyond it they are joined by shuffle.
BLOCKS = 50_000


def with_ordinals(df: DataFrame, root: str | None = None) -> DataFrame:
    """df with _path (below root, or the bare name) and _row, the number of a row in its file. Text files carry none: rows are counted once by block, then numbered."""
    base = Path(root).resolve() if root else None
    below = F.replace("_metadata.file_path", F.lit((base if base.is_dir() else base.parent).as_uri().rstrip("/") + "/"), F.lit("")) if root else F.col("_metadata.file_name")
    try:
        return df.select("*", below.alias("_path"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # only Parquet knows it
        pass
    rows = df.select("*", below.alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_k"))
    blocks = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    few = blocks.count() <= BLOCKS
    joined = rows.join(F.broadcast(blocks) if few else blocks, ["_path", "_block"])
    return joined.withColumn("_row", F.col("_k") - F.col("_first") + F.col("_before")).select(*df.columns, "_path", "_row")


def with_row_id(df: DataFrame, name: str, file_id: str = "", root: str | None = None) -> DataFrame:
    """Add a deterministic id from file, path and ordinal of a row; the name must be free."""
    if name in df.columns:
        raise SourceError("GENERATED_ID_EXISTS", name)
    key = F.sha2(F.concat_ws("\u0000", F.lit(file_id), F.col("_path"), F.col("_row").cast("string")), 256)
    rows = df if {"_path", "_row"} <= set(df.columns) else with_ordinals(df, root)
    return rows.withColumn(name, F.concat(F.lit("row_"), key)).drop(*({"_path", "_row"} - set(df.columns)))


def row_counts(sources: dict[str, DataFrame], most: int | None = None) -> dict[str, int]:
    """Rows of each source; more than most together are an error."""
    counts = {name: df.count() for name, df in sources.items()}
    if most is not None and sum(counts.values()) > most:
        raise SourceError("SOURCE_ROWS", f"{sum(counts.values())} rows are more than {most}")
    return counts


def unchanged(spark: SparkSession, root: str, before: DataFrame) -> DataFrame:
    """A second manifest of root, the same as before, or an error: files that change while they are scanned are not a snapshot."""
    after = file_manifest(spark, root)
    if not before.exceptAll(after).isEmpty() or not after.exceptAll(before).isEmpty():
        raise SourceError("SOURCE_CHANGED", root)
    return after
