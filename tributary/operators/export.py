"""Splits, hash order, shards, and their verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.scalars import UNITS, draw_key, slot

MAX_SPLITS = 16


def split_units(weights: dict[str, float]) -> dict[str, int]:
    """Weights as parts of 10,000 by largest remainder, ties by name; a split without a part is an error."""
    if not weights or len(weights) > MAX_SPLITS or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    exact = {n: weights[n] * UNITS / total for n in sorted(weights)}
    units = {n: int(x) for n, x in exact.items()}
    for n in sorted(exact, key=lambda n: (units[n] - exact[n], n))[: UNITS - sum(units.values())]:
        units[n] += 1
    if 0 in units.values():
        raise ValueError("a split has no part")
    return units


def choose_split(at: Column, units: dict[str, int]) -> Column:
    """The first split, by name, whose cumulative part lies above the slot."""
    out, total = None, 0
    for n in sorted(units):
        total += units[n]
        out = F.when(at < total, n) if out is None else out.when(at < total, n)
    return out


def assign(df: DataFrame, id_col: str, seed: str, weights: dict[str, float]) -> DataFrame:
    """df with split_key, slot and split: by hash of seed and id, so rows keep their split as data grow."""
    keyed = df.withColumn("split_key", draw_key("split", seed, F.col(id_col)))
    return keyed.withColumn("slot", slot(F.col("split_key"))).withColumn("split", choose_split(F.col("slot"), split_units(weights)))


def _ranks(df: DataFrame, id_col: str) -> DataFrame:
    """Rank of each row in (split, key, id) order without one task for a split: ranks within buckets of the hash, plus what lies before."""
    rows = df.withColumn("_bucket", F.substring("split_key", 1, 2))
    counts = rows.groupBy("split", "_bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most 256 rows a split
    before = Window.partitionBy("split").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy("split", "_bucket").orderBy("split_key", id_col)
    return rows.withColumn("_k", F.row_number().over(inner)).join(F.broadcast(base), ["split", "_bucket"]).withColumn("position", F.col("_before") + F.col("_k") - 1).drop("_bucket", "_k", "_before")


def shard(df: DataFrame, id_col: str, max_records: int) -> DataFrame:
    """Assigned rows with position (0-based within the split, in hash order) and shard."""
    return _ranks(df, id_col).withColumn("shard", F.floor(F.col("position") / max_records).cast("bigint"))


def shard_by_bytes(df: DataFrame, id_col: str, max_records: int, max_bytes: int) -> DataFrame:
    """(split, id, position, shard): a shard closes at max_records or before it would pass max_bytes; a longer record stands alone.

    The rule is sequential within a split. Only ids and sizes travel for it:
    a task sorts its splits by position, spilling where they are large, and
    reads them as a stream that remembers nothing but the open shard. Records
    of null bytes have none.
    """
    rows = _ranks(df, id_col).select("split", F.col(id_col).alias("id"), "position", F.coalesce(F.col("bytes").cast("bigint"), F.lit(0)).alias("bytes"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        split, shard, n, size = None, 0, 0, 0
        for batch in batches:
            shards = np.empty(batch.num_rows, np.int64)
            names = batch.column(0).to_pylist()
            sizes = batch.column(3).to_numpy()
            for k, name in enumerate(names):
                if name != split:
                    split, shard, n, size = name, 0, 0, 0
                if n and (n == max_records or size + sizes[k] > max_bytes):
                    shard, n, size = shard + 1, 0, 0
                n, size = n + 1, size + int(sizes[k])
                shards[k] = shard
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shards)], ["split", "id", "position", "shard"])

    return rows.repartition("split").sortWithinPartitions("split", "position").mapInArrow(run, f"split string, id {kind}, position long, shard long")


def summary(sharded: DataFrame) -> DataFrame:
    """(split, records, shards)."""
    return sharded.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("shard").alias("shards"))


def verify(sharded: DataFrame, id_col: str, seed: str, weights: dict[str, float], max_records: int) -> DataFrame:
    """(wrong_split, wrong_order, repeated): all zero for a sound bundle."""
    key = draw_key("split", seed, F.col(id_col))
    wrong = choose_split(slot(key), split_units(weights)) != F.col("split")
    before = F.lag("split_key").over(Window.partitionBy("split", "shard").orderBy("position"))
    checked = sharded.withColumn("_wrong", wrong).withColumn("_order", F.coalesce(before > F.col("split_key"), F.lit(False)))
    first = checked.agg(F.count_if("_wrong").alias("wrong_split"), F.count_if("_order").alias("wrong_order"))
    twice = sharded.groupBy(id_col).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    return first.crossJoin(twice)  # one row each
