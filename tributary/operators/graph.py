"""Tables that cut lineage, pair units that split hot keys, and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import shared_dir

#: A table of up to this many counted rows is broadcast to those it is held against; a larger one is joined by shuffle.
FEW = 100_000


def beside(small: DataFrame) -> DataFrame:
    """small, to be broadcast where its counted rows are few."""
    return F.broadcast(small) if small.count() <= FEW else small


#: Rows of one key above which a join does not shuffle them.
HOT = 1_000_000


def keyed(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", few: int = FEW, hot: int = HOT) -> DataFrame:
    """rows beside table, which has one row a key and _n, the rows of rows that bear it; how: inner or left.

    A table of few counted rows is broadcast. Else only keys of over hot rows
    are, of which there are few however many rows there be, and all others meet
    by shuffle, so no task gets a hot key's rows; null keys stay where they are.
    """
    facts = table.drop("_n")
    if table.count() <= few:
        return rows.join(F.broadcast(facts), key, how)
    heavy = table.where(F.col("_n") > hot).drop("_n")
    known = rows.where(F.col(key).isNotNull())
    if heavy.isEmpty():
        out = known.join(facts, key, how)
    else:
        rest = known.join(F.broadcast(heavy.select(key)), key, "left_anti")
        out = known.join(F.broadcast(heavy), key).unionByName(rest.join(table.where(F.col("_n") <= hot).drop("_n"), key, how))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, a lost executor costs one task."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pair_units(rows: DataFrame, keys: list[str], salt: str, cap: int, shared_only: bool = False) -> DataFrame:
    """Deal rows into units so that any two rows of equal keys meet in exactly one unit.

    A key of up to ``cap`` rows is one unit. A larger one is split by a hash of
    ``salt`` into blocks, and each pair of blocks is a unit (unit_i < unit_j:
    only pairs across; unit_i = unit_j: all pairs inside), so no task ever gets
    a whole hot key. Adds block, unit_i, unit_j. shared_only: rows alone under
    their key, which form no pair, are left out early.
    """
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (1 if shared_only else cap))
    large = large.withColumn("_blocks", F.ceil(F.col("_n") / cap).cast("int")).drop("_n")
    dealt = rows.join(large, keys, "inner" if shared_only else "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(salt), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("unit_i", F.least("block", "_other")).withColumn("unit_j", F.greatest("block", "_other")).drop("_blocks", "_other")


#: Edges, counted, that one task unites in memory: two columns of as many rows.
SMALL = 1_000_000


def _united(e: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v), in one task."""
    kind = e.schema["u"].dataType.simpleString()

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        u, v = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in parts]) for k in (0, 1))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)  # sorted, so a label's least index is its least node
        labels = np.arange(len(nodes))
        merge_labels(labels, place[: len(u)], place[len(u) :])
        linked = np.flatnonzero(labels != np.arange(len(nodes)))
        for k in range(0, len(linked), 1 << 16):
            some = linked[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[labels[some]])], ["node", "component"])

    return materialize(e.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"), "united")


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """Connected components of an edge list: (node, component), component the smallest node reachable.

    Up to small counted edges are united by one task. More alternate large-star and small-star contraction: each round is two grouped
    minima and two equi-joins, every node ends up hanging off the least node of
    its component, and no adjacency list is ever gathered. Rounds grow with the
    logarithm of the longest path. Null ends are left out; a component's least
    node itself is not listed.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, before = materialize(e, "edges"), None
    while True:
        sign = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first())
        if before is None and 0 < sign[0] <= small:
            return _united(e)
        if sign == before or not sign[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        old, before = e, sign
        e = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs (a, b) into labels, in place; labels[i] is the smallest index reachable so far."""
    while len(a):
        ra, rb = labels[a], labels[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped
