"""Near-duplicates of word shingles: SimHash candidates, verified by exact Jaccard similarity.

The SimHash operator's banded tables name the first candidates: fingerprints of
few differing bits, as in simhash.py; whole sets decide. Similar texts whose
fingerprints differ in more bits than bands can bring together meet otherwise:
two shingle sets of similarity 4/5 or more share a shingle among the first
n - ceil(4n/5) + 1 of each in any order common to all sets, so keys made of these
prefixes bring every pair together. Shingles that are frequent in a sample come
last in the order, which only keeps the units small. Within a unit the SimHash
fingerprints of the same sets are compared bit-sliced at a radius of 28 in the
first 64 bits, then at 81 in all 256: each of them a pair of that similarity
fails with probability 1e-7 at most (12 and 48 bits differ at most on average,
deviations 3.1 and 6.2), and of strangers next to none passes both. What is left
is verified on whole sets. Of the pairs with the ends of a key the closest of
each text is checked first. Keys that then still hold several components are
drawn together into clusters, whose units first tell which texts are candidates
across components, so that only these travel, then verify them and give back no
more than the links that join some, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import FEW, components, discard, materialize, pair_units, quiet
from tributary.llm.simhash import SEED, close_pairs, fingerprint_links, fingerprint_of

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Texts from which frequent shingles are told, how often they occur there at least, and how many are known at most.
SAMPLE, OFTEN, KNOWN = 20_000, 4, 100_000
#: Rows of a cluster above which it is split into blocks, and rows that go to one call, about: units are small.
CAP, ROWS = 1024, 2000
#: Bits of the first 64 and of all 256 in which candidates may differ.
RADIUS, WIDE = 28, 81
#: Words of a fingerprint: SimHash of the hashes, and of what each factor makes of them.
PRINT = ["fp", "fp1", "fp2", "fp3"]
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of width words; fewer words: one shingle of all, none or None: one of no words."""
    words = (text or b"").lower().split()
    grams = zip(*(words[k:] for k in range(width))) if len(words) >= width else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(g), SEED) for g in grams), np.uint64))


def words_of(found: np.ndarray) -> list[int]:
    """The words of a set's fingerprint."""
    mixed = []
    for f in _FACTORS:
        x = (found ^ (found >> np.uint64(31))) * f
        mixed.append((x ^ (x >> np.uint64(29))) * f)
    return [fingerprint_of(x) for x in (found, *(x ^ (x >> np.uint64(32)) for x in mixed))]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sets of shingles is NUM / DEN or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _frequent(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Sorted hashes and counts (2, n) of shingles frequent in a sample of texts; only the order of shingles follows from them."""
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    every = max(1, docs.count() // SAMPLE)
    texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()

    def run(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))], ["key"])

    counts = texts.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "key").limit(KNOWN).collect()
    found = np.array([(r["key"], r["n"]) for r in rows], np.int64).reshape(-1, 2).T
    keys = found[0].copy().view(np.uint64)
    order = np.argsort(keys)
    return np.stack([keys[order], found[1][order].astype(np.uint64)])


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: as many as every set similar to it must meet."""
    rank = np.zeros(len(found), np.uint64)
    if frequent.shape[1]:
        at = np.minimum(np.searchsorted(frequent[0], found), frequent.shape[1] - 1)
        rank = np.where(frequent[0][at] == found, frequent[1][at], rank)
    n = len(found)
    return found[np.lexsort((found, rank))][: n - -(-NUM * n // DEN) + 1]


def _described(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_hash, node, n, *PRINT, prefix) of every row; node stands for the set of shingles, PRINT is its SimHash."""
    frequent = _frequent(docs, text_col, width)
    text = F.col(text_col).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), text.alias("text"))

    def run(batches):
        with quiet():
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    yield describe(batch.slice(at, 1000))

    def describe(batch):
        nodes, sizes, prints, firsts = [], [], [], []
        for t in batch.column(2):
            s = shingles(t.as_py(), width)
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            sizes.append(len(s))
            prints.append(words_of(s))
            firsts.append(prefix(s, frequent).view(np.int64))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(nodes), pa.array(sizes, pa.int32()), *map(signed, zip(*prints)), pa.array(firsts, pa.list_(pa.int64()))], ["id", "text_hash", "node", "n", *PRINT, "prefix"])

    return source.mapInArrow(run, f"id long, text_hash long, node long, n int, {', '.join(f'{p} long' for p in PRINT)}, prefix array<long>")


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of each of nodes: one text of each, dealt by node."""
    used = materialize(classes.join(nodes.distinct(), "node", "left_semi").select("node", "text_hash"), "used")
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(F.broadcast(used) if used.count() <= FEW else used, "text_hash").dropDuplicates(["node"]).select("node", "text")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """Those of pairs (a, b) that are similar, by their whole sets of shingles."""
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), classes, docs, text_col)

    def sets(batches):
        with quiet():
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    found = [shingles(t.as_py(), width).tobytes() for t in part.column(1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "found"])

    found = materialize(texts.mapInArrow(sets, "node long, found binary"), "sets")

    def check(batches):
        with quiet():
            for batch in batches:
                keep = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column(2), batch.column(3))]
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one, other = found.toDF("a", "one"), found.toDF("b", "other")
    links = materialize(pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(check, "a long, b long"), "links")
    discard(found)
    return links


def _apart(a: str, b: str, words: list[str] = PRINT):
    """Bits in which the fingerprints of two structs differ."""
    return sum(F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in words)


def _possible(a: str, b: str):
    """Can two sets of these sizes be similar? And are their fingerprints close?"""
    sizes = DEN * F.least(f"{a}.n", f"{b}.n") >= NUM * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (_apart(a, b, PRINT[:1]) <= RADIUS) & (_apart(a, b) <= WIDE)


def banded(classes: DataFrame) -> DataFrame:
    """Candidates (a, b) of the SimHash operator: forests of fingerprints of few differing bits, and of those that are equal."""
    prints = materialize(classes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = classes.join(prints.withColumnRenamed("node", "least"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return fingerprint_links(prints.select("node", "fp")).union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _split(units: pd.DataFrame):
    """units (cluster, unit_i, unit_j, ...) in order, and for each unit its rows and those of its two blocks."""
    units = units.sort_values(["cluster", "unit_i", "unit_j", "node"], kind="stable").reset_index(drop=True)
    unit, block = units[["cluster", "unit_i", "unit_j"]].to_numpy(), units["block"].to_numpy()
    begins = np.flatnonzero(np.r_[len(unit) > 0, (unit[1:] != unit[:-1]).any(axis=1)])

    def parts():
        for begin, end in zip(begins, np.r_[begins[1:], len(unit)]):
            rows = np.arange(begin, end)
            yield rows, rows[block[rows] == unit[begin][1]], rows[block[rows] == unit[begin][2]]

    return units, parts()


def _candidates(prints: np.ndarray, n: np.ndarray, one: np.ndarray, other: np.ndarray):
    """Yield rows (a of one, b of other) whose fingerprints are close and whose sizes allow similarity."""
    for q, w in close_pairs(prints[one, 0], prints[other, 0], RADIUS):
        a, b = one[q], other[w]
        ok = DEN * np.minimum(n[a], n[b]) >= NUM * np.maximum(n[a], n[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1) <= WIDE
        yield a[ok], b[ok]


def crossing(units: pd.DataFrame) -> pd.DataFrame:
    """Those rows of each unit that are candidates with one of another component."""
    units, parts = _split(units)
    prints, n, component = np.ascontiguousarray(units[PRINT].to_numpy(np.int64)).view(np.uint64), units["n"].to_numpy(), units["component"].to_numpy()
    hit = np.zeros(len(units), bool)
    for rows, one, other in parts:
        if (component[rows] != component[rows[0]]).any():
            for a, b in _candidates(prints, n, one, other):
                apart = component[a] != component[b]
                hit[a[apart]] = hit[b[apart]] = True
    return units.loc[hit, units.columns != "call"]


def joining_links(units: pd.DataFrame, width: int = SHINGLE) -> pd.DataFrame:
    """Links (a, b) that join components within each unit (cluster, unit_i, unit_j): a forest over its components, found by comparing fingerprints, then the whole sets of the texts."""
    units, parts = _split(units)
    node, n = (units[c].to_numpy() for c in ("node", "n"))
    prints = np.ascontiguousarray(units[PRINT].to_numpy(np.int64)).view(np.uint64)
    links = []
    for rows, one, other in parts:
        begin = rows[0]
        part = pd.factorize(units["component"].to_numpy()[rows])[0]
        labels = np.arange(part.max() + 1)
        sets: dict[int, np.ndarray] = {}
        texts = units["text"].to_numpy()[rows]

        def shingled(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(texts[k], width)
            return sets[k]

        for a, b in _candidates(prints, n, one, other):
            a, b = a - begin, b - begin
            ok = labels[part[a]] != labels[part[b]]
            for x, y in zip(a[ok], b[ok]):
                c, d = labels[part[x]], labels[part[y]]
                if c != d and similar(shingled(x), shingled(y)):
                    labels[labels == max(c, d)] = min(c, d)
                    links.append((node[begin + x], node[begin + y]))
    found = np.array(links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": found.min(axis=1) if len(found) else found[:, 0], "b": found.max(axis=1) if len(found) else found[:, 1]})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """One row per input row: id, text_hash, component (equal for rows joined by links of similarity NUM / DEN or more).

    No pair below that similarity links; a pair of it is missed with probability
    2e-7 at most, where its fingerprints differ by over RADIUS or WIDE bits. Null and
    word-less texts are copies of each other; words are split at ASCII
    whitespace and compared without ASCII case. Other columns are not read.
    """
    described = materialize(_described(docs, id_col, text_col, width), "described")
    classes = materialize(described.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *(F.first(c).alias(c) for c in ("n", *PRINT, "prefix"))), "classes")
    rows = materialize(described.select("id", "text_hash", "node"), "rows")
    discard(described)
    # of the keys most stand alone: these are told by their number only, before more than a node travels with a key
    keyed = classes.select("node", F.explode("prefix").alias("key"))
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    shared = materialize(keyed.join(repeated, "key", "left_semi"), "shared")
    facts = materialize(classes.select("node", "text_hash", "n", *PRINT), "facts")
    discard(classes)

    place = F.struct("node", "n", *PRINT)
    held = materialize(shared.join(facts.drop("text_hash"), "node").select("key", place.alias("x")), "held")
    ends = held.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ends = held.join(ends, "key").select("x", F.explode(F.array("low", "high")).alias("y")).where("x.node <> y.node").where(_possible("x", "y"))
    ends = ends.groupBy(F.col("x.node").alias("x")).agg(F.min(F.struct(_apart("x", "y").alias("bits"), F.col("y.node").alias("y"))).alias("best"))
    ends = ends.select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b"))
    ends = materialize(ends.union(banded(facts)).distinct(), "ends")
    discard(held)
    links = _verified(ends, facts, docs, text_col, width)
    known = components(links)

    across = shared.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    across = materialize(across, "across")
    discard(shared)
    mixed = across.groupBy("key").agg(F.min("component").alias("cluster"), F.max("component").alias("_most")).where("cluster <> _most").select("key", "cluster")
    members = materialize(across.join(mixed, "key").select("cluster", "node", "component").distinct().join(facts.drop("text_hash"), "node"), "members")
    discard(across)

    def dealt(units: DataFrame) -> DataFrame:
        calls = max(16, units.count() // ROWS)
        return units.withColumn("call", F.pmod(F.xxhash64("cluster", "unit_i", "unit_j"), F.lit(calls))).groupBy("call")

    units = materialize(pair_units(members, ["cluster"], "node", CAP), "units")
    units = materialize(dealt(units).applyInPandas(crossing, units.schema), "crossing")
    units = units.join(_texts(units.select("node"), facts, docs, text_col), "node")
    more = materialize(dealt(units).applyInPandas(lambda pdf: joining_links(pdf, width), "a long, b long"), "links")
    links = links.union(more)
    known = materialize(components(links), "known")
    return rows.join(known, "node", "left").select("id", "text_hash", F.coalesce("component", "node").alias("component"))
