"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits its vectors again and again at a random quantile of a random
projection, placed where few vectors lie close by; what lies as close together
as linked vectors is not split. A vector that lies close to a split spills over:
it also goes to the leaf on the other side of the closest split it passed. Vectors are compared
only within leaves, in double precision, and links are united.

A pair may meet in several leaves. It counts in the first leaf that both share,
which each side can tell from its own list of leaves, so links are counted
exactly without ever writing pairs down.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import components, keyed, materialize, merge_labels, pair_units

#: Least cosine of a link; trees; directions of a tree; vectors of a leaf aimed at.
COSINE, TREES, POOL, LEAF = 0.95, 8, 64, 1024
#: Spill within this share of a projection's spread; vectors that split points are read from.
SPILL, SAMPLE = 0.35, 32768
#: Spread of projections, as a share of a projection's spread, below which a node is left whole.
TIGHT = 1.0
#: Rows of a leaf above which it is split into blocks, and levels with own split points.
CAP, OWN = 4096, 11


class Forest:
    """Trees of one depth; leaves(x) gives (rows, 2 * trees) leaf codes, -1 where a vector does not spill."""

    def __init__(self, dim: int, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.spill = depth, spill
        self.trees = trees if depth else 1
        self.pool = rng.normal(size=(self.trees, POOL, dim))
        self.pick = rng.integers(0, POOL, (self.trees, max(1, depth), 1 << min(depth, OWN)))
        self.share = rng.uniform(0.4, 0.6, self.pick.shape)
        self.cut: list[list[np.ndarray]] = []

    def fit(self, x: np.ndarray) -> Forest:
        """Read split points off a sample."""
        self.scale, self.middle = [], []
        for t in range(self.trees):
            p = x @ self.pool[t].T
            self.scale.append(p.std(axis=0) + 1e-12)
            self.middle.append(np.median(p, axis=0))
            node, cuts = np.zeros(len(x), np.int64), []
            for level in range(min(self.depth, OWN)):
                pick, share = self.pick[t, level], self.share[t, level]
                cut = self.middle[t][pick[: 1 << level]].copy()
                order = np.argsort(node, kind="stable")
                ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
                for k in range(1 << level):
                    rows = order[ends[k] : ends[k + 1]]
                    if len(rows) >= 16:
                        cut[k] = _sparse_cut(np.sort(p[rows, pick[k]]), share[k], self.scale[t][pick[k]])
                cuts.append(cut)
                node = node * 2 + (p[np.arange(len(x)), pick[node]] > cut[node])
            self.cut.append(cuts)
        return self

    def _split(self, t: int, level: int, node: np.ndarray, p: np.ndarray):
        """(side, distance to the split in spreads) of each row at its node."""
        at = node & ((1 << min(self.depth, OWN)) - 1)
        pick = self.pick[t, level][at]
        cut = self.cut[t][level][node] if level < len(self.cut[t]) else self.middle[t][pick]
        gap = (p[np.arange(len(node)), pick] - cut) / self.scale[t][pick]
        return gap > 0, np.abs(gap)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), 2 * self.trees), -1, np.int64)
        for t in range(self.trees):
            p = x @ self.pool[t].T
            node, least, where, flipped = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                side, gap = self._split(t, level, node, p)
                closer = gap < least
                least[closer], where[closer] = gap[closer], level
                flipped[closer] = node[closer] * 2 + ~side[closer]
                node = node * 2 + side
            out[:, 2 * t] = (t << 40) | node
            spill = np.flatnonzero(least < self.spill)
            other, begun = flipped[spill], where[spill]
            for level in range(self.depth):  # go on down from the other side of the closest split
                below = np.flatnonzero(begun < level)
                if len(below):
                    side, _ = self._split(t, level, other[below], p[spill[below]])
                    other[below] = other[below] * 2 + side
            out[spill, 2 * t + 1] = (t << 40) | other
        return out


def _sparse_cut(p: np.ndarray, share: float, scale: float) -> float:
    """Where to split sorted projections: among quantiles around share, the one with the fewest rows close by.

    Rows as close together as linked pairs are not split at all: their leaf is
    split into blocks later, which loses no pair.
    """
    if p[len(p) * 19 // 20] - p[len(p) // 20] < TIGHT * scale:
        return np.inf
    cuts = np.quantile(p, np.clip(share + np.linspace(-0.2, 0.2, 9), 0.2, 0.8))
    close = np.searchsorted(p, cuts + 0.25 * scale) - np.searchsorted(p, cuts - 0.25 * scale)
    return float(cuts[close.argmin()])


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest code that both rows of a and b hold; -1 is none."""
    best = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        hit = (a[:, k] >= 0) & (b == a[:, k][:, None]).any(axis=1)
        best[hit] = np.minimum(best[hit], a[hit, k])
    return best


def usable(v) -> F.Column:
    """Vectors that can link: not null, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def plant(classes: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> dict[int, Forest]:
    """A forest for each length of vectors that more than leaf of them have; others are one leaf a length.

    Split points come from at most sample vectors a length, chosen by hash.
    """
    many = classes.groupBy(F.size("v").alias("d")).count().where(F.col("count") > leaf).collect()  # at most one row for leaf vectors
    forests = {}
    for d, total in sorted((r["d"], r["count"]) for r in many):
        part = min(1.0, 1.2 * sample / total)
        chosen = classes.where((F.size("v") == d) & (F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(part * 1_000_000) + 1)).select("v").limit(sample).collect()
        x = np.array([r["v"] for r in sorted(chosen)], float)
        forests[d] = Forest(d, math.ceil(math.log2(total / leaf)), trees).fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    return forests


def vector_links(classes: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """classes (node, n, v), one row per distinct vector of n copies: rows (a, b, links).

    b not null: an edge; the edges of a leaf span its links. b null: a has
    links more linked vectors, counted with their copies. Every vector is placed
    and compared, with those of its own length.
    """
    shared = classes.sparkSession.sparkContext.broadcast(plant(classes, trees, leaf, sample))
    names = ["node", "n", "v", "d", "leaves", "at"]

    def place(batches):
        for batch in batches:
            vectors = batch.column(2)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == d)))
                x = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, d)
                forest, unit = shared.value.get(int(d)), x.astype(float)
                leaves = forest.leaves(unit / np.linalg.norm(unit, axis=1, keepdims=True)) if forest else np.zeros((len(x), 1), np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.full(len(x), d, np.int32)), pa.array([r.tobytes() for r in leaves], pa.binary()), pa.array([r[r >= 0].tolist() for r in leaves], pa.list_(pa.int64()))], names)

    kind = np.float32 if "float" in classes.schema["v"].dataType.simpleString() else np.float64
    placed = classes.select("node", "n", "v").mapInArrow(place, "node long, n long, v binary, d int, leaves binary, at array<long>")
    units = pair_units(placed.select("node", "n", "v", "d", "leaves", F.explode(F.array_distinct("at")).alias("leaf")), ["d", "leaf"], "node", CAP)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        nodes, copies, block = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy()
        leaves = np.frombuffer(b"".join(pdf["leaves"]), np.int64).reshape(len(pdf), -1)
        x = np.frombuffer(b"".join(pdf["v"]), kind).reshape(len(pdf), -1).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        here, i, j = pdf["leaf"].iloc[0], pdf["unit_i"].iloc[0], pdf["unit_j"].iloc[0]
        one, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        labels, links = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
        for at in range(0, len(one), 512):
            rows = one[at : at + 512]
            q, w = np.nonzero(x[rows] @ x[other].T >= cosine)
            a, b = rows[q], other[w]
            if i == j:
                a, b = a[a < b], b[a < b]
            merge_labels(labels, a, b)
            for k in range(0, len(a), 1 << 16):
                p, q2 = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                new = first_shared(leaves[p], leaves[q2]) == here
                links += np.bincount(p[new], copies[q2[new]], len(pdf)).astype(np.int64) + np.bincount(q2[new], copies[p[new]], len(pdf)).astype(np.int64)
        edge, count = np.flatnonzero(labels != np.arange(len(pdf))), np.flatnonzero(links)
        return pd.DataFrame({
            "a": np.concatenate([nodes[edge], nodes[count]]),
            "b": pd.array(np.concatenate([nodes[labels[edge]], np.zeros(len(count), np.int64)]), "Int64").copy() if not len(count) else pd.array([*nodes[labels[edge]].tolist(), *[None] * len(count)], "Int64"),
            "links": np.concatenate([np.zeros(len(edge), np.int64), links[count]]),
        })

    return units.groupBy("d", "leaf", "unit_i", "unit_j").applyInPandas(compare, "a long, b long, links long")


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    n_links counts the other rows linked directly, copies included.
    component_id is the smallest id reachable. Vectors link within their length.
    Vectors that are null, zero, or hold null or non-finite components link with
    nothing and are their own component; so do rows of a null id, whose
    component is null. Other columns are not read; an empty table gives none.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fits = F.coalesce(usable(F.col("v")) & F.col("id").isNotNull(), F.lit(False))
    classes = materialize(rows.where(fits).groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "vectors")
    found = materialize(vector_links(classes, cosine, trees, leaf, sample), "links")
    labels = components(found.where("b is not null"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.join(counts, "node", "left").join(labels, "node", "left")
    known = materialize(known.select("v", F.col("n").alias("_n"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "known")
    hit = keyed(rows.where(fits), known, "v", few=0).select("id", "n_links", "component_id")
    rest = rows.where(~fits).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return hit.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_vectors(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings at cosine 0.95."""
    return vector_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
