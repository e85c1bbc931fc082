"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints lie as vertical bit planes: plane p holds bit p of 64 fingerprints
in one word. A query XORs its bit into every plane and adds the planes three at
a time with carry-save adders into bitwise counters, so one word operation moves
64 distances. Lanes past the radius stick in an overflow word; blocks whose
lanes are all over are abandoned, and after the first planes only the words
with a live lane are carried on.

Candidates come from the pigeonhole principle: fingerprints that differ in at
most r bits agree on at least m - r of m bands, so each choice of m - r bands is
a table keyed by their bits. The number of key bits follows the number of
fingerprints; it only sets bucket sizes and never loses a pair.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import components, keyed, materialize, merge_labels, pair_units

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Rows of a bucket aimed at, and rows of a bucket above which it is split into blocks.
BUCKET, CAP = 2048, 8192
_SLICE = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of one UTF-8 text; None or no words: 0; fewer than width words: one shingle of all."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(width))) if len(words) >= width else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - width + 1)
    return fingerprint_of(np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, n))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes: a bit is 1 if set in over half of them."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, _SLICE):
        part = hashes[at : at + _SLICE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed 64-bit integer."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(run, "id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) planes of uint64: lane i of plane p is bit p of fingerprint i."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(counters: list[np.ndarray], over: np.ndarray, carry: np.ndarray, at: int) -> None:
    """Add a word of weight 2**at to bitwise counters; what overflows the last one sticks in over."""
    for k in range(at, len(counters)):
        counters[k], carry = counters[k] ^ carry, counters[k] & carry
    over |= carry


def close_pairs(queries: np.ndarray, fps: np.ndarray, radius: int = RADIUS, step: int = 128):
    """Yield (query indexes, fingerprint indexes) of all pairs that differ in at most radius bits."""
    planes = bit_planes(fps)
    spare = np.zeros(planes.shape[1], np.uint64)
    if len(fps) % 64:
        spare[-1] = ~np.uint64((1 << (len(fps) % 64)) - 1)
    width = max(1, int(radius).bit_length())
    stops = (24, 42, 64)
    for begin in range(0, len(queries), step):
        part = queries[begin : begin + step]
        flip = (np.uint64(0) - np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64)).reshape(len(part), 64)
        rows, words = (x.ravel() for x in np.indices((len(part), planes.shape[1])))
        over = np.broadcast_to(spare, (len(part), planes.shape[1])).ravel().copy()
        counters = [np.zeros_like(over) for _ in range(width)]
        dense, p = True, 0
        for stop in stops:
            if dense:
                plane = lambda k: (planes[k][None, :] ^ flip[:, k][:, None]).ravel()
            else:
                plane = lambda k: planes[k][words] ^ flip[rows, k]
            while p < stop:
                if stop - p >= 3 and width > 1:
                    x, y, z = plane(p), plane(p + 1), plane(p + 2)
                    both = x ^ y
                    _add(counters, over, both ^ z, 0)
                    _add(counters, over, (x & y) | (both & z), 1)
                    p += 3
                else:
                    _add(counters, over, plane(p), 0)
                    p += 1
            live = np.flatnonzero(~over)
            if not len(live):
                break  # every lane of the block is past the radius
            if len(live) < len(over):
                rows, words, over, counters, dense = rows[live], words[live], over[live], [c[live] for c in counters], False
        else:
            alive = ~over
            if radius + 1 != 1 << width:  # counters can still hold values above the radius
                value_ok = np.zeros_like(over)
                for v in range(radius + 1):
                    same = ~np.uint64(0)
                    for k in range(width):
                        same = same & (counters[k] if v >> k & 1 else ~counters[k])
                    value_ok |= same
                alive &= value_ok
            lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            yield begin + rows[at], words[at] * 64 + lane


def band_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the key bits of each table; every pair within radius agrees under one of them at least."""
    need = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    if not need:
        return [0]
    for m in range(radius + 1, radius + 5):
        cuts = [64 * k // m for k in range(m + 1)]
        bands = [list(range(cuts[k], cuts[k + 1])) for k in range(m)]
        if min(map(len, bands)) * (m - radius) >= need or m == radius + 4:
            break
    masks = []
    for chosen in combinations(bands, m - radius):
        bits = [b for row in zip(*chosen) for b in row][:need]
        masks.append(sum(1 << b for b in bits))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """classes (node, fp), one row per distinct fp: edges (a, b) that span every component of pairs within radius.

    A unit of pairs gives a spanning forest of its own links, never all pairs.
    """
    masks = band_masks(classes.count(), radius)
    keyed = classes.select("node", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("band", "key"))
    units = pair_units(keyed, ["band", "key"], "fp", CAP)

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, nodes = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        fps, nodes, block = fps[order], nodes[order], pdf["block"].to_numpy()[order]
        labels = np.arange(len(fps))
        one, other = (np.flatnonzero(block == pdf[c].iloc[0]) for c in ("unit_i", "unit_j"))
        for q, w in close_pairs(fps[one], fps[other], radius):
            merge_labels(labels, one[q], other[w])
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[labels[linked]]})

    return units.groupBy("band", "key", "unit_i", "unit_j").applyInPandas(forest, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row per input row: id_col, fp long, component_id (the smallest id reachable over links).

    Texts of one fingerprint are one class, represented by its smallest id.
    Null or word-less texts have fingerprint 0 and link like any other; rows of
    a null id get the component of their fingerprint; repeated rows repeat;
    an empty table gives an empty result. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("_n")), "classes")
    labels = components(fingerprint_links(classes.where("node is not null").drop("_n"), radius))
    known = materialize(classes.join(labels, "node", "left").select("fp", "_n", F.coalesce("component", "node").alias("component_id")), "known")
    return keyed(fps, known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def as_hex(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components within three bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
