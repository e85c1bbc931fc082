"""Image folders as tables: layout and findings of a scan, perceptual hashes of pixels, and a cache of what was decoded before.

No imaging library is a part of this engine: decoded images come as columns
(width, height, channels, media_format, luma), from whatever decoded them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS, SUFFIXES, MAX_DECODED = ("train", "val", "test"), ("jpg", "jpeg", "png", "webp"), 32 << 20
# The order of a perceptual hash.
SIDE, LOW = 32, 8


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content_hash, split, label, logical_path, code) of every regular file: <split>/<label>/<file>, code INVALID_LAYOUT where it is none."""
    from tributary.sources.readers import file_manifest

    return layout(file_manifest(spark, root))


def layout(files: DataFrame) -> DataFrame:
    """files (path, size, content_hash) with split, label, logical_path and code."""
    form = rf"^({'|'.join(SPLITS)})/([^/]+)/(.+)\.({'|'.join(SUFFIXES)})$"
    lower = F.concat(F.regexp_extract("path", r"^(.*)\.[^./]*$", 1), F.lit("."), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    good = F.regexp_like(lower, F.lit(form))
    part = lambda k: F.when(good, F.regexp_extract(lower, form, k))
    code = F.when(~good, "INVALID_LAYOUT").when(F.col("size") > MAX_DECODED, "IMAGE_DECODE_SKIPPED")
    return files.select("*", part(1).alias("split"), part(2).alias("label"), F.when(good, F.regexp_replace("path", "^[^/]+/", "")).alias("logical_path"), code.alias("code"))


def with_media(scanned: DataFrame, decoded: DataFrame) -> DataFrame:
    """The scan with the facts of decoded (content_hash, width, height, channels, media_format, perceptual_hash): what has none failed to decode; other than three channels are told."""
    facts = decoded.dropDuplicates(["content_hash"])
    both = scanned.join(facts, "content_hash", "left")
    code = F.when(F.col("code").isNotNull(), F.col("code")).when(F.col("width").isNull(), "IMAGE_DECODE_FAILED").when(F.col("channels") != 3, "UNEXPECTED_CHANNELS")
    return both.withColumn("code", code)


def scan_findings(samples: DataFrame) -> DataFrame:
    """(severity, code, message, sample_ids) of a scan's codes."""
    severity = F.when(F.col("code").isin("INVALID_LAYOUT", "IMAGE_DECODE_FAILED"), "error").otherwise("warning")
    return samples.where("code is not null").select(severity.alias("severity"), "code", F.lit("sample can't be taken as it is").alias("message"), F.array("path").alias("sample_ids"))


def uncached(scanned: DataFrame, cache: DataFrame) -> DataFrame:
    """Contents that no row of the cache (content_hash, ...) knows, each once: what is left to decode."""
    return scanned.where("code is null").select("content_hash").distinct().join(cache.select("content_hash"), "content_hash", "left_anti")


def _dct() -> np.ndarray:
    k, n = np.arange(SIDE)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


def perceptual_hash(luma: np.ndarray) -> str:
    """16 hex digits of a 32 x 32 luma plane: which of the lowest 8 x 8 frequencies lie above their median, first frequency in the highest bit."""
    basis = _dct()
    low = (basis @ luma.astype(float).reshape(SIDE, SIDE) @ basis.T)[:LOW, :LOW].ravel()
    bits = low > np.median(low)
    return f"{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


def _weights(size: int) -> np.ndarray:
    """(SIDE, size) Lanczos weights of three lobes that scale size samples to SIDE."""
    scale = size / SIDE
    reach = 3 * max(scale, 1.0)
    centre = (np.arange(SIDE) + 0.5) * scale
    x = (np.arange(size) + 0.5 - centre[:, None]) / max(scale, 1.0)
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0) if reach else np.zeros_like(x)
    return w / w.sum(axis=1, keepdims=True)


def resize_luma(luma: np.ndarray) -> np.ndarray:
    """A plane of any size scaled to 32 x 32."""
    high, wide = luma.shape
    return np.clip(np.round(_weights(high) @ luma.astype(float) @ _weights(wide).T), 0, 255)


def with_hashes(pixels: DataFrame, id_col: str = "content_hash") -> DataFrame:
    """(id_col, perceptual_hash) of rows with width, height and luma (row-major bytes); null where the plane is missing or has another size."""

    def run(batches):
        for batch in batches:
            out = []
            for w, h, raw in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                fits = raw is not None and w and h and len(raw) == w * h
                out.append(perceptual_hash(resize_luma(np.frombuffer(raw, np.uint8).reshape(h, w))) if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "perceptual_hash"])

    kind = pixels.schema[id_col].dataType.simpleString()
    return pixels.select(id_col, "width", "height", "luma").mapInArrow(run, f"id {kind}, perceptual_hash string").withColumnRenamed("id", id_col)


def hash_bits(c) -> F.Column:
    """A hash of 16 hex digits as a signed 64-bit number, for distances."""
    high, low = (F.conv(F.substring(c, k, 8), 16, 10).cast("bigint") for k in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)
