"""Token ids as canonical length-limited Huffman blocks.

Format. A shard is a run of blocks in ascending document order. A block is
independent of all others:

    magic "THB1", then little-endian: u32 documents, u32 ids, u32 lane
    i64 first id's number within the shard
    documents x i64 doc_id, documents x u8 (1: the doc_id is null), documents x u32 number of ids
    lanes x u32 bit offset of every lane-th id (the checkpoints)
    the codes, most significant bit first

The code book is one length for each id; codes follow canonically (by length,
then id). Lengths come from the counts of the whole corpus by package-merge,
16 bits at most (more only where more ids than 65,536 occur), so one table of
65,536 entries decodes any id, and the checkpoints let all lanes of a block
decode side by side.
Shards are rows of a Parquet table (shard, block, n_ids, payload) in the shared
folder: executors write and read them there through Spark.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.common import FEW, discard, materialize, quiet
from tributary.llm.tokens import WORDS, Borders, batches_of, chunk_encoder, default_path

#: Longest code in bits; vocabularies that need more take as many as they need, up to what a 32-bit window can hold.
LIMIT, WIDEST = 16, 25
LANE = 128
#: Ids of a block, and of a shard, aimed at.
BLOCK, SHARD = 1 << 17, 8_000_000
MAGIC = b"THB1"


def limited_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits for positive counts (package-merge); of as many as n symbols need where that is more."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, (n - 1).bit_length())
    if limit > WIDEST:
        raise ValueError(f"{n} symbols do not fit codes of {WIDEST} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    leaf_flags, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        place = np.argsort(merged, kind="stable")
        leaf_flags.append(place < n)
        merged = merged[place]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class CodeBook:
    """Canonical codes of symbols with given lengths; encodes arrays and decodes blocks by table."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        symbols, lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.limit = limit = max(LIMIT, int(lengths.max()) if len(lengths) else 0)
        spans = np.int64(1) << (limit - lengths)
        begins = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.int64) if len(symbols) else spans
        self.length = np.zeros(size, np.int64)
        self.code = np.zeros(size, np.uint64)
        self.length[symbols] = lengths
        self.code[symbols] = begins >> (limit - lengths)
        self.table_symbol = np.zeros(1 << limit, np.uint32)
        self.table_length = np.ones(1 << limit, np.int64)
        filled = int(spans.sum()) if len(symbols) else 0
        self.table_symbol[:filled] = np.repeat(symbols, spans)
        self.table_length[:filled] = np.repeat(lengths, spans)

    def encode(self, ids: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, bytes]:
        """(checkpoints, bits) of ids."""
        if not len(ids):
            return np.zeros(0, np.uint32), b""
        lengths = self.length[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        at = ends - lengths
        word, value = at >> 5, self.code[ids]
        value <<= (64 - lengths - (at & 31)).view(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        joined = np.bitwise_or.reduceat(value, first)  # codes that begin in one word share no bit
        bits = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
        bits[word[first]] = joined >> np.uint64(32)
        bits[word[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
        return at[::lane].astype(np.uint32), bits.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8]

    def decode(self, checkpoints: np.ndarray, bits: bytes, n: int, lane: int = LANE) -> np.ndarray:
        """The n ids of a block; all lanes advance together, one table look-up an id."""
        raw = np.frombuffer(bits + bytes(self.limit * lane // 8 + 8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        rest, mask = 32 - self.limit, np.uint32((1 << self.limit) - 1)
        at = checkpoints.astype(np.int64)
        out = np.empty((lane, len(at)), np.uint32)
        for k in range(lane):
            key = (window[at >> 3] >> (rest - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.table_symbol[key]
            at = at + self.table_length[key]
        return np.ascontiguousarray(out.T).reshape(-1)[:n]


def write_block(book: CodeBook, first: int, doc_ids: list, parts: list[np.ndarray], lane: int = LANE) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    marks, bits = book.encode(ids, lane)
    return b"".join((
        MAGIC, struct.pack("<IIIq", len(doc_ids), len(ids), lane, first),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.array([len(p) for p in parts], "<u4").tobytes(), marks.astype("<u4").tobytes(), bits,
    ))


def read_block(book: CodeBook, payload: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """(first id's number, doc_ids, ids of each document, all ids)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, lane, first = struct.unpack_from("<IIIq", payload, 4)
    at = 24
    keys = np.frombuffer(payload, "<i8", docs, at)
    null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    lanes = -(-n // lane)
    marks = np.frombuffer(payload, "<u4", lanes, at)
    ids = book.decode(marks, payload[at + 4 * lanes :], n, lane)
    return first, [None if x else int(k) for k, x in zip(keys, null)], sizes, ids


def _pack(ids: bytes, planes: int) -> bytes:
    """Little-endian 32-bit ids for the temporary table, as planes of their lower bytes, which compress better."""
    return b"".join(ids[k::4] for k in range(planes))


def _unpack(raw: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Ids of each document of a batch."""
    out = []
    for x, n in zip(raw, sizes):
        got = np.frombuffer(x, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
        ids = np.zeros(n, np.uint32)
        for k, plane in enumerate(got):
            ids |= plane.astype(np.uint32) << np.uint32(8 * k) if k else plane
        out.append(ids)
    return out


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, end_id: int, borders: Borders) -> DataFrame:
    """(id, n, ids) of each row, and per task one row (symbols, counts) of what it saw."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = int(end_id).to_bytes(4, "little")
    names = ["id", "n", "ids", "symbols", "counts"]

    def run(batches):
        with quiet(collect=False):
            yield from encoded(batches)

    def encoded(batches):
        encoder = chunk_encoder(tokenizer or default_path("word_bpe_49k.json"), borders)
        planes = -(-max(encoder.tokenizer.get_vocab_size().bit_length(), int(end_id).bit_length()) // 8)
        counts = np.zeros(0, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                found = [x + end for x in encoder.encode(texts[a:b])]
                seen = np.bincount(np.frombuffer(b"".join(found), np.uint32))
                if len(seen) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(seen) - len(counts), np.int64)])
                counts[: len(seen)] += seen
                none = pa.nulls(b - a, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([_pack(x, planes) for x in found], pa.binary()), none, none], names)
        symbols = np.flatnonzero(counts)
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (symbols, counts[symbols])]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *lists], names)

    return source.mapInArrow(run, "id long, n long, ids binary, symbols array<long>, counts array<long>")


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, borders: Borders = WORDS) -> tuple[DataFrame, DataFrame]:
    """Write shards in ascending id order; returns the written tables (blocks, code book).

    blocks: shard int, block int, n_ids long, payload binary. code book: symbol
    long, length long (at most one row an id of the vocabulary). The string of a
    special token in a text is that token. Null text is
    empty (its end id alone); null ids come first; repeated ids stay as they are.
    """
    table = materialize(tokenized(docs, id_col, text_col, tokenizer, end_id, borders), "ids")
    seen = table.where("symbols is not null").select(F.explode(F.arrays_zip("symbols", "counts")).alias("x"))
    totals = np.array([tuple(r) for r in seen.groupBy("x.symbols").agg(F.sum("x.counts").alias("c")).orderBy("symbols").collect()], np.int64).reshape(-1, 2)
    symbols, lengths = totals[:, 0], limited_lengths(totals[:, 1])
    spark = docs.sparkSession
    book_table = materialize(spark.createDataFrame([(int(s), int(x)) for s, x in zip(symbols, lengths)], "symbol long, length long").coalesce(1), "codebook")
    shards = max(1, -(-int(totals[:, 1].sum()) // SHARD))
    book = spark.sparkContext.broadcast((symbols, lengths))
    names = ["shard", "block", "n_ids", "payload"]

    def run(batches):
        codes, shard = CodeBook(*book.value), TaskContext.get().partitionId()
        keys, parts, held, first, number = [], [], 0, 0, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([write_block(codes, first, keys, parts)], pa.binary())], names)

        for batch in batches:
            sizes = batch.column(1).to_pylist()
            for key, n, ids in zip(batch.column(0).to_pylist(), sizes, _unpack(batch.column(2).to_pylist(), sizes)):
                keys.append(key)
                parts.append(ids)
                held += n
                if held >= BLOCK:
                    yield out()
                    first, number = first + held, number + 1
                    keys, parts, held = [], [], 0
        if keys:
            yield out()

    ordered = table.where("n is not null").select("id", "n", "ids").repartitionByRange(shards, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"))
    blocks = materialize(ordered.mapInArrow(run, "shard int, block int, n_ids long, payload binary"), "blocks", "uncompressed")
    discard(table)
    return blocks, book_table


def read_ids(blocks: DataFrame, book_table: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the written blocks."""
    spark = blocks.sparkSession
    # ids before each shard: a running sum over one row a shard, of which a shard holds SHARD ids
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("shard", before.alias("base"))
    bases = F.broadcast(bases) if totals.count() <= FEW else bases
    rows = book_table.orderBy("symbol").collect()  # one row an id of the vocabulary
    book = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))
    names = ["id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        codes = CodeBook(*book.value)
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, keys, sizes, ids = read_block(codes, payload)
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                found = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                columns = [pa.array(keys, pa.int64()), pa.array(starts + first + base), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(x) for x in found], pa.int64())]
                if with_ids:
                    columns.append(pa.array(found, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return blocks.join(bases, "shard").select("base", "payload").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_huffman(spark, sf_dir: str) -> DataFrame:
    """All documents written as Huffman blocks and read back."""
    return read_ids(*write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")))
