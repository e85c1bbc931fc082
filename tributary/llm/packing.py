"""Hierarchical multi-length packing of documents into training sequences.

Documents are routed by length to context-size tiers. What fills the longest
tier is cut off first; the tail goes to the smallest tier that holds it. Each
tier is packed from the longest down: a window opens with one of its own tails,
and its gap is filled with the best fitting tails of shorter tiers, the last of
them cut, so windows end full. Sequences of one tier are then dealt into step
groups of even attention cost (sum of squared piece lengths).

Each input partition packs its own rows in bounded windows, so nothing is
shuffled and a lost task repeats exactly its own sequences; what a partition
has left at its end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import quiet
from tributary.llm.tokens import CACHE, SPACED, Borders, batches_of, chunk_encoder, default_path

TIERS = (1024, 512, 256, 128)
WINDOW = 4096
GROUP = 8
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"


class TierPacker:
    """Packs documents given as id bytes; take() gives rows (key, start, length, crc, tokens, sequence, offset, filled, tier, group).

    Every tier is a power of two. Sequence numbers count up from base.
    """

    def __init__(self, base: int = 0, tiers: tuple[int, ...] = TIERS, group: int = GROUP, width: int = 4):
        self.tiers, self.group, self.width = tuple(sorted(tiers, reverse=True)), group, width
        self.next, self.groups = base, base
        self.tails: list[tuple] = []  # (length, order, key, start, ids, tokens)
        self.order = 0
        self.ready: list[list] = []  # sequences: lists of (key, start, ids, tokens)
        self.full: list[list] = []

    def add(self, key, ids: bytes) -> None:
        w, top = self.width, self.tiers[0]
        tokens, at = len(ids) // w, 0
        while tokens - at >= top:
            self.full.append([(key, at, ids[at * w : (at + top) * w], tokens)])
            at += top
        if at < tokens:
            self._tail(key, at, ids[at * w :], tokens)

    def _tail(self, key, start, ids, tokens) -> None:
        self.tails.append((len(ids) // self.width, self.order, key, start, ids, tokens))
        self.order += 1

    def pack(self) -> None:
        """Fill windows tier by tier; tails that no longer fill one are carried over."""
        w = self.width
        self.ready += self.full
        self.full = []
        pool, carried = sorted(self.tails), []
        while pool:
            length, order, key, start, ids, tokens = pool.pop()
            tier = next(t for t in reversed(self.tiers) if t >= length)
            rows, gap = [(key, start, ids, tokens)], tier - length
            used = [(length, order, key, start, ids, tokens)]
            while gap and pool:
                k = bisect.bisect_right(pool, (gap, float("inf"))) - 1
                if k >= 0:
                    item = pool.pop(k)
                    used.append(item)
                    rows.append(item[2:])
                    gap -= item[0]
                else:  # all that is left is longer: cut the shortest of them
                    length, order, key, start, ids, tokens = pool.pop(0)
                    rows.append((key, start, ids[: gap * w], tokens))
                    bisect.insort(pool, (length - gap, order, key, start + gap, ids[gap * w :], tokens))
                    gap = 0
            if gap:
                carried += used
            else:
                self.ready.append(rows)
        self.tails = carried

    def finish(self) -> None:
        """Cut what is left into sequences whose lengths are powers of two."""
        w = self.width
        left = sorted(self.tails, key=lambda x: (-x[0], x[1]))
        total = sum(x[0] for x in left)
        self.tails = []
        k = used = 0
        while total:
            size = min(self.tiers[0], 1 << (total.bit_length() - 1))
            rows, room = [], size
            while room:
                length, _, key, start, ids, tokens = left[k]
                n = min(room, length - used)
                rows.append((key, start + used, ids[used * w : (used + n) * w], tokens))
                room, used = room - n, used + n
                if used == length:
                    k, used = k + 1, 0
            self.ready.append(rows)
            total -= size

    def take(self):
        """Rows of the sequences that are ready, dealt into step groups."""
        w = self.width
        by_tier: dict[int, list] = {}
        for rows in self.ready:
            filled = sum(len(r[2]) for r in rows) // w
            by_tier.setdefault(filled, []).append((sum((len(r[2]) // w) ** 2 for r in rows), rows))
        self.ready = []
        for filled in sorted(by_tier, reverse=True):
            found = sorted(by_tier[filled], key=lambda x: -x[0])
            n = -(-len(found) // self.group)
            for k, (_, rows) in enumerate(found):  # there and back over the groups: costs even out
                lap, at = divmod(k, n)
                step, offset = self.groups + (at if lap % 2 == 0 else n - 1 - at), 0
                for key, start, ids, tokens in rows:
                    length = len(ids) // w
                    yield key, start, length, zlib.crc32(ids), tokens, self.next, offset, filled, next((t for t in reversed(self.tiers) if t >= filled), filled), step
                    offset += length
                self.next += 1
            self.groups += n


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, tiers: tuple[int, ...] = TIERS, group: int = GROUP, window: int = WINDOW, borders: Borders = SPACED, room: int = CACHE) -> DataFrame:
    """One row per piece: id_col and the columns of SCHEMA.

    Null text is empty and gives one piece, the end id. Rows with a null or a
    repeated id are packed like any other. sequence_length is a power of two, so
    no sequence needs padding; room bounds the bytes of the chunks a worker
    remembers; sequence_id is unique, step_group names sequences of one length
    that a step takes together. Which documents share a sequence follows from
    the partitions of docs. The string of a special token in a text is that
    token. Other columns are not read. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType
    end = int(end_id).to_bytes(4, "little")
    names = ["id", *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches):
        with quiet(collect=False):
            yield from pack(batches)

    def pack(batches):
        path = tokenizer or default_path("byte_bpe_50k.json")
        encoder = chunk_encoder(path, borders, room)
        packer, held, schema = TierPacker(TaskContext.get().partitionId() << 40, tiers, group), 0, None

        def out():
            rows = list(packer.take())
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema), *(pa.array(c, pa.int64()) for c in columns[1:8]), pa.array(columns[8], pa.int32()), pa.array(columns[9], pa.int64())], names)

        for batch in batches:
            schema = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                for key, found in zip(ids[a:b], encoder.encode(texts[a:b])):
                    packer.add(key, found + end)
                    held += 1
                    if held >= window or len(packer.full) >= window:  # few long documents fill memory as well
                        packer.pack()
                        yield out()
                        held = 0
        if schema is not None:
            packer.pack()
            packer.finish()
            yield out()

    return source.mapInArrow(run, f"id {kind.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of all documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
