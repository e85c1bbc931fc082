"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its few fields are read here directly. From them
the normaliser, the metaspace marker, the piece scores (merges for a BPE model,
log probabilities for a unigram one) and byte fallback are rebuilt as a
tokenizers pipeline, which encodes batches on several threads and gives the
ids. The sentencepiece library is the measure: parity is checked text by text,
and only a text that differs falls back to the library's ids, which a column
tells.

Where no piece has a marker after another character, no merge can cross the
border before a marker, so texts are encoded by their space-separated chunks
and each distinct chunk once, new chunks in one multithreaded batch.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import quiet
from tributary.llm.tokens import PIECES, ChunkEncoder, batches_of, default_path

MARK = "▁"
# Fixed values of the model format: piece kinds and model kinds.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message; value is an int or bytes."""
    at, end = 0, len(raw)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            at += n
            yield tag >> 3, raw[at - n : at]
        elif kind == 2:
            n = varint()
            at += n
            yield tag >> 3, raw[at - n : at]
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(raw: bytes) -> Model:
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append(piece)
            m.scores.append(score)
            m.kinds.append(kind)
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    m.unk_id = m.kinds.index(UNKNOWN)
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Merges of a BPE model: every split of a piece into two pieces, best score first."""
    known = {p: k for k, p in enumerate(m.pieces)}
    found = []
    for k, p in enumerate(m.pieces):
        if m.kinds[k] == NORMAL and len(p) > 1:
            splits = [(known[p[:c]], known[p[c:]], p[:c], p[c:]) for c in range(1, len(p)) if p[:c] in known and p[c:] in known]
            found += [(-m.scores[k], k, *s) for s in splits]
    return [(x[4], x[5]) for x in sorted(found)]


def backend(m: Model, lead: bool = True):
    """The tokenizers pipeline of a model; lead: with the marker put before a text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == BPE:
        core = models.BPE(vocab={p: k for k, p in enumerate(m.pieces)}, merges=merges_of(m), unk_token=m.pieces[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        core = models.Unigram(list(zip(m.pieces, m.scores)), unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind}")
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if lead and m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if separable(m):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return out


def separable(m: Model) -> bool:
    """Does no piece hold a marker after another character, or a line end beside one?"""
    return m.escape and not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER))


class Codec:
    """encode(texts) -> id bytes (little-endian u32); decode(ids) -> text; library(texts) -> sentencepiece's ids."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.whole = backend(m)
        self.chunks = ChunkEncoder(backend(m, lead=False), PIECES) if separable(m) and m.dummy_prefix and not m.charsmap and not m.squeeze else None
        self.bytes = []
        for p, k in zip(m.pieces, m.kinds):
            self.bytes.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.chunks:
            return [x if t else b"" for t, x in zip(texts, self.chunks.encode(texts))]
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.reference.encode(texts, num_threads=1)]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I")))
        return (raw[1:] if self.model.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_crc32, parity, round_trip[, ids].

    parity: the rebuilt pipeline gave the library's ids, which are checked for
    every text; the row's ids are the pipeline's where it did, else the
    library's. round_trip: decoding gives the text back. Null text is empty and
    has no ids. Other columns are not read; an empty table gives none.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "n_tokens", "ids_crc32", "parity", "round_trip", *(["ids"] if with_ids else [])]

    def run(batches):
        with quiet(collect=False):
            yield from encoded(batches)

    def encoded(batches):
        c = codec(model or default_path("piece_bpe_32k.model"))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                part = texts[a:b]
                own, parity = c.encode(part), []
                for k, theirs in enumerate(c.library(part)):
                    parity.append(own[k] == theirs)
                    if not parity[k]:
                        own[k] = theirs
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in own], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(parity, pa.bool_()), pa.array([c.decode(x) == t for x, t in zip(own, part)], pa.bool_())]
                if with_ids:
                    columns.append(pa.array(own, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + (", ids binary" if with_ids else "")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents, parity checked for each."""
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
