"""What the contracts of the queries fix: ids as the library gives them, several bands, wide vocabularies, hot keys."""

import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from tributary.llm import huffman, packing, simhash, tokens
from tributary.llm.common import components
from tributary.operators import graph

SPECIAL = [
    "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "two  <|endoftext|>\n<|endoftext|> more", "<|startoftext|> A b <|endoftext|>", "<|ENDOFTEXT|> <|Endoftext|>", "<|endoftext", "plain words only", "", " ",
    "caf\u00e9 <|startoftext|>\u4f60\u597d", "end <|endoftext|> ",
]


def fresh(name):
    return Tokenizer.from_file(tokens.default_path(name))


@pytest.mark.parametrize("name,borders", [("byte_bpe_50k.json", tokens.SPACED), ("word_bpe_49k.json", tokens.WORDS)])
def test_special_strings_are_their_tokens(name, borders):
    encoder, plain = tokens.ChunkEncoder(fresh(name), borders), fresh(name)
    want = [array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in SPECIAL]
    assert encoder.encode(SPECIAL) == want and [encoder.encode([t])[0] for t in SPECIAL[::-1]] == want[::-1]


def test_queries_on_special_strings(spark):
    t = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    byte, word = fresh("byte_bpe_50k.json"), fresh("word_bpe_49k.json")
    for r in packing.pack_documents(t).collect():
        ids = byte.encode(SPECIAL[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes())
    for r in huffman.read_ids(*huffman.write_ids(t)).collect():
        ids = word.encode(SPECIAL[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(array("I", ids).tobytes()))


def test_the_cache_is_bounded_by_bytes():
    encoder = tokens.ChunkEncoder(fresh("byte_bpe_50k.json"), tokens.SPACED, room=50_000)
    for k in range(40):
        encoder.encode([" ".join(f"word{k}x{j}" for j in range(60))])
        assert len(encoder.rest) * tokens.ENTRY <= 2 * 50_000


def test_vocabularies_beyond_sixteen_bits():
    rng = np.random.default_rng(31)
    counts = rng.integers(1, 1000, 70_000)
    lengths = huffman.limited_lengths(counts)
    assert lengths.max() == 17 and (2.0**-lengths).sum() == 1
    book = huffman.CodeBook(np.arange(70_000), lengths)
    ids = rng.integers(0, 70_000, 4001).astype(np.uint32)
    _, _, _, back = huffman.read_block(book, huffman.write_block(book, 0, [1], [ids]))
    assert (back == ids).all()


def test_several_bands_end_to_end(spark, monkeypatch):
    """Buckets of eight rows give four tables and more; every pair within three bits is still found."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    monkeypatch.setattr(simhash, "CAP", 32)
    rng = np.random.default_rng(32)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(63, n, replace=False))) for n in rng.integers(0, 5, 500)]
    fps = np.unique(np.concatenate([base, base ^ np.array(flips, np.uint64), base[:1] ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))]))
    assert len(simhash.band_masks(len(fps))) > 1
    table = spark.createDataFrame([(k, int(f)) for k, f in enumerate(fps)], "node long, fp long")
    found = {r["node"]: r["component"] for r in components(simhash.fingerprint_links(table)).collect()}
    labels = np.arange(len(fps))
    graph.merge_labels(labels, *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    assert {k: found.get(k, k) for k in range(len(fps))} == dict(enumerate(labels.tolist()))


def test_hot_keys_do_not_shuffle(spark):
    rows = spark.createDataFrame([(k, "hot" if k < 300 else None if k < 350 else f"k{k % 20}") for k in range(500)], "id long, key string")
    table = rows.where("key is not null and key <> 'k3'").groupBy("key").count().selectExpr("key", "count as _n", "upper(key) as big")
    for few in (0, 100):
        for how in ("inner", "left"):
            got = graph.keyed(rows, table, "key", how, few, hot=100)
            want = rows.join(table.drop("_n"), "key", how).select("id", "key", "big")
            assert sorted(map(str, got.select("id", "key", "big").collect())) == sorted(map(str, want.collect()))
