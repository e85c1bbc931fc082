"""Each operator on small fixtures: brute force or round trips, nulls, empty and long texts, ties, empty tables, clashing names."""

import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import audio, html, huffman, language, packing, pieces, quality, secrets, simhash, tokens, vectors

LONG = "word and Word, again.\n" * 4000
TEXTS = [None, "", " ", "a", "a b", "a b c", "A b C", "the cat sat on the mat", "the cat sat on the mat", "the cat sat on the mat today", "été 你好 \U0001f600 x́", "  two  spaces\tand tab\r\n", "x\x1cy z", LONG]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, a null id, and columns named like the operators' own."""
    rows = [(k, t, "s", 1, "x", 2, "f") for k, t in enumerate(TEXTS)] + [(7, TEXTS[7], "s", 1, "x", 2, "f"), (None, "no id here at all", "s", 1, "x", 2, "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp int, id string, score int, start string").repartition(3)


def test_planes_against_brute_force():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    f[100:200] = f[:100] ^ np.uint64(5)
    f[300:] = f[0] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    apart = np.bitwise_count(f[:, None] ^ f[None, :])
    for radius in (0, 1, 2, 3, 6):
        got = {(int(a), int(b)) for q, w in simhash.close_pairs(f, f, radius) for a, b in zip(q, w)}
        assert got == set(map(tuple, np.argwhere(apart <= radius).tolist()))


def test_band_masks_lose_no_pair():
    rng = random.Random(2)
    for n in (10, 10_000, 10**6, 10**8, 10**10, 10**12):
        masks = simhash.band_masks(n)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not flips & m for m in masks)


def _fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash_against_brute_force(spark, docs):
    out = simhash.simhash_components(docs)
    assert out.columns == ["doc_id", "fp", "component_id"] and out.count() == docs.count()
    fps = {k: _fingerprint(t) for k, t in enumerate(TEXTS)}
    want = {}
    for k in fps:
        seen, todo = {k}, [k]
        while todo:
            x = todo.pop()
            near = [y for y in fps if y not in seen and (fps[x] ^ fps[y]).bit_count() <= 3]
            seen.update(near)
            todo += near
        want[k] = (fps[k], min(seen))
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in out.where("doc_id is not null").collect()}
    assert got == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", 16)
    rng = np.random.default_rng(3)
    f = [int(x) for x in rng.integers(0, 1 << 62, 60)] + [7 ^ (1 << k) for k in range(40)]
    edges = simhash.fingerprint_links(spark.createDataFrame(list(enumerate(f)), "node long, fp long"))
    from tributary.llm.common import components

    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {found.get(k, k) for k in range(60, 100)} == {60}


def test_quality(spark, docs):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "quiet", "river", "runs", "below", "hills"]) for _ in range(80)) + "." for _ in range(120)]
    bad = ["!!! ".join(w.upper() for w in g.split()) for g in good]
    rows = [(k, t, k % 2) for k, t in enumerate(x for p in zip(bad, good) for x in p)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(3, None), (None, 1)], "doc_id long, quality int"))
    model = quality.train(table, labels)
    out = quality.score_quality(table, model).withColumn("held", quality.held_out("doc_id")).where("held")
    assert out.where("predicted = quality").count() == out.count() > 20
    edge = quality.score_quality(docs, model)
    assert edge.count() == docs.count() and edge.where("score is null or score < 0 or score > 1").count() == 0
    assert edge.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert quality.score_quality(docs, quality.train(table.limit(0), labels.limit(0))).where("score <> 0.5").count() == 0


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    clean = [" ".join(word() for _ in range(400)) for _ in range(60)]
    dirty = [c[:1000] + " ".join(word().upper() + "!!" for _ in range(70)) + c[1000:] for c in clean]
    bags = [quality.passages(t.encode()) for t in clean + dirty]
    model = quality.fit(bags, np.array([1.0] * 60 + [0.0] * 60))
    _, a = model.score(bags[60], np.zeros(1, np.int64))
    upper = bags[60][:, 1]
    assert upper[a.argmax()] > 0.2


def test_gradient_matches_differences():
    bags, y = [quality.passages(t.encode()) for t in ("One two three. " * 90, "AAA!! " * 200)], np.array([1.0, 0.0])
    model = quality.fit(bags, y, steps=300, batch=2)
    s = [model.score(b, np.zeros(1, np.int64))[0][0] for b in bags]
    assert s[0] > 0.9 and s[1] < 0.1


def test_packing(spark, docs):
    out = packing.pack_documents(docs)
    rows = out.collect()
    tk = tokens.load(tokens.default_path("byte_bpe_50k.json"))
    for k, t in enumerate(TEXTS):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        twice = 2 if k == 7 else 1
        assert sum(r["length"] for r in mine) == twice * len(ids)
        for r in mine:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for found in by.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packer_cuts_and_groups():
    rng = random.Random(6)
    p, sizes = packing.TierPacker(), [rng.choice([1, 5, 60, 128, 300, 700, 1023, 1024, 1025, 5000]) for _ in range(400)]
    for k, n in enumerate(sizes):
        p.add(k, array("I", range(n)).tobytes())
    p.pack()
    p.finish()
    rows = list(p.take())
    assert sum(r[2] for r in rows) == sum(sizes)
    spans = {}
    for r in rows:
        spans.setdefault(r[0], []).append((r[1], r[1] + r[2]))
    for k, n in enumerate(sizes):
        ends = sorted(spans[k])
        assert ends[0][0] == 0 and ends[-1][1] == n and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert all(len({r[7] for r in rows if r[9] == g}) == 1 for g in {r[9] for r in rows})


HARD = [t for t in TEXTS if t] + ["it's don't x.", "abc...def", "\x01 a b", "İstanbul I", "<|endoftext|> a", "a.\nB c.\nD", "$$$ a*** **b", "\n\n", "12345 67a. b9!", "▁a ▁ b", "x" * 300 + " y. z"]


@pytest.mark.parametrize("name,borders", [("byte_bpe_50k.json", tokens.SPACED), ("word_bpe_49k.json", tokens.WORDS)])
def test_chunks_are_whole_texts(name, borders):
    encoder = tokens.ChunkEncoder(tokens.load(tokens.default_path(name)), borders, room=20)
    want = [array("I", e.ids).tobytes() for e in encoder.tokenizer.encode_batch(HARD, add_special_tokens=False)]
    assert encoder.encode(HARD) == want and encoder.encode(HARD[::-1]) == want[::-1]


def test_huffman_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 50, 1000):
        counts = rng.zipf(1.5, n).astype(np.int64)
        lengths = huffman.limited_lengths(counts)
        heap, cost = list(map(int, counts)), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert lengths.max() <= 16 and (2.0 ** -lengths).sum() <= 1
        if n > 1 and n < 100:
            assert (lengths * counts).sum() == cost
    deep = huffman.limited_lengths(np.array([2**k for k in range(40)]))
    assert deep.max() == 16 and (2.0**-deep).sum() == 1


def test_huffman_blocks_round_trip():
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.zipf(1.3, 5000), 40000).astype(np.uint32)
    seen = np.unique(ids, return_counts=True)
    book = huffman.CodeBook(seen[0].astype(np.int64), huffman.limited_lengths(seen[1]))
    for n in (0, 1, 127, 128, 129, 5000):
        parts = np.array_split(ids[:n], 3)
        first, keys, sizes, back = huffman.read_block(book, huffman.write_block(book, 9, [4, None, 6], parts))
        assert (first, keys, sizes.tolist()) == (9, [4, None, 6], [len(p) for p in parts]) and (back == ids[:n]).all()


def test_huffman_files(spark, docs):
    out = huffman.read_ids(*huffman.write_ids(docs), with_ids=True).collect()
    tk = tokens.load(tokens.default_path("word_bpe_49k.json"))
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        t = "no id here at all" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = array("I", tk.encode(t, add_special_tokens=False).ids + [2]).tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids) // 4, ids) and r["ids_crc32"] == zlib.crc32(ids)
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert huffman.read_ids(*huffman.write_ids(docs.limit(0))).count() == 0


def test_html():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="page"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies, is that all right with you?</div><article><h1>A&nbsp;title &amp; more</h1><p>First   <b>bold</b> words.<br>Next <p>Sh&ouml;rt.<ul><li>one point<li>two points</ul><div class="ad">Buy this now and be glad for ever</div>
    <form><label>Mail</label><input></form><p>Last <a href=x>linked</a> text of the page</article><aside>Other things to read in the evening</aside><section id="comments"><p>Nice text, thank you very much</p></section><footer>&copy; us</footer></body>"""
    assert html.main_text(page) == "A title & more\n\nFirst bold words. Next\n\nShört.\n\none point\n\ntwo points\n\nLast linked text of the page"
    for odd in (None, "", "<", "<p", "<!-- x", "<script>x", "</div></div>", "&amp"):
        html.main_text(odd)
    assert html.main_text("<p>plain text without any article around it</p>") == "plain text without any article around it"
    assert html.main_text("<p>" + "word " * 50_000 + "</p>").count("word") == 50_000


def test_html_links_inside_articles():
    """Nothing of an article goes for the links before it or in it; link blocks without an article do."""
    nav = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"
    assert html.main_text(f"<body>{nav}<article><p>A first paragraph without a heading.</p><p>More of it.</p></article>") == "A first paragraph without a heading.\n\nMore of it."
    linked = "<article><h1>Title</h1><p><a href=x>nearly all of it is one</a> link</p><p>Short.</p><ul><li><a href=y>an item</a> too</li><li>plain</li></ul><p>" + "word " * 30 + "</p></article>"
    assert html.main_text(nav + linked) == "Title\n\nnearly all of it is one link\n\nShort.\n\nan item too\n\nplain\n\n" + ("word " * 30).strip()
    assert html.main_text("<div><p>" + "text of the page " * 9 + "</p><p><a href=x>eight linked words that are no main text</a></p></div>") == ("text of the page " * 9).strip()


def test_html_articles_that_are_not_the_page():
    """Teasers and comments marked as articles do not hide the text; cues on what holds an article do not drop it."""
    text = "The whole text of this page stands in a plain block without any mark."
    teasers = "<aside><article><h3>Other</h3><p>Read this other article too.</p></article></aside>"
    comments = '<section id="comments"><article id="div-comment-5" class="comment-body"><p>Nice, thanks.</p></article></section>'
    bare = '<article class="comment"><p>Also a comment of a reader.</p></article>'
    assert html.main_text(f"<body><div><p>{text}</p></div>{teasers}{comments}{bare}</body>") == text
    for name in ("content with-sidebar", "no-sidebar", "has-header", "social", "page sidebar-layout"):
        assert html.main_text(f'<body><div class="{name}"><article><p>{text}</p></article>{teasers}{comments}</div></body>') == text
    assert html.main_text(f'<form><nav><a href=x>Home</a></nav><main><p>{text}</p></main></form>') == text
    assert html.main_text(f'<div class="no-sidebar has-header"><p>{text}</p></div>') == text
    assert html.main_text(f'<article class="post comments-open"><p>{text}</p><div class="share">Share this</div></article>') == text


def test_html_table(spark):
    t = spark.createDataFrame([(1, "u", None, 5, "x"), (2, None, "<article><p>Hi你</p></article>", 6, "y"), (2, None, "<article><p>Hi你</p></article>", 6, "y")], "page_id long, url string, html string, n_chars int, text string")
    assert sorted(map(tuple, html.extract_text(t).collect()), key=str) == [(1, "u", "", 0), (2, None, "Hi你", 3), (2, None, "Hi你", 3)]
    assert html.extract_text(t.limit(0)).count() == 0


def test_pieces(spark, docs):
    out = pieces.encode_pieces(docs, with_ids=True).collect()
    assert len(out) == docs.count() and all(r["parity"] for r in out)
    assert all(r["round_trip"] for r in out if r["doc_id"] not in (10,))
    c = pieces.Codec(tokens.default_path("piece_bpe_32k.model"))
    texts = [t for t in HARD]
    assert c.encode(texts) == c.library(texts)
    whole = [array("I", e.ids).tobytes() for e in c.whole.encode_batch(texts, add_special_tokens=False)]
    assert whole == c.library(texts)
    assert [c.decode(x) for x in c.library(texts)] == c.reference.decode([list(memoryview(x).cast("I")) for x in c.library(texts)])
    assert pieces.encode_pieces(docs.limit(0)).count() == 0


def test_unigram_backend():
    m = pieces.Model(pieces=["<unk>", "▁", "▁a", "a", "b", "ab", "▁ab"], scores=[0.0, -3.0, -2.0, -2.5, -2.5, -3.0, -1.0], kinds=[2, 1, 1, 1, 1, 1, 1], kind=pieces.UNIGRAM, squeeze=False)
    assert pieces.backend(m).encode("ab ab").tokens == ["▁ab", "▁ab"]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(120, 16))
    x = np.concatenate([base, base[:30] + 0.05 * rng.normal(size=(30, 16)), base[:5], [base[0] + 0.03 * rng.normal(size=16) for _ in range(40)]]).astype(np.float32)
    rows = [(k, v.tolist(), 1, 2) for k, v in enumerate(x)]
    n = len(rows)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [None] + [1.0] * 15), (n + 5, [1.0] * 3), (None, x[0].tolist())]
    t = spark.createDataFrame(rows + [(*o, 1, 2) for o in odd], "vec_id long, embedding array<float>, n int, kept int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.vector_components(t).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    labels = np.arange(n)
    from tributary.llm.common import merge_labels

    merge_labels(labels, *np.nonzero(near))
    assert {k: got[k] for k in range(n)} == {k: (int(near[k].sum()) - 1, int(labels[k]), bool(labels[k] == k)) for k in range(n)}
    assert all(got[k] == (0, k, True) for k in range(n, n + 6)) and got[None] == (0, None, True)
    assert vectors.vector_components(t.limit(0)).count() == 0


def test_forest_recall():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(4000, 32))
    y = x + 0.3 * rng.normal(size=x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    close = (x * y).sum(axis=1) >= 0.95
    forest = vectors.Forest(32, 7).fit(x)
    shared = vectors.first_shared(forest.leaves(x), forest.leaves(y)) < np.iinfo(np.int64).max
    assert close.sum() > 500 and shared[close].mean() > 0.97


def test_audio(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(12, 32))
    v[6:9] = v[:3] + 0.1 * rng.normal(size=(3, 32))
    wavs = [audio.render(x) for x in v]
    shifted = audio.write_wav(audio.read_wav(wavs[4])[audio.HOP * 9 :])
    rows = [(k, w) for k, w in enumerate(wavs)] + [(12, shifted), (13, wavs[5]), (14, None), (15, b"junk"), (16, audio.write_wav(np.zeros(100))), (17, audio.write_wav(np.zeros(200_000)))]
    t = spark.createDataFrame([(*r, 0, "x") for r in rows], "rec_id long, audio binary, n_links int, f string")
    got = {r["rec_id"]: (r["n_links"], r["component_id"]) for r in audio.recording_components(t).collect()}
    prints = {k: audio.fingerprint(w) for k, w in rows}
    usable = {k: f for k, f in prints.items() if f is not None and len(f) >= audio.LEAST}
    want = {k: sum(1 for j, g in usable.items() if j != k and k in usable and audio.alike(usable[k], [g])[0]) for k in prints}
    assert {k: x[0] for k, x in got.items()} == want
    assert [got[k][1] for k in (6, 7, 8, 12, 13)] == [0, 1, 2, 4, 5] and all(got[k] == (0, k) for k in (14, 15, 16))
    assert audio.align(prints[4], prints[12])[0] == 9
    assert audio.recording_components(t.limit(0)).count() == 0


def test_language(spark, docs):
    en, de = "the river runs below the hills and over there ", "der Fluss läuft unter den Hügeln und über dort "
    rows = [(k, (en if k % 2 else de) * 3, "en" if k % 2 else "de", f"h{k % 2}.example.org") for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = language.train(table)
    out = language.identify(table, model, host_col="host")
    assert out.where("language <> lang or not kept").count() == 0
    # a text that says nothing follows its host; claims that the corpus bears out count
    weak = table.select("doc_id", "text", "lang", "host", F.lit(None).cast("string").alias("claim")).union(spark.createDataFrame([(99, "", "de", "h0.example.org", None), (98, None, None, None, None), (97, "42", None, "h1.example.org", None)], "doc_id long, text string, lang string, host string, claim string"))
    got = {r["doc_id"]: r for r in language.identify(weak, model, host_col="host", declared_col="claim").collect()}
    assert got[99]["language"] == "de" and not got[99]["kept"] and not got[98]["kept"] and got[97]["language"] == "en"
    again = language.identify(language.text_evidence(table, model).drop("text"), model, host_col="host", scored=True)
    assert sorted((r["doc_id"], r["language"], round(r["probability"], 9)) for r in again.collect()) == sorted((r["doc_id"], r["language"], round(r["probability"], 9)) for r in out.collect())
    odd = language.identify(docs.withColumn("kept", F.lit("clash")), model, host_col="source")
    assert odd.count() == docs.count() and odd.columns[-3:] == ["language", "probability", "kept"]
    assert language.identify(docs.limit(0), model).count() == 0


def _base(text):
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_secrets_against_brute_force(spark, docs):
    key, sec, hx = "AKIA" + "Q7" * 8, "a/B+" * 10, "0123456789abcdef" * 2
    texts = [
        *(t or "" for t in TEXTS), f"\U0001f600 id {key} then {sec} at https://s3.example.com/x", sec, f"{key}AKIA", "AKIA1234 AKIA" + "A" * 16, "token=token=abcdef", 'secret: token "= abcdefg',
        f"PassWord : '{hx}' and api_key=short api-key=longenough", f"see https://a.example.org {'x ' * 400} {key}", f"ſecret=abcdefgh {hx[:23]} {hx}", f"passwd={hx}{key}",
    ]
    t = spark.createDataFrame([(k, x, 1) for k, x in enumerate(texts)], "doc_id long, text string, base_spans int")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(t).collect()}
    for k, x in enumerate(texts):
        assert [(s["start"], s["end"], s["kind"]) for s in got[k]["base_spans"]] == _base(x), x
    kinds = lambda k: [s["kind"] for s in got[k]["linked_spans"]]
    n = len(TEXTS)
    assert kinds(n) == ["secret", "endpoint"] and kinds(n + 1) == [] and kinds(n + 7) == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan_secrets(t)).collect()}
    assert clean[n] == "\U0001f600 id [access] then [secret] at [endpoint]" and clean[13] == LONG
    nulls = secrets.redact(secrets.scan_secrets(docs))
    assert nulls.columns == docs.columns and nulls.where("doc_id = 0 and text is null").count() == 1
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_secrets_after_long_weak_parts(spark):
    """A complement right after a weak part that is longer than the scope links too."""
    long = ["x " * 199 + " " + "https://a.example.org/" + "p" * 778 + " AKIA" + "Q7" * 8 + " " + "0123456789abcdef" * 2, "x " * 199 + " client_id=" + "z" * 790 + " " + "0123456789abcdef" * 2]
    t = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["linked_spans"]] for r in secrets.scan_secrets(t).collect()}
    assert got == {0: [("endpoint", 399, 1199)], 1: [("identifier", 399, 1199)]}
