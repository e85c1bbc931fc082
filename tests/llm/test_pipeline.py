"""The pipeline and the registered queries on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm.queries import queries

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "secrets", "packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, DIR)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert 0 < out.count() <= kept.count()
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DIR)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (5, "quite another text than that"), (None, "a b c d e f"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.keep_one_of_each(spark, docs, DIR)
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 5, 6]


def test_registered():
    names = queries()
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{k}" for k in range(1, 11))}


def test_near_duplicates_against_brute_force(spark):
    """Every pair of five-word Jaccard similarity 0.8 or more links, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, w in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * min(len(a), len(sets[j])) >= 4 * max(len(a), len(sets[j])) and 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                label[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (n, _) in enumerate(rows):
        least[top(k)] = min(n, least.get(top(k), n))
    out = corpus_pipeline.keep_one_of_each(spark, docs, DIR)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(least.values())


def test_one_id_on_two_texts(spark):
    """A text goes only where it is a copy itself, not for another text of its id."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "some text that is no copy of any"), (4, "one of two other texts here"), (4, "and the second of these texts"), (5, "x y z"), (5, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.keep_one_of_each(spark, docs, DIR)
    assert sorted(map(tuple, out.collect())) == sorted({rows[0], *rows[2:]})


ODD = [
    (1, "the quiet river runs below the hills and over there, it is said. " * 6, "en", "s", 5, "x", 1.0), (1, "the quiet river runs below the hills and over there, it is said. " * 6, "en", "s", 5, "x", 1.0),
    (1, "quite another text stands under the same number here, and it stays. " * 6, "en", "s", 5, None, 1.0), (2, None, None, None, None, "x", None), (None, "a text without a number, password=hunter2hunter2 stands in it. " * 6, "en", "s", 7, "x", 2.0),
    (3, "", "en", "s", 0, "x", 1.0), (4, " \n\t", "en", None, 3, "x", 1.0), (5, "word and Word, again. " * 60_000, "en", "s", 9, "x", 1.0), (6, "the very same words stand in two documents of the table, all of them. " * 6, None, "t", 5, "x", 1.0),
    (7, "the very same words stand in two documents of the table, all of them. " * 6, "en", None, 5, "x", 1.0),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, and no rows at all."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, predicted string, score double").withColumn("base_spans", F.lit(1)).repartition(3)
    out = stage(spark, docs, DIR)
    rows = out.collect()
    empty = stage(spark, docs.limit(0), DIR)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {1, 2, None, 3, 4, 5, 6, 7}
        return
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    given = [tuple(r) for r in docs.collect()]
    if name == "secrets":
        assert len(rows) == len(ODD) and [r["text"] for r in rows if r["doc_id"] is None] == ["a text without a number, [assign] stands in it. " * 6]
        assert sorted(tuple(r) for r in rows if r["doc_id"] in (5, 7)) == sorted(g[:4] + (len(g[1]),) + g[5:] for g in given if g[0] in (5, 7))
    else:
        assert all(tuple(r) in given for r in rows)
    if name == "language":
        assert {r["doc_id"] for r in rows} >= {1, None, 5, 6, 7} and not {r["doc_id"] for r in rows} & {2, 3, 4}
    if name == "near_duplicates":
        assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 1, 2, 5, 6]


def test_near_duplicates_of_a_hot_cluster(spark, monkeypatch):
    """One large group of near copies, split into blocks, whose members are often below the similarity with each other."""
    import random

    from tributary.llm import jaccard

    monkeypatch.setattr(jaccard, "CAP", 16)
    monkeypatch.setattr(jaccard, "ROWS", 40)
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(140):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    below = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
            else:
                below += 1
    got = {}
    for r in jaccard.jaccard_components(docs).collect():
        got.setdefault(r["component"], []).append(r["id"])
    assert below > 1000 and sorted(min(v) for v in got.values()) == sorted(set(label))
    assert {i: min(v) for v in got.values() for i in v} == dict(enumerate(label))


def _sharing(rng, many):
    """Texts of which every three share a passage and are strangers otherwise, and a near copy of every tenth."""
    texts = []
    for k in range(many):
        words = [f"p{k // 3}x{j}" for j in range(40)] + [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts.append(" ".join(words))
        if k % 10 == 0:
            texts.append(" ".join([*words[:-1], "other"]))
    return texts


def test_only_texts_of_candidates_travel(spark, monkeypatch):
    """Texts that meet under a key but have no candidate in another component are not dealt to units."""
    import random

    from tributary.llm import jaccard

    given, seen, texts_of = _sharing(random.Random(3), 200), [], jaccard._texts

    def counted(nodes, *rest):
        seen.append(nodes.distinct().count())
        return texts_of(nodes, *rest)

    monkeypatch.setattr(jaccard, "_texts", counted)
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(4)
    found = jaccard.jaccard_components(docs)
    assert found.select("component").distinct().count() == 200
    assert max(seen) <= 60  # of 220; the 20 pairs, and what else fingerprints name


def test_simhash_bands_name_candidates(spark, monkeypatch):
    """Near copies whose fingerprints differ in few bits are found by the operator's bands, whatever the keys of prefixes bring together."""
    import numpy as np

    from tributary.llm import jaccard

    words = [f"w{k}" for k in range(900)]
    given = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["some", *words]), " ".join(words[::-1])]
    monkeypatch.setattr(jaccard, "prefix", lambda found, frequent: np.empty(0, np.uint64))
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {}
    for r in jaccard.jaccard_components(docs).collect():
        got.setdefault(r["component"], []).append(r["id"])
    assert sorted(map(sorted, got.values())) == [[0, 1, 2], [3]]
