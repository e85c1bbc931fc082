"""The learned operations: gradients, held-out accuracy, evidence fused as by hand, texts read whole."""

import math

import numpy as np
from pyspark.sql import functions as F

from tributary.llm import language, quality

DIR = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    sizes = [3, 1, 5]
    x, y = rng.normal(size=(sum(sizes), quality.WIDTH)), np.array([1.0, 0.0, 1.0])
    starts = np.cumsum([0, *sizes[:-1]])
    params = [rng.normal(0, 0.4, s) for s in ((quality.WIDTH, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,))]
    _, grads = quality.gradients(params, x, starts, y)
    for k, p in enumerate(params):
        for place in np.ndindex(p.shape):
            kept = p[place]
            losses = []
            for step in (1e-5, -1e-5):
                p[place] = kept + step
                losses.append(quality.gradients(params, x, starts, y)[0])
            p[place] = kept
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[k][place]) < 1e-6


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    scored = quality.score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality.held_out("doc_id"))
    row = scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right")).first()
    assert row["n"] > 50 and row["right"] > 0.97


def test_every_passage_of_a_long_text_is_learned_from(spark):
    """Good and bad documents differ in one passage far behind the first 64."""
    rows = [(k, "quiet words run on " * 3000 + ("SHOUT!! " * 200 if k % 2 else "") + "quiet words run on " * 300, 1 - k % 2) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(table, table.select("doc_id", "quality"))
    out = quality.score_quality(table, model).where(quality.held_out("doc_id"))
    assert out.count() > 5 and out.where("(score > 0.5) <> (quality = 1)").count() == 0
    few = quality.train(table, table.select("doc_id", "quality"), passages_at_most=1)  # not one document fits
    assert quality.score_quality(table, few).where("score <> 0.5").count() == 0


def test_scores_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(n, quality.WIDTH)) for n in (1, 700, 3, 90)]
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), [rng.normal(0, 0.3, s) for s in ((quality.WIDTH, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,))])
    sizes = [len(b) for b in bags]
    whole = model.score(np.concatenate(bags), np.cumsum([0, *sizes[:-1]]))[0]
    assert np.allclose(whole, [model.score(b, np.zeros(1, np.int64))[0][0] for b in bags])


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = F.pmod(F.xxhash64("text"), F.lit(2)) == 1
    model = language.train(docs.where(odd))
    rest = docs.where(~odd)
    found = language.identify(rest, model, host_col="source").where("kept")
    row = found.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("language") == F.col("lang")).cast("double")).alias("right")).first()
    assert row["n"] > 0.8 * rest.count() and row["right"] > 0.95
    assert language.identify(rest, language.train(docs.limit(0)), host_col="source").where("language <> 'und'").count() == 0


def test_evidence_is_fused_as_by_hand(spark):
    en, de = "the river runs below the hills and over there", "der Fluss fließt unter den Hügeln und dort drüben"
    rows = [(k, (en, de, "", "12 34", None)[k % 5] if k % 7 else "x", ("a.one.org", "b.one.org", "two.net", None)[k % 4], ("en", "de", None)[k % 3], ("org", "de")[k % 2]) for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, host string, claim string, place string")
    model = language.TextModel.fit([("en", en.encode()), ("de", de.encode())])
    got = {r["doc_id"]: r for r in language.identify(table, model, host_col="host", declared_col="claim", address_col="place").collect()}
    scores = {k: model.scores((t or "").encode()) for k, t, *_ in rows}
    vote = {k: int(np.argmax(s)) for k, (s, n) in scores.items() if n}

    def counts(of):
        out = {}
        for row in rows:
            if row[0] in vote and of(row) is not None:
                out.setdefault(of(row), np.zeros(2))[vote[row[0]]] += 1
        return out

    hosts, domains = counts(lambda r: r[2]), counts(lambda r: r[2] and ".".join(r[2].split(".")[-2:]))
    root = (np.bincount(list(vote.values()), minlength=2) + 1.0) / (len(vote) + 2)
    s = language.STRENGTH
    for k, _, host, claim, place in rows:
        total, own = scores[k][0].copy(), np.eye(2)[vote[k]] if k in vote else np.zeros(2)
        for seen, key in ((counts(lambda r: r[3]), claim), (counts(lambda r: r[4]), place)):
            if key in seen:
                whole = sum(seen.values())
                total += np.log((seen[key] + 0.5) / (whole + 0.5 * (len(seen) + 1)))
        if host in hosts:
            d, c = domains[".".join(host.split(".")[-2:])] - own, hosts[host] - own
            total += np.log((c + s * (d + s * root) / (d.sum() + s)) / (c.sum() + s))
        else:
            total += np.log(root)
        p = np.exp(total - total.max())
        p /= p.sum()
        assert math.isclose(got[k]["probability"], p.max(), rel_tol=1e-9)
        assert got[k]["language"] == model.languages[int(p.argmax())] or math.isclose(p[0], p[1])


def test_long_texts_are_summed_like_short_ones():
    model = language.TextModel.fit([("en", b"the river runs below"), ("de", "der Fluss fließt".encode())])
    raw = b"the river runs below the hills " * 3000
    grams = language._trigrams(raw)
    want = model.table[grams].sum(axis=0, dtype=np.float64) * min(1.0, model.temper / len(grams))
    assert np.allclose(model.scores(raw)[0], want) and np.allclose(model.scores(raw, part=1000)[0], want)
