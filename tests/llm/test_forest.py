"""The forest end to end: many leaves, hot leaves, several lengths, against brute force."""

import numpy as np

from tributary.llm import vectors
from tributary.llm.common import merge_labels


def _expected(x, cosine=0.95):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= cosine
    labels = np.arange(len(x))
    merge_labels(labels, *np.nonzero(near))
    return near.sum(axis=1) - 1, labels


def test_forest_of_many_leaves_against_brute_force(spark, monkeypatch):
    """Leaves of 64 vectors give trees of depth 6; a hot leaf is split into blocks of 128."""
    monkeypatch.setattr(vectors, "CAP", 128)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2200, 24))
    near = base[:900] + 0.2 * rng.normal(size=(900, 24))
    hot = base[0] + 0.1 * rng.normal(size=(500, 24))
    x = np.concatenate([base, near, hot, base[:50]]).astype(np.float32)
    t = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {r["vec_id"]: r for r in vectors.vector_components(t, leaf=64, sample=1500).collect()}
    links, labels = _expected(x)
    found = sum(got[k]["n_links"] for k in range(len(x)))
    assert all(got[k]["n_links"] <= links[k] for k in range(len(x)))
    assert links.sum() > 100_000 and found >= 0.97 * links.sum()
    assert np.mean([got[k]["component_id"] == labels[k] for k in range(len(x))]) > 0.97
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in range(len(x)))


def test_vectors_link_within_their_length(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for d, n in ((8, 300), (3, 40), (5, 2), (1, 3)):
        x = np.abs(rng.normal(size=(n, d))).astype(np.float32)
        links, labels = _expected(x)
        first = len(rows)
        for k, v in enumerate(x):
            want[first + k] = (int(links[k]), first + int(labels[k]))
            rows.append((first + k, v.tolist()))
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.vector_components(t).collect()}
    assert got == want
    assert sum(x[0] for x in want.values()) > 0 and want[len(rows) - 1][0] == 2
