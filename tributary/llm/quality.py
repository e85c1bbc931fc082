"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes; only the document carries a
label. Each passage is encoded from counts of byte classes and of repeats,
h = tanh(W x + b). Gated attention weighs the passages,

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),

and the document's score is the sigmoid of a linear form of sum_k a_k h_k. All
weights are learned together from document labels, on a bounded sample of
labelled rows; scoring reads whole texts of all rows and never shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.common import quiet

PASSAGE = 512
#: Labelled documents that the model is fitted on at most, and passages of all of them together: whole documents are taken up to there.
SAMPLE, PASSAGES = 4000, 1_000_000
THRESHOLD = 0.7
_LAGS = tuple(range(2, 14))


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 .,;: 6 !? 7 | 8 quotes and brackets 9 other signs 10 non-ASCII 11 control."""
    out = np.full(256, 9, np.uint8)
    for k, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "|", "\"'()[]{}<>")):
        out[[ord(c) for c in members]] = k
    out[128:] = 10
    out[[c for c in range(32) if chr(c) not in "\t\n\r"] + [127]] = 11
    return out


_CLASS = _classes()
CLASSES = 12
WIDTH = CLASSES + 3 + 2


def passages(raw: bytes, size: int = PASSAGE) -> np.ndarray:
    """(passages, WIDTH) features of a whole text; an empty text is one empty passage."""
    x = np.frombuffer(raw, np.uint8)
    if not len(x):
        return np.zeros((1, WIDTH))
    n = max(1, round(len(x) / size))
    starts = np.arange(n) * len(x) // n
    lengths = np.diff(np.append(starts, len(x)))
    kind = _CLASS[x]
    which = np.repeat(np.arange(n), lengths)
    counts = np.bincount(which * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    word = kind != 3
    word &= kind != 4
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    letter = (kind < 2) | (kind == 10)
    marked = np.zeros(len(x), bool)  # a sign of class 9 right after a letter
    marked[1:] = letter[:-1] & (kind[1:] == 9)
    repeats = np.zeros(n)
    for lag in _LAGS:
        same = np.zeros(len(x), bool)
        same[lag:] = x[lag:] == x[:-lag]
        repeats = np.maximum(repeats, np.add.reduceat(same, starts, dtype=np.int64) / lengths)
    words = np.add.reduceat(begins, starts, dtype=np.int64)
    out = np.empty((n, WIDTH))
    out[:, :CLASSES] = counts / lengths[:, None]
    out[:, CLASSES] = words / lengths
    out[:, CLASSES + 1] = np.add.reduceat(marked, starts, dtype=np.int64) / np.maximum(words, 1)
    out[:, CLASSES + 2] = repeats
    out[:, CLASSES + 3] = np.log1p(lengths) / 8
    out[:, CLASSES + 4] = np.log1p(len(x)) / 12
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # W, b, V, U, w, c, d

    def score(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, attention of each passage); starts: each bag's first row in x."""
        w_in, b, v, u, w, c, d = self.weights
        h = np.tanh((x - self.mean) / self.scale @ w_in + b)
        e = (np.tanh(h @ v) * _sigmoid(h @ u)) @ w
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return _sigmoid(z @ c + d[0]), a


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(params: list[np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean cross entropy, its gradient by each parameter) of bags of standardised passages."""
    w_in, b, v, u, w, c, d = params
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ w_in + b)
    t, s = np.tanh(h @ v), _sigmoid(h @ u)
    e = (t * s) @ w
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    p = _sigmoid(z @ c + d[0])
    g = (p - y) / len(y)
    dz = np.repeat(g[:, None] * c, sizes, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    dt, ds = de[:, None] * w * s * (1 - t * t), de[:, None] * w * t * s * (1 - s)
    dh = dz * a[:, None] + dt @ v.T + ds @ u.T
    dp = dh * (1 - h * h)
    loss = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    return loss, [x.T @ dp, dp.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ g, g.sum(keepdims=True)]


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 400, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Learn all weights by Adam on the cross entropy of document labels."""
    rng = np.random.default_rng(seed)
    allx = np.concatenate(bags)
    mean, scale = allx.mean(axis=0), allx.std(axis=0) + 1e-3
    bags = [(x - mean) / scale for x in bags]
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    params = [init(WIDTH, hidden), np.zeros(hidden), init(hidden, gate), init(hidden, gate), init(gate), init(hidden), np.zeros(1)]
    m, v2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        chosen = rng.choice(len(bags), min(batch, len(bags)), replace=False)
        x, y = np.concatenate([bags[k] for k in chosen]), labels[chosen]
        sizes = np.array([len(bags[k]) for k in chosen])
        starts = np.cumsum(sizes) - sizes
        _, grads = gradients(params, x, starts, y)
        lr = rate * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        for k, grad in enumerate(grads):
            grad = grad + decay * params[k]
            m[k], v2[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v2[k] + 0.001 * grad * grad
            params[k] = params[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, params)


def held_out(id_col) -> F.Column:
    """Documents whose label is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages_at_most: int = PASSAGES) -> Model:
    """Fit on at most sample labelled rows that are not held out, chosen by hash of the id.

    Every passage of a chosen document is used; where the documents would pass
    PASSAGES together, fewer are taken, in the order of that hash, each whole.
    Of several labels of one document the smallest counts; null labels and null
    ids are left out. Without both labels the model says 0.5 for every text.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)  # bounded by sample: small enough to broadcast
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_raw")).join(F.broadcast(known), id_col)
    sizes = rows.select(F.xxhash64(id_col).alias("h"), F.greatest(F.lit(1), F.ceil(F.coalesce(F.length("_raw"), F.lit(0)) / PASSAGE)).alias("n"))
    sizes = sizes.groupBy("h").agg(F.sum("n").alias("n"))  # at most sample rows, whatever ids repeat
    order = Window.orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    last = sizes.withColumn("t", F.sum("n").over(order)).where(F.col("t") <= passages_at_most).agg(F.max("h")).first()[0]
    rows = rows.where(F.xxhash64(id_col) <= F.lit(last)) if last is not None else rows.limit(0)

    def run(batches):
        for batch in batches:
            found = [passages(raw or b"").astype(np.float32).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "label", "x"])

    bags = rows.mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, label int, x binary").collect()
    bags = sorted({(r["id"], r["label"], bytes(r["x"])) for r in bags})
    y = np.array([r[1] for r in bags], float)
    if len(set(y)) < 2:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), [np.zeros((WIDTH, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1), np.zeros(1), np.zeros(1)])
    return fit([np.frombuffer(r[2], np.float32).reshape(-1, WIDTH).astype(float) for r in bags], y)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Every row and column of docs, plus score_col double in 0..1 and predicted_col int (1 at threshold or more).

    Null text is empty; empty texts get the score of an empty passage. Input
    columns of those two names are replaced.
    """
    from pyspark.sql.functions import arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights))

    def scores(m: Model, texts: pa.Array) -> pa.Array:
        out, bags, held = [], [], 0

        def flush():
            sizes = [len(x) for x in bags]
            out.append(m.score(np.concatenate(bags), np.cumsum([0, *sizes[:-1]]))[0])

        for raw in texts:
            bags.append(passages(raw.as_py() or b""))
            held += len(bags[-1])
            if held >= 4096:  # all passages of these texts in one go
                flush()
                bags, held = [], 0
        if bags:
            flush()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with quiet():
            m = Model(*shared.value)
            for texts in batches:
                yield scores(m, texts)

    scored = docs.drop(score_col, predicted_col).withColumn(score_col, score(F.col(text_col).cast("binary")))
    return scored.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """The quality contract over documents: learned from labels, scored on whole texts."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
