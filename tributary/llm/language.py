"""Language identification by fusing evidence in Bayes' form.

log P(lang | row) = log P(text | lang) + log P(declared | lang)
                  + log P(address | lang) + log P(lang | host)

* text: naive Bayes over hashed byte trigrams, tempered by text length;
* declared: what the page's markup claims, through a confusion table learned
  from the corpus, so a claim counts as much as it has proved right;
* address: the suffix of the host and the language segment of the path, alike;
* host: counts of the text-only decisions of all other rows by grouped
  aggregation, smoothed down the hierarchy all -> domain -> host.

Only the text model is fitted on a bounded sample of labelled rows; tables of
claims and priors cover every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import keyed, materialize, quiet

#: Labelled rows that the text model is fitted on at most, and buckets of its trigram table.
SAMPLE, BUCKETS = 4000, 1 << 15
#: Sum of trigram weight that a text can reach, strength of a parent prior, least posterior of a kept row.
TEMPER, STRENGTH, KEEP = 60.0, 20.0, 0.5
#: Hosts or claims up to this number are broadcast; beyond it their tables are joined by shuffle.
BROADCAST = 50_000
_HTML_LANG = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def _trigrams(raw: bytes) -> np.ndarray:
    """Hashed trigrams of lower-cased bytes, white space and signs folded to one blank."""
    x = _FOLD[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    if len(x) < 3:
        x = np.concatenate([x, np.full(3 - len(x), 32, np.uint32)])
    return ((x[:-2] * np.uint32(961748927) ^ x[1:-1] * np.uint32(982451653) ^ x[2:] * np.uint32(122949823)) >> np.uint32(7)) & np.uint32(BUCKETS - 1)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
#: Bytes that carry letters: the rest of a text says nothing about its language.
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


def weighed(rows) -> dict[str, np.ndarray]:
    """Trigram counts of each language; a text counts by its shares of trigrams, times the root of their number."""
    counts: dict[str, np.ndarray] = {}
    for lang, raw in rows:
        seen = np.bincount(_trigrams(raw), minlength=BUCKETS)
        counts.setdefault(lang, np.zeros(BUCKETS))
        counts[lang] += seen / np.sqrt(seen.sum())
    return counts


class TextModel:
    """log P(trigram | language) for each language; scores are per language, tempered."""

    def __init__(self, languages: list[str], counts: np.ndarray, temper: float = TEMPER):
        self.languages, self.temper = languages, temper
        smooth = counts + 0.5
        table = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.table = np.ascontiguousarray((table - table.mean(axis=0)).T.astype(np.float32))

    @classmethod
    def fit(cls, rows: list[tuple[str, bytes]]) -> TextModel:
        """Fit on (language, whole text) pairs."""
        return cls.of_counts(weighed(rows))

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> TextModel:
        languages = sorted(counts)
        return cls(languages, np.array([counts[lang] for lang in languages]))

    def scores(self, raw: bytes, part: int = 1 << 20) -> tuple[np.ndarray, int]:
        """(log likelihoods up to a constant, letters seen)."""
        letters, total, n = 0, np.zeros(len(self.languages)), 0
        for at in range(0, max(1, len(raw)), part):
            piece = raw[at : at + part + 2]
            letters += int(_LETTER[np.frombuffer(raw[at : at + part], np.uint8)].sum())
            grams = _trigrams(piece)
            total += self.table[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total * min(1.0, self.temper / max(1, n)), letters


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Fit the text model on at most sample distinct labelled texts, those of the smallest hashes, each read whole.

    The cut-off is found on hashes alone; then one task counts the trigrams of
    the chosen texts as they stream by, and only its counts reach the driver.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text")).where("lang is not null and text is not null")
    labelled = labelled.withColumn("h", F.xxhash64("text", "lang"))
    last = labelled.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return TextModel.fit([("und", b"")])
    # copies of one text fall together before the shuffle, so a hot text costs one row a map task
    chosen = labelled.where(F.col("h") <= last).dropDuplicates(["h"]).select("lang", "text").coalesce(1)

    def count(batches):
        whole: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, seen in weighed(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())).items():
                whole[lang] = whole.get(lang, 0) + seen
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(list(whole)), pa.array([c.tobytes() for c in whole.values()], pa.binary())], ["lang", "counts"])

    found = chosen.mapInArrow(count, "lang string, counts binary").collect()
    return TextModel.of_counts({r["lang"]: np.frombuffer(r["counts"]) for r in found})


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _fused(languages: list[str], *weights: Column) -> Column:
    """Normalised posterior of summed log weights, as array<double>."""
    total = weights[0]
    for w in weights[1:]:
        total = F.zip_with(total, w, lambda a, b: a + b)
    top = F.array_max(total)
    raw = F.transform(total, lambda x: F.exp(x - top))
    whole = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / whole)


def _votes(k: int) -> Column:
    """A row's own text vote as counts: 1 at its best language where its text has letters."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when((F.col("_letters") > 0) & (i == F.col("_best")), 1.0).otherwise(0.0))


def text_evidence(docs: DataFrame, model: TextModel, text_col: str = "text") -> DataFrame:
    """docs with _text (log likelihoods) and _letters."""
    from pyspark.sql.functions import arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.temper))

    @arrow_udf("struct<_text: array<double>, _letters: bigint>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with quiet():
            m = TextModel.__new__(TextModel)
            m.languages, m.table, m.temper = shared.value
            for texts in batches:
                yield scored_batch([m.scores(t.as_py() or b"") for t in texts])

    def scored_batch(found: list) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([x[0].tolist() for x in found], pa.list_(pa.float64())), pa.array([x[1] for x in found], pa.int64())], ["_text", "_letters"])

    scored = docs.withColumn("_evidence", score(F.col(text_col).cast("binary")))
    return scored.withColumn("_text", F.col("_evidence._text")).withColumn("_letters", F.col("_evidence._letters")).drop("_evidence")


def _claims(counts: DataFrame, k: int, key: str, name: str) -> DataFrame:
    """(key, name): log P(key | language) for every claim that occurs, from counts of (key, best language)."""
    by = counts.where(F.col(key).isNotNull()).groupBy(key).pivot("_best", list(range(k))).agg(F.sum("n")).na.fill(0)
    by = materialize(by.select(key, *(F.col(str(i)).cast("double").alias(f"n{i}") for i in range(k))), "claims")
    whole = by.agg(F.count(F.lit(1)).alias("keys"), *(F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(k))).first()
    logs = (F.log((F.col(f"n{i}") + 0.5) / F.lit(whole[f"n{i}"] + 0.5 * (whole["keys"] + 1))) for i in range(k))
    n = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0")).cast("long")
    return materialize(by.select(key, F.array(*logs).alias(name), n.alias("_n")), "claims")


def identify(docs: DataFrame, model: TextModel, text_col: str = "text", host_col: str | None = None, declared_col: str | None = None, address_col: str | None = None, strength: float = STRENGTH, scored: bool = False) -> DataFrame:
    """Every row and column of docs, plus language, probability, kept.

    host_col, declared_col and address_col name columns with the host, the
    declared language and the language-like token of the address; null or
    missing evidence counts as none. A row is kept where it has a letter and its
    best language reaches KEEP. Null and empty texts rest on the other evidence
    and are not kept. Input columns named language, probability or kept are
    replaced; repeated rows repeat. scored: docs come from text_evidence, with
    or without their texts, so no text is read again.
    """
    spark, k = docs.sparkSession, len(model.languages)
    given = docs.drop("language", "probability", "kept")
    names = [c for c in given.columns if not (scored and c in ("_text", "_letters"))]
    flat = F.array(*(F.lit(0.0) for _ in range(k)))
    pick = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = given.withColumn("_host", pick(host_col)).withColumn("_declared", F.lower(pick(declared_col))).withColumn("_address", F.lower(pick(address_col)))
    rows = rows if scored else text_evidence(rows, model, text_col)
    alone = rows.withColumn("_best", F.array_position("_text", F.array_max("_text")).cast("int") - 1)
    # the one grouped aggregation: text-only decisions by host, claim and address
    counts = materialize(alone.where("_letters > 0").groupBy("_host", "_declared", "_address", "_best").agg(F.count(F.lit(1)).alias("n")), "claims")
    world = {r["_best"]: r["n"] for r in counts.groupBy("_best").agg(F.sum("n").alias("n")).collect()}
    whole = sum(world.values())
    root = [(world.get(i, 0) + 1.0) / (whole + k) for i in range(k)]
    by = counts.where("_host is not null").groupBy("_host").pivot("_best", list(range(k))).agg(F.sum("n")).na.fill(0)
    by = by.select("_host", domain(F.col("_host")).alias("_domain"), F.array(*(F.col(str(i)).cast("double") for i in range(k))).alias("_seen"))
    up = by.groupBy("_domain").agg(F.array(*(F.sum(F.col("_seen")[i]) for i in range(k))).alias("_above"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    priors = materialize(by.join(up, "_domain").select("_host", "_seen", "_above", total(F.col("_seen")).cast("long").alias("_n")), "priors")
    below = lambda n, over: F.zip_with(n, over, lambda c, p: (c + strength * p) / (total(n) + strength))
    others = lambda a: F.zip_with(a, F.col("_own"), lambda n, o: n - o)
    ground = F.array(*map(F.lit, root))
    prior = F.transform(below(others(F.col("_seen")), below(others(F.col("_above")), ground)), lambda x: F.log(x))
    rows = alone.withColumn("_own", _votes(k))  # its own vote is no evidence beside its text
    joined = keyed(rows, priors, "_host", "left", BROADCAST)
    for column, given_by in (("_declared", declared_col), ("_address", address_col)):
        if given_by:
            joined = keyed(joined, _claims(counts, k, column, f"{column}_log"), column, "left", BROADCAST)
        else:
            joined = joined.withColumn(f"{column}_log", flat)
    fused = _fused(model.languages, F.col("_text"), F.coalesce("_declared_log", flat), F.coalesce("_address_log", flat), F.coalesce(prior, F.array(*(F.lit(math.log(p)) for p in root))))
    out = joined.withColumn("_posterior", fused).withColumn("probability", F.array_max("_posterior"))
    out = out.withColumn("language", F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("_posterior", F.col("probability")).cast("int")))
    return out.withColumn("kept", (F.col("_letters") > 0) & (F.col("probability") >= KEEP)).select(*names, "language", "probability", "kept")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, host, declared, address) from raw pages: an address ends in the number of the document taken from it.

    Of several pages of one document the one with the smallest page_id counts.
    """
    url = F.col("url")
    rows = pages.select(
        F.expr(r"try_cast(regexp_extract(url, '/([0-9]{1,18})(?:\\.[a-z]+)?/?(?:[?#].*)?$', 1) as bigint)").alias("doc_id"), "page_id",
        F.nullif(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)), F.lit("")).alias("host"),
        F.nullif(F.lower(F.regexp_extract("html", _HTML_LANG, 1)), F.lit("")).alias("declared"),
        F.concat_ws("/", F.substring_index(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1), ".", -1), F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})/", 1)).alias("address"),
    ).where("doc_id is not null")
    best = rows.groupBy("doc_id").agg(F.min(F.struct("page_id", "host", "declared", "address")).alias("x"))
    return best.select("doc_id", "x.host", "x.declared", "x.address")


def with_evidence(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """docs with _h, _d, _a: host (of the page, else the source), declared language and address."""
    found = page_evidence(pages).select(F.col("doc_id").alias("_id"), F.col("declared").alias("_d"), F.col("address").alias("_a"), F.col("host").alias("_page"))
    return docs.join(found, docs["doc_id"] == F.col("_id"), "left").withColumn("_h", F.coalesce("_page", F.col("source"))).drop("_id", "_page")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Language, probability and kept of every document, its page's claims and host fused with its text."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    model = train(docs)
    # texts are scored once, before the join, and only their scores travel
    scores = materialize(text_evidence(docs.select("doc_id", "text", "source"), model).drop("text"), "scores")
    found = identify(with_evidence(scores, pages), model, "text", "_h", "_d", "_a", scored=True)
    return found.select("doc_id", "language", "probability", "kept")
