"""The corpus pipeline: language, quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but
the last returns the columns of documents, so stages can be run one by one with
a Parquet table between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm import jaccard, language, packing, quality, secrets
from tributary.llm.common import materialize, without

#: Bytes of chunks that a worker of the last stage remembers: earlier stages share its memory. Results do not depend on it.
ROOM = 128 << 20

#: SQL can express none of the models, fingerprints and tokenizers above.
ORACLE_SQL = None


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; the rest go.

    Texts are scored once and only scores meet the pages; a row is known again
    by its id and a hash of its text and source, on which the decision rests.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = language.train(docs)
    row = F.xxhash64("text", "source")
    scores = language.text_evidence(docs.select("doc_id", "text", "source"), model).withColumn("_row", row).drop("text")
    scores = materialize(scores, "scores")
    found = language.identify(language.with_evidence(scores, pages), model, "text", "_h", "_d", "_a", scored=True)
    return without(docs, found.where("not kept").select("doc_id", "_row"), [docs["doc_id"], row], "rejected")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 1; the rest go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    return quality.score_quality(docs, model, score_col="_score", predicted_col="_good").where("_good = 1").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id, once.

    SimHash fingerprints of five-word shingles name candidates, five-word
    Jaccard similarity of 0.8 or more decides. A row is known by its id and a
    hash of its text; rows without an id stay.
    """
    text = F.xxhash64("text")
    found = jaccard.jaccard_components(docs).where("id is not null").withColumn("row", F.struct("id", "text_hash"))
    least = found.groupBy("component").agg(F.min("row").alias("least"))
    found = materialize(found.join(least, "component").select("id", "text_hash", (F.col("row") == F.col("least")).alias("first")), "found")
    left = without(docs, found.where("not first").select("id", "text_hash"), [docs["doc_id"], text], "gone")
    repeated = found.where("first").groupBy("id", "text_hash").count().where("count > 1").select(F.col("id").alias("doc_id"), F.col("text_hash").alias("_row"))
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return left
    left, same = left.withColumn("_row", text), ["doc_id", "_row"]
    order = Window.partitionBy(*same).orderBy(*docs.columns)
    twice = left.join(repeated, same, "left_semi").withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return left.join(repeated, same, "left_anti").select(*docs.columns).unionByName(twice.select(*docs.columns))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kind."""
    spans = {"base": "_base", "links": "_linked"}
    return secrets.redact(secrets.scan_secrets(docs, **spans), **spans).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs, room=ROOM)


STAGES = [
    ("language", keep_identified),
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("secrets", hide_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, a Parquet table in the shared folder between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
