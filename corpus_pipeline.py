"""A corpus pipeline of five stages over the documents: toxic documents go, one
document of each group of near-duplicates stays, secrets are masked, sources are
mixed to target weights, and what is left is encoded.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, mixing, secrets_scan, simhash, toxicity
from voxloom.llm.common import broadcast_if_small, cut, fresh, give_back_memory, table


BATCH_ROWS = 1_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage):
    """A stage whose texts go to Python ``BATCH_ROWS`` at a time, where the session
    would send more: what a task holds of them, in Java and in Python, is a tenth of
    what it is at Spark's default. The setting stays, as the stage's result is
    computed after it has returned."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(ARROW_ROWS))
        if rows <= 0 or rows > BATCH_ROWS:
            spark.conf.set(ARROW_ROWS, BATCH_ROWS)
        spark.sparkContext._jvm.System.gc()
        give_back_memory()
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the rejection threshold, by models of all
    labelled documents there are. Each row is judged by its own text, whether its
    id is null or repeats."""
    key = fresh(docs, "row")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    scored = toxicity.score(keyed, toxicity.train(docs, table(spark, sf_dir, "labels")), id_col=key)
    gone = cut(scored.where(F.col("score") >= toxicity.REJECT).select(F.col("id").alias(fresh(keyed, "gone"))).distinct())
    return keyed.join(broadcast_if_small(gone), F.col(key) == F.col(gone.columns[0]), "left_anti").drop(key)


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts that are near by five-word shingles, the document
    with the smallest id."""
    return simhash.keep_one_of_each(docs, simhash.near_duplicates(docs, words=5, similarity=0.8))


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew."""
    masked = secrets_scan.redact(docs, secrets_scan.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by calibrated probabilities. Null sources and
    languages are values of their own; a document without tokens stays."""
    names = docs.columns
    topic = fresh(docs, "topic")
    tagged, dims = docs.withColumn(topic, F.expr(mixing.TOPIC)), ["source", "lang", topic]
    cells = mixing.calibrated(tagged, dims, F.expr(mixing.TOKENS).cast("long"))
    p, kept = fresh(tagged, "p"), fresh(tagged, "kept")
    return mixing.sample(tagged, cells, dims, "doc_id", p=p, kept=kept).where(F.col(kept)).select(*names)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, bpe.digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs


#: a trained model and a tokenizer are among the stages: tests hold run() against brute force
ORACLE_SQL = None
