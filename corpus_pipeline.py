"""A corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed, texts are encoded.

STAGES lists (name, function of (spark, docs, sf_dir)); each takes what the one
before kept, read from Parquet. All but the last return the columns of
documents. The result of the last has one row for each copy of a document in the mix.

Rows hold whole texts, and Python workers keep what their largest Arrow batch
took: the stages set spark.sql.execution.arrow.maxRecordsPerBatch of the session to 1,000 at most.

In every stage null text counts as empty, repeated rows are documents of their
own, and an empty table gives no rows. The columns of documents stay as they
are, whatever others there are beside id, text and source.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from docengine.llm.common import held_out, table, written


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1_000:
        spark.conf.set(key, "1000")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; empty texts have the model's bias alone."""
    _small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", held_out("doc_id", 5, 0))
    scored = toxicity.score(docs, model, carry=tuple(docs.columns))
    return scored.where("_score < 0.5").select(*[F.col(f"_carry_{c}").alias(c) for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts, that of the largest id; of rows that repeat id and text one; null ids are the smallest."""
    return exact_dedup.drop_exact_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id; null ids come last."""
    _small_batches(spark)
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them; null is a source of its own, and texts without words are of size 0."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and the digest of what they decode to; an empty text has no ids."""
    _small_batches(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole, pieces = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    found = bpe.joined(whole, pieces)
    return found.select(F.col("_id").alias("doc_id"), (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"), F.col("_ids").alias("ids"), F.sha2("_bytes", 256).alias("decoded_sha256"))


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("mixing", mixed), ("byte_bpe", encoded)]

#: SQL cannot express a trained classifier, sketches or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
