"""Queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bpe, collocations, exact_dedup, filter_audit, html_extract, language_model, licenses, mixing, near_dedup, quality, repetition, suffix_dedup, toxicity
from docengine.llm.common import held_out, table, text_of


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null html is empty, repeated rows are pages each, an empty table gives no rows. Nulls, ties and columns of clashing names as in extract_main_text()."""
    found = html_extract.extract_main_text(table(spark, sf_dir, "pages"), carry=("page_id", "url"))
    return found.select(F.col("_carry_page_id").alias("page_id"), F.col("_carry_url").alias("url"), F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"), F.col("_by_tree").alias("n_by_tree"), F.col("_by_names").alias("n_by_names"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, its size, and whether the document is the one that stays; null and empty texts are one class, null ids come last. Others as in near_classes()."""
    found = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    sizes = found.groupBy("_class").agg(F.count("*").alias("class_size"))
    out = found.join(sizes, "_class").select(F.col("_id").alias("doc_id"), F.col("_class").alias("class_id"), "class_size")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the row of the same text that stays; null counts as empty, of rows that repeat id and text one is kept, null ids are the smallest. Others as in exact_groups()."""
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(text_of("text"), 256))
    found = exact_dedup.exact_groups(docs, carry=("text_sha256",))
    return found.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), "text_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null and empty texts have the model's bias alone, null ids are held out, without labels all scores are 0.5. Repeated rows are scored each; columns of other names are ignored; an empty table gives no rows."""
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of the sources takes of every document; null is a source of its own, texts without words are of size 0 and taken 0 words of. Ties and repeats as in systematic_mix()."""
    taken = mixing.systematic_mix(table(spark, sf_dir, "documents"))
    return taken.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null and empty texts have no words and fail the base. Others as in repetition_coverage()."""
    found = repetition.repetition_coverage(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = found.withColumnRenamed("_id", "doc_id").withColumn("base_failed", base)
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("_repetitive")).drop("_repetitive")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document keeps; null counts as empty, null ids come first. Others as in repeated_bytes()."""
    found = suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every document; null, empty and wordless texts match none. Others as in scan()."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_matches").alias("n_matches"), F.col("_license").alias("license"), F.round("_score", 6).alias("score"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests; null counts as empty and has no ids, repeated rows are encoded each, an empty table gives no rows."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole, pieces = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return bpe.digests(whole, pieces).withColumnRenamed("_id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null and empty texts have the model's bias alone, null ids are held out. Repeated rows are scored each; columns of other names are ignored; an empty table gives no rows."""
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of those outside one seventh of the ids; nulls, repeats and empty tables as in perplexity()."""
    found = language_model.perplexity(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2)).withColumnRenamed("_id", "doc_id")
    return found.withColumn("base_score", F.round("base_score", 6)).withColumn("score", F.round("score", 6))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 most cohesive phrases of each language, of those that no longer phrase covers; nulls and empty tables as in collocations()."""
    found = collocations.best(collocations.collocations(table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language in all 120 orders; nulls, repeats and empty tables as in audit()."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("_part", "part")


QUERIES = {f.__name__: f for f in (op1_html_main_text, op2_near_dedup, op3_exact_dedup, op4_toxicity, op5_mixing, op6_repetition, op7_suffix_dedup, op8_license_scan, op9_byte_bpe, op10_quality, op11_language_model, op12_collocations, op13_filter_audit)}

ORACLE_SQL = {
    "op11_language_model": language_model.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
    "op8_license_scan": licenses.oracle(),
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op5_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                     source_size * 2.0::DOUBLE AS cap FROM s),
        l AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target,
                     ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
                     row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS n
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               CAST((floor(n * e + u) - floor((n - 1) * e + u)) AS BIGINT) * size AS taken FROM p""",
}
