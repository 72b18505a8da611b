"""Chunk records: ids, texts for embedding, selection, validation, union of corpora, topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import vocab
from docengine.functions.text import fold_ascii


def unique_ids(chunks: DataFrame, base: str, order: str) -> DataFrame:
    """Adds unique_id: the n-th row of an id, n over 1, gets a suffix."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    suffix = F.concat(F.lit("_duplicata-"), F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))
    return chunks.withColumn("unique_id", F.when(n > 1, F.concat(F.col(base), suffix)).otherwise(F.col(base)))


def labelled_text(labels: list[tuple[str, Column]], text: Column) -> Column:
    """Header lines "label: value" of what is there, then the text."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), c) for n, c in labels], F.concat(F.lit("Texto: "), text))


def eligible(chunks: DataFrame) -> DataFrame:
    """Adds embedding_eligible and embedding_exclusion_reason by the first rule that holds; a column that chunks lack is null."""
    col = lambda name, kind="string": F.col(name) if name in chunks.columns else F.lit(None).cast(kind)
    is_ = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    layout = is_(col("chunk_type"), vocab.NON_RETRIEVABLE_CHUNK_TYPES) | is_(col("document_structure_type"), vocab.NON_RETRIEVABLE_CHUNK_TYPES) | is_(col("content_role"), ["structural"])
    wanted = (
        F.coalesce(col("is_doctrinal", "boolean"), F.lit(False)) | is_(col("document_type"), vocab.DOCTRINAL_DOCUMENT_TYPES + vocab.NORMATIVE_DOCUMENT_TYPES)
        | is_(col("source_category"), ["doctrinal_document", "denominational_normative_document"]) | is_(col("content_role"), ["doctrinal", "normative"]) | is_(col("chunk_type"), ["introductory_context", "conclusion_paragraph"])
    )
    reason = F.when(layout, "summary_or_non_retrievable_layout").when(~wanted, "non_documentary_context_not_selected")
    return chunks.withColumn("embedding_exclusion_reason", reason).withColumn("embedding_eligible", F.col("embedding_exclusion_reason").isNull())


def issues(chunks: DataFrame, most: int = 3200) -> DataFrame:
    """chunk_id, document_id, issue: one row for each finding about a chunk (chunk_id, document_id, text, article_number)."""
    copy = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("chunk_id")) > 1
    found = F.array_compact(
        F.array(
            F.when(F.trim("text") == "", "empty_text"), F.when(F.length("text") > most, "chunk_above_expected_limit"), F.when(F.coalesce("article_number", F.lit("0")) == "0", "missing_reference"), F.when(F.col("_copy"), "duplicate_text")
        )
    )
    return chunks.withColumn("_copy", copy).select("chunk_id", "document_id", F.explode(found).alias("issue"))


def unify(corpora: list[DataFrame], key: str) -> DataFrame:
    """Corpora one after another, by column name; of equal keys the row of the first corpus stays, keys that are null go."""
    tagged = [c.withColumn("_corpus", F.lit(i)) for i, c in enumerate(corpora)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).where(F.col(key).isNotNull())
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_corpus"))).where("_n = 1").drop("_n", "_corpus")


def first_rule(chunks: DataFrame, rules, default: str, name: str = "topic") -> DataFrame:
    """Adds the name of the first rule (name, keywords) of which the folded text holds a keyword, also inside words."""
    folded = fold_ascii("text")
    out = F.lit(default)
    for topic, keywords in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [folded.contains(k) for k in keywords]), topic).otherwise(out)
    return chunks.withColumn(name, out)
