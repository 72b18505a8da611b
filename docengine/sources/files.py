"""Readers and writers of the records of §2.1: JSON lines, JSON documents, CSV of questions, page sources, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.operators.chunks import eligible

CHUNK_SCHEMA = (
    "chunk_id string, document_id string, document string, document_type string, source_category string, chunk_type string, content_role string, is_doctrinal boolean, section_title string, section_reference string,"
    " chapter_title string, chapter_reference string, article_number string, paragraph_number string, page_start int, page_end int, source_path string, text string, text_hash string, embedding_text string, embedding_eligible boolean"
)
QUESTION_COLUMNS = ("id", "categoria", "pergunta", "documentos_esperados", "escopo_esperado", "mistura_permitida", "referencia_esperada", "resposta_esperada_ground_truth", "deve_responder", "observacao")


def read_chunks(spark: SparkSession, path: str, only_eligible: bool = False, strict: bool = False) -> DataFrame:
    """Chunks of JSON lines. strict: a line that is no record fails the job; else it gives no row."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.where(F.col("embedding_eligible").eqNullSafe(True)) if only_eligible else rows


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """issue, line of JSON lines that are blank or no records."""
    text = spark.read.text(path)
    issue = F.when(F.trim("value") == "", "blank_line").when(F.from_json("value", CHUNK_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull(), "invalid_json")
    return text.select(issue.alias("issue"), F.col("value").alias("line")).where("issue is not null")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file."""
    return spark.read.option("multiLine", True).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of questions: the delimiter is that of the first line, ; where in doubt; a byte-order mark goes; cells are trimmed; missing columns fail."""
    head = (spark.read.text(path).limit(1).collect() or [[""]])[0][0].lstrip("﻿")
    rows = spark.read.option("header", True).option("sep", "," if head.count(",") > head.count(";") else ";").option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.strip().lstrip("﻿") for c in rows.columns])
    if missing := sorted(set(QUESTION_COLUMNS) - set(rows.columns)):
        raise ValueError(f"missing columns: {missing}")
    return rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in rows.columns])


def read_pages(spark: SparkSession, path: str, separator: str = "===== PAGE ") -> DataFrame:
    """document, page_number, text, char_count, is_empty of text files with a line before each page."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document"), F.posexplode(F.split("value", separator + r"\d+ =====\n?")).alias("page_number", "text"))
    pages = files.where("page_number > 0").withColumn("text", F.regexp_replace("text", r"\n+\z", ""))
    return pages.withColumn("char_count", F.length("text")).withColumn("is_empty", F.trim("text") == "")


def page_texts(pages: DataFrame) -> DataFrame:
    """document_id, text: the pages of each document in order, each after its separator."""
    block = F.concat(F.lit("===== PAGE "), F.col("page_number").cast("string"), F.lit(" =====\n"), "text")
    listed = F.array_sort(F.collect_list(F.struct("page_number", block.alias("block"))))
    return pages.groupBy("document_id").agg(F.concat_ws("\n\n", F.transform(listed, lambda x: x["block"])).alias("text"))


def write_chunks(chunks: DataFrame, path: str, append: bool = False) -> None:
    chunks.write.mode("append" if append else "overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key; a new row replaces an old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new")))).where("_n = 1").drop("_n", "_new")


def chunks_to_embed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Eligible chunks that have no vector yet: the job resumes where it stopped."""
    return eligible(chunks).where("embedding_eligible").join(done.select("chunk_id"), "chunk_id", "left_anti")
