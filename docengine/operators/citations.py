"""Citations of answers with the contexts behind them, and the text of a context package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import page_span
from docengine.operators.orchestration import joined_pt

#: Heads of a package's text (fixed values).
PACKAGE_HEAD = "[CONTEXTOS DOCUMENTAIS RECUPERADOS]"


def _distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def structural_reference(reference: Column, references: Column, paragraphs: Column, articles: Column) -> Column:
    """A context's own reference, else those of its chunks, else the numbers of their paragraphs, else of their articles."""
    numbered = lambda one, many, v: F.concat(F.when(F.size(v) == 1, one).otherwise(many), F.lit(" "), joined_pt(v))
    r, p, a = _distinct(references), _distinct(paragraphs), _distinct(articles)
    return F.coalesce(
        F.nullif(F.trim(reference), F.lit("")), F.when(F.size(r) > 0, joined_pt(r)), F.when(F.size(p) > 0, numbered("Parágrafo", "Parágrafos", p)), F.when(F.size(a) > 0, numbered("Artigo", "Artigos", a))
    )


def included_chunks(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, rank, place, chunk_id and the columns of chunks: the chunks (chunk_ids) of each context, each once, in the place where it comes first."""
    each = contexts.select("question_id", "rank", F.posexplode(F.array_distinct("chunk_ids")).alias("place", "chunk_id"))
    return each.join(chunks, "chunk_id")


def enriched(citations: DataFrame, contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (question_id, source_id, included_chunk_ids) with context_text, context_status, content_priority, parent_key, pages, structural_reference and chunk_texts of the context their source names.

    contexts (question_id, rank, parent_key, status, priority, page_start, page_end, text, chunk_ids, full_reference); chunks (chunk_id, text, full_reference,
    paragraph_number, article_number). Texts are those of the cited chunks, of all where a citation names none. A citation whose source is not there keeps nulls.
    """
    source = F.concat(F.lit("source_"), F.col("rank").cast("string"))
    inside = included_chunks(contexts, chunks.select("chunk_id", "text", F.col("full_reference").alias("_r"), F.col("paragraph_number").alias("_p"), F.col("article_number").alias("_a")))
    row = F.struct("place", "chunk_id", F.trim("text").alias("text"), "_r", "_p", "_a")
    held = inside.groupBy("question_id", "rank").agg(F.array_sort(F.collect_list(row)).alias("_chunks"))
    named = contexts.join(held, ["question_id", "rank"], "left").withColumn("source_id", source)
    pick = lambda name: F.coalesce(F.transform("_chunks", lambda x: x[name].cast("string")), F.array().cast("array<string>"))
    named = named.select(
        "question_id", "source_id", F.col("text").alias("context_text"), F.col("status").alias("context_status"), F.col("priority").alias("content_priority"), "parent_key", "page_start", "page_end",
        structural_reference(F.col("full_reference"), pick("_r"), pick("_p"), pick("_a")).alias("structural_reference"), "_chunks",
    )
    found = citations.join(named, ["question_id", "source_id"], "left")
    none = F.size(F.coalesce("included_chunk_ids", F.array().cast(citations.schema["included_chunk_ids"].dataType))) == 0
    cited = F.filter("_chunks", lambda x: (none | F.array_contains("included_chunk_ids", x["chunk_id"])) & (x["text"] != ""))
    return found.withColumn("chunk_texts", F.transform(cited, lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text")))).drop("_chunks")


def cited_documents(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """question_id, documents: the documents that citations (question_id, place, document_id, document) name, in order of first place; fallback of questions (question_id, fallback) where they name none."""
    name = F.trim(F.coalesce(F.nullif(F.col("document_id"), F.lit("")), F.col("document"), F.lit("")))
    first = citations.withColumn("_d", name).where("_d <> ''").groupBy("question_id", "_d").agg(F.min("place").alias("place"))
    listed = first.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_d"))), lambda x: x["_d"]).alias("documents"))
    return questions.join(listed, "question_id", "left").select("question_id", F.coalesce("documents", "fallback").alias("documents"))


def package_text(contexts: DataFrame) -> DataFrame:
    """question_id, text: the contexts of each question as one text, numbered by rank.

    contexts (question_id, query, rank, document, priority, title, parent_key, full_reference, page_start, page_end,
    anchors, included, status, text); a package is bounded by the budget that chose its contexts.
    """
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    unit = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("parent_key"))
    fields = (
        ("Documento", F.col("document")), ("Tipo de fonte", F.col("priority")), ("Unidade", unit), ("Referência", F.coalesce(F.nullif(F.col("full_reference"), F.lit("")), unit)), ("Páginas", page_span("page_start", "page_end")),
        ("Chunks âncora", ids("anchors")), ("Chunks incluídos", ids("included")), ("Status", F.col("status")), ("Prioridade de conteúdo", F.col("priority")),
    )
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(""))) for name, value in fields]
    block = F.concat_ws("\n", F.concat(F.lit("[FONTE "), F.col("_n").cast("string"), F.lit("]")), *lines, F.lit(""), F.lit("Texto:"), F.coalesce("text", F.lit("")), F.lit(""))
    rows = contexts.withColumn("_n", n).withColumn("_block", block)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_block"))), lambda x: x["_block"])
    head = F.concat(F.lit(f"{PACKAGE_HEAD}\n\nPergunta: "), F.coalesce("query", F.lit("")), F.lit("\n\n"))
    made = rows.groupBy("question_id", "query").agg(listed.alias("_all"))
    return made.select("question_id", F.regexp_replace(F.concat(head, F.array_join("_all", "\n")), r"\A\s+|\s+\z", "").alias("text"))
