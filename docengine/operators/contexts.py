"""Contexts of retrieved chunks: which chunks of the parent, the section or the chapter stand beside an anchor, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import fold_ascii, page_span
from docengine.operators.lines import greedy_fit
from docengine.operators.questions import is_overview

#: Questions for the items of one unit (fixed patterns).
LIST_QUESTIONS = (
    r"\b(?:quais|liste|listar|relacione|enumere|descreva|informe)\b.*\b(?:requisitos|documentos|documentacao|exigencias|criterios|itens)\b",
    r"\b(?:requisitos|documentos|documentacao|exigencias|criterios|itens)\b.*\b(?:ingresso|filiacao|admissao|candidata|candidato|apresentar)\b",
)


def asks_for_items(question: Column | str) -> Column:
    folded = F.trim(F.regexp_replace(fold_ascii(question), r"\s+", " "))
    return folded.rlike(LIST_QUESTIONS[0]) | folded.rlike(LIST_QUESTIONS[1])


def is_weak(parent_key: Column | str) -> Column:
    """Whether a parent key says no more than the type or the chunk itself."""
    key = F.col(parent_key) if isinstance(parent_key, str) else parent_key
    return key.contains("::chunk-type::") | key.contains("::chunk::")


def chunk_block(anchor: Column) -> Column:
    """A chunk as it is shown: label, id, reference, pages and text. Columns chunk_id, reference, page_start, page_end, text."""
    id_ = F.col("chunk_id").cast("string")
    label = F.when(anchor, "Chunk âncora").otherwise(F.concat(F.lit("Contexto relacionado: "), id_))
    lines = [F.concat(F.lit("--- "), label, F.lit(" ---")), F.concat(F.lit("Chunk: "), id_), F.concat(F.lit("Referência: "), F.coalesce("reference", F.lit("não informado"))), F.concat(F.lit("Páginas: "), page_span("page_start", "page_end"))]
    return F.regexp_replace(F.concat_ws("\n", *lines, F.lit(""), F.coalesce("text", F.lit(""))), r"\s+\z", "")


def selected(chunks: DataFrame, anchors: DataFrame, small_chars: int = 7000, before: int = 1, after: int = 1) -> DataFrame:
    """question_id, anchor_id, chunk_id, strategy, status, reason: the chunks that each anchor (question_id, chunk_id, query) is shown with.

    chunks (chunk_id, document_id, parent_key, position, section_title, chapter_reference, is_item, reference, page_start, page_end, text).
    The first that holds: a weak parent key leaves the anchor alone; a question
    for items takes the whole unit if it has items; an overview takes the section, else the chapter, if it has more than one chunk; a
    parent of up to small_chars is taken whole; else the neighbours. Every
    group is joined by its key; none is collected.
    """
    base = chunks.withColumn("_size", F.length(chunk_block(F.lit(False))))
    parents = base.groupBy("parent_key").agg(F.count("*").alias("_n"), F.sum("_size").alias("_chars"), F.max(F.coalesce("is_item", F.lit(False))).alias("_items"))
    sections = base.where("section_title is not null").groupBy("document_id", "section_title").agg(F.count("*").alias("_in_section"))
    chapters = base.where("chapter_reference is not null").groupBy("document_id", "chapter_reference").agg(F.count("*").alias("_in_chapter"))
    placed = base.withColumn("_place", F.row_number().over(Window.partitionBy("parent_key").orderBy("position", "chunk_id"))).select("chunk_id", "document_id", "parent_key", "section_title", "chapter_reference", "_place")
    a = anchors.select("question_id", F.col("chunk_id"), "query").join(placed, "chunk_id").join(parents, "parent_key").join(sections, ["document_id", "section_title"], "left").join(chapters, ["document_id", "chapter_reference"], "left")
    overview = is_overview("query")
    how = (
        F.when(is_weak("parent_key"), "alone").when(asks_for_items("query") & (F.col("_n") > 1) & F.col("_items"), "unit").when(overview & (F.coalesce("_in_section", F.lit(0)) > 1), "section")
        .when(overview & (F.coalesce("_in_chapter", F.lit(0)) > 1), "chapter").when(F.col("_chars") <= small_chars, "parent").otherwise("neighbours")
    )
    a = a.withColumn("_how", how).withColumnRenamed("chunk_id", "anchor_id")
    kept = ["question_id", "anchor_id", "_how"]
    other = placed.select(F.col("chunk_id").alias("_c"), F.col("document_id").alias("_d"), F.col("parent_key").alias("_k"), F.col("section_title").alias("_s"), F.col("chapter_reference").alias("_h"), F.col("_place").alias("_p"))
    near = F.col("_how").isin("unit", "parent") | F.col("_p").between(F.col("_place") - before, F.col("_place") + after)
    same = a.where("_how in ('unit', 'parent', 'neighbours')").join(other, F.col("parent_key") == F.col("_k")).where(near).select(*kept, F.col("_c").alias("chunk_id"))
    by_section = a.where("_how = 'section'").join(other, (F.col("document_id") == F.col("_d")) & (F.col("section_title") == F.col("_s"))).select(*kept, F.col("_c").alias("chunk_id"))
    by_chapter = a.where("_how = 'chapter'").join(other, (F.col("document_id") == F.col("_d")) & (F.col("chapter_reference") == F.col("_h"))).select(*kept, F.col("_c").alias("chunk_id"))
    alone = a.where("_how = 'alone'").select(*kept, F.col("anchor_id").alias("chunk_id"))
    strategy = F.when(F.col("_how") == "unit", "normative_unit_list").when(F.col("_how").isin("section", "chapter"), "overview_parent").otherwise("default_parent")
    reason = F.when(F.col("_how") == "alone", "insufficient_parent_metadata").when(F.col("_how") == "unit", "normative_unit_list_query").when(F.col("_how").isin("section", "chapter"), "overview_query_structural_group")
    each = same.unionByName(by_section).unionByName(by_chapter).unionByName(alone)
    return each.select("question_id", "anchor_id", "chunk_id", "_how", strategy.alias("strategy"), reason.alias("reason"))


def built(chunks: DataFrame, anchors: DataFrame, most_chars: int = 9000, **options) -> DataFrame:
    """question_id, anchor_id, strategy, status, reason, included, page_start, page_end, context_text: the context of each anchor.

    The anchor comes first, then the others in order of position; what does
    not fit into most_chars is skipped, the anchor never. An anchor that
    chunks do not hold has a row of status missing_anchor and no text. A context is bounded by its limit
    once fitted; before, it holds the sizes of one group of chunks.
    """
    rows = selected(chunks, anchors, **options).join(chunks.select("chunk_id", "position", "reference", "page_start", "page_end", "text"), "chunk_id")
    is_anchor = F.col("chunk_id") == F.col("anchor_id")
    rows = rows.withColumn("_block", chunk_block(is_anchor)).withColumn("_first", (~is_anchor).cast("int"))
    order = F.array_sort(F.collect_list(F.struct("_first", "position", "chunk_id", (F.length("_block") + 2).alias("size"))))
    listed = rows.groupBy("question_id", "anchor_id", "strategy", "reason", "_how").agg(order.alias("_all"))
    fit = greedy_fit(F.transform("_all", lambda x: x["size"].cast("long")), most_chars)
    places = listed.select("question_id", "anchor_id", "strategy", "reason", "_how", F.size("_all").alias("_n"), F.transform(fit, lambda i: F.element_at("_all", i)["chunk_id"]).alias("included"))
    status = F.when(F.col("_how").isin("section", "chapter"), "overview_expanded").when((F.col("_how") == "alone") | ((F.col("_how") == "neighbours") & (F.col("_n") == 1)), "anchor_only").otherwise("expanded")
    texts = places.select("question_id", "anchor_id", F.posexplode("included").alias("_at", "chunk_id")).join(rows.select("question_id", "anchor_id", "chunk_id", "_block", "page_start", "page_end"), ["question_id", "anchor_id", "chunk_id"])
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_block"))), lambda x: x["_block"]), "\n\n")
    texts = texts.groupBy("question_id", "anchor_id").agg(shown.alias("context_text"), F.min("page_start").alias("page_start"), F.max(F.coalesce("page_end", "page_start")).alias("page_end"))
    made = places.join(texts, ["question_id", "anchor_id"]).select("question_id", "anchor_id", "strategy", status.alias("status"), "reason", "included", "page_start", "page_end", "context_text")
    lost = anchors.select("question_id", F.col("chunk_id").alias("anchor_id")).join(chunks.select(F.col("chunk_id").alias("anchor_id")), "anchor_id", "left_anti")
    none = lambda c: F.lit(None).cast(made.schema[c].dataType).alias(c)
    lost = lost.select("question_id", "anchor_id", F.lit("default_parent").alias("strategy"), F.lit("missing_anchor").alias("status"), F.lit("anchor_chunk_not_found").alias("reason"), none("included"), none("page_start"), none("page_end"), F.lit("").alias("context_text"))
    return made.unionByName(lost)
