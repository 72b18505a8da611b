"""Parents, grouping, scoring, pruning, diversity and budget of contexts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import vocab
from docengine.functions.text import truncated


def siblings(chunks: DataFrame, anchors: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """question_id, anchor_id, chunk_id: each anchor with its neighbours in the order of its parent group.

    chunks (chunk_id, parent_key, position), anchors (question_id, chunk_id).
    """
    placed = chunks.withColumn("_place", F.row_number().over(Window.partitionBy("parent_key").orderBy("position", "chunk_id")))
    found = anchors.join(placed, "chunk_id").select("question_id", F.col("chunk_id").alias("anchor_id"), "parent_key", F.explode(F.sequence(F.col("_place") - before, F.col("_place") + after)).alias("_place"))
    return found.join(placed.select("parent_key", "_place", "chunk_id"), ["parent_key", "_place"]).select("question_id", "anchor_id", "parent_key", "chunk_id")


def small_parents(chunks: DataFrame, most: int = 7000) -> DataFrame:
    """parent_key, n_chunks, total_chars, is_small: whether a whole group fits."""
    out = chunks.groupBy("parent_key").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("total_chars"))
    return out.withColumn("is_small", F.col("total_chars") <= most)


def fitted(rows: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Rows of each group that fit into limit, in order (ties by the other columns), what does not fit being skipped; the first always fits.

    What fits depends on what was taken before, so a group is read in one task,
    sorted, with nothing but its running total held. A null size counts as 0.
    """
    columns = rows.columns
    places, at = [columns.index(k) for k in keys], columns.index(size)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, 0
        for batch in batches:
            kept = []
            for key, n in zip(zip(*[batch.column(i).to_pylist() for i in places], strict=True), batch.column(at).to_pylist(), strict=True):
                first = key != group
                group, total = key, 0 if first else total
                kept.append(first or total + (n or 0) <= limit)
                total += (n or 0) if kept[-1] else 0
            yield batch.filter(pa.array(kept, pa.bool_()))

    rest = [c for c in columns if c not in (*keys, order)]
    return rows.repartition(*keys).sortWithinPartitions(*keys, order, *rest).mapInArrow(fit, rows.schema)


def content_priority(chunk_type: Column, document_type: Column, source_category: Column, content_role: Column) -> Column:
    doctrinal = chunk_type.isin(*vocab.DOCTRINAL_CHUNK_TYPES) | document_type.isin(*vocab.DOCTRINAL_DOCUMENT_TYPES) | (source_category == "doctrinal_document") | (content_role == "doctrinal")
    normative = document_type.isin(*vocab.NORMATIVE_DOCUMENT_TYPES) | (source_category == "denominational_normative_document") | (content_role == "normative")
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.when(no(doctrinal), "doctrinal").when(no(normative), "normative").when(no(chunk_type.isin(*vocab.INTRODUCTORY_CHUNK_TYPES)), "introductory").otherwise("contextual")


def ranking_score(best: Column, priority: Column, status: Column, doctrinal: Column, normative: Column) -> Column:
    """A group's best score with the weights of its status, its priority and the question's intent."""
    plus = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    return (
        F.coalesce(best, F.lit(0.0)) + plus(status.contains("expanded"), 0.75) + plus(priority == "doctrinal", 0.5) + plus(priority == "normative", 0.45)
        + plus(normative & (priority == "normative"), 0.7) + plus(doctrinal & (priority == "doctrinal"), 0.7) - plus(doctrinal & (priority == "introductory"), 2.0) - plus(status.startswith("anchor_only"), 0.5)
    )


def grouped(contexts: DataFrame) -> DataFrame:
    """One row for each question and parent: best score, status, priority, ids in order of score, and pages.

    contexts (question_id, parent_key, document_id, chunk_id, score, status, priority, page).
    """
    rank = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), F.col("chunk_id").alias("c"))
    of = {p: i for i, p in enumerate(("doctrinal", "normative", "introductory", "contextual"))}
    order = F.create_map(*[F.lit(x) for p in of.items() for x in p])
    return contexts.groupBy("question_id", "parent_key").agg(
        F.max("score").alias("best_score"),
        F.min_by("document_id", rank).alias("document_id"),
        F.element_at(F.array(*map(F.lit, of)), F.min(order[F.col("priority")]) + 1).alias("priority"),
        F.when(F.bool_or(F.col("status").contains("expanded")), "expanded").otherwise("anchor_only").alias("status"),
        F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["c"]).alias("chunk_ids"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
    )


def pruned(groups: DataFrame) -> DataFrame:
    """Without introductory anchors where a doctrinal question has an expanded doctrinal context; other lone anchors lose 1.0 beside expanded ones. Adds rank."""
    q = Window.partitionBy("question_id")
    has = F.bool_or((F.col("priority") == "doctrinal") & (F.col("status") == "expanded")).over(q)
    kept = groups.withColumn("_has", has).where(~(F.col("doctrinal_query") & F.col("_has") & (F.col("priority") == "introductory") & (F.col("status") == "anchor_only")))
    other = F.bool_or(F.col("status") == "expanded").over(q)
    kept = kept.withColumn("ranking_score", F.round(F.col("ranking_score") - F.when((F.col("status") == "anchor_only") & other, 1.0).otherwise(0.0), 6))
    return kept.withColumn("rank", F.row_number().over(q.orderBy(F.desc("ranking_score"), "parent_key"))).drop("_has")


def chunks_once(ranked: DataFrame) -> DataFrame:
    """Each chunk only in its question's best context; a context left empty keeps its chunks."""
    each = ranked.select("question_id", "parent_key", "rank", F.posexplode("chunk_ids").alias("_p", "_c"))
    mine = each.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "_c").orderBy("rank", "_p"))).where("_n = 1")
    left = mine.groupBy("question_id", "parent_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_c"))), lambda x: x["_c"]).alias("_left"))
    return ranked.join(left, ["question_id", "parent_key"], "left").withColumn("chunk_ids", F.coalesce("_left", "chunk_ids")).drop("_left")


def one_per_document(ranked: DataFrame) -> DataFrame:
    """First the best context of each document that is not too far below the best of all, then the others. Renews rank."""
    q = Window.partitionBy("question_id")
    best = F.max("ranking_score").over(q)
    floor = F.when(best <= 0, best - 1.0).otherwise(best - F.greatest(F.lit(1.5), F.abs(best) * 0.35))
    first = F.row_number().over(Window.partitionBy("question_id", "document_id").orderBy("rank")) == 1
    marked = ranked.withColumn("promoted", first & (F.col("ranking_score") >= floor))
    return marked.withColumn("rank", F.row_number().over(q.orderBy(F.desc("promoted"), F.asc("rank"))))


def diversified(ranked: DataFrame, k: int = 4) -> DataFrame:
    """Adds reason and renews rank: which contexts of each question come first.

    ranked (question_id, parent_key, document_id, rank, ranking_score, topic_score, document_filter, specific_document, overview_query, is_overview).
    The first that holds: a single context stays; a question with a document filter puts its k best topic
    matches first; one that names a document stays; an overview puts the contexts of the first overview's document first;
    topic matches in several documents put the best match of each first, up to k; matches in one document all come
    first. Promoted contexts are in order of topic score and score (of different documents by score alone), the others as they were.
    """
    q = Window.partitionBy("question_id")
    match = F.col("topic_score") > 0
    lead = F.min_by("document_id", F.when(F.col("is_overview"), F.col("rank"))).over(q)
    rows = ranked.withColumn("_n", F.count("*").over(q)).withColumn("_matched", F.size(F.collect_set(F.when(match, F.col("document_id"))).over(q))).withColumn("_lead", lead).withColumn("_documents", F.size(F.collect_set("document_id").over(q)))
    rows = rows.withColumn("_of_lead", F.count_if(F.col("document_id") == F.col("_lead")).over(q))
    why = (
        F.when(F.col("_n") <= 1, "disabled_or_single_candidate").when(F.col("document_filter") & (F.col("_matched") > 0), "intradocument_topic_contexts_promoted").when(F.col("document_filter"), "document_filter_present")
        .when(F.col("specific_document"), "specific_document_mentioned").when(F.col("overview_query") & (F.col("_of_lead") > 1), "overview_same_document_contexts_promoted")
        .when(F.col("_matched") >= 2, "topic_matched_one_context_per_document_promoted").when(F.col("_documents") <= 1, "single_document_available").otherwise("no_relevant_alternative_document")
    )
    rows = rows.withColumn("reason", why)
    best = [F.desc("topic_score"), F.desc("ranking_score"), F.asc("rank")]
    inside = F.row_number().over(Window.partitionBy("question_id", match).orderBy(*best)) <= k
    first = match & (F.row_number().over(Window.partitionBy("question_id", "document_id", match).orderBy("rank")) == 1)
    rows = rows.withColumn("_inside", match & inside).withColumn("_first", first)
    rows = rows.withColumn("_first", F.col("_first") & (F.row_number().over(Window.partitionBy("question_id", "_first").orderBy(F.desc("ranking_score"), "rank")) <= k))
    several = F.col("reason") == "topic_matched_one_context_per_document_promoted"
    promoted = (
        F.when(F.col("reason") == "intradocument_topic_contexts_promoted", F.col("_inside")).when(F.col("reason") == "overview_same_document_contexts_promoted", F.col("document_id") == F.col("_lead")).when(several, F.col("_first"))
        .when(F.col("reason").isin("single_document_available", "no_relevant_alternative_document"), match).otherwise(False)
    )
    rows = rows.withColumn("promoted", promoted)
    moved = F.col("promoted") & (F.col("reason") != "overview_same_document_contexts_promoted")
    order = q.orderBy(F.desc("promoted"), F.desc(F.when(moved & ~several, F.col("topic_score"))), F.desc(F.when(moved, F.col("ranking_score"))), F.asc("rank"))
    return rows.withColumn("rank", F.row_number().over(order)).drop("_n", "_matched", "_lead", "_documents", "_of_lead", "_inside", "_first")


def preferred_scope(ranked: DataFrame, scoped: Column) -> DataFrame:
    """Without the doctrinal contexts outside a scope where a question has contexts inside it; ranks anew."""
    q = Window.partitionBy("question_id")
    inside = F.coalesce(scoped, F.lit(False))
    marked = ranked.withColumn("_in", inside).withColumn("_any", F.bool_or(inside).over(q))
    kept = marked.where(~(F.col("_any") & ~F.col("_in") & (F.col("priority") == "doctrinal")))
    return kept.withColumn("rank", F.row_number().over(q.orderBy("rank"))).drop("_in", "_any")


def budgeted(contexts: DataFrame, total: int) -> DataFrame:
    """Contexts (question_id, rank, text) that fit into total characters in order of rank, what does not fit being skipped; the first is cut to it with a mark."""
    first = F.row_number().over(Window.partitionBy("question_id").orderBy("rank")) == 1
    cut = contexts.withColumn("_first", first).withColumn("text", F.when(F.col("_first"), truncated("text", total)).otherwise(F.col("text"))).drop("_first")
    return fitted(cut.withColumn("_size", F.length("text")), ["question_id"], "rank", "_size", total).drop("_size")
