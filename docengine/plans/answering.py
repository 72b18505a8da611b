"""From a batch of questions to context packages and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.operators import consolidation as C
from docengine.operators import questions as Q
from docengine.operators import retrieval as R
from docengine.operators.lines import greedy_fit
from docengine.operators.retrieval import top


CUT = "\n\n[TRUNCADO POR LIMITE DE CONTEXTO]"


def expanded(chunks: DataFrame, hits: DataFrame, small_chars: int = 7000, most_chars: int = 9000) -> DataFrame:
    """question_id, chunk_id (the anchor), included: the anchor, then what of its parent fits beside it, in order: all of a small parent, else the neighbours."""
    small = C.small_parents(chunks, small_chars).where("is_small").select("parent_key")
    anchors = hits.select("question_id", "chunk_id").distinct().join(chunks.select("chunk_id", "parent_key"), "chunk_id")
    near = C.siblings(chunks, anchors.join(small, "parent_key", "left_anti").select("question_id", "chunk_id")).select("question_id", "anchor_id", "chunk_id")
    whole = anchors.join(small, "parent_key").select("question_id", F.col("chunk_id").alias("anchor_id"), "parent_key").join(chunks.select("parent_key", "chunk_id"), "parent_key")
    each = whole.select("question_id", "anchor_id", "chunk_id").unionByName(near).join(chunks.select("chunk_id", "position", F.length("text").cast("long").alias("size")), "chunk_id")
    order = F.struct(F.col("chunk_id") != F.col("anchor_id"), "position", "chunk_id", (F.coalesce("size", F.lit(0)) + 2).alias("size"))
    all_ = each.groupBy("question_id", F.col("anchor_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(order)).alias("_all"))
    fit = greedy_fit(F.transform("_all", lambda x: x["size"]), most_chars)
    return all_.select("question_id", "chunk_id", F.transform(fit, lambda i: F.element_at("_all", i)["chunk_id"]).alias("included"))


def packages(chunks: DataFrame, questions: DataFrame, candidates: int = 40, contexts: int = 4, most_chars: int = 18_000, unanswered: bool = False) -> DataFrame:
    """question_id, query, context_count, total_chars, priorities, statuses, context_text, has_source_map, parents.

    chunks (chunk_id, document_id, parent_key, position, chunk_type, document_type, text), questions (question_id, text).
    Retrieval, parent expansion, grouping, scoring, pruning, one context per
    document first, budget: all questions at once. A context is expanded if it
    holds more than its anchors; a first context over the budget is cut to it.
    With unanswered, questions without a hit have a row of no contexts.
    """
    hits = R.bm25(chunks, questions, candidates)
    info = chunks.select("chunk_id", "document_id", "parent_key", "chunk_type", "document_type", F.col("position").alias("page"))
    null = F.lit(None).cast("string")
    wide = expanded(chunks, hits)
    c = hits.join(info, "chunk_id").join(wide, ["question_id", "chunk_id"]).withColumn("priority", C.content_priority(F.col("chunk_type"), F.col("document_type"), null, null))
    c = c.withColumn("status", F.when(F.size("included") > 1, "expanded").otherwise("anchor_only"))
    asked = questions.select("question_id", F.col("text").alias("query"), Q.intent("text").alias("intent"))
    g = C.grouped(c).join(asked, "question_id")
    doctrinal, normative = F.col("intent").isin("doctrinal", "mixed"), F.col("intent").isin("normative", "mixed")
    g = g.withColumn("doctrinal_query", doctrinal).withColumn("ranking_score", C.ranking_score(F.col("best_score"), F.col("priority"), F.col("status"), doctrinal, normative))
    ranked = C.one_per_document(C.chunks_once(C.pruned(g)))
    # each chunk once, in the place that its first anchor gives it
    held = ranked.select("question_id", "parent_key", F.posexplode("chunk_ids").alias("_a", "chunk_id")).join(wide, ["question_id", "chunk_id"])
    held = held.select("question_id", "parent_key", "_a", F.posexplode("included").alias("_p", "chunk_id"))
    held = held.groupBy("question_id", "parent_key", "chunk_id").agg(F.min(F.struct("_a", "_p")).alias("_at")).join(chunks.select("chunk_id", "text"), "chunk_id")
    texts = held.groupBy("question_id", "parent_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), "\n\n").alias("context_text"))
    cut = F.concat(F.regexp_replace(F.substring("context_text", 1, max(0, most_chars - len(CUT))), r"\s+\z", ""), F.lit(CUT))
    best = ranked.join(texts, ["question_id", "parent_key"]).withColumn("context_text", F.when(F.length("context_text") > most_chars, cut).otherwise(F.col("context_text"))).withColumn("chars", F.length("context_text"))
    chosen = top(C.fitted(best, ["question_id"], "rank", "chars", most_chars), "question_id", [F.asc("rank")], contexts, "place")
    listed = F.array_sort(F.collect_list(F.struct("place", "parent_key", "priority", "status", "context_text", "chars")))
    p = chosen.groupBy("question_id", "query").agg(listed.alias("all"))
    each = lambda name: F.transform("all", lambda x: x[name])
    made = p.select(
        "question_id", "query", F.size("all").alias("context_count"), F.aggregate(each("chars"), F.lit(0), lambda a, x: a + x).alias("total_chars"), each("priority").alias("priorities"), each("status").alias("statuses"),
        F.concat_ws(" ", each("context_text")).alias("context_text"), F.lit(True).alias("has_source_map"), each("parent_key").alias("parents"),
    )
    if not unanswered:
        return made
    empty = F.array().cast("array<string>")
    rest = questions.join(made, "question_id", "left_anti").select(
        "question_id", F.col("text").alias("query"), F.lit(0).alias("context_count"), F.lit(0).alias("total_chars"), empty.alias("priorities"), empty.alias("statuses"),
        F.lit("").alias("context_text"), F.lit(False).alias("has_source_map"), F.array().cast(made.schema["parents"].dataType).alias("parents"),
    )
    return made.unionByName(rest)


def decisions(chunks: DataFrame, questions: DataFrame, **options) -> DataFrame:
    """Packages with can_answer and reason."""
    return Q.evidence(packages(chunks, questions, **options))
