"""The whole way of a batch of questions: scope, hybrid retrieval under filters, reranking, contexts, consolidation, diversity, budget, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.functions import vocab
from docengine.operators import consolidation as C
from docengine.operators import contexts as X
from docengine.operators import orchestration as O
from docengine.operators import questions as Q
from docengine.operators import retrieval as R
from docengine.sources.shared import written


def hybrid(chunks: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, filters: tuple[str, ...] = (), candidates: int = 20, k: int = 20) -> DataFrame:
    """question_id, chunk_id, score, sources, rank: words and vectors fused, both under the filters of each question; by words alone without vectors.

    vectors (chunk_id, vector), question_vectors (question_id, vector); filters name columns of chunks and of questions.
    """
    lists = [("bm25", R.bm25(chunks.select("chunk_id", "text", *filters), questions.select("question_id", "text", *filters), candidates, filters))]
    if vectors is not None and question_vectors is not None:
        held = vectors.join(chunks.select("chunk_id", *filters), "chunk_id") if filters else vectors
        asked = question_vectors.join(questions.select("question_id", *filters), "question_id") if filters else question_vectors
        lists.insert(0, ("vector", R.dense(held, asked, candidates, filters=filters)))
    return R.fuse(lists, k=k)


def reranked(found: DataFrame, chunks: DataFrame, questions: DataFrame, score: Column | None = None, k: int = 5, enabled: bool = True) -> DataFrame:
    """The k best of found (question_id, chunk_id, rank) by a score over the columns question and text, with rerank_status; disabled, the first k as they are, marked so."""
    if not enabled:
        kept = found.where(F.col("rank") <= k)
        return kept.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("pre_rerank_rank", F.col("rank")).withColumn("rerank_status", F.lit("skipped_disabled"))
    rows = found.join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("question_id", F.col("text").alias("question")), "question_id")
    return R.rerank(rows, R.overlap_score(F.col("question"), F.col("text")) if score is None else score, k).drop("text", "question").withColumn("rerank_status", F.lit("reranked"))


def hierarchical(chunks: DataFrame, questions: DataFrame, hits: DataFrame, most_chars: int = 9000, **options) -> DataFrame:
    """The context of each hit (question_id, chunk_id, rank ...) with the hit's own columns: what its parent, section or chapter adds."""
    asked = questions.select("question_id", F.col("text").alias("query"))
    built = X.built(chunks, hits.select("question_id", "chunk_id").join(asked, "question_id"), most_chars, **options)
    return built.join(hits.withColumnRenamed("chunk_id", "anchor_id"), ["question_id", "anchor_id"])


def scoped_questions(questions: DataFrame, aliases=vocab.DOCUMENT_ALIASES, given: str | None = None) -> DataFrame:
    """Questions with document_id, what they are restricted to: the filter that they were given (a column), else the one document that they name; null for none; and document_filter, whether it was given."""
    scope = Q.document_scope(questions.select("question_id", "text"), aliases).select("question_id", "scope_document")
    own = F.lit(None).cast("string") if given is None else F.col(given)
    return questions.join(scope, "question_id", "left").withColumn("document_filter", own.isNotNull()).withColumn("document_id", F.coalesce(own, "scope_document"))


def answer_packages(
    chunks: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, aliases=vocab.DOCUMENT_ALIASES, given: str | None = None, candidates: int = 20, anchors: int = 8,
    contexts: int = 4, most_chars: int = 18_000, context_chars: int = 9000, rerank: bool = True, **options,
) -> DataFrame:
    """One row for each question: query, scope_document, attempt, context_count, total_chars, priorities, statuses, parents, context_text, sources, has_source_map, and the decision can_answer and reason.

    chunks (chunk_id, document_id, parent_key, position, chunk_type, document_type, section_title, chapter_reference, is_item, reference, page_start, page_end, text), questions (question_id, text).

    1. A question that names one document looks only there; where that finds
       nothing, a second attempt looks everywhere.
    2. Words and vectors are fused under that filter and reranked; the best anchors get their contexts.
    3. Contexts of one parent are one, the best anchor's text; introductory and lone anchors give way, a chunk stays in one context.
    4. Diversity of topics and documents decides the order, then the number and the budget.
    5. The evidence policy decides on what is left. Questions without contexts have a row with none.

    Every step is a join or a window by question; what is held for a question is bounded by candidates, anchors and the budget. Questions in scope, hits
    and contexts are written out once: later steps read them several times.
    """
    asked = written(scoped_questions(questions, aliases, given), "asked")
    find = lambda q, attempt: written(hybrid(chunks, q, vectors, question_vectors, ("document_id",), candidates).withColumn("attempt", F.lit(attempt)), "found")
    found = find(asked, 1)
    missed = asked.where("document_id is not null").join(found.select("question_id").distinct(), "question_id", "left_anti").withColumn("document_id", F.lit(None).cast("string"))
    if not missed.isEmpty():
        found = found.unionByName(find(missed, 2))
    hits = written(reranked(found, chunks, questions, k=anchors, enabled=rerank), "hits")
    info = chunks.select("chunk_id", "document_id", "parent_key", "chunk_type", "document_type", F.col("page_start").alias("page"))
    made = hierarchical(chunks, questions, hits, context_chars, **options).withColumnRenamed("anchor_id", "chunk_id").join(info, "chunk_id")
    null = F.lit(None).cast("string")
    made = made.withColumn("priority", C.content_priority(F.col("chunk_type"), F.col("document_type"), null, null)).withColumn("status", F.when(F.col("status").contains("expanded"), "expanded").otherwise(F.col("status")))
    made = written(made, "contexts")
    wanted = asked.select("question_id", F.col("text").alias("query"), "scope_document", "document_filter", Q.intent("text").alias("_intent"), Q.is_overview("text").alias("overview_query"), Q.names_document("text").alias("specific_document"), T.topic_terms("text").alias("_terms"))
    groups = C.grouped(made).join(wanted, "question_id")
    doctrinal, normative = F.col("_intent").isin("doctrinal", "mixed"), F.col("_intent").isin("normative", "mixed")
    groups = groups.withColumn("doctrinal_query", doctrinal).withColumn("ranking_score", C.ranking_score(F.col("best_score"), F.col("priority"), F.col("status"), doctrinal, normative))
    ranked = C.chunks_once(C.pruned(groups))
    best = made.select("question_id", F.col("chunk_id").alias("_anchor"), "context_text", "strategy", "attempt", F.col("page").alias("_page"))
    ranked = ranked.withColumn("_anchor", F.col("chunk_ids")[0]).join(best, ["question_id", "_anchor"])
    score = F.size(F.array_intersect("_terms", T.topic_terms("context_text"))).cast("long")
    ranked = ranked.withColumn("topic_score", F.when(score >= 3, score).otherwise(0)).withColumn("is_overview", F.col("strategy") == "overview_parent")
    ordered = C.diversified(ranked, contexts).withColumnRenamed("context_text", "text")
    fitted = R.top(C.budgeted(ordered, most_chars), "question_id", [F.asc("rank")], contexts, "place")
    listed = F.array_sort(F.collect_list(F.struct("place", "parent_key", "document_id", "priority", "status", "text", F.col("_page").alias("page"), "attempt")))
    rows = fitted.groupBy("question_id").agg(listed.alias("_all"))
    each = lambda c: F.transform("_all", lambda x: x[c])
    source = F.transform("_all", lambda x: F.concat(F.lit("["), x["place"].cast("string"), F.lit("] "), x["document_id"], F.lit(", p. "), F.coalesce(x["page"].cast("string"), F.lit("não informado")), F.lit(".")))
    rows = rows.select(
        "question_id", F.col("_all")[0]["attempt"].alias("attempt"), F.size("_all").alias("context_count"), F.aggregate(F.transform("_all", lambda x: F.length(x["text"])), F.lit(0), lambda a, x: a + x).alias("total_chars"), each("priority").alias("priorities"), each("status").alias("statuses"),
        each("parent_key").alias("parents"), F.array_join(each("text"), "\n\n").alias("context_text"), source.alias("sources"),
    )
    empty = F.array().cast("array<string>")
    out = wanted.select("question_id", "query", "scope_document").join(rows, "question_id", "left").na.fill(0, ["context_count", "total_chars", "attempt"]).na.fill("", ["context_text"])
    out = out.withColumns({c: F.coalesce(F.col(c).cast("array<string>"), empty) for c in ("priorities", "statuses", "parents", "sources")}).withColumn("has_source_map", F.size("sources") > 0)
    return Q.evidence(out)
