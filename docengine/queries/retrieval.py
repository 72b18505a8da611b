"""Queries over lexical, dense and fused retrieval, and consolidation of what it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import consolidation as C
from docengine.operators import retrieval as R
from docengine.queries.common import documents, table
from docengine.queries.chunks import _P, _parents


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _asked(v: DataFrame) -> DataFrame:
    return v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question_id"), "vector")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each benchmark text."""
    return R.bm25(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), _benchmark(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among German chunks, whose statistics count."""
    return R.bm25(documents(spark, sf_dir).where("lang = 'de'").select(F.col("doc_id").alias("chunk_id"), "text"), _benchmark(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each hundredth one."""
    v = _vectors(spark, sf_dir)
    return R.dense(v, _asked(v)).withColumn("rank", F.col("rank").cast("long"))


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return R.dense(v, _asked(v), where=F.col("label") % 2 == 0).withColumn("rank", F.col("rank").cast("long"))


def bm25_per_question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each benchmark text among those of the language and the source that it asks for; some ask for one of them or for nothing."""
    i = F.col("question_id")
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es", None))), (i % 5 + 1).cast("int"))
    q = _benchmark(spark, sf_dir).withColumn("given", F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array(lang, F.when(i % 3 == 0, F.concat(F.lit("src"), (i % 4).cast("string"))))))
    q = R.filter_columns(q.withColumn("given", R.merged_filters(F.col("given"), {})), "given", ("lang", "source"))
    found = R.bm25(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source"), q, filters=("lang", "source"))
    return found.withColumn("rank", F.col("rank").cast("long"))


def dense_per_question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each hundredth one among those of its own label, for every fourth of them among all."""
    v = _vectors(spark, sf_dir)
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question_id"), "vector", F.when(F.col("chunk_id") % 400 != 0, F.col("label")).alias("label"))
    return R.dense(v, q, filters=("label",)).withColumn("rank", F.col("rank").cast("long"))


def _hybrid(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Each benchmark text as a question: chunks by its words and by the vector of its number, fused."""
    v, q = _vectors(spark, sf_dir), _benchmark(spark, sf_dir)
    words = R.bm25(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), q, 20)
    near = R.dense(v, v.join(F.broadcast(q.select("question_id")), F.col("chunk_id") == F.col("question_id")).select("question_id", "vector"), 20)
    return R.fuse([("vector", near), ("bm25", words)], k=k)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused candidates by the part of the question's words that their texts hold."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    q = _benchmark(spark, sf_dir).withColumnRenamed("text", "question")
    c = _hybrid(spark, sf_dir).join(d, "chunk_id").join(q, "question_id")
    return R.rerank(c, R.overlap_score(F.col("question"), F.col("text"))).select("question_id", "chunk_id", "rerank_score", F.col("pre_rerank_rank").cast("long").alias("pre_rerank_rank"), F.col("rank").cast("long").alias("rank"))


def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_changes(rerank_topk(spark, sf_dir))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best chunks of each benchmark text as contexts, with status and priority."""
    hits = R.bm25(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), _benchmark(spark, sf_dir), 20)
    p = _parents(spark, sf_dir).select("chunk_id", "parent_key", "document_id", "chunk_type", "document_type", F.col("position").alias("page"), F.length("text").alias("n_chars"))
    c = hits.join(p, "chunk_id")
    null = F.lit(None).cast("string")
    return c.withColumn("priority", C.content_priority(F.col("chunk_type"), F.col("document_type"), null, null)).withColumn("status", F.when(F.col("chunk_id") % 3 == 0, "anchor_only").otherwise("expanded"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.grouped(_contexts(spark, sf_dir)).withColumn("doctrinal_query", F.col("question_id") % 2 == 0)
    score = C.ranking_score(F.col("best_score"), F.col("priority"), F.col("status"), F.col("doctrinal_query"), ~F.col("doctrinal_query"))
    return g.withColumn("ranking_score", F.round(score, 6))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ","))


def group_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(_groups(spark, sf_dir)).select("question_id", "parent_key", "document_id", "priority", "status", "chunk_ids", "page_start", "page_end", "ranking_score")


def drop_intro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pruned(_groups(spark, sf_dir)).select("question_id", "parent_key", "ranking_score", F.col("rank").cast("long").alias("rank"))


def one_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.one_per_document(C.pruned(_groups(spark, sf_dir))).select("question_id", "parent_key", "promoted", F.col("rank").cast("long").alias("rank"))


def cross_context_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each context also lists the chunk before its best one; each chunk stays in one context."""
    r = C.pruned(_groups(spark, sf_dir)).withColumn("chunk_ids", F.array_union("chunk_ids", F.array(F.col("page_start") - F.col("page_start") % 50)))
    return _listed(C.chunks_once(r)).select("question_id", "parent_key", "chunk_ids")


_FNS = (bm25_topk, bm25_topk_filtered, bm25_per_question_filter, dense_topk, dense_topk_filtered, dense_per_question_filter, rrf_hybrid, rerank_topk, rank_changes, group_by_parent, drop_intro, one_per_document, cross_context_dedupe)
QUERIES = {f.__name__: f for f in _FNS}


def _bm25_sql(docs: str, asked: str, k: int, p: str = "") -> str:
    """Common table expressions that end in {p}bm25 (question_id, chunk_id, score, rank)."""
    return rf"""
      {p}d AS ({docs}), {p}q AS ({asked}),
      {p}w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM {p}d),
      {p}tot AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {p}w),
      {p}tf AS (SELECT doc_id, len(w) AS len, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM {p}w) GROUP BY doc_id, len, term),
      {p}df AS (SELECT term, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf, any_value(mean) AS mean FROM {p}tf, {p}tot GROUP BY term),
      {p}idf AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM {p}df) ELSE idf END AS idf, mean FROM {p}df),
      {p}qt AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM {p}q) GROUP BY ALL),
      {p}s AS (SELECT question_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM {p}qt JOIN {p}idf USING (term) JOIN {p}tf USING (term) GROUP BY ALL),
      {p}bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM {p}s) WHERE rank <= {k})"""


def _dense_sql(k: int, where: str = "true", asked: str = "q.vec_id % 100 = 0") -> str:
    return f"""dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM (
        SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round(list_cosine_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings v WHERE {asked} AND {where})) WHERE rank <= {k})"""


_ALL_DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_GERMAN = _ALL_DOCS + " WHERE lang = 'de'"
_BENCH = "SELECT item_id AS question_id, text FROM benchmark"
_HYBRID = f"""{_bm25_sql(_ALL_DOCS, _BENCH, 20)}, {_dense_sql(20, asked="q.vec_id IN (SELECT item_id FROM benchmark)")},
    u AS (SELECT question_id, chunk_id, rank, 0 AS l, 'vector' AS name FROM dense UNION ALL SELECT question_id, chunk_id, rank, 1, 'bm25' FROM bm25),
    f AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min(l * 1000 + rank) AS seen, string_agg(name, ',' ORDER BY name) AS sources FROM u GROUP BY question_id, chunk_id),
    hybrid AS (SELECT * EXCLUDE (seen) FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen, chunk_id) AS rank FROM f) WHERE rank <= 10)"""
_RERANK = rf"""{_HYBRID}, words AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM ({_ALL_DOCS})), asked AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS a FROM benchmark),
    sc AS (SELECT h.question_id, h.chunk_id, h.rank AS pre_rerank_rank, round(CASE WHEN len(q.a) > 0 THEN len(list_intersect(q.a, c.w)) / len(q.a)::DOUBLE ELSE 0 END, 6) AS rerank_score FROM hybrid h JOIN asked q ON q.item_id = h.question_id JOIN words c ON c.doc_id = h.chunk_id),
    rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, pre_rerank_rank) AS rank FROM sc) WHERE rank <= 5)"""
_GROUPS = f"""{_bm25_sql(_ALL_DOCS, _BENCH, 20)}, {_P},
    x AS (SELECT b.*, p.parent_key, p.document_id, p.position AS page,
      CASE WHEN chunk_type IN ('doctrinal_article', 'confession_paragraph') OR document_type IN ('confession_of_faith', 'catechism', 'doctrinal_canons') THEN 0 WHEN document_type = 'constitution' THEN 1 WHEN chunk_type IN ('preface', 'summary', 'special_layout') THEN 2 ELSE 3 END AS pr,
      CASE WHEN b.chunk_id % 3 = 0 THEN 'anchor_only' ELSE 'expanded' END AS status FROM bm25 b JOIN p USING (chunk_id)),
    g0 AS (SELECT question_id, parent_key, max(score) AS best, first(document_id ORDER BY score DESC, chunk_id) AS document_id, ['doctrinal', 'normative', 'introductory', 'contextual'][min(pr) + 1] AS priority,
      CASE WHEN bool_or(status = 'expanded') THEN 'expanded' ELSE 'anchor_only' END AS status, list(chunk_id ORDER BY score DESC, chunk_id) AS ids, min(page) AS page_start, max(page) AS page_end, question_id % 2 = 0 AS dq FROM x GROUP BY question_id, parent_key),
    g AS (SELECT *, round(best + CASE WHEN status = 'expanded' THEN 0.75::DOUBLE ELSE 0 END + CASE priority WHEN 'doctrinal' THEN 0.5::DOUBLE WHEN 'normative' THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN NOT dq AND priority = 'normative' THEN 0.7::DOUBLE ELSE 0 END
      + CASE WHEN dq AND priority = 'doctrinal' THEN 0.7::DOUBLE ELSE 0 END - CASE WHEN dq AND priority = 'introductory' THEN 2.0::DOUBLE ELSE 0 END - CASE WHEN status = 'anchor_only' THEN 0.5::DOUBLE ELSE 0 END, 6) AS rs FROM g0)"""
_PRUNED = f"""{_GROUPS}, h AS (SELECT *, bool_or(priority = 'doctrinal' AND status = 'expanded') OVER (PARTITION BY question_id) AS has FROM g),
    k AS (SELECT * FROM h WHERE NOT (dq AND has AND priority = 'introductory' AND status = 'anchor_only')),
    k2 AS (SELECT * REPLACE (round(rs - CASE WHEN status = 'anchor_only' AND any_exp THEN 1.0::DOUBLE ELSE 0 END, 6) AS rs) FROM (SELECT *, bool_or(status = 'expanded') OVER (PARTITION BY question_id) AS any_exp FROM k)),
    pr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rs DESC, parent_key) AS rank FROM k2)"""
_JOIN = "array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ',')"

ORACLE_SQL = {
    "bm25_topk": f"WITH {_bm25_sql(_ALL_DOCS, _BENCH, 10)} SELECT question_id, chunk_id, score, rank FROM bm25",
    "bm25_topk_filtered": f"WITH {_bm25_sql(_GERMAN, _BENCH, 10)} SELECT question_id, chunk_id, score, rank FROM bm25",
    "dense_topk": f"WITH {_dense_sql(10)} SELECT question_id, chunk_id, distance, rank FROM dense",
    "dense_topk_filtered": f"WITH {_dense_sql(10, 'v.label % 2 = 0')} SELECT question_id, chunk_id, distance, rank FROM dense",
    "bm25_per_question_filter": rf"""WITH d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
        q AS (SELECT item_id AS question_id, text, ['en', 'de', 'fr', 'es', NULL][item_id % 5 + 1] AS fl, CASE WHEN item_id % 3 = 0 THEN 'src' || item_id % 4 END AS fs FROM benchmark),
        g AS (SELECT *, row_number() OVER () AS g FROM (SELECT DISTINCT fl, fs FROM q)),
        dg AS (SELECT g, doc_id, w FROM d JOIN g ON (fl IS NULL OR fl = lang) AND (fs IS NULL OR fs = source)),
        tot AS (SELECT g, count(*) AS n, avg(len(w)) AS mean FROM dg GROUP BY g),
        tf AS (SELECT g, doc_id, len, term, count(*) AS tf FROM (SELECT g, doc_id, len(w) AS len, unnest(w) AS term FROM dg) GROUP BY ALL),
        df AS (SELECT g, term, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf, any_value(mean) AS mean FROM tf JOIN tot USING (g) GROUP BY g, term),
        idf AS (SELECT g, term, CASE WHEN idf < 0 THEN avg(idf) OVER (PARTITION BY g) * 0.25 ELSE idf END AS idf, mean FROM df),
        qt AS (SELECT question_id, g, term, count(*) AS times FROM (SELECT question_id, g, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM q JOIN g ON q.fl IS NOT DISTINCT FROM g.fl AND q.fs IS NOT DISTINCT FROM g.fs) GROUP BY ALL),
        s AS (SELECT question_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM qt JOIN idf USING (g, term) JOIN tf USING (g, term) GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "dense_per_question_filter": f"WITH {_dense_sql(10, '(q.vec_id % 400 = 0 OR q.label = v.label)')} SELECT question_id, chunk_id, distance, rank FROM dense",
    "rrf_hybrid": f"WITH {_HYBRID} SELECT question_id, chunk_id, score, sources, rank FROM hybrid",
    "rerank_topk": f"WITH {_RERANK} SELECT question_id, chunk_id, rerank_score, pre_rerank_rank, rank FROM rr",
    "rank_changes": f"""WITH {_RERANK} SELECT question_id, count(*) FILTER (pre_rerank_rank > rank) AS moved_up, count(*) FILTER (pre_rerank_rank < rank) AS moved_down, count(*) FILTER (pre_rerank_rank = rank) AS unchanged,
        max(pre_rerank_rank - rank) AS max_gain, min(pre_rerank_rank - rank) AS max_loss FROM rr GROUP BY question_id""",
    "group_by_parent": f"WITH {_GROUPS} SELECT question_id, parent_key, document_id, priority, status, {_JOIN} AS chunk_ids, page_start, page_end, rs AS ranking_score FROM g",
    "drop_intro": f"WITH {_PRUNED} SELECT question_id, parent_key, rs AS ranking_score, rank FROM pr",
    "one_per_document": f"""WITH {_PRUNED}, m AS (SELECT *, max(rs) OVER (PARTITION BY question_id) AS b, row_number() OVER (PARTITION BY question_id, document_id ORDER BY rank) AS n FROM pr),
        t AS (SELECT *, n = 1 AND rs >= CASE WHEN b <= 0 THEN b - 1.0::DOUBLE ELSE b - greatest(1.5::DOUBLE, abs(b) * 0.35::DOUBLE) END AS promoted FROM m)
        SELECT question_id, parent_key, promoted, row_number() OVER (PARTITION BY question_id ORDER BY promoted DESC, rank) AS rank FROM t""",
    "cross_context_dedupe": f"""WITH {_PRUNED}, c2 AS (SELECT question_id, parent_key, rank, CASE WHEN list_contains(ids, page_start - page_start % 50) THEN ids ELSE list_append(ids, page_start - page_start % 50) END AS ids FROM pr),
        e AS (SELECT question_id, parent_key, rank, unnest(ids) AS c, generate_subscripts(ids, 1) AS p FROM c2),
        n AS (SELECT *, row_number() OVER (PARTITION BY question_id, c ORDER BY rank, p) AS n FROM e),
        l AS (SELECT question_id, parent_key, list(c ORDER BY p) AS ids FROM n WHERE n = 1 GROUP BY question_id, parent_key),
        o AS (SELECT c2.question_id, c2.parent_key, coalesce(l.ids, c2.ids) AS ids FROM c2 LEFT JOIN l USING (question_id, parent_key))
        SELECT question_id, parent_key, {_JOIN} AS chunk_ids FROM o""",
}
