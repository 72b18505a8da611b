"""Queries over chunks: ids, selection, validation, parents, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.functions import vocab
from docengine.operators import consolidation as C
from docengine.operators import chunks as K
from docengine.queries.common import CHUNKS, chunk_rows, sql_slug, table


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from document, article and first words; the n-th of equal ones gets a suffix."""
    c = chunk_rows(spark, sf_dir).select("chunk_id", F.concat_ws("_", "document_id", T.slug(F.col("article_number")), T.slug(F.col("lang"))).alias("base"))
    return K.unique_ids(c, "base", "chunk_id").select("chunk_id", "unique_id")


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_rows(spark, sf_dir)
    t = K.labelled_text([("Documento", F.col("document_id")), ("Tipo documental", F.col("document_type")), ("Referência", F.col("article_number"))], F.col("text"))
    return c.select("chunk_id", F.sha2(t, 256).alias("embedding_input_hash"), F.length(t).cast("long").alias("n_chars"))


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.eligible(chunk_rows(spark, sf_dir)).select("chunk_id", "embedding_eligible", "embedding_exclusion_reason")


def eligibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.eligible(chunk_rows(spark, sf_dir))
    return e.groupBy(F.coalesce("embedding_exclusion_reason", F.lit("eligible")).alias("outcome")).agg(F.count("*").alias("n"))


def chunk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.issues(chunk_rows(spark, sf_dir)).groupBy("issue").agg(F.count("*").alias("n"))


def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the worst of its chunks' findings."""
    i = K.issues(chunk_rows(spark, sf_dir))
    severity = F.max(F.when(F.col("issue") == "empty_text", 2).when(F.col("issue").isNotNull(), 1).otherwise(0))
    all_ = chunk_rows(spark, sf_dir).select("document_id", "chunk_id").join(i.select("chunk_id", "issue"), "chunk_id", "left")
    return all_.groupBy("document_id").agg(F.element_at(F.array(F.lit("PASS"), F.lit("PARTIAL"), F.lit("FAIL")), severity + 1).alias("status"))


def topic_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule whose keyword a folded text holds, else a default."""
    return K.first_rule(chunk_rows(spark, sf_dir), TOPIC_RULES, "general").select("chunk_id", "topic")


TOPIC_RULES = (("licensing", ("licensed", "copyright")), ("contact", ("email", "phone", "@")), ("german", (" und ", " der ")), ("spanish", (" que ",)), ("english", (" the ",)))


def unify_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping corpora by name; of equal ids the first stays."""
    c = chunk_rows(spark, sf_dir).select("chunk_id", "document_id", F.length("text").cast("long").alias("n_chars"))
    a = c.where("chunk_id % 3 <> 0").withColumn("origin", F.lit("a"))
    b = c.withColumn("origin", F.lit("b")).withColumn("note", F.lit("second"))
    return K.unify([a, b], "chunk_id").select("chunk_id", "document_id", "n_chars", "origin", "note")


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have no vector yet."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return chunk_rows(spark, sf_dir).select("chunk_id", "document_id").join(v, "chunk_id", "left_anti")


def seed_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that can be used again: same id and same text hash."""
    c = chunk_rows(spark, sf_dir).select("chunk_id", F.sha2("text", 256).alias("text_hash"))
    old = table(spark, sf_dir, "embeddings").join(c, F.col("vec_id") == F.col("chunk_id")).select("vec_id", "label", F.when(F.col("vec_id") % 5 == 0, F.lit("changed")).otherwise(F.col("text_hash")).alias("old_hash"))
    return c.join(old, (F.col("chunk_id") == F.col("vec_id")) & (F.col("text_hash") == F.col("old_hash"))).select("chunk_id", F.col("label").cast("long").alias("label"))


def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.size("embedding").cast("long").alias("dimensions")).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.count_if(F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).alias("n_bad"))


def vector_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without a chunk, with an ineligible or an empty one."""
    c = K.eligible(chunk_rows(spark, sf_dir)).select("chunk_id", "embedding_eligible", (F.trim("text") == "").alias("empty"))
    v = table(spark, sf_dir, "embeddings").select("vec_id").join(c, F.col("vec_id") == F.col("chunk_id"), "left")
    issue = F.when(F.col("chunk_id").isNull(), "orphan").when(~F.col("embedding_eligible"), "ineligible").when(F.col("empty"), "empty_text").otherwise("aligned")
    return v.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(spark, sf_dir).withColumn("parent_key", T.parent_key(F.col("document_id"), article=F.when(F.col("chunk_type") != "note", F.col("article_number")), chunk_type=F.col("chunk_type"), chunk_id=F.col("chunk_id").cast("string")))


def parent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(spark, sf_dir).select("chunk_id", "parent_key")


def small_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.small_parents(_parents(spark, sf_dir))


def sibling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth chunk as an anchor with its neighbours."""
    c = _parents(spark, sf_dir)
    a = c.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question_id"), "chunk_id")
    return C.siblings(c, a).select("anchor_id", "chunk_id")


def greedy_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each parent's chunks those that fit into 9000 characters, too long ones being skipped."""
    c = _parents(spark, sf_dir).select("parent_key", "position", "chunk_id", (F.length("text") + 2).alias("size"))
    return C.fitted(c, ["parent_key"], "position", "size", 9000).select("parent_key", "chunk_id")


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parents(spark, sf_dir).groupBy("parent_key").agg(F.min("position").alias("a"), F.max("position").alias("b"))
    return p.select("parent_key", T.page_span("a", "b").alias("pages"))


_FNS = (chunk_ids, embedding_text, eligibility, eligibility_counts, chunk_issues, report_status, topic_inference, unify_corpora, resume_antijoin, seed_hash_join, vector_validation, vector_alignment, parent_keys, small_parent, sibling_window, greedy_fit, page_spans)
QUERIES = {f.__name__: f for f in _FNS}

_C = f"c AS ({CHUNKS})"
_REASON = f"""CASE WHEN chunk_type IN ('special_layout', 'signature') THEN 'summary_or_non_retrievable_layout'
    WHEN document_type IN ({', '.join(f"'{x}'" for x in vocab.DOCTRINAL_DOCUMENT_TYPES + vocab.NORMATIVE_DOCUMENT_TYPES)}) THEN NULL
    WHEN chunk_type IN ('introductory_context', 'conclusion_paragraph') THEN NULL ELSE 'non_documentary_context_not_selected' END"""
_E = f"{_C}, e AS (SELECT *, {_REASON} AS reason FROM c)"
_I = f"""{_C}, i AS (SELECT chunk_id, document_id, 'empty_text' AS issue FROM c WHERE trim(text) = '' UNION ALL SELECT chunk_id, document_id, 'chunk_above_expected_limit' FROM c WHERE length(text) > 3200
    UNION ALL SELECT chunk_id, document_id, 'missing_reference' FROM c WHERE article_number = '0' UNION ALL SELECT chunk_id, document_id, 'duplicate_text' FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY chunk_id) AS n FROM c) WHERE n > 1)"""
_P = f"""{_C}, p AS (SELECT *, CASE WHEN chunk_type <> 'note' THEN document_id || '::article::' || article_number ELSE document_id || '::chunk-type::note' END AS parent_key FROM c)"""

ORACLE_SQL = {
    "chunk_ids": f"""
        WITH {_C}, b AS (SELECT chunk_id, concat_ws('_', document_id, {sql_slug('article_number')}, {sql_slug('lang')}) AS base FROM c),
        n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY chunk_id) AS n FROM b)
        SELECT chunk_id, CASE WHEN n > 1 THEN base || '_duplicata-' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') ELSE base END AS unique_id FROM n""",
    "embedding_text": f"""
        WITH {_C}, t AS (SELECT chunk_id, concat_ws(chr(10), 'Documento: ' || document_id, 'Tipo documental: ' || document_type, 'Referência: ' || article_number, 'Texto: ' || text) AS t FROM c)
        SELECT chunk_id, sha256(t) AS embedding_input_hash, CAST(length(t) AS BIGINT) AS n_chars FROM t""",
    "eligibility": f"WITH {_E} SELECT chunk_id, reason IS NULL AS embedding_eligible, reason AS embedding_exclusion_reason FROM e",
    "eligibility_counts": f"WITH {_E} SELECT coalesce(reason, 'eligible') AS outcome, count(*) AS n FROM e GROUP BY 1",
    "chunk_issues": f"WITH {_I} SELECT issue, count(*) AS n FROM i GROUP BY issue",
    "report_status": f"""
        WITH {_I} SELECT c.document_id, ['PASS', 'PARTIAL', 'FAIL'][max(CASE WHEN issue = 'empty_text' THEN 2 WHEN issue IS NOT NULL THEN 1 ELSE 0 END) + 1] AS status FROM c LEFT JOIN i USING (chunk_id) GROUP BY c.document_id""",
    "topic_inference": f"""
        WITH {_C}, f AS (SELECT chunk_id, regexp_replace(translate(lower(text), '{vocab.ACCENTED}', '{vocab.PLAIN}'), '[^\\x00-\\x7F]', '', 'g') AS t FROM c)
        SELECT chunk_id, CASE {' '.join(f"WHEN {' OR '.join(f'''contains(t, '{k}')''' for k in ks)} THEN '{n}'" for n, ks in TOPIC_RULES)} ELSE 'general' END AS topic FROM f""",
    "unify_corpora": f"""
        WITH {_C} SELECT chunk_id, document_id, CAST(length(text) AS BIGINT) AS n_chars, CASE WHEN chunk_id % 3 <> 0 THEN 'a' ELSE 'b' END AS origin, CASE WHEN chunk_id % 3 <> 0 THEN NULL ELSE 'second' END AS note
        FROM c""",
    "resume_antijoin": f"WITH {_C} SELECT chunk_id, document_id FROM c WHERE NOT EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = c.chunk_id)",
    "seed_hash_join": f"WITH {_C} SELECT c.chunk_id, CAST(v.label AS BIGINT) AS label FROM c JOIN embeddings v ON v.vec_id = c.chunk_id WHERE v.vec_id % 5 <> 0",
    "vector_validation": "SELECT CAST(len(embedding) AS BIGINT) AS dimensions, count(*) AS n, count(DISTINCT vec_id) AS n_ids, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS n_bad FROM embeddings GROUP BY 1",
    "vector_alignment": f"""
        WITH {_E} SELECT CASE WHEN e.chunk_id IS NULL THEN 'orphan' WHEN e.reason IS NOT NULL THEN 'ineligible' WHEN trim(e.text) = '' THEN 'empty_text' ELSE 'aligned' END AS issue, count(*) AS n
        FROM embeddings v LEFT JOIN e ON v.vec_id = e.chunk_id GROUP BY 1""",
    "parent_keys": f"WITH {_P} SELECT chunk_id, parent_key FROM p",
    "small_parent": f"WITH {_P} SELECT parent_key, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS total_chars, sum(length(text)) <= 7000 AS is_small FROM p GROUP BY parent_key",
    "sibling_window": f"""
        WITH {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY parent_key ORDER BY position, chunk_id) AS n FROM p)
        SELECT a.chunk_id AS anchor_id, b.chunk_id FROM n a JOIN n b ON a.parent_key = b.parent_key AND b.n BETWEEN a.n - 1 AND a.n + 1 WHERE a.chunk_id % 100 = 0""",
    "greedy_fit": f"""
        WITH RECURSIVE {_P}, n AS (SELECT parent_key, chunk_id, length(text) + 2 AS size, row_number() OVER (PARTITION BY parent_key ORDER BY position) AS n FROM p),
        r AS (SELECT parent_key, chunk_id, n, size AS total, true AS kept FROM n WHERE n = 1
              UNION ALL SELECT n.parent_key, n.chunk_id, n.n, CASE WHEN r.total + n.size <= 9000 THEN r.total + n.size ELSE r.total END, r.total + n.size <= 9000 FROM r JOIN n ON n.parent_key = r.parent_key AND n.n = r.n + 1)
        SELECT parent_key, chunk_id FROM r WHERE kept""",
    "page_spans": f"WITH {_P} SELECT parent_key, CASE WHEN min(position) = max(position) THEN CAST(min(position) AS VARCHAR) ELSE min(position) || '-' || max(position) END AS pages FROM p GROUP BY parent_key",
}
