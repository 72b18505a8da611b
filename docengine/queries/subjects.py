"""Queries over subject rules and over packages as evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import audits as U
from docengine.operators import retrieval as R
from docengine.operators import subjects as S
from docengine.queries.common import DOCS, documents, sql_fold, sql_list, table
from docengine.queries.questions import _Q, _QUESTION, _asked, _question
from docengine.queries.retrieval import _ALL_DOCS, _BENCH, _bm25_sql

#: Rules over words of the questions and of the texts of the tables.
RULES = (
    S.SubjectRule("discipline", ("disciplina", "igreja local"), ("artigo", "governo", "liste"), (S.Unit("src0", "3", 90), S.Unit("src1", "4", 35, "2"), S.Unit("src0", "5", 10)), (("src0", "c-16"), ("src1", "c-7")), "regras do processo", 5, (r"\bthe\b", r"\ber\w+\b"), (r"\band\b", r"\bund\b")),
    S.SubjectRule("ordination", ("ordenacao", "ministros"), ("doutrina", "artigo", "quais documentos orientam"), (S.Unit("src2", "1", 60), S.Unit("src3", "2", 50)), (("src2", "c-1"),), "requisitos", 0, (r"\bof\b", r"\bque\b"), (r"\bin\b",)),
    S.SubjectRule("faith", ("fe", "graca", "salvacao", "batismo"), ("ensina", "confissao", "resuma", "o que diz"), (S.Unit("src1", "6", 20), S.Unit("src4", "8", 15, "1")), (), "", None, (r"\bla\b", r"\bdie\b", r"\b\w{9}\b"), (r"\bto\b",)),
)


def subject_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that each message falls under, with its widened question."""
    s = S.subject_scope(_asked(spark, sf_dir).select("conv_id", "turn", F.col("question").alias("text")), RULES)
    return s.select("conv_id", "turn", "rule_id", F.md5("coverage_query").alias("query_hash"), F.coalesce(F.col("least_contexts").cast("long"), F.lit(0)).alias("least_contexts"))


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best chunks of each benchmark text as contexts of its question, with the question's rule: of those without one that of its number."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    rule = S.subject_scope(q.select("question_id", _question(F.col("text")).alias("text")), RULES)
    given = F.coalesce("rule_id", *[F.when(F.col("question_id") % 4 == i, F.lit(r.id)) for i, r in enumerate(RULES)])
    hits = R.bm25(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), q, 20)
    return hits.select("question_id", "chunk_id").join(rule.select("question_id", given.alias("rule_id")), "question_id").join(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("document_id")), "chunk_id")


def subject_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the texts of contexts fit the rule of their question."""
    return S.subject_match(_scoped(spark, sf_dir), RULES).select("question_id", "chunk_id", "rule_id", F.col("subject_score").cast("long").alias("subject_score"))


def unit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which contexts are units of their question's rule: by an included chunk, by the parent's key, or by the reference."""
    n = F.length("text")
    a, p = (n % 9).cast("string"), F.when(n % 4 == 0, (n % 3).cast("string"))
    c = _scoped(spark, sf_dir).withColumn("included", F.when(n % 5 < 2, F.array(F.struct(a.alias("article_number"), p.alias("paragraph_number")))))
    c = c.withColumn("parent_key", F.when(n % 5 == 2, F.concat_ws("::", "document_id", F.lit("article"), a, F.when(p.isNotNull(), F.concat(F.lit("paragraph::"), p))))).withColumn("reference", F.when(n % 5 == 3, F.concat(F.lit("Art. "), a, F.coalesce(F.concat(F.lit(", § "), p, F.lit("o")), F.lit("")))))
    m = S.unit_match(c, RULES, ["question_id", "chunk_id"])
    return m.select("question_id", "chunk_id", "unit_matches", F.col("unit_priority").cast("long").alias("unit_priority"))


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a package of two contexts, in which members are missing, null or of another type as its length has it."""
    n = F.length("text")
    text = F.to_json(F.struct(F.substring_index("text", "\n", 1).alias("t"))).substr(F.lit(6), F.lit(10**9))
    text = F.regexp_replace(text, r"\}$", "")
    i = F.col("doc_id").cast("string")
    chunk = F.concat(F.lit('{"chunk_id":"'), i, F.lit('a","text":'), text, F.lit(',"page_start":'), F.when(n % 3 == 0, F.lit('"x"')).when(n % 3 == 1, F.lit("null")).otherwise((n % 100).cast("string")), F.lit("}"))
    chunks = F.when(n % 7 == 0, F.lit("[]")).when(n % 7 == 1, F.lit('"none"')).when(n % 7 == 2, F.concat(F.lit("[5,"), chunk, F.lit("]"))).otherwise(F.concat(F.lit("["), chunk, F.lit(',{"chunk_id":'), i, F.lit(',"text":" "}]')))
    first = F.concat(F.lit('{"document_id":"'), F.col("source"), F.lit('","context_text":'), F.when(n % 4 == 0, F.lit('{"a":1}')).otherwise(text), F.lit(',"anchor_chunk_ids":["'), i, F.lit('a"],"metadata":'), F.when(n % 11 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"included_chunks":'), chunks, F.lit("}"))), F.lit("}"))
    package = F.when(n % 5 == 0, F.lit("{}")).when(n % 5 == 1, F.lit('{"contexts":"text"}')).when(n % 13 == 0, F.lit("[1]")).when(n % 17 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"contexts":["no",'), first, F.lit(',{"context_text":'), i, F.lit("}]}")))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("question_id"), package.alias("package"))


def audit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts and sources of packages."""
    a = U.audit_fields(_packages(spark, sf_dir), "chunks")
    return a.select("question_id", F.sha2(F.array_join("contexts", "|"), 256).alias("contexts_hash"), F.sha2(F.array_join("prompt_contexts", "|"), 256).alias("prompt_hash"), "n_contexts", "n_sources", "n_anchors")


def audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = U.package_sources(_packages(spark, sf_dir))
    return s.select("question_id", "context_index", "chunk_id", "document_id", F.coalesce(F.col("page_start").cast("long"), F.lit(0)).alias("page_start"), "is_anchor", F.length("text").cast("long").alias("n_chars"))


def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores found in records of labels: numbers in some rows, null or texts in others."""
    q = F.col("quality")
    d = table(spark, sf_dir, "labels").select(F.to_json(F.struct("doc_id", F.lit("x").alias("answer"), q.alias("faithfulness"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic") / 4).alias("harm"), F.when(F.col("doc_id") % 2 == 0, (q == 1)).alias("good"), F.lit("a").alias("note"), F.array("toxic").alias("contexts")), {"ignoreNullFields": "false"}).alias("record"))
    return U.score_columns(d).select("name", "n_rows", "n_scored", F.round("mean", 6).alias("mean"))


_FNS = (subject_scope, subject_match, unit_match, audit_fields, audit_sources, score_columns)
QUERIES = {f.__name__: f for f in _FNS}


def _names(aliases, f: str = "folded", w: str = "w") -> str:
    single, several = [a for a in aliases if " " not in a], [a for a in aliases if " " in a]
    return "(" + " OR ".join([f"list_has_any({w}, {sql_list(single)})" if single else "false", *[f"contains({f}, '{a}')" for a in several]]) + ")"


_UNDER = ", ".join(f"CASE WHEN {_names(r.subject)} AND {_names(r.intent)} THEN '{r.id}' END" for r in RULES)
_ONE = f"list_filter([{_UNDER}], lambda x: x IS NOT NULL)"
_TERMS = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN '{r.terms}'" for r in RULES) + " END"
_LEAST = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN {max(1, r.least_contexts)}" for r in RULES if r.least_contexts is not None) + " END"
_SCOPED = f"""{_bm25_sql(_ALL_DOCS, _BENCH, 20)}, bq AS (SELECT item_id AS question_id, {_QUESTION('text')} AS question FROM benchmark), bf AS (SELECT *, {sql_fold('question')} AS folded FROM bq), bw AS (SELECT *, list_distinct(regexp_extract_all(folded, '\\w+')) AS w FROM bf),
    br AS (SELECT question_id, {_ONE} AS u FROM bw), rq AS (SELECT question_id, coalesce(CASE WHEN len(u) = 1 THEN u[1] END, {sql_list([r.id for r in RULES])}[question_id % 4 + 1]) AS rule_id FROM br),
    sc AS (SELECT question_id, chunk_id, rule_id, source AS document_id, text, length(text) AS n, {sql_fold('text')} AS f FROM bm25 JOIN rq USING (question_id) JOIN ({DOCS}) d ON d.doc_id = bm25.chunk_id)"""
_SCORE = "CASE " + " ".join(f"WHEN rule_id = '{r.id}' THEN {S.GAIN} * len(list_filter({sql_list(r.positive)}, lambda p: regexp_matches(f, p))) - {S.LOSS} * len(list_filter({sql_list(r.negative)}, lambda p: regexp_matches(f, p)))" for r in RULES) + " ELSE 0 END"
_UNITS = ", ".join(f"('{r.id}', '{u.document_id}', '{u.article}', '{u.paragraph or ''}', {u.priority})" for r in RULES for u in r.units)
_PACK = f"""p AS (SELECT doc_id, source, length(text) AS n, trim(split_part(text, chr(10), 1)) AS t FROM ({DOCS})), k AS (SELECT *, n % 5 > 1 AND n % 13 <> 0 AND n % 17 <> 0 AS whole, CASE WHEN n % 11 = 0 OR n % 7 < 2 THEN 'none' WHEN n % 7 = 2 THEN 'one' ELSE 'two' END AS kind FROM p),
    s AS (SELECT doc_id AS question_id, 1 AS context_index, CASE WHEN kind = 'none' OR part = 1 THEN doc_id || 'a' ELSE CAST(doc_id AS VARCHAR) END AS chunk_id, source AS document_id, CASE WHEN kind <> 'none' AND part = 1 AND n % 3 = 2 THEN n % 100 END AS page_start, kind = 'none' OR part = 1 AS is_anchor,
        CASE WHEN kind = 'none' THEN CASE WHEN n % 4 = 0 THEN '' ELSE t END WHEN part = 1 THEN t ELSE '' END AS text FROM (SELECT *, unnest(CASE WHEN kind = 'two' THEN [1, 2] ELSE [1] END) AS part FROM k WHERE whole)
      UNION ALL SELECT doc_id, 2, NULL, NULL, NULL, true, CAST(doc_id AS VARCHAR) FROM k WHERE whole)"""

ORACLE_SQL = {
    "subject_scope": f"""WITH {_Q}, u AS (SELECT conv_id, turn, question, {_ONE} AS u FROM w), r AS (SELECT *, CASE WHEN len(u) = 1 THEN u[1] END AS rule_id FROM u)
        SELECT conv_id, turn, rule_id, md5(CASE WHEN rule_id IS NULL THEN question ELSE trim(concat_ws(' ', question, nullif({_TERMS}, ''))) END) AS query_hash, CAST(coalesce({_LEAST}, 0) AS BIGINT) AS least_contexts FROM r""",
    "subject_match": f"WITH {_SCOPED} SELECT question_id, chunk_id, rule_id, CAST({_SCORE} AS BIGINT) AS subject_score FROM sc",
    "unit_match": f"""WITH {_SCOPED}, u(rule_id, document_id, a, p, priority) AS (VALUES {_UNITS}), c AS (SELECT *, CAST(n % 9 AS VARCHAR) AS ca, CASE WHEN n % 4 = 0 THEN CAST(n % 3 AS VARCHAR) ELSE '' END AS cp FROM sc),
        m AS (SELECT question_id, chunk_id, max(priority) AS priority FROM c JOIN u USING (rule_id, document_id) WHERE n % 5 < 4 AND ca = a AND CASE WHEN n % 5 < 3 THEN cp = p ELSE (p = '' AND cp = '') OR (p <> '' AND (cp || 'o' = p OR a = p)) END GROUP BY ALL)
        SELECT question_id, chunk_id, priority IS NOT NULL AS unit_matches, CAST(coalesce(priority, 0) AS BIGINT) AS unit_priority FROM sc LEFT JOIN m USING (question_id, chunk_id)""",
    "audit_sources": f"WITH {_PACK} SELECT question_id, CAST(context_index AS BIGINT) AS context_index, chunk_id, document_id, CAST(coalesce(page_start, 0) AS BIGINT) AS page_start, is_anchor, length(text) AS n_chars FROM s",
    "audit_fields": f"""WITH {_PACK}, x AS (SELECT doc_id, list_concat(CASE WHEN kind = 'none' AND (n % 11 = 0 OR n % 7 = 0 OR n % 7 = 1) THEN CASE WHEN n % 4 = 0 OR t = '' THEN []::VARCHAR[] ELSE [t] END WHEN t = '' THEN []::VARCHAR[] ELSE [t] END, [CAST(doc_id AS VARCHAR)]) AS c,
          list_concat(CASE WHEN n % 4 = 0 OR t = '' THEN []::VARCHAR[] ELSE [t] END, [CAST(doc_id AS VARCHAR)]) AS pc FROM k WHERE whole), g AS (SELECT question_id, count(*) AS n_sources, count(*) FILTER (is_anchor) AS n_anchors FROM s GROUP BY ALL)
        SELECT p.doc_id AS question_id, sha256(coalesce(array_to_string(c, '|'), '')) AS contexts_hash, sha256(coalesce(array_to_string(pc, '|'), '')) AS prompt_hash, CAST(CASE WHEN c IS NULL THEN 0 ELSE 2 END AS BIGINT) AS n_contexts, coalesce(n_sources, 0) AS n_sources, coalesce(n_anchors, 0) AS n_anchors
        FROM p LEFT JOIN x USING (doc_id) LEFT JOIN g ON g.question_id = p.doc_id""",
    "score_columns": """SELECT 'doc_id' AS name, count(*) AS n_rows, count(doc_id) AS n_scored, round(avg(doc_id), 6) AS mean FROM labels UNION ALL SELECT 'faithfulness', count(*), count(quality), round(avg(quality::DOUBLE), 6) FROM labels
        UNION ALL SELECT 'harm', count(*), count(CASE WHEN doc_id % 3 <> 0 THEN toxic END), round(avg(CASE WHEN doc_id % 3 <> 0 THEN toxic / 4.0::DOUBLE END), 6) FROM labels UNION ALL SELECT 'good', count(*), count(CASE WHEN doc_id % 2 = 0 THEN quality END), round(avg(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END END), 6) FROM labels""",
}
