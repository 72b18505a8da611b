"""Queries over headed documents and over contexts built around retrieved chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.functions import vocab
from docengine.operators import consolidation as C
from docengine.operators import contexts as X
from docengine.operators import lines as L
from docengine.operators import questions as Q
from docengine.operators import retrieval as R
from docengine.operators import segments as G
from docengine.queries.chunks import _P, _parents
from docengine.queries.common import documents, sql_fold, sql_list, table
from docengine.queries.questions import _QUESTION, _has, _match, _question
from docengine.plans import flow as P
from docengine.queries.retrieval import _ALL_DOCS, _BENCH, _PRUNED, _RERANK, _benchmark, _bm25_sql, _groups, rerank_topk
from docengine.queries.texts import _LINES, _UPPER


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the texts; by its length a line opens a chapter, section, article or preamble, or is put in capitals."""
    lines = L.flatten(documents(spark, sf_dir))
    n, i = F.length("line") % 14, F.col("line_index")
    roman = F.element_at(F.array(*map(F.lit, vocab.ROMANS)), (i % len(vocab.ROMANS) + 1).cast("int"))
    capital = F.upper(F.regexp_replace(F.substring("line", 1, 60), "ß", "s"))
    made = (
        F.when(n == 0, F.concat(F.lit("CAPÍTULO "), roman)).when(n == 1, F.concat(F.lit("Capítulo "), roman, F.lit(" "), F.substring("line", 1, 20))).when(n == 2, F.concat(F.lit("SEÇÃO "), roman)).when(n == 3, F.lit("Preâmbulo"))
        .when(n.isin(4, 5), F.concat(F.lit("Art. "), i.cast("string"), F.lit("º "), F.col("line"))).when(n.isin(6, 7, 8), capital).otherwise(F.col("line"))
    )
    return lines.withColumn("line", F.trim(made))


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preambles and articles with their chapters and sections."""
    c = G.in_context(G.segments(_made(spark, sf_dir)))
    return c.select("document_id", "segment", "kind", "number", "chapter_number", "section_number", F.md5(F.concat_ws("|", "chapter_title", "section_title")).alias("titles_hash"), "first_line", "last_line", F.md5(F.array_join("lines", "\n")).alias("text_hash"))


def heading_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and sections with titles that run on over lines in capitals."""
    return G.segments(_made(spark, sf_dir)).where("kind in ('chapter', 'section')").select("document_id", "segment", "kind", "number", F.md5(F.coalesce("title", F.lit(""))).alias("title_hash"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each text open what."""
    return _made(spark, sf_dir).withColumn("kind", F.coalesce(G.line_kind("line"), F.lit("none"))).groupBy("document_id", "kind").agg(F.count("*").alias("n"))


def loose_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in capitals that belong to nothing."""
    return G.unhandled_headings(G.segments(_made(spark, sf_dir))).groupBy("document_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("line")), "|")).alias("lines_hash"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parents(spark, sf_dir)
    n = F.length("text")
    return p.select(
        "chunk_id", "document_id", "parent_key", "position", F.when(n % 3 == 0, F.concat(F.lit("s"), (n % 2).cast("string"))).alias("section_title"), F.when(n % 5 < 3, F.concat(F.lit("c"), (n % 4).cast("string"))).alias("chapter_reference"),
        (n % 4 == 0).alias("is_item"), F.when(n % 2 == 0, F.concat(F.lit("Art. "), "article_number")).alias("reference"), (n % 50).cast("long").alias("page_start"), F.when(n % 3 > 0, (n % 50 + n % 3).cast("long")).alias("page_end"), "text",
    )


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of each benchmark text."""
    q = _benchmark(spark, sf_dir)
    hits = R.bm25(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), q, 5)
    return hits.select("question_id", "chunk_id").join(q.select("question_id", _question(F.col("text")).alias("query")), "question_id")


def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each anchor; parents over 2,000 characters count as large, contexts hold up to 6,000."""
    b = X.built(_chunks(spark, sf_dir), _anchors(spark, sf_dir), 6000, small_chars=2000)
    return b.select("question_id", "anchor_id", "strategy", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.array_join(F.transform("included", lambda x: x.cast("string")), ",").alias("included"), "page_start", "page_end", F.md5("context_text").alias("text_hash"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of the benchmark texts with topic scores of their first chunk and what their questions ask for."""
    q = _benchmark(spark, sf_dir).select("question_id", F.col("text").alias("asked"), _question(F.col("text")).alias("query"))
    q = q.select("question_id", T.topic_terms("asked").alias("_asked"), (F.length("asked") % 5 == 0).alias("document_filter"), Q.names_document("query").alias("specific_document"), Q.is_overview("query").alias("overview_query"))
    ranked = C.pruned(_groups(spark, sf_dir)).withColumn("chunk_id", F.col("chunk_ids")[0])
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    rows = ranked.join(texts, "chunk_id").join(q, "question_id")
    score = F.size(F.array_intersect("_asked", T.topic_terms("text"))).cast("long")
    return rows.withColumn("topic_score", F.when(score >= 3, score).otherwise(0)).withColumn("is_overview", F.length("text") % 3 == 0)


def diversity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts put in order by topic, document and overview; three shared terms are a match."""
    return C.diversified(_ranked(spark, sf_dir)).select("question_id", "parent_key", "reason", "promoted", F.col("rank").cast("long").alias("rank"))


def scope_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of texts of even length as the scope."""
    return C.preferred_scope(_ranked(spark, sf_dir), F.length("text") % 2 == 0).select("question_id", "parent_key", F.col("rank").cast("long").alias("rank"))


def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each question's contexts fits into 3,000 characters."""
    b = C.budgeted(_ranked(spark, sf_dir).select("question_id", "parent_key", "rank", "text"), 3000)
    return b.select("question_id", "parent_key", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_hash"))


def hierarchical_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of the five best chunks of each benchmark text by words and vectors, fused and reranked."""
    asked = _benchmark(spark, sf_dir)
    hits = rerank_topk(spark, sf_dir)
    b = P.hierarchical(_chunks(spark, sf_dir), asked.withColumn("text", _question(F.col("text"))), hits, 6000, small_chars=2000)
    return b.select("question_id", "anchor_id", "rank", "strategy", "status", F.array_join(F.transform("included", lambda x: x.cast("string")), ",").alias("included"), F.md5("context_text").alias("text_hash"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of the benchmark texts as questions, with vectors, to packages and decisions."""
    q, v = _benchmark(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = v.join(F.broadcast(q.select("question_id")), F.col("chunk_id") == F.col("question_id")).select("question_id", "vector")
    types = _parents(spark, sf_dir).select("chunk_id", "chunk_type", "document_type")
    p = P.answer_packages(_chunks(spark, sf_dir).join(types, "chunk_id"), q.withColumn("text", _question(F.col("text"))), v, asked, small_chars=2000)
    return p.select("question_id", "scope_document", F.col("attempt").cast("long").alias("attempt"), F.col("context_count").cast("long").alias("context_count"), F.col("total_chars").cast("long").alias("total_chars"), F.array_join("parents", ",").alias("parents"), F.md5("context_text").alias("text_hash"), "reason", "can_answer")


_FNS = (diversity_order, scope_preference, budget_fit, document_segments, heading_titles, boundaries, loose_headings, context_build, hierarchical_contexts, decisions)
QUERIES = {f.__name__: f for f in _FNS}

_ROMAN = f"{sql_list(vocab.ROMANS)}[line_index % {len(vocab.ROMANS)} + 1]"
_C = r"'(?i)^CAP[ÍI]TULO\s+([IVXLCDM]+|[0-9]+)\b(?:\s*(.*))?$'"
_S = r"'(?i)^SE[ÇC][ÃA]O\s+([IVXLCDM]+|[0-9]+)\b(?:\s*(.*))?$'"
_A = r"'^Art\.?\s*([0-9]+)([º°]?)(?:\.|\s*[–—-]|\s+[A-ZÁÉÍÓÚÂÊÔÃÕ])'"
_UP = _UPPER.replace("(length(line) BETWEEN", f"(NOT regexp_matches(line, {_A}) AND length(line) BETWEEN")
_SEG = rf"""{_LINES}, made AS (SELECT document_id, line_index, trim(CASE WHEN length(line) % 14 = 0 THEN 'CAPÍTULO ' || {_ROMAN} WHEN length(line) % 14 = 1 THEN 'Capítulo ' || {_ROMAN} || ' ' || substr(line, 1, 20) WHEN length(line) % 14 = 2 THEN 'SEÇÃO ' || {_ROMAN}
      WHEN length(line) % 14 = 3 THEN 'Preâmbulo' WHEN length(line) % 14 IN (4, 5) THEN 'Art. ' || line_index || 'º ' || line WHEN length(line) % 14 IN (6, 7, 8) THEN upper(replace(substr(line, 1, 60), 'ß', 's')) ELSE line END) AS line FROM lines),
    k AS (SELECT *, CASE WHEN trim({sql_fold('line')}) = 'preambulo' THEN 'preamble' WHEN regexp_matches(line, {_C}) THEN 'chapter' WHEN regexp_matches(line, {_S}) THEN 'section' WHEN regexp_matches(line, {_A}) THEN 'article' END AS kind, {_UP} AS up FROM made),
    g AS (SELECT *, CAST(sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM k),
    a AS (SELECT document_id, segment, first(kind ORDER BY line_index) AS kind, first(line ORDER BY line_index) AS head, min(line_index) AS first_line, max(line_index) AS last_line, list(line ORDER BY line_index) AS ls, list(up ORDER BY line_index)[2:] AS ups FROM g GROUP BY document_id, segment),
    b AS (SELECT *, CASE kind WHEN 'chapter' THEN upper(regexp_extract(head, {_C}, 1)) WHEN 'section' THEN upper(regexp_extract(head, {_S}, 1)) WHEN 'article' THEN regexp_extract(head, {_A}, 1) END AS number,
      nullif(trim(CASE kind WHEN 'chapter' THEN regexp_extract(head, {_C}, 2) WHEN 'section' THEN regexp_extract(head, {_S}, 2) END), '') AS inline FROM a),
    c AS (SELECT *, CASE WHEN kind IN ('chapter', 'section') THEN least(coalesce(list_position(ups, false) - 1, len(ups)), CASE WHEN inline IS NULL THEN 3 ELSE 2 END) ELSE 0 END AS nt FROM b),
    seg AS (SELECT *, nullif(trim(concat_ws(' ', inline, nullif(array_to_string(ls[2:1 + nt], ' '), ''))), '') AS title, list_concat(ls[1:1], ls[2 + nt:]) AS kept FROM c)"""
_BLOCK = lambda anchor: f"""rtrim('--- ' || CASE WHEN {anchor} THEN 'Chunk âncora' ELSE 'Contexto relacionado: ' || c.chunk_id END || ' ---' || chr(10) || 'Chunk: ' || c.chunk_id || chr(10) || 'Referência: ' || coalesce(c.reference, 'não informado')
      || chr(10) || 'Páginas: ' || CASE WHEN c.page_end IS NULL OR c.page_start = c.page_end THEN CAST(c.page_start AS VARCHAR) ELSE c.page_start || '-' || c.page_end END || chr(10) || chr(10) || c.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"""  # noqa: E731

_STOP = sql_list(vocab.TOPIC_STOPWORDS)
_TERMS = lambda x: f"list_distinct(list_transform(list_filter(regexp_extract_all({sql_fold(x)}, '\\w+'), lambda t: length(t) >= 4 AND NOT list_contains({_STOP}, t)), lambda t: CASE WHEN length(t) > 5 THEN regexp_replace(t, 's$', '') ELSE t END))"
_RANKED = f"""{_PRUNED}, qq AS (SELECT item_id AS question_id, text AS asked, {_QUESTION('text')} AS query FROM benchmark), qw AS (SELECT *, {sql_fold('query')} AS folded, list_distinct(regexp_extract_all(folded, '\\w+')) AS w FROM qq),
    qx AS (SELECT question_id, {_TERMS('asked')} AS terms, length(asked) % 5 = 0 AS document_filter, {_has(vocab.SPECIFIC_DOCUMENT_TERMS)} OR (list_contains(w, 'congregacional') AND {_has(['confissao', 'fe'])}) AS specific, {_match(vocab.OVERVIEW_PATTERNS)} AS overview FROM qw),
    rk0 AS (SELECT pr.question_id, parent_key, document_id, priority, rs, rank, t.text, qx.* EXCLUDE (question_id), len(list_intersect(qx.terms, {_TERMS('t.text')})) AS s0, length(t.text) % 3 = 0 AS is_overview FROM pr JOIN ({_ALL_DOCS}) t ON t.doc_id = ids[1] JOIN qx USING (question_id)),
    rk AS (SELECT *, CASE WHEN s0 >= 3 THEN s0 ELSE 0 END AS topic FROM rk0)"""


def _built_sql(hits: str) -> str:
    """Contexts of the hits that a common table expression zbm25 (question_id, chunk_id) gives."""
    return f"""WITH RECURSIVE {hits}, {_P},
      ck AS (SELECT chunk_id, document_id, parent_key, position, CASE WHEN length(text) % 3 = 0 THEN 's' || length(text) % 2 END AS section_title, CASE WHEN length(text) % 5 < 3 THEN 'c' || length(text) % 4 END AS chapter_reference, length(text) % 4 = 0 AS is_item,
        CASE WHEN length(text) % 2 = 0 THEN 'Art. ' || article_number END AS reference, length(text) % 50 AS page_start, CASE WHEN length(text) % 3 > 0 THEN length(text) % 50 + length(text) % 3 END AS page_end, text, row_number() OVER (PARTITION BY parent_key ORDER BY position, chunk_id) AS place FROM p),
      pa AS (SELECT parent_key, count(*) AS n, sum(length({_BLOCK('false')})) AS chars, bool_or(is_item) AS items FROM ck c GROUP BY parent_key),
      q AS (SELECT item_id AS question_id, {_QUESTION('text')} AS query FROM benchmark), qf AS (SELECT *, {sql_fold('query')} AS folded FROM q),
      a0 AS (SELECT h.question_id, h.chunk_id AS anchor_id, folded, c.* EXCLUDE (chunk_id), pa.n, pa.chars, pa.items, (SELECT count(*) FROM ck s WHERE s.document_id = c.document_id AND s.section_title = c.section_title) AS ins, (SELECT count(*) FROM ck s WHERE s.document_id = c.document_id AND s.chapter_reference = c.chapter_reference) AS inc
             FROM zbm25 h JOIN qf USING (question_id) JOIN ck c USING (chunk_id) JOIN pa USING (parent_key)),
      a AS (SELECT *, CASE WHEN contains(parent_key, '::chunk-type::') OR contains(parent_key, '::chunk::') THEN 'alone' WHEN {_match(X.LIST_QUESTIONS)} AND n > 1 AND items THEN 'unit' WHEN {_match(vocab.OVERVIEW_PATTERNS)} AND ins > 1 THEN 'section'
             WHEN {_match(vocab.OVERVIEW_PATTERNS)} AND inc > 1 THEN 'chapter' WHEN chars <= 2000 THEN 'parent' ELSE 'neighbours' END AS how FROM a0),
      r0 AS (SELECT a.question_id, a.anchor_id, a.how, c.chunk_id, c.position, c.page_start, c.page_end, {_BLOCK('a.anchor_id = c.chunk_id')} AS block FROM a JOIN ck c ON CASE how WHEN 'alone' THEN c.chunk_id = a.anchor_id WHEN 'section' THEN c.document_id = a.document_id AND c.section_title = a.section_title
             WHEN 'chapter' THEN c.document_id = a.document_id AND c.chapter_reference = a.chapter_reference WHEN 'neighbours' THEN c.parent_key = a.parent_key AND c.place BETWEEN a.place - 1 AND a.place + 1 ELSE c.parent_key = a.parent_key END),
      r AS (SELECT *, length(block) + 2 AS size, row_number() OVER (PARTITION BY question_id, anchor_id ORDER BY chunk_id <> anchor_id, position, chunk_id) AS i, count(*) OVER (PARTITION BY question_id, anchor_id) AS total FROM r0),
      f AS (SELECT question_id, anchor_id, i, size AS used, true AS fits FROM r WHERE i = 1 UNION ALL SELECT r.question_id, r.anchor_id, r.i, CASE WHEN f.used + r.size <= 6000 THEN f.used + r.size ELSE f.used END, f.used + r.size <= 6000 FROM f JOIN r ON r.question_id = f.question_id AND r.anchor_id = f.anchor_id AND r.i = f.i + 1)
      SELECT question_id, anchor_id, CASE WHEN how = 'unit' THEN 'normative_unit_list' WHEN how IN ('section', 'chapter') THEN 'overview_parent' ELSE 'default_parent' END AS strategy,
        CASE WHEN how IN ('section', 'chapter') THEN 'overview_expanded' WHEN how = 'alone' OR (how = 'neighbours' AND any_value(total) = 1) THEN 'anchor_only' ELSE 'expanded' END AS status,
        CASE how WHEN 'alone' THEN 'insufficient_parent_metadata' WHEN 'unit' THEN 'normative_unit_list_query' WHEN 'section' THEN 'overview_query_structural_group' WHEN 'chapter' THEN 'overview_query_structural_group' ELSE '' END AS reason,
        string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY i) AS included, min(page_start) AS page_start, max(coalesce(page_end, page_start)) AS page_end, md5(string_agg(block, chr(10) || chr(10) ORDER BY i)) AS text_hash
      FROM r JOIN f USING (question_id, anchor_id, i) WHERE fits GROUP BY question_id, anchor_id, how"""


ORACLE_SQL = {
    "diversity_order": f"""WITH {_RANKED}, dm AS (SELECT *, count(*) OVER o AS n, count(DISTINCT CASE WHEN topic > 0 THEN document_id END) OVER o AS matched, count(DISTINCT document_id) OVER o AS documents, arg_min(document_id, rank) FILTER (is_overview) OVER o AS lead FROM rk WINDOW o AS (PARTITION BY question_id)),
        dy AS (SELECT *, CASE WHEN n <= 1 THEN 'disabled_or_single_candidate' WHEN document_filter AND matched > 0 THEN 'intradocument_topic_contexts_promoted' WHEN document_filter THEN 'document_filter_present' WHEN specific THEN 'specific_document_mentioned'
          WHEN overview AND count(*) FILTER (document_id = lead) OVER (PARTITION BY question_id) > 1 THEN 'overview_same_document_contexts_promoted' WHEN matched >= 2 THEN 'topic_matched_one_context_per_document_promoted' WHEN documents <= 1 THEN 'single_document_available' ELSE 'no_relevant_alternative_document' END AS reason,
          row_number() OVER (PARTITION BY question_id, topic > 0 ORDER BY topic DESC, rs DESC, rank) AS ni, topic > 0 AND row_number() OVER (PARTITION BY question_id, document_id, topic > 0 ORDER BY rank) = 1 AS one FROM dm),
        dz AS (SELECT *, row_number() OVER (PARTITION BY question_id, one ORDER BY rs DESC, rank) AS no FROM dy),
        dp AS (SELECT *, coalesce(CASE WHEN reason LIKE 'intra%' THEN topic > 0 AND ni <= 4 WHEN reason LIKE 'overview%' THEN document_id = lead WHEN reason LIKE 'topic%' THEN one AND no <= 4 WHEN reason IN ('single_document_available', 'no_relevant_alternative_document') THEN topic > 0 END, false) AS promoted FROM dz)
        SELECT question_id, parent_key, reason, promoted, row_number() OVER (PARTITION BY question_id ORDER BY promoted DESC, CASE WHEN promoted AND reason NOT LIKE 'overview%' AND reason NOT LIKE 'topic%' THEN topic END DESC NULLS LAST, CASE WHEN promoted AND reason NOT LIKE 'overview%' THEN rs END DESC NULLS LAST, rank) AS rank FROM dp""",
    "scope_preference": f"""WITH {_RANKED}, sk AS (SELECT *, length(text) % 2 = 0 AS i, bool_or(length(text) % 2 = 0) OVER (PARTITION BY question_id) AS inside FROM rk)
        SELECT question_id, parent_key, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM sk WHERE NOT (inside AND NOT i AND priority = 'doctrinal')""",
    "budget_fit": f"""WITH RECURSIVE {_RANKED}, t AS (SELECT question_id, parent_key, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i, text AS raw,
          CASE WHEN i = 1 AND length(raw) > 3000 THEN regexp_replace(substr(raw, 1, 3000 - {len(vocab.TRUNCATION_MARK)}), '\\s+\\z', '') || '{vocab.TRUNCATION_MARK}' ELSE raw END AS text FROM rk),
        f AS (SELECT question_id, i, length(text) AS used, true AS fits FROM t WHERE i = 1 UNION ALL SELECT t.question_id, t.i, CASE WHEN f.used + length(t.text) <= 3000 THEN f.used + length(t.text) ELSE f.used END, f.used + length(t.text) <= 3000 FROM f JOIN t ON t.question_id = f.question_id AND t.i = f.i + 1)
        SELECT question_id, parent_key, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_hash FROM t JOIN f USING (question_id, i) WHERE fits""",
    "document_segments": f"""WITH {_SEG}, x AS (SELECT *, sum(CASE WHEN kind = 'chapter' THEN 1 ELSE 0 END) OVER o AS n, last_value(CASE WHEN kind = 'chapter' THEN {{'n': number, 't': title}} END IGNORE NULLS) OVER o AS ch FROM seg WINDOW o AS (PARTITION BY document_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        y AS (SELECT *, last_value(CASE WHEN kind = 'section' THEN {{'n': number, 't': title}} END IGNORE NULLS) OVER (PARTITION BY document_id, n ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS se FROM x)
        SELECT document_id, segment, kind, CASE WHEN kind = 'article' THEN number END AS number, ch.n AS chapter_number, se.n AS section_number, md5(concat_ws('|', ch.t, se.t)) AS titles_hash, first_line, last_line, md5(array_to_string(kept, chr(10))) AS text_hash
        FROM y WHERE kind IN ('preamble', 'article')""",
    "heading_titles": f"WITH {_SEG} SELECT document_id, segment, kind, number, md5(coalesce(title, '')) AS title_hash FROM seg WHERE kind IN ('chapter', 'section')",
    "boundaries": f"WITH {_SEG} SELECT document_id, coalesce(kind, 'none') AS kind, count(*) AS n FROM k GROUP BY ALL",
    "loose_headings": f"""WITH {_SEG}, r AS (SELECT document_id, unnest(kept) AS line FROM seg WHERE kind IS NULL OR kind IN ('chapter', 'section')) SELECT document_id, count(*) AS n, md5(string_agg(line, '|' ORDER BY line)) AS lines_hash FROM r WHERE {_UP} GROUP BY document_id""",
    "context_build": _built_sql(_bm25_sql(_ALL_DOCS, _BENCH, 5, "z")),
    "hierarchical_contexts": f"""SELECT x.question_id, x.anchor_id, rank, strategy, status, included, text_hash FROM ({_built_sql(f"zbm25 AS (WITH {_RERANK} SELECT question_id, chunk_id, rank FROM rr)")}) x
      JOIN (WITH {_RERANK} SELECT question_id, chunk_id AS anchor_id, rank FROM rr) y USING (question_id, anchor_id)""",
}
