"""Queries over the contexts of answers: roles that they cover, citations, package texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.text import page_span
from docengine.operators import citations as C
from docengine.operators import coverage as V
from docengine.operators.consolidation import pruned
from docengine.queries.chunks import _parents
from docengine.queries.common import documents, sql_fold, sql_list
from docengine.queries.retrieval import _ALL_DOCS, _PRUNED, _benchmark, _groups

#: What a context's text is followed by, and the type its document has, by the length of its first text.
ADDED = ("", " A igreja e o governo.", " Constituição, regimento e confissão.", " Palavra e normas.", " Código de ética.")
TYPES = ("constitution", "internal_regiment", "normative_ethics", "administrative_resolution", "confession_of_faith", "letter", "catechism")


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of the benchmark texts with the text of their first chunk, roles and what the roles are chosen by."""
    one = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    texts = documents(spark, sf_dir).withColumn("n", F.length("text")).select(F.col("doc_id").alias("chunk_id"), "n", F.concat("text", one(ADDED, F.col("n"))).alias("text"), one(TYPES, F.col("n")).alias("document_type"))
    r = pruned(_groups(spark, sf_dir)).withColumn("chunk_id", F.col("chunk_ids")[0]).join(texts, "chunk_id")
    title = F.concat(F.lit("Documento "), "document_id")
    r = r.withColumn("bridge", V.bridge_score(title, F.col("text"))).withColumn("inventory", V.inventory_count(title, F.col("text"))).withColumn("unit_match", (F.col("n") % 3 == 0).cast("int"))
    role = V.coverage_role(F.col("inventory"), F.col("document_type") == "confession_of_faith", F.col("document_type"), F.when(F.col("document_type") == "letter", "denominational_normative_document"), F.col("priority"))
    return r.withColumn("role", role)


def coverage_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).select("question_id", "parent_key", "role", F.col("bridge").cast("long").alias("bridge"), F.col("inventory").cast("long").alias("inventory"))


def _promoted(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = V.promoted_by_role(_covered(spark, sf_dir), kind, 4, 300)
        return p.select("question_id", "parent_key", "reason", "promoted", F.length("text").cast("long").alias("n_chars"), F.col("rank").cast("long").alias("rank"))

    return query


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contexts of the benchmark texts, their chunks, and citations of the first eight: some of a chunk, some of all, some of a source that is not there."""
    c = _covered(spark, sf_dir).withColumn("full_reference", F.when(F.col("n") % 4 == 0, F.concat(F.lit("Ref "), "document_id")))
    p = _parents(spark, sf_dir)
    size = F.length("text")
    chunks = p.select("chunk_id", "text", F.when(size % 3 == 0, F.concat(F.lit("Art. "), "article_number")).alias("full_reference"), F.when(size % 2 == 0, (size % 5).cast("string")).alias("paragraph_number"), "article_number")
    cites = c.where("rank <= 8").select(
        "question_id", F.col("rank").cast("long").alias("place"), F.concat(F.lit("source_"), F.when(F.col("n") % 11 == 0, 999).otherwise(F.col("rank")).cast("string")).alias("source_id"),
        F.when(F.col("n") % 2 == 0, F.slice("chunk_ids", 1, 1)).otherwise(F.array().cast("array<bigint>")).alias("included_chunk_ids"), F.when(F.col("n") % 3 > 0, F.col("document_id")).otherwise("").alias("document_id"), F.when(F.col("n") % 5 > 0, F.col("document_id")).alias("document"),
    )
    return c, chunks, cites


def citation_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, chunks, cites = _cited(spark, sf_dir)
    e = C.enriched(cites, c, chunks)
    shown = F.array_join(F.transform("chunk_texts", lambda x: F.concat(x["chunk_id"].cast("string"), F.lit(":"), x["text"])), "|")
    return e.select("question_id", "place", "source_id", "parent_key", "context_status", "content_priority", F.when(F.col("parent_key").isNotNull(), page_span("page_start", "page_end")).alias("pages"), "structural_reference", F.size(F.coalesce("chunk_texts", F.array())).alias("n_texts"), F.md5(F.coalesce(shown, F.lit(""))).alias("texts_hash"))


def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind the citations of each benchmark text; the text's own id where there are none."""
    q = _benchmark(spark, sf_dir).select("question_id", F.array(F.concat(F.lit("q"), F.col("question_id").cast("string"))).alias("fallback"))
    d = C.cited_documents(q, _cited(spark, sf_dir)[2])
    return d.select("question_id", F.array_join("documents", ",").alias("documents"))


def package_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best contexts of each benchmark text as one text."""
    c = _covered(spark, sf_dir).where("rank <= 4").join(_benchmark(spark, sf_dir).select("question_id", F.col("text").alias("query")), "question_id")
    c = c.select(
        "question_id", "query", "rank", F.concat(F.lit("Documento "), "document_id").alias("document"), "priority", F.when(F.col("n") % 2 == 0, F.concat(F.lit("Unidade "), F.col("n").cast("string"))).otherwise("").alias("title"), "parent_key",
        F.when(F.col("n") % 3 == 0, "Art. 1").alias("full_reference"), "page_start", "page_end", F.slice("chunk_ids", 1, 1).alias("anchors"), F.col("chunk_ids").alias("included"), "status", "text",
    )
    t = C.package_text(c)
    return t.select("question_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_hash"))


QUERIES = {
    "coverage_roles": coverage_roles, "bridge_promotion": _promoted("bridge"), "inventory_promotion": _promoted("inventory"), "citation_enrich": citation_enrich, "cited_documents": cited_documents, "package_texts": package_texts,
}

_SHOWN = lambda n: sql_fold(f"'Documento ' || document_id || ' ' || substr(text, 1, {n})")
_SUM = lambda weighted: " + ".join(f"CASE WHEN regexp_matches(fold, '{p}') THEN {w} ELSE 0 END" for p, w in weighted)
_COVERED = f"""{_PRUNED}, cv0 AS (SELECT pr.*, length(t.text) AS n, t.text || {sql_list(ADDED)}[length(t.text) % {len(ADDED)} + 1] AS text, {sql_list(TYPES)}[length(t.text) % {len(TYPES)} + 1] AS document_type FROM pr JOIN ({_ALL_DOCS}) t ON t.doc_id = ids[1]),
    cv1 AS (SELECT *, {_SUM(V.BRIDGE_WEIGHTS)} AS bridge FROM (SELECT *, {_SHOWN(3000)} AS fold FROM cv0)),
    cv2 AS (SELECT *, {_SUM([(p, 1) for p in V.INVENTORY_TERMS])} AS inventory FROM (SELECT * REPLACE ({_SHOWN(4000)} AS fold) FROM cv1)),
    cv AS (SELECT *, CASE WHEN inventory >= 3 THEN 'document_inventory' WHEN document_type = 'confession_of_faith' THEN 'alliance_confession' WHEN list_contains({sql_list(V.TYPE_ROLES)}, document_type) THEN document_type
      WHEN document_type = 'letter' THEN 'other_normative' WHEN priority = 'doctrinal' THEN 'other_doctrinal' ELSE 'other' END AS role FROM cv2)"""


def _promoted_sql(kind: str, roles: tuple[str, ...], done: str, lack: str) -> str:
    first = "bridge DESC, CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END DESC, " if kind == "bridge" else ""
    both = " AND bool_or(seat IS NOT NULL AND role = 'alliance_confession') OVER w AND bool_or(seat IS NOT NULL AND role IN ('constitution', 'internal_regiment', 'normative_ethics', 'administrative_resolution')) OVER w" if kind == "bridge" else ""
    return f"""WITH RECURSIVE {_COVERED}, li AS (SELECT question_id, list({{'r': rank, 'd': document_id, 'a': role, 'b': document_type}} ORDER BY {first}inventory DESC, rs DESC, rank) AS l FROM cv GROUP BY question_id),
        st AS (SELECT question_id, 0 AS step, l, l[1:0] AS picks, [0][1:0] AS seats FROM li UNION ALL
          SELECT question_id, step + 1, l, CASE WHEN x IS NULL OR len(picks) >= 4 THEN picks ELSE list_append(picks, x) END, CASE WHEN x IS NULL OR len(picks) >= 4 THEN seats ELSE list_append(seats, step + 1) END FROM
            (SELECT *, list_filter(l, lambda e: (e.a = {sql_list(roles)}[step + 1] OR (list_contains({sql_list(V.TYPE_ROLES)}, e.b) AND e.b = {sql_list(roles)}[step + 1])) AND NOT list_contains(list_transform(picks, lambda p: p.d), e.d))[1] AS x FROM st WHERE step < {len(roles)})),
        pk AS (SELECT question_id, unnest(list_transform(picks, lambda p: p.r)) AS rank, unnest(seats) AS seat FROM st WHERE step = {len(roles)}),
        m AS (SELECT *, count(seat) OVER w >= 2{both} AS applied FROM (SELECT cv.*, pk.seat FROM cv LEFT JOIN pk USING (question_id, rank)) WINDOW w AS (PARTITION BY question_id)),
        o AS (SELECT *, coalesce(applied, false) AND seat IS NOT NULL AS promoted, '\n\n[TRUNCADO POR LIMITE DE CONTEXTO]' AS mark FROM m)
        SELECT question_id, parent_key, CASE WHEN applied THEN '{done}' ELSE '{lack}' END AS reason, promoted, length(CASE WHEN promoted AND length(text) > 300 THEN regexp_replace(substr(text, 1, 300 - length(MARK)), '\\s+\\z', '') || MARK ELSE text END) AS n_chars,
          row_number() OVER (PARTITION BY question_id ORDER BY promoted DESC, CASE WHEN promoted THEN seat END, rank) AS rank FROM o"""


_PT = lambda v: f"CASE len({v}) WHEN 1 THEN {v}[1] ELSE array_to_string({v}[:-2], ', ') || ' e ' || {v}[-1] END"
_ONCE = lambda x: f"list_transform(list_sort(list_filter(list(DISTINCT {{'p': {x}_at, 'v': {x}}}), lambda e: e.v IS NOT NULL)), lambda e: e.v)"
_CITES = """ci AS (SELECT question_id, rank AS place, 'source_' || CASE WHEN n % 11 = 0 THEN 999 ELSE rank END AS source_id, CASE WHEN n % 2 = 0 THEN ids[1:1] ELSE [] END AS allowed, CASE WHEN n % 3 > 0 THEN document_id ELSE '' END AS d, CASE WHEN n % 5 > 0 THEN document_id END AS dd FROM cv WHERE rank <= 8)"""
_DOC = "coalesce(nullif(d, ''), dd, '')"

ORACLE_SQL = {
    "coverage_roles": f"WITH {_COVERED} SELECT question_id, parent_key, role, CAST(bridge AS BIGINT) AS bridge, CAST(inventory AS BIGINT) AS inventory FROM cv",
    "bridge_promotion": _promoted_sql("bridge", V.BRIDGE_ROLES, "institutional_doctrinal_bridge_coverage_promoted", "insufficient_doctrinal_normative_coverage"),
    "inventory_promotion": _promoted_sql("inventory", V.INVENTORY_ROLES, "document_inventory_coverage_promoted", "insufficient_document_inventory_coverage"),
    "citation_enrich": f"""WITH {_COVERED}, {_CITES}, ex AS (SELECT question_id, rank, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS place FROM cv),
        ch AS (SELECT ex.*, trim(text) AS text, CASE WHEN length(text) % 3 = 0 THEN 'Art. ' || article_number END AS r, CASE WHEN length(text) % 2 = 0 THEN CAST(length(text) % 5 AS VARCHAR) END AS g, article_number AS a FROM ex JOIN p USING (chunk_id)),
        fi AS (SELECT *, min(place) OVER (PARTITION BY question_id, rank, r) AS r_at, min(place) OVER (PARTITION BY question_id, rank, g) AS g_at, min(place) OVER (PARTITION BY question_id, rank, a) AS a_at FROM ch),
        rf AS (SELECT question_id, rank, {_ONCE('r')} AS rs_, {_ONCE('g')} AS gs, {_ONCE('a')} AS aa FROM fi GROUP BY ALL),
        nm AS (SELECT cv.question_id, 'source_' || cv.rank AS source_id, cv.rank AS crank, parent_key, status, priority, page_start, page_end, CASE WHEN n % 4 = 0 THEN 'Ref ' || document_id WHEN len(rs_) > 0 THEN {_PT('rs_')} WHEN len(gs) > 0 THEN CASE WHEN len(gs) = 1 THEN 'Parágrafo ' ELSE 'Parágrafos ' END || {_PT('gs')}
          WHEN len(aa) > 0 THEN CASE WHEN len(aa) = 1 THEN 'Artigo ' ELSE 'Artigos ' END || {_PT('aa')} END AS structural_reference FROM cv JOIN rf USING (question_id, rank)),
        tx AS (SELECT ci.question_id, ci.place, count(*) AS n_texts, string_agg(ch.chunk_id || ':' || ch.text, '|' ORDER BY ch.place) AS t FROM ci JOIN nm USING (question_id, source_id) JOIN ch ON ch.question_id = ci.question_id AND ch.rank = crank WHERE (len(allowed) = 0 OR list_contains(allowed, ch.chunk_id)) AND ch.text <> '' GROUP BY ALL)
        SELECT ci.question_id, ci.place, ci.source_id, parent_key, status AS context_status, priority AS content_priority, CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '-' || page_end END AS pages, structural_reference, CAST(coalesce(n_texts, 0) AS INTEGER) AS n_texts, md5(coalesce(t, '')) AS texts_hash
        FROM ci LEFT JOIN nm USING (question_id, source_id) LEFT JOIN tx ON tx.question_id = ci.question_id AND tx.place = ci.place""",
    "cited_documents": f"""WITH {_COVERED}, {_CITES}, f0 AS (SELECT question_id, {_DOC} AS x, min(place) AS p FROM ci WHERE {_DOC} <> '' GROUP BY ALL), fs AS (SELECT question_id, string_agg(x, ',' ORDER BY p) AS xs FROM f0 GROUP BY question_id)
        SELECT item_id AS question_id, coalesce(xs, 'q' || item_id) AS documents FROM benchmark LEFT JOIN fs ON fs.question_id = item_id""",
    "package_texts": rf"""WITH {_COVERED}, u AS (SELECT cv.*, b.text AS query, CASE WHEN n % 2 = 0 THEN 'Unidade ' || n ELSE parent_key END AS unit FROM cv JOIN benchmark b ON b.item_id = question_id WHERE rank <= 4),
        bl AS (SELECT question_id, query, rank, concat_ws(chr(10), '[FONTE ' || rank || ']', 'Documento: Documento ' || document_id, 'Tipo de fonte: ' || priority, 'Unidade: ' || unit, 'Referência: ' || CASE WHEN n % 3 = 0 THEN 'Art. 1' ELSE unit END,
          'Páginas: ' || CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '-' || page_end END, 'Chunks âncora: ' || ids[1], 'Chunks incluídos: ' || array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ', '), 'Status: ' || status,
          'Prioridade de conteúdo: ' || priority, '', 'Texto:', text, '') AS block FROM u),
        t AS (SELECT question_id, regexp_replace('{C.PACKAGE_HEAD}' || chr(10) || chr(10) || 'Pergunta: ' || coalesce(query, '') || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY rank), '\A\s+|\s+\z', '', 'g') AS text FROM bl GROUP BY question_id, query)
        SELECT question_id, length(text) AS n_chars, md5(text) AS text_hash FROM t""",
}
