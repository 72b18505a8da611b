"""Queries over structural parsing and the steps around retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import answers as A
from docengine.functions import text as T
from docengine.operators import lines as L
from docengine.operators import orchestration as O
from docengine.operators import retrieval as R
from docengine.operators import structure as S
from docengine.queries.common import DOCS, documents, sql_list, table
from docengine.queries.retrieval import _bm25_sql
from docengine.queries.texts import _LINES

NOTES = ("ver (Rm 3:21-24) e (cf. nota)", "(1 Co 2; Jo 3.16) (texto)", "sem nada", "(Sl 119) (Ap 2:1)")


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the texts, each behind a head that its length chooses; numbers are those of the line."""
    lines = L.flatten(documents(spark, sf_dir))
    n, i = F.length("line"), F.col("line_index").cast("string")
    head = F.when(n % 6 == 0, F.concat(F.lit("Art. "), i, F.lit("º – "))).when(n % 6 == 1, F.concat(F.lit("Art "), i, F.lit(". "))).when(n % 6 == 2, F.concat(F.lit("Art."), i, F.lit(" "))).when(n % 6 == 3, F.concat(F.lit("Artigo "), i, F.lit(" "))).otherwise(F.lit(""))
    return lines.withColumn("line", F.concat(head, "line"))


_HEADED = rf"""{_LINES}, headed AS (SELECT document_id, line_index, CASE length(line) % 6 WHEN 0 THEN 'Art. ' || line_index || 'º – ' WHEN 1 THEN 'Art ' || line_index || '. ' WHEN 2 THEN 'Art.' || line_index || ' ' WHEN 3 THEN 'Artigo ' || line_index || ' ' ELSE '' END || line AS line FROM lines)"""


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def article_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that the lines of each text open, and what follows their number."""
    d = _headed(spark, sf_dir).select("document_id", "line_index", S.article_heading(F.col("line")).alias("a")).where("a is not null")
    return d.select("document_id", "line_index", F.col("a.number").alias("number"), F.col("a.display").alias("display"), F.md5("a.remainder").alias("remainder_hash"))


def biblical_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in parentheses behind each text."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(S.biblical_references(F.concat_ws(" ", F.regexp_replace("text", "[()]", ""), _pick(NOTES, F.col("doc_id")))), ";").alias("found"))


def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.joined_paragraphs(L.flatten(documents(spark, sf_dir)), F.length("line") % 4 == 0)
    return p.select("document_id", "paragraph", F.md5("text").alias("text_hash"))


def pair_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.forward_pairs(L.flatten(documents(spark, sf_dir)), F.length("line") % 7 == 0, F.length("line") % 5 == 0)


def number_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each text's lines, cut to their first digit where a line's length is a multiple of 3 and 5 ahead where it is one of 11, repaired."""
    lines = L.flatten(documents(spark, sf_dir))
    place = F.row_number().over(L.ordered()) + F.when(F.length("line") % 11 == 0, 5).otherwise(0)
    seen = lines.withColumn("n", place.cast("string")).withColumn("n", F.when(F.length("line") % 3 == 0, F.substring("n", 1, 1)).otherwise(F.col("n")))
    d = seen.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "n"))), lambda x: x["n"]).alias("n"))
    return d.select("document_id", F.array_join(F.transform(S.repaired_numbers(F.col("n")), lambda x: x.cast("string")), ",").alias("numbers"))


def footnote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of odd length as markers and lines of a length that 3 divides as references, numbered in each text from 1 or, where its first line is long, from 2."""
    lines = L.flatten(documents(spark, sf_dir))
    place = F.row_number().over(L.ordered())
    long_ = F.first(F.length("line") > 200).over(L.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    m = lines.where("length(line) % 2 = 1").withColumn("position", place - 1).select("document_id", "position", (F.col("position") + 1).alias("marker"))
    r = lines.withColumn("_long", long_).where("length(line) % 3 = 0").withColumn("position", place - 1)
    r = r.select("document_id", "position", (F.col("position") + F.when(F.col("_long"), 2).otherwise(1)).alias("number"), F.md5("line").alias("reference"))
    return S.linked_notes(m, r).select("document_id", F.col("marker").cast("long").alias("marker"), "reference", "link")


def table_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table_rows(L.flatten(documents(spark, sf_dir)), 3).select("document_id", "row", F.md5("cells").alias("cells_hash"))


def article_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by id against chunks, of which some are missing or twice."""
    d = documents(spark, sf_dir).select(F.col("source").alias("document_id"), "doc_id", (F.col("doc_id") % 97).alias("article"))
    chunked = d.where("doc_id % 89 <> 0").select("document_id", "article").union(d.where("doc_id % 83 = 0").select("document_id", "article"))
    return S.article_audit(d.select("document_id", "article"), chunked)


def top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three short lines without a full stop of each text."""
    lines = L.flatten(documents(spark, sf_dir)).where((F.length("line") <= 90) & ~F.col("line").endswith("."))
    place = F.row_number().over(L.ordered())
    return lines.withColumn("place", place.cast("long")).where("place <= 3").select("document_id", "place", F.md5("line").alias("title_hash"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best chunks of each benchmark text as candidates."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "lang", F.length("text").cast("long").alias("n_chars"), (F.length("text") % 7).cast("long").alias("page"))
    d = d.withColumn("parent_key", F.concat_ws("::", "document_id", F.col("page").cast("string")))
    hits = R.bm25(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text"), 50)
    return hits.join(d, "chunk_id").withColumn("rank", F.col("rank").cast("long"))


def framing_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each question, and of the others the best of each parent that has none."""
    c = _candidates(spark, sf_dir)
    keys = ["question_id", "parent_key"]
    return O.supplemented(c.where("rank <= 10"), c.where("rank > 10 and lang = 'en'"), keys).select("question_id", "chunk_id", "rank")


def scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    scope = c.where("rank = 1 and question_id % 2 = 0").select("question_id", F.col("document_id").alias("scope_document"))
    return O.guarded(c.where("rank <= 20"), scope).select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "context_count", "total_chars")


def missing_source_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German candidates, else French ones, else any, of those over a length."""
    c = _candidates(spark, sf_dir).where("n_chars > 3000")
    tries = c.where("lang = 'de'").withColumn("attempt", F.lit(1)).union(c.where("lang = 'fr'").withColumn("attempt", F.lit(2))).union(c.withColumn("attempt", F.lit(3)))
    return O.first_attempt(tries).select("question_id", "chunk_id", F.col("attempt").cast("long").alias("attempt"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each language in turn."""
    c = _candidates(spark, sf_dir).where("rank <= 20").withColumn("roles", F.array("lang"))
    return O.by_roles(c, ["de", "en", "fr"], 3)


def source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.source_map(_candidates(spark, sf_dir))


def candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    final = c.groupBy("question_id", "parent_key").agg(F.min("rank").alias("rank")).where("rank <= 4")
    return O.candidate_audit(c.select("question_id", "parent_key", "chunk_id"), final).select("question_id", "chunk_id", F.coalesce("final_rank", F.lit(0)).alias("final_rank"), "selected")


def topic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic terms that each document shares with its question's best candidate; 1 where there are none."""
    t = documents(spark, sf_dir).select("doc_id", T.topic_terms("text").alias("terms"))
    c = _candidates(spark, sf_dir)
    q = c.where("rank = 1").select("question_id", F.col("chunk_id").alias("best")).join(t.select(F.col("doc_id").alias("best"), F.col("terms").alias("asked")), "best")
    found = c.select("question_id", "chunk_id").join(t, F.col("chunk_id") == F.col("doc_id")).join(q, "question_id")
    return found.select("question_id", "chunk_id", F.when(F.size("asked") == 0, 1).otherwise(F.size(F.array_intersect("asked", "terms"))).cast("long").alias("score"))


def joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    return d.select("source", O.joined_pt(F.col("langs")).alias("joined"))


def suggestion_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each conversation as a fenced JSON array of suggestions, as models give them."""
    c = table(spark, sf_dir, "conversations").withColumn("question", F.coalesce("text", F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "question"))), lambda x: F.struct(x["question"].alias("question")))
    content = F.concat(F.lit("```json\n"), F.to_json(listed), F.lit("\n```"))
    found = O.suggestions(c.groupBy(F.col("conv_id").alias("id")).agg(content.alias("content")))
    return found.select("id", "place", F.md5("question").alias("question_hash"))


def merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by position for records that are not skipped, one shard for each source."""
    r = documents(spark, sf_dir).select(F.col("source").alias("shard"), F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 5 == 0, "skipped").alias("skip_reason"))
    s = documents(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).select(F.col("source").alias("shard"), "place", F.when(F.col("place") % 6 == 0, float("nan")).otherwise(F.col("place") / 4).alias("score"))
    return O.merged_scores(r, s).select("shard", "position", F.coalesce("score", F.lit(-1.0)).alias("score"), "warning")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("total"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"))


def article_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text under markers that follow from their number, split into units."""
    i = F.col("line_index") % 6
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    marker = F.when(i == 1, made("paragraph", F.col("line_index").cast("string"))).when(i == 3, made("inciso", F.lit("I"))).when(i == 4, made("alinea", F.lit("a")))
    u = S.article_units(L.flatten(documents(spark, sf_dir)), marker)
    return u.select("document_id", "unit", "paragraph", "inciso", "alinea", F.md5("text").alias("text_hash"))


def answer_polish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of answers to open and closed questions."""
    d = documents(spark, sf_dir)
    q = _pick(("O que diz a confissão?", "A salvação pode ser perdida?", "Há requisitos?"), F.col("doc_id"))
    a = F.concat(_pick(("Sim. ", "Não, ", "**Sim** - "), F.floor(F.col("doc_id") / 3)), F.lit("os eleitos não podem decair. "), F.trim("text"))
    return d.select("doc_id", A.is_open_question(q).alias("open"), F.md5(A.without_opening(A.corrected_polarity(a, q), q)).alias("answer_hash"))


_FNS = (
    article_units, answer_polish, article_headings, biblical_references, joined_text, pair_forward, number_repair, footnote_links, table_layout, article_audit, top_titles, framing_antijoin, scope_guard, missing_source_retry, roles, source_map, candidate_audit,
    topic_match, joined_lists, suggestion_parse, merged_scores, run_summary,
)
QUERIES = {f.__name__: f for f in _FNS}

_CAND = f"""{_bm25_sql(f"SELECT doc_id, text FROM ({DOCS})", "SELECT item_id AS question_id, text FROM benchmark", 50, "z")},
    c AS (SELECT question_id, chunk_id, source AS document_id, lang, CAST(length(text) AS BIGINT) AS n_chars, length(text) % 7 AS page, source || '::' || length(text) % 7 AS parent_key, rank FROM zbm25 JOIN ({DOCS}) d ON d.doc_id = chunk_id)"""

ORACLE_SQL = {
    "article_units": f"""WITH {_LINES}, m AS (SELECT *, line_index % 6 AS i FROM lines),
        w AS (SELECT *, CAST(sum(CASE WHEN i IN (1, 3, 4) THEN 1 ELSE 0 END) OVER o AS BIGINT) AS unit, sum(CASE WHEN i = 1 THEN 1 ELSE 0 END) OVER o AS p, sum(CASE WHEN i IN (1, 3) THEN 1 ELSE 0 END) OVER o AS q,
          last_value(CASE WHEN i = 1 THEN CAST(line_index AS VARCHAR) END IGNORE NULLS) OVER o AS paragraph FROM m WINDOW o AS (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        v AS (SELECT *, last_value(CASE WHEN i = 3 THEN 'I' END IGNORE NULLS) OVER (PARTITION BY document_id, p ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inciso,
          last_value(CASE WHEN i = 4 THEN 'a' END IGNORE NULLS) OVER (PARTITION BY document_id, q ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alinea FROM w)
        SELECT document_id, unit, min(paragraph) AS paragraph, min(inciso) AS inciso, min(alinea) AS alinea, md5(string_agg(line, ' ' ORDER BY line_index)) AS text_hash FROM v GROUP BY document_id, unit""",
    "answer_polish": rf"""WITH d AS (SELECT doc_id, doc_id % 3 AS q, (doc_id // 3) % 3 AS a, 'os eleitos não podem decair. ' || trim(text) AS rest FROM ({DOCS})),
        p AS (SELECT doc_id, q = 0 AS open, CASE WHEN q = 1 THEN ['Não. ', 'Não, ', '**Não** - '][a + 1] ELSE ['Sim. ', 'Não, ', '**Sim** - '][a + 1] END AS o, a, rest FROM d)
        SELECT doc_id, open, md5(CASE WHEN open THEN regexp_replace(CASE WHEN a < 2 THEN rest ELSE o || rest END, '\A\s+|\s+\z', '', 'g') ELSE o || rest END) AS answer_hash FROM p""",
    "article_headings": rf"""WITH {_HEADED}, m AS (SELECT document_id, line_index, regexp_extract(line, '^Art\.?\s*([0-9]+)([º°]?)(?:\.\s*|\s*[–—-]\s*|\s+([A-ZÁÉÍÓÚÂÊÔÃÕ]))(.*)$', ['n', 'o', 'capital', 'rest']) AS x FROM headed)
        SELECT document_id, line_index, x.n AS number, 'Art. ' || x.n || x.o AS display, md5(trim(x.capital || x.rest)) AS remainder_hash FROM m WHERE x.n <> ''""",
    "biblical_references": f"""WITH d AS (SELECT doc_id, concat_ws(' ', regexp_replace(text, '[()]', '', 'g'), {sql_list(NOTES)}[doc_id % 4 + 1]) AS t FROM ({DOCS}))
        SELECT doc_id, array_to_string(list_filter(regexp_extract_all(t, '\\(([^)]*)\\)', 1), lambda x: regexp_matches(x, '(?i)\\b([1-3]\\s*)?(rm|co|jo|sl|ap)\\.?\\s*[0-9]+')), ';') AS found FROM d""",
    "joined_text": f"""WITH {_LINES}, s AS (SELECT *, CAST(sum(CASE WHEN length(line) % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS paragraph FROM lines)
        SELECT document_id, paragraph, md5(trim(string_agg(CASE WHEN line LIKE '%-' THEN left(line, -1) ELSE line || ' ' END, '' ORDER BY line_index))) AS text_hash FROM s GROUP BY document_id, paragraph""",
    "pair_forward": f"""WITH {_LINES}, n AS (SELECT *, min(CASE WHEN length(line) % 5 = 0 THEN line_index END) OVER (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r, max(line_index) OVER (PARTITION BY document_id) AS last FROM lines)
        SELECT a.document_id, a.line_index AS left_index, a.r AS right_index, coalesce((SELECT min(b.line_index) FROM lines b WHERE b.document_id = a.document_id AND length(b.line) % 7 = 0 AND b.line_index > a.r), any_value(a.last) + 1) - 1 AS end_index
        FROM n a WHERE length(a.line) % 7 = 0 AND a.r IS NOT NULL GROUP BY a.document_id, a.line_index, a.r""",
    "number_repair": f"""WITH RECURSIVE {_LINES}, k AS (SELECT document_id, length(line) AS len, row_number() OVER (PARTITION BY document_id ORDER BY line_index) AS i FROM lines),
        n AS (SELECT document_id, i, CASE WHEN len % 3 = 0 THEN left(CAST(x AS VARCHAR), 1) ELSE CAST(x AS VARCHAR) END AS n FROM (SELECT *, i + CASE WHEN len % 11 = 0 THEN 5 ELSE 0 END AS x FROM k)),
        r AS (SELECT document_id, i, CAST(n AS BIGINT) AS v FROM n WHERE i = 1
              UNION ALL SELECT n.document_id, n.i, CASE WHEN starts_with(CAST(r.v + 1 AS VARCHAR), n.n) THEN r.v + 1 ELSE CAST(n.n AS BIGINT) END FROM r JOIN n ON n.document_id = r.document_id AND n.i = r.i + 1)
        SELECT document_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS numbers FROM r GROUP BY document_id""",
    "footnote_links": f"""WITH {_LINES}, l AS (SELECT *, first_value(length(line) > 200) OVER (PARTITION BY document_id ORDER BY line_index) AS long FROM lines),
        m AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line_index) AS marker FROM l WHERE length(line) % 2 = 1),
        r AS (SELECT document_id, md5(line) AS reference, row_number() OVER (PARTITION BY document_id ORDER BY line_index) AS p, p + CASE WHEN long THEN 1 ELSE 0 END AS number FROM l WHERE length(line) % 3 = 0),
        k AS (SELECT a.document_id, CASE WHEN b.n IS NULL THEN 'number' WHEN a.s = b.s THEN 'exact' WHEN a.n = b.n THEN 'position' ELSE 'number' END AS kind
              FROM (SELECT document_id, list(marker ORDER BY marker) AS s, count(*) AS n FROM m GROUP BY 1) a LEFT JOIN (SELECT document_id, list(number ORDER BY number) AS s, count(*) AS n FROM r GROUP BY 1) b USING (document_id))
        SELECT m.document_id, m.marker, r.reference, CASE WHEN kind = 'position' THEN 'position_inferred_number_mismatch' WHEN r.reference IS NULL THEN 'missing_source_reference' ELSE 'exact' END AS link
        FROM m JOIN k USING (document_id) LEFT JOIN r ON r.document_id = m.document_id AND CASE WHEN kind = 'position' THEN r.p ELSE r.number END = m.marker""",
    "table_layout": f"""WITH {_LINES}, p AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY line_index) - 1) // 3 AS row FROM lines)
        SELECT document_id, row, md5(string_agg(line, ' | ' ORDER BY line_index)) AS cells_hash FROM p GROUP BY document_id, row""",
    "article_audit": """WITH d AS (SELECT source AS document_id, doc_id, doc_id % 97 AS article FROM documents), k AS (SELECT document_id, article FROM d WHERE doc_id % 89 <> 0 UNION ALL SELECT document_id, article FROM d WHERE doc_id % 83 = 0),
        e AS (SELECT document_id, article, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT DISTINCT document_id, article FROM d),
        x AS (SELECT t.document_id, count(*) AS n_detected, count(e.n) AS n_chunked, count(*) FILTER (e.n IS NULL) AS n_missing, count(*) FILTER (e.n > 1) AS n_duplicate FROM t LEFT JOIN e USING (document_id, article) GROUP BY t.document_id)
        SELECT *, CASE WHEN n_missing > 0 THEN 'FAIL' WHEN n_duplicate > 0 THEN 'PARTIAL' ELSE 'PASS' END AS status FROM x""",
    "top_titles": f"""WITH {_LINES} SELECT document_id, place, md5(line) AS title_hash FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_index) AS place FROM lines WHERE length(line) <= 90 AND line NOT LIKE '%.') WHERE place <= 3""",
    "framing_antijoin": f"""WITH {_CAND}, f AS (SELECT * FROM c WHERE rank <= 10) SELECT question_id, chunk_id, rank FROM f UNION ALL SELECT question_id, chunk_id, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id, parent_key ORDER BY rank) AS n FROM c WHERE rank > 10 AND lang = 'en' AND NOT EXISTS (SELECT 1 FROM f WHERE f.question_id = c.question_id AND f.parent_key = c.parent_key)) WHERE n = 1""",
    "scope_guard": f"""WITH {_CAND}, s AS (SELECT question_id, document_id AS d FROM c WHERE rank = 1 AND question_id % 2 = 0), k AS (SELECT c.* FROM c LEFT JOIN s USING (question_id) WHERE c.rank <= 20 AND (s.d IS NULL OR s.d = c.document_id))
        SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, count(*) OVER (PARTITION BY question_id) AS context_count, CAST(sum(n_chars) OVER (PARTITION BY question_id) AS BIGINT) AS total_chars FROM k""",
    "missing_source_retry": f"""WITH {_CAND}, k AS (SELECT *, CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS a FROM c WHERE n_chars > 3000), m AS (SELECT *, min(a) OVER (PARTITION BY question_id) AS attempt FROM k)
        SELECT question_id, chunk_id, CAST(attempt AS BIGINT) AS attempt FROM m WHERE attempt = 3 OR a = attempt""",
    "roles": f"""WITH {_CAND}, k AS (SELECT * FROM c WHERE rank <= 20), a AS (SELECT question_id, 'de' AS role, arg_min(chunk_id, rank) AS chunk_id, arg_min(document_id, rank) AS document_id FROM k WHERE lang = 'de' GROUP BY question_id),
        b AS (SELECT question_id, 'en' AS role, arg_min(chunk_id, rank) AS chunk_id, arg_min(document_id, rank) AS document_id FROM k WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM a WHERE a.question_id = k.question_id AND a.document_id = k.document_id) GROUP BY question_id),
        d AS (SELECT question_id, 'fr' AS role, arg_min(chunk_id, rank) AS chunk_id, arg_min(document_id, rank) AS document_id FROM k WHERE lang = 'fr' AND NOT EXISTS (SELECT 1 FROM a WHERE a.question_id = k.question_id AND a.document_id = k.document_id)
          AND NOT EXISTS (SELECT 1 FROM b WHERE b.question_id = k.question_id AND b.document_id = k.document_id) GROUP BY question_id)
        SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d""",
    "source_map": f"WITH {_CAND} SELECT question_id, 'source_' || rank AS source, concat('[', rank, '] ', document_id, ', p. ', page, '.') AS label FROM c WHERE rank <= 8",
    "candidate_audit": f"""WITH {_CAND}, f AS (SELECT question_id, parent_key, min(rank) AS r FROM c GROUP BY ALL HAVING min(rank) <= 4) SELECT question_id, chunk_id, coalesce(r, 0) AS final_rank, r IS NOT NULL AS selected FROM c LEFT JOIN f USING (question_id, parent_key)""",
    "joined_lists": "SELECT source, CASE WHEN len(l) < 2 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' e ' || l[-1] END AS joined FROM (SELECT source, list_sort(list(DISTINCT lang)) AS l FROM documents GROUP BY source)",
    "suggestion_parse": r"""WITH q AS (SELECT conv_id AS id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS question FROM conversations),
        o AS (SELECT id, question, turn FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(question) ORDER BY turn) AS n FROM q WHERE question <> '') WHERE n = 1)
        SELECT id, place, md5(substr(question, 1, 220)) AS question_hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS place FROM o) WHERE place <= 3""",
    "merged_scores": """WITH r AS (SELECT source AS shard, doc_id AS position, doc_id % 5 = 0 AS skip, row_number() OVER (PARTITION BY source, doc_id % 5 = 0 ORDER BY doc_id) AS place FROM documents)
        SELECT shard, position, CASE WHEN skip OR place % 6 = 0 THEN -1.0::DOUBLE ELSE place / 4.0::DOUBLE END AS score, CASE WHEN NOT skip AND place % 6 = 0 THEN 'missing_score' END AS warning FROM r""",
    "run_summary": "SELECT role, count(*) AS total, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn FROM conversations GROUP BY role",
}
ORACLE_SQL["topic_match"] = f"""WITH {_CAND}, t AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(f, '\\w+'), lambda x: length(x) >= 4 AND NOT list_contains({sql_list(T.vocab.TOPIC_STOPWORDS)}, x)), lambda x: CASE WHEN length(x) > 5 THEN regexp_replace(x, 's$', '') ELSE x END)) AS k
      FROM (SELECT doc_id, regexp_replace(translate(lower(text), '{T.vocab.ACCENTED}', '{T.vocab.PLAIN}'), '[^\\x00-\\x7F]', '', 'g') AS f FROM ({DOCS}))),
    q AS (SELECT question_id, k AS asked FROM c JOIN t ON t.doc_id = c.chunk_id WHERE rank = 1)
    SELECT question_id, chunk_id, CAST(CASE WHEN len(asked) = 0 THEN 1 ELSE len(list_intersect(asked, k)) END AS BIGINT) AS score FROM c JOIN t ON t.doc_id = c.chunk_id JOIN q USING (question_id)"""
