"""Queries over paragraphs with notes, references and chunk records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import lines as L
from docengine.operators import notes as N
from docengine.operators import records as R
from docengine.operators import segments as G
from docengine.operators.structure import BOOKS
from docengine.queries.chunks import _C
from docengine.queries.common import chunk_rows, documents, sql_list
from docengine.queries.contexts import _SEG, _made
from docengine.queries.texts import _LINES


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the texts; by its length a line opens a paragraph, or has references before or behind it."""
    lines = L.flatten(documents(spark, sf_dir)).withColumn("_n", F.length("line"))
    n, i = F.col("_n"), F.col("line_index") % 90 + 1
    s = lambda x: x.cast("string")
    opening = F.concat(s(i), F.lit(". Gn "), s(n % 20 + 1), F.lit(":1 "), F.trim(F.substring("line", 1, 15)))
    inner = F.concat(F.trim(F.substring("line", 1, 30)), F.lit(" "), s(i), F.lit(". Jo "), s(n % 9 + 1), F.lit(":16 "), s(i + 1), F.lit(". 1Pe 2:"), s(n % 9))
    made = lines.withColumn("line", F.when(n % 7 == 0, opening).when(n % 7 == 1, inner).otherwise(F.col("line")))
    return L.segmented(made, n % 4 == 0, "paragraph").drop("_n")


def note_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the body of each paragraph ends."""
    return N.body_and_notes(_noted(spark, sf_dir)).groupBy("document_id", "paragraph", "part").agg(F.count("*").alias("n_lines"), F.min("line_index").alias("first_line"), F.sum(F.length("line")).alias("n_chars"))


def footnote_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = N.footnotes(N.body_and_notes(_noted(spark, sf_dir)))
    return f.select("document_id", "paragraph", "place", "marker", F.md5("reference").alias("reference_hash"))


def paragraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with their references listed below."""
    t = N.with_notes(N.body_and_notes(_noted(spark, sf_dir)))
    return t.select("document_id", "paragraph", "n_notes", F.md5("text").alias("text_hash"))


def full_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of preambles and articles, in each of the four styles in turn."""
    p = G.in_context(G.segments(_made(spark, sf_dir)))
    n = F.length(F.array_join("lines", ""))
    p = p.select(
        "document_id", "segment", F.col("kind").alias("structure_type"), "chapter_number", "chapter_title", "section_number", "section_title", F.col("title").alias("subsection_title"),
        F.when(F.col("kind") == "article", F.concat(F.lit("Art. "), "number")).alias("article_display"), F.when(n % 3 == 0, "único").when(n % 3 == 1, (n % 9 + 1).cast("string")).alias("paragraph_number"),
        F.when(n % 2 == 0, "II").alias("inciso"), F.when(n % 5 == 0, "b").otherwise("").alias("alinea"), F.element_at(F.array(*map(F.lit, STYLES)), (n % 4 + 1).cast("int")).alias("style"),
    )
    return p.select("document_id", "segment", F.md5(R.full_reference(F.concat(F.lit("Documento "), F.col("document_id").cast("string")), F.col("style"))).alias("reference_hash"))


STYLES = ("chapters", "titles", "paragraphs", "resolution")


def metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without some of their metadata; which ones depends on their length."""
    c, n = chunk_rows(spark, sf_dir), F.length("text")
    lacking = lambda m, value: F.when(n % m == 0, None).when(n % m == 1, "").otherwise(value)
    c = c.select(
        "chunk_id", lacking(5, F.col("document_id")).alias("document_id"), F.when(n % 5 < 2, F.concat("document_id", F.lit(" "))).alias("doc_id"), lacking(3, F.concat(F.lit("Texto "), F.col("lang"))).alias("document"), lacking(4, F.col("lang")).alias("document_title"),
        "document_type", F.when(n % 2 == 0, "corpus\\normative\\a").otherwise("corpus/a").alias("source_path"), lacking(6, F.lit("doctrinal_document")).alias("source_category"), lacking(7, F.lit("outra")).alias("denomination"), lacking(3, F.lit("batista")).alias("tradition"),
        F.upper("lang").alias("tradition_branch"), lacking(2, F.lit("")).alias("full_reference"), lacking(3, F.lit("S 1")).alias("section_reference"), lacking(4, F.lit("C 2")).alias("chapter_reference"), lacking(5, F.lit("Secao")).alias("section_title"),
        F.lit("Capitulo").alias("chapter_title"), lacking(3, F.lit("tabela")).alias("document_structure_type"), "chunk_type", F.when(n % 2 == 0, F.array(F.lit("Gn 1"))).alias("biblical_references"), F.lit(False).alias("is_doctrinal"),
        F.when(n % 3 == 0, "normative").otherwise("contextual").alias("content_role"),
    )
    return R.with_defaults(c).select("chunk_id", "document_id", "doc_id", "document", "document_title", "source_category", "denomination", "tradition", "full_reference", "document_structure_type", F.size("biblical_references").alias("n_references"), "is_doctrinal", "content_role")


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document's chunks; over 2,000 characters they count as long."""
    c = R.chunk_counts(chunk_rows(spark, sf_dir), 2000)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("chunk_types")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return c.withColumn("chunk_types", shown).select("document_id", "chunk_count", "chunk_types", "long_chunks", F.col("most_chars").cast("long").alias("most_chars"), "article_count")


def consolidation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with words in the corpus against all that their documents have."""
    rows = chunk_rows(spark, sf_dir)
    made = rows.groupBy("document_id").agg(F.count("*").alias("expected_count"))
    return R.consolidated(R.chunk_counts(rows.where("text rlike '[a-z]'")), made)


_FNS = (note_parts, footnote_parse, paragraph_text, full_references, metadata_defaults, chunk_summary, consolidation_check)
QUERIES = {f.__name__: f for f in _FNS}

_OPEN = rf"(?i)^([0-9]{{1,3}})\.\s*({BOOKS}\.?\s*[0-9].*)$"
_IN = rf"(?i)\s+([0-9]{{1,3}})\.\s*({BOOKS}\.?\s*[0-9])"
_OVER = "PARTITION BY document_id, paragraph"
_NOTED = rf"""{_LINES}, l AS (SELECT *, length(line) AS n, line_index % 90 + 1 AS i FROM lines),
    made AS (SELECT document_id, line_index, CASE n % 7 WHEN 0 THEN i || '. Gn ' || (n % 20 + 1) || ':1 ' || trim(substr(line, 1, 15)) WHEN 1 THEN trim(substr(line, 1, 30)) || ' ' || i || '. Jo ' || (n % 9 + 1) || ':16 ' || (i + 1) || '. 1Pe 2:' || (n % 9) ELSE line END AS line,
      CAST(sum(CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS paragraph FROM l),
    o AS (SELECT *, regexp_matches(line, '{_OPEN}') AS opens, min(CASE WHEN regexp_matches(line, '{_OPEN}') OR regexp_matches(line, '{_IN}') THEN line_index END) OVER ({_OVER}) AS first, length(regexp_extract(line, '(?s)^(.*?)' || '{_IN}', 1)) AS cut FROM made),
    parts AS (SELECT * FROM (SELECT document_id, paragraph, line_index, 'body' AS part, trim(CASE WHEN first IS NULL OR line_index < first THEN line WHEN line_index = first AND NOT opens THEN substr(line, 1, cut) ELSE '' END) AS line FROM o
      UNION ALL SELECT document_id, paragraph, line_index, 'notes', trim(CASE WHEN line_index < first OR first IS NULL THEN '' WHEN line_index = first AND NOT opens THEN substr(line, cut + 1) ELSE line END) FROM o) WHERE line <> ''),
    fw AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_OPEN}') THEN 1 ELSE 0 END) OVER ({_OVER} ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS note FROM parts WHERE part = 'notes'),
    ft AS (SELECT document_id, paragraph, note, string_split(regexp_replace(string_agg(line, ' ' ORDER BY line_index), '{_IN}', chr(1) || '\1. \2', 'g'), chr(1)) AS xs FROM fw GROUP BY document_id, paragraph, note),
    fe AS (SELECT document_id, paragraph, note, unnest(xs) AS x, generate_subscripts(xs, 1) AS p FROM ft),
    notes AS (SELECT document_id, paragraph, row_number() OVER ({_OVER} ORDER BY note, p) AS place, marker, reference FROM (SELECT *, regexp_extract(x, '^([0-9]{{1,3}})\.', 1) AS marker, trim(regexp_replace(x, '^[0-9]{{1,3}}\.\s*', '')) AS reference FROM fe) WHERE reference <> '')"""
_GIVEN = lambda *xs: f"coalesce({', '.join(f'nullif({x}, {chr(39) * 2})' for x in xs)}, '')"
_LACK = lambda m, value: f"CASE length(text) % {m} WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {value} END"
_TITLE = lambda x: f"CASE WHEN length({x}) > 0 THEN array_to_string(list_transform(regexp_split_to_array(trim(lower({x})), '\\s+'), lambda w, i: CASE WHEN i > 1 AND list_contains({sql_list(R.SMALL_WORDS)}, w) THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ') END"

ORACLE_SQL = {
    "note_parts": f"WITH {_NOTED} SELECT document_id, paragraph, part, count(*) AS n_lines, min(line_index) AS first_line, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM parts GROUP BY ALL",
    "footnote_parse": f"WITH {_NOTED} SELECT document_id, paragraph, place, marker, md5(reference) AS reference_hash FROM notes",
    "paragraph_text": rf"""WITH {_NOTED}, b AS (SELECT document_id, paragraph, trim(string_agg(CASE WHEN line LIKE '%-' THEN line[:-2] ELSE line || ' ' END, '' ORDER BY line_index)) AS body FROM parts WHERE part = 'body' GROUP BY ALL),
        n AS (SELECT document_id, paragraph, count(*) AS n_notes, string_agg(marker || '. ' || reference, chr(10) ORDER BY place) AS ns FROM notes GROUP BY ALL)
        SELECT document_id, paragraph, coalesce(n_notes, 0) AS n_notes, md5(regexp_replace(coalesce(body, '') || CASE WHEN ns IS NULL THEN '' ELSE chr(10) || chr(10) || 'Referências bíblicas:' || chr(10) || ns END, '\A\s+|\s+\z', '', 'g')) AS text_hash FROM b FULL JOIN n USING (document_id, paragraph)""",
    "full_references": f"""WITH {_SEG}, x AS (SELECT *, sum(CASE WHEN kind = 'chapter' THEN 1 ELSE 0 END) OVER o AS n, last_value(CASE WHEN kind = 'chapter' THEN {{'n': number, 't': title}} END IGNORE NULLS) OVER o AS ch FROM seg WINDOW o AS (PARTITION BY document_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        y AS (SELECT *, last_value(CASE WHEN kind = 'section' THEN {{'n': number, 't': title}} END IGNORE NULLS) OVER (PARTITION BY document_id, n ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS se FROM x),
        z AS (SELECT document_id, segment, kind, ch.n AS cn, ch.t AS ct, se.n AS sn, se.t AS st, title, CASE WHEN kind = 'article' THEN 'Art. ' || number END AS art, length(array_to_string(kept, '')) AS k FROM y WHERE kind IN ('preamble', 'article')),
        w AS (SELECT *, 'Documento ' || document_id AS label, k % 4 AS s, CASE k % 3 WHEN 0 THEN 'único' WHEN 1 THEN CAST(k % 9 + 1 AS VARCHAR) END AS p, CASE WHEN k % 2 = 0 THEN 'II' END AS i, CASE WHEN k % 5 = 0 THEN 'b' END AS a FROM z)
        SELECT document_id, segment, md5(CASE WHEN kind = 'preamble' THEN label || ', PREÂMBULO' WHEN s = 2 THEN concat_ws(', ', label, 'Capítulo ' || cn, {_TITLE('ct')}, 'parágrafo ' || p)
          ELSE concat_ws(', ', label, CASE WHEN s <> 1 THEN 'Capítulo ' || cn END, CASE WHEN s = 0 THEN 'Seção ' || sn END, CASE WHEN s = 1 THEN {_TITLE('st')} END, CASE WHEN s = 1 THEN {_TITLE('title')} END, art,
            CASE WHEN p = 'único' AND s <> 3 THEN 'Parágrafo único' ELSE '§ ' || p END, 'inciso ' || i, CASE WHEN s <> 3 THEN 'alínea ' || a END) END) AS reference_hash FROM w""",
    "metadata_defaults": f"""WITH {_C}, m AS (SELECT chunk_id, length(text) AS n, {_LACK(5, 'document_id')} AS d0, CASE WHEN length(text) % 5 < 2 THEN document_id || ' ' END AS i0, {_LACK(3, "'Texto ' || lang")} AS t0, {_LACK(4, 'lang')} AS l0, document_type AS dt, length(text) % 2 = 0 AS norm,
          {_LACK(6, "'doctrinal_document'")} AS c0, {_LACK(7, "'outra'")} AS e0, {_LACK(3, "'batista'")} AS r0, lower(coalesce(lang, '')) AS branch, {_LACK(3, "'S 1'")} AS s0, {_LACK(4, "'C 2'")} AS h0, {_LACK(5, "'Secao'")} AS st0, {_LACK(3, "'tabela'")} AS k0, chunk_type AS ck FROM c),
        k AS (SELECT *, trim({_GIVEN('d0', 'i0')}) AS document_id, trim({_GIVEN('t0', 'l0', 'trim(' + _GIVEN('d0', 'i0') + ')')}) AS document, coalesce(nullif(c0, ''), CASE WHEN norm THEN '{R.NORMATIVE_CATEGORY}' ELSE '{R.DOCTRINAL_CATEGORY}' END) AS source_category FROM m),
        j AS (SELECT *, dt IN ('confession_of_faith', 'catechism', 'doctrinal_canons') AND source_category = '{R.DOCTRINAL_CATEGORY}' AS doc FROM k)
        SELECT chunk_id, document_id, {_GIVEN('i0', 'document_id')} AS doc_id, document, {_GIVEN('l0', 'document')} AS document_title, source_category, coalesce(nullif(e0, ''), CASE WHEN norm THEN '{R.DENOMINATION}' ELSE '' END) AS denomination,
          coalesce(nullif(r0, ''), CASE WHEN norm THEN '{R.TRADITION}' ELSE branch END) AS tradition, {_GIVEN('s0', 'h0', 'st0', "'Capitulo'")} AS full_reference, {_GIVEN('k0', 'ck')} AS document_structure_type, CAST(CASE WHEN norm THEN 1 ELSE 0 END AS INTEGER) AS n_references,
          doc AS is_doctrinal, CASE WHEN n % 3 = 0 THEN CASE WHEN doc THEN 'doctrinal' ELSE 'normative' END ELSE 'contextual' END AS content_role FROM j""",
    "chunk_summary": f"""WITH {_C}, t AS (SELECT document_id, coalesce(chunk_type, '') AS t, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT document_id, string_agg(t || ':' || n, ',' ORDER BY t) AS chunk_types FROM t GROUP BY ALL)
        SELECT document_id, count(*) AS chunk_count, any_value(chunk_types) AS chunk_types, count(*) FILTER (length(text) > 2000) AS long_chunks, max(length(text)) AS most_chars, count(DISTINCT article_number) AS article_count FROM c JOIN s USING (document_id) GROUP BY document_id""",
    "consolidation_check": f"""WITH {_C} SELECT document_id, count(*) FILTER (regexp_matches(text, '[a-z]')) AS chunk_count, count(*) AS expected_count, CASE WHEN count(*) FILTER (regexp_matches(text, '[a-z]')) <> count(*) THEN 'consolidated_count_does_not_match_document_sum' END AS issue FROM c GROUP BY document_id""",
}
