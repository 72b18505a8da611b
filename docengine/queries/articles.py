"""Queries over articles: stretches in context, chunks, full records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import articles as A
from docengine.operators import lines as L
from docengine.queries.common import documents, split_sql, sql_fold, sql_list, sql_slug
from docengine.queries.texts import _LINES

PAGE = 30
LABELS = ("Constituição", "Regimento", "Código")
TYPES = ("constitution", "internal_regiment", "normative_ethics")
STYLES = ("chapters", "titles", "chapters")
RULES = (("ministry", "ordination", ("the ", "und")), ("membership", "duties", ("que ", " les ")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the texts, each behind a head that its length chooses: chapter, section, article, paragraph, inciso, alínea, or none."""
    rows = L.flatten(documents(spark, sf_dir))
    n, i = F.length("line"), F.col("line_index").cast("string")
    put = lambda before, after: F.concat(F.lit(before), i, F.lit(after), "line")
    line = (
        F.when(n % 41 == 0, F.concat(F.lit("CAPÍTULO "), i, F.lit(" DOS DEVERES"))).when(n % 41 == 1, F.concat(F.lit("SEÇÃO "), i)).when(n % 41 == 2, F.lit("DAS NORMAS GERAIS")).when(n % 41 == 3, F.lit("PREÂMBULO")).when(n % 41 < 6, put("Art. ", "º – "))
        .when(n % 41 < 10, put("§ ", "º ")).when(n % 41 < 12, F.concat(F.lit("IV - "), "line")).when(n % 41 < 14, F.concat(F.lit("b) "), "line")).when(n % 41 < 17, F.concat("line", F.lit("-"))).otherwise(F.col("line"))
    )
    return rows.select("document_id", "line_index", F.floor(F.col("line_index") / PAGE).alias("page"), line.alias("line"))


def article_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch with the chapter and the section that hold it."""
    rows = A.article_lines(_lines(spark, sf_dir))
    return rows.groupBy("document_id", "segment", "kind", "chapter_number", "chapter_title", "section_number", "section_title").agg(F.count("*").alias("n_lines"), F.min("line_index").alias("first_line"))


def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all articles and preambles, ids not yet told apart."""
    c = A.article_chunks(A.article_lines(_lines(spark, sf_dir)))
    return c.select("chunk_id", "document_id", "segment", "structure_type", "article_number", "paragraph_number", "inciso", "alinea", "item_label", "page_start", "page_end", F.sha2("text", 256).alias("text_hash"), F.array_join("warnings", ",").alias("warnings"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each document: its type, label and style by its language, others are left out."""
    k = (F.length("lang") + F.ascii(F.substring("lang", 1, 1))) % len(TYPES)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("Documento "), F.col("source")).alias("title"), pick(TYPES).alias("document_type"), pick(LABELS).alias("label"), pick(STYLES).alias("style"), F.lit(None).cast("string").alias("default_topic"),
        F.when(F.col("lang") == "en", "local_church").alias("default_subtopic"), F.col("lang").alias("language"), F.col("source").alias("source_path"),
    )


def normative_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full records of the same chunks."""
    r = A.document_chunks(_lines(spark, sf_dir), _documents(spark, sf_dir), RULES)
    return r.select("chunk_id", "document_id", "chunk_type", "full_reference", "topic", "subtopic", "language", F.sha2("embedding_text", 256).alias("embedding_hash"), "text_hash", F.array_join("warnings", ",").alias("warnings"))


_FNS = (article_context, article_chunks, normative_records)
QUERIES = {f.__name__: f for f in _FNS}

_ART = r"^Art\.?\s*([0-9]+)([º°]?)(\.|\s*[–—-]|\s+[A-ZÁÉÍÓÚÂÊÔÃÕ])"
_ROMAN = "^(I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV)[ ]*[.–—-]"
_MARK = rf"(regexp_matches(line, '(?i)^Par[aá]grafo\s+[úu]nico') OR regexp_matches(line, '^§\s*[0-9]+') OR regexp_matches(line, '^[a-z]\)') OR regexp_matches(upper(line), '{_ROMAN}'))"
_UP = rf"(length(line) BETWEEN 4 AND 140 AND NOT regexp_matches(line, '{_ART}') AND op NOT IN ('chapter', 'section') AND length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= 4 AND upper(line) = line AND lower(line) <> line)"
_CONTEXT = rf"""{_LINES}, h AS (SELECT document_id, line_index, line_index // {PAGE} AS page, trim(CASE WHEN n = 0 THEN 'CAPÍTULO ' || line_index || ' DOS DEVERES' WHEN n = 1 THEN 'SEÇÃO ' || line_index WHEN n = 2 THEN 'DAS NORMAS GERAIS' WHEN n = 3 THEN 'PREÂMBULO'
      WHEN n < 6 THEN 'Art. ' || line_index || 'º – ' || line WHEN n < 10 THEN '§ ' || line_index || 'º ' || line WHEN n < 12 THEN 'IV - ' || line WHEN n < 14 THEN 'b) ' || line WHEN n < 17 THEN line || '-' ELSE line END) AS line FROM (SELECT *, length(line) % 41 AS n FROM lines)),
    op AS (SELECT *, CASE WHEN trim({sql_fold('line')}) = 'preambulo' THEN 'preamble' WHEN regexp_matches(line, '(?i)^CAP[ÍI]TULO\s+([IVXLCDM]+|[0-9]+)\b') THEN 'chapter' WHEN regexp_matches(line, '(?i)^SE[ÇC][ÃA]O\s+([IVXLCDM]+|[0-9]+)\b') THEN 'section' WHEN regexp_matches(line, '{_ART}') THEN 'article' ELSE '' END AS op FROM h),
    sg AS (SELECT *, sum(CASE WHEN op <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_index) AS segment FROM op),
    kd AS (SELECT *, first(op) OVER (PARTITION BY document_id, segment ORDER BY line_index) AS kind, row_number() OVER (PARTITION BY document_id, segment ORDER BY line_index) AS place, {_UP} AS up FROM sg),
    hd AS (SELECT document_id, segment, any_value(kind) AS kind, first(upper(regexp_extract(line, '(?i)^(CAP[ÍI]TULO|SE[ÇC][ÃA]O)\s+([IVXLCDM]+|[0-9]+)', 2)) ORDER BY place) AS number, nullif(first(trim(regexp_extract(line, '(?i)^(CAP[ÍI]TULO|SE[ÇC][ÃA]O)\s+([IVXLCDM]+|[0-9]+)\b\s*(.*)$', 3)) ORDER BY place), '') AS inline,
             list(line ORDER BY place) AS all_lines, list(up ORDER BY place) AS ups FROM kd WHERE kind IN ('chapter', 'section') GROUP BY document_id, segment),
    tt AS (SELECT document_id, segment, kind, number, nullif(trim(concat_ws(' ', inline, array_to_string(list_filter(all_lines, lambda x, i: i > 1 AND NOT list_contains(ups[2:i], false) AND i - 1 + CASE WHEN inline IS NULL THEN 0 ELSE 1 END <= 3), ' '))), '') AS title FROM hd),
    st AS (SELECT document_id, segment, any_value(kind) AS kind FROM kd GROUP BY ALL),
    cx AS (SELECT document_id, segment, kind, last_value(CASE WHEN kind = 'chapter' THEN {{'n': number, 't': title}} END IGNORE NULLS) OVER w AS c, sum(CASE WHEN kind = 'chapter' THEN 1 ELSE 0 END) OVER w AS chapters, number, title FROM st LEFT JOIN tt USING (document_id, segment, kind) WINDOW w AS (PARTITION BY document_id ORDER BY segment)),
    cc AS (SELECT document_id, segment, kind, c.n AS chapter_number, c.t AS chapter_title, s.n AS section_number, s.t AS section_title FROM (SELECT *, last_value(CASE WHEN kind = 'section' THEN {{'n': number, 't': title}} END IGNORE NULLS) OVER (PARTITION BY document_id, chapters ORDER BY segment) AS s FROM cx) WHERE kind IN ('preamble', 'article'))"""


_MARKED = rf"""{_CONTEXT}, m0 AS (SELECT kd.*, kind = 'article' AND place > 1 AND {_MARK} AS marks, place = 1 OR op = 'article' OR {_MARK} AS opens,
      CASE WHEN regexp_matches(line, '(?i)^Par[aá]grafo\s+[úu]nico') THEN 'paragraph' WHEN regexp_matches(line, '^§\s*[0-9]+') THEN 'paragraph' WHEN regexp_matches(line, '^[a-z]\)') THEN 'alinea' ELSE 'inciso' END AS mk,
      CASE WHEN regexp_matches(line, '(?i)^Par[aá]grafo\s+[úu]nico') THEN 'único' WHEN regexp_matches(line, '^§\s*[0-9]+') THEN regexp_extract(line, '^§\s*([0-9]+)', 1) || coalesce(nullif(regexp_extract(line, '^§\s*[0-9]+([º°]?)', 1), ''), 'º') WHEN regexp_matches(line, '^[a-z]\)') THEN line[1] ELSE regexp_extract(upper(line), '{_ROMAN}', 1) END AS mv
      FROM kd WHERE kind IN ('preamble', 'article')),
    m1 AS (SELECT *, sum(CASE WHEN marks THEN 1 ELSE 0 END) OVER w AS unit, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS block, sum(CASE WHEN marks AND mk = 'paragraph' THEN 1 ELSE 0 END) OVER w AS np, sum(CASE WHEN marks AND mk <> 'alinea' THEN 1 ELSE 0 END) OVER w AS ni FROM m0 WINDOW w AS (PARTITION BY document_id, segment ORDER BY line_index)),
    m2 AS (SELECT *, last_value(CASE WHEN marks AND mk = 'paragraph' THEN mv END IGNORE NULLS) OVER (PARTITION BY document_id, segment ORDER BY line_index) AS pn, last_value(CASE WHEN marks AND mk = 'inciso' THEN mv END IGNORE NULLS) OVER (PARTITION BY document_id, segment, np ORDER BY line_index) AS inc,
      last_value(CASE WHEN marks AND mk = 'alinea' THEN mv END IGNORE NULLS) OVER (PARTITION BY document_id, segment, ni ORDER BY line_index) AS al FROM m1),
    bl AS (SELECT document_id, segment, kind, unit, block, list(line ORDER BY line_index) AS ls, min(page) AS p0, max(page) AS p1, any_value(pn) AS pn, any_value(inc) AS inc, any_value(al) AS al, max(CASE WHEN marks THEN mk END) AS mk, max(CASE WHEN place = 1 THEN line END) AS head FROM m2 GROUP BY ALL),
    bt AS (SELECT *, trim(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = len(ls) THEN x WHEN x[-1] = '-' THEN x[:-2] ELSE x || ' ' END), '')) AS t FROM bl),
    un AS (SELECT document_id, segment, kind, unit, string_agg(t, chr(10) || chr(10) ORDER BY block) AS t, min(p0) AS p0, max(p1) AS p1, any_value(pn) AS pn, any_value(inc) AS inc, any_value(al) AS al, max(mk) AS mk, max(head) AS head FROM bt GROUP BY ALL),
    wh AS (SELECT document_id, segment, kind, string_agg(t, chr(10) || chr(10) ORDER BY unit) AS t, min(p0) AS p0, max(p1) AS p1, count(*) AS units, first(t ORDER BY unit) AS prefix, max(head) AS head FROM un GROUP BY ALL),
    ch AS (SELECT document_id, segment, kind, 0 AS n, t, p0, p1, NULL AS pn, NULL AS inc, NULL AS al, NULL AS mk, head, 'whole' AS how FROM wh WHERE length(t) <= 3200 OR kind = 'preamble' UNION ALL SELECT document_id, segment, kind, 0, t, p0, p1, NULL, NULL, NULL, NULL, head, 'bare' FROM wh WHERE length(t) > 3200 AND kind = 'article' AND units = 1
      UNION ALL SELECT document_id, segment, kind, un.unit, prefix || chr(10) || chr(10) || un.t, un.p0, un.p1, un.pn, un.inc, un.al, un.mk, wh.head, 'unit' FROM wh JOIN un USING (document_id, segment, kind) WHERE length(wh.t) > 3200 AND kind = 'article' AND units > 1 AND un.unit > 0),
    pt AS (SELECT *, len(parts) AS n_parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS part_no FROM (SELECT *, CASE WHEN how = 'whole' THEN [t] ELSE {split_sql('t')} END AS parts FROM ch)),
    pi AS (SELECT *, nullif(regexp_extract(head, '^Art\.?\s*([0-9]+)', 1), '') AS an FROM pt),
    id AS (SELECT *, document_id || '_' || CASE WHEN kind = 'preamble' THEN 'preambulo-' || lpad(CAST(dense_rank() OVER (PARTITION BY document_id, kind ORDER BY segment) AS VARCHAR), 2, '0')
      ELSE concat_ws('_', 'artigo-' || lpad(an, CAST(greatest(3, length(an)) AS INTEGER), '0'), CASE WHEN pn IS NOT NULL THEN {sql_slug("'paragrafo-' || pn")} END, CASE WHEN inc IS NOT NULL THEN 'inciso-' || lower(inc) END, 'alinea-' || al, CASE WHEN n_parts > 1 OR how = 'bare' THEN 'parte-' || lpad(CAST(part_no AS VARCHAR), 2, '0') END) END AS chunk_id FROM pi),
    fin AS (SELECT chunk_id, document_id, CAST(segment AS BIGINT) AS segment, n, part_no, CASE WHEN kind = 'preamble' THEN 'preamble' WHEN how = 'unit' THEN mk ELSE 'normative_article' END AS structure_type, CASE WHEN kind = 'article' THEN an END AS article_number, 'Art. ' || an || regexp_extract(head, '^Art\.?\s*[0-9]+([º°]?)', 1) AS display,
      pn AS paragraph_number, inc AS inciso, al AS alinea, CASE mk WHEN 'paragraph' THEN CASE WHEN pn = 'único' THEN 'Parágrafo único' ELSE '§ ' || pn END WHEN 'inciso' THEN 'inciso ' || inc WHEN 'alinea' THEN 'alínea ' || al END AS item_label, p0 AS page_start, p1 AS page_end, trim(part) AS text,
      list_filter([CASE how WHEN 'bare' THEN 'article_split_by_length_without_structural_children' WHEN 'unit' THEN 'article_split_by_structural_children' END, CASE WHEN how = 'unit' AND n_parts > 1 THEN 'structural_child_split_by_length' END], lambda x: x IS NOT NULL) AS warnings FROM id WHERE trim(part) <> '')"""
_pick = lambda values: f"{sql_list(values)}[(length(lang) + ascii(left(lang, 1))) % {len(TYPES)} + 1]"
_small = sql_list(("a", "as", "o", "os", "e", "da", "das", "de", "do", "dos", "em", "na", "no"))
_title = lambda x: f"array_to_string(list_transform(string_split_regex(lower(trim({x})), '\\s+'), lambda w, i: CASE WHEN i > 1 AND list_contains({_small}, w) THEN w ELSE upper(left(w, 1)) || w[2:] END), ' ')"
_hay = sql_fold("concat_ws(' ', chapter_title, section_title, text)")

ORACLE_SQL = {
    "article_context": f"WITH {_CONTEXT} SELECT document_id, CAST(segment AS BIGINT) AS segment, kind, chapter_number, chapter_title, section_number, section_title, count(*) AS n_lines, min(line_index) AS first_line FROM cc JOIN (SELECT document_id, segment, line_index FROM kd) USING (document_id, segment) GROUP BY ALL",
    "article_chunks": f"WITH {_MARKED} SELECT chunk_id, document_id, segment, structure_type, article_number, paragraph_number, inciso, alinea, item_label, page_start, page_end, sha256(text) AS text_hash, array_to_string(warnings, ',') AS warnings FROM fin",
    "normative_records": f"""WITH {_MARKED}, q AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY segment, n, part_no) AS k FROM fin),
        d AS (SELECT doc_id AS document_id, lang AS language, 'Documento ' || source AS title, {_pick(TYPES)} AS document_type, {_pick(LABELS)} AS label, {_pick(STYLES)} AS style FROM documents),
        e AS (SELECT q.* REPLACE (CASE WHEN k > 1 THEN chunk_id || '_duplicata-' || CASE WHEN k < 10 THEN '0' ELSE '' END || k ELSE chunk_id END AS chunk_id, CASE WHEN structure_type = 'normative_article' AND document_type = 'normative_ethics' THEN 'ethics_article' ELSE structure_type END AS structure_type,
            CASE WHEN k > 1 THEN list_append(warnings, 'duplicate_chunk_id_disambiguated') ELSE warnings END AS warnings), d.* EXCLUDE (document_id), cc.* EXCLUDE (document_id, segment, kind) FROM q JOIN d USING (document_id) JOIN cc USING (document_id, segment)),
        g AS (SELECT *, CASE WHEN structure_type = 'preamble' THEN label || ', PREÂMBULO' ELSE concat_ws(', ', label, CASE WHEN style = 'chapters' THEN 'Capítulo ' || chapter_number END, CASE WHEN style = 'chapters' THEN 'Seção ' || section_number END, CASE WHEN style = 'titles' THEN {_title('section_title')} END, display,
            CASE WHEN paragraph_number = 'único' THEN 'Parágrafo único' ELSE '§ ' || paragraph_number END, 'inciso ' || inciso, 'alínea ' || alinea) END AS full_reference, {_hay} AS hay FROM e),
        t AS (SELECT *, CASE WHEN contains(hay, 'the ') OR contains(hay, 'und') THEN ['ministry', 'ordination'] WHEN contains(hay, 'que ') OR contains(hay, ' les ') THEN ['membership', 'duties'] ELSE ['denominational_governance', CASE WHEN language = 'en' THEN 'local_church' ELSE 'general_governance' END] END AS topic FROM g)
        SELECT chunk_id, document_id, structure_type AS chunk_type, full_reference, topic[1] AS topic, topic[2] AS subtopic, language, sha256(concat_ws(chr(10), 'Documento: ' || title, 'Corpus: Normativo Congregacional', 'Tipo documental: ' || document_type, 'Referência: ' || full_reference, 'Tópico: ' || topic[1] || ' / ' || topic[2], 'Texto: ' || text)) AS embedding_hash,
          sha256(text) AS text_hash, array_to_string(warnings, ',') AS warnings FROM t""",
}
