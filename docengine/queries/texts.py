"""Queries over texts, pages and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import lines as L
from docengine.queries.common import DOCS, documents, split_sql, sql_fold, sql_list, sql_slug
from docengine.functions import vocab


def norm_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.normalized_pages(documents(spark, sf_dir))
    return d.select("doc_id", F.sha2("page_text", 256).alias("text_hash"), F.length("page_text").cast("long").alias("n_chars"), F.array_join("actions", ",").alias("actions"))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels put around each text, and taken off again."""
    d = documents(spark, sf_dir).select("doc_id", F.concat(F.col("doc_id") % 1000, F.lit("\n 7 \n"), "text", F.lit("\n12\n 3")).alias("page"))
    return d.select("doc_id", F.sha2(T.strip_page_numbers("page"), 256).alias("text_hash"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.sha2(T.fold_ascii("text"), 256).alias("folded_hash"), F.md5(T.slug("text")).alias("slug_hash"), F.sha2(T.scope_text("text"), 256).alias("scope_hash"), F.sha2("text", 256).alias("text_hash"))


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("t"), T.topic_terms("text").alias("k"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.size("k").cast("long").alias("n_topic_terms"), F.sha2(F.array_join(F.sort_array("k"), " "), 256).alias("terms_hash"))


def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: pages, characters, short and empty pages, mean length, lines."""
    d = documents(spark, sf_dir)
    return d.groupBy("source").agg(
        F.count("*").alias("pages"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.length("text") < 500).alias("short_pages"), F.count_if(F.trim("text") == "").alias("empty_pages"),
        F.round(F.avg(F.length("text")), 2).alias("mean_chars"), F.sum(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
    )


def marker_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some marker words each source holds, folded."""
    d = documents(spark, sf_dir).select("source", T.fold_ascii("text").alias("t"))
    flags = [F.bool_or(F.col("t").contains(m)).alias(f"has_{m}") for m in MARKERS]
    return d.groupBy("source").agg(*flags)


MARKERS = ("licensed", "email", "the", "sich", "que")


def page_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone of each page by what its folded text holds."""
    t = T.fold_ascii("text")
    zone = (
        F.when(F.trim("text") == "", "empty").when(t.contains("preambulo"), "preamble_or_body")
        .when(F.col("text").rlike(T.CHAPTER) | F.col("text").rlike(T.SECTION) | F.col("text").rlike(T.ARTICLE) | t.contains("das disposicoes") | t.contains("dos principios"), "normative_body").otherwise("unknown")
    )
    return documents(spark, sf_dir).select("doc_id", zone.alias("zone"))


def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.flatten(documents(spark, sf_dir))
    return lines.groupBy("document_id").agg(F.count("*").alias("n_lines"), F.max("line_index").alias("last_index"), F.max(F.length("line")).cast("long").alias("longest"), F.count_if(T.upper_heading("line")).alias("n_headings"))


def _short(lines: DataFrame):
    return F.length("line") < 80


def carried_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines as headings, carried to the lines below."""
    lines = L.flatten(documents(spark, sf_dir))
    return L.carried(lines, _short(lines)).select("document_id", "line_index", F.md5(F.coalesce("heading", F.lit(""))).alias("heading_hash"))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.flatten(documents(spark, sf_dir))
    cut = L.segmented(lines, _short(lines))
    return cut.groupBy("document_id", "segment").agg(F.count("*").alias("n_lines"), F.min("line_index").alias("first_line"), F.sum(F.length("line")).cast("long").alias("chars"))


def next_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the next short line below it."""
    lines = L.flatten(documents(spark, sf_dir))
    return L.next_match(lines, _short(lines)).select("document_id", "line_index", F.coalesce("next_index", F.lit(0)).alias("next_index"))


def item_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the texts behind markers that their length chooses, parsed again."""
    heads = F.array(*map(F.lit, MARKED))
    lines = L.flatten(documents(spark, sf_dir))
    d = lines.withColumn("line", F.concat(F.element_at(heads, (F.length("line") % len(MARKED) + 1).cast("int")), F.lit(" "), "line")).withColumn("m", T.item_marker("line"))
    return d.where("m is not null").select("document_id", "line_index", F.col("m.kind").alias("kind"), F.col("m.value").alias("value"))


MARKED = ("§ 2º", "§ 3.", "Parágrafo único.", "a)", "IV -", "XVI -", "xii.", "Art. 5º", "-")


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeral that stands before each line of a text, by its place; after the largest known they begin anew."""
    numeral = F.element_at(F.array(*map(F.lit, vocab.ROMANS)), ((F.col("place") - 1) % len(vocab.ROMANS) + 1).cast("int"))
    lines = L.flatten(documents(spark, sf_dir)).withColumn("place", F.row_number().over(L.ordered()))
    lines = lines.withColumn("roman", F.regexp_extract(F.concat(numeral, F.lit(". "), "line"), "^([IVXLCDM]+)\\.", 1))
    return lines.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(T.roman_value("roman")).cast("long").alias("total"), F.max_by("roman", "line_index").alias("last"))


def length_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split into parts of up to 3200 characters."""
    d = documents(spark, sf_dir).select("doc_id", L.split_by_length(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("parts"))
    return d.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.array_max(F.transform("parts", lambda p: F.length(p))).cast("long").alias("longest"), F.aggregate("parts", F.lit(0), lambda a, p: a + F.length(p)).cast("long").alias("chars"))


def answer_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts and trailing offers removed from texts that get both."""
    t = F.concat(F.lit("αβγ "), "text", F.when(F.col("doc_id") % 2 == 0, F.lit("\n\nSe quiser, posso explicar mais.")).otherwise(F.lit("")))
    clean = T.without_trailing_offer(T.without_scripts(t))
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.regexp_replace(clean, r"\s+", ""), 256).alias("clean_hash"))


def citation_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each text with a citation [n] by their length behind each; four sources are renumbered in order of use."""
    lines = L.flatten(documents(spark, sf_dir))
    cited = F.concat(F.regexp_replace("line", r"[\[\]]", ""), F.lit(" ["), (F.length("line") % 6).cast("string"), F.lit("]"))
    d = lines.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", cited.alias("c")))), lambda x: x["c"]), " ").alias("t"))
    d = d.select("document_id", T.compacted_citations(F.col("t"), F.lit(4)).alias("c"))
    return d.select("document_id", F.array_join(F.regexp_extract_all("c.text", F.lit(r"\[[0-9]+\]"), F.lit(0)), "").alias("cited"), F.array_join(F.transform("c.numbers", lambda x: x.cast("string")), ",").alias("numbers"))


_FNS = (norm_page_text, page_numbers, folded, word_tokens, page_profile, marker_validation, page_zone, flat_lines, carried_heading, line_segments, next_heading, item_markers, roman_numerals, length_parts, answer_cleanup, citation_compaction)
QUERIES = {f.__name__: f for f in _FNS}

_LINES = f"""lines AS (SELECT document_id, line_index, trim(x) AS line FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line_index FROM ({DOCS}))
    WHERE trim(x) <> '' AND NOT regexp_full_match(trim(x), '[0-9]{{1,3}}'))"""
_STOP = sql_list(vocab.TOPIC_STOPWORDS)
_UPPER = r"""(length(line) BETWEEN 4 AND 140 AND NOT regexp_matches(line, '(?i)^CAP[ÍI]TULO\s+([IVXLCDM]+|[0-9]+)\b') AND NOT regexp_matches(line, '(?i)^SE[ÇC][ÃA]O\s+([IVXLCDM]+|[0-9]+)\b')
    AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 4 AND upper(line) = line AND lower(line) <> line)"""

ORACLE_SQL = {
    "norm_page_text": r"""
        WITH s0 AS (SELECT doc_id, coalesce(text, '') AS t0 FROM documents),
        s1 AS (SELECT *, regexp_replace(t0, '\r\n?', chr(10), 'g') AS t1 FROM s0),
        s2 AS (SELECT *, replace(t1, chr(160), ' ') AS t2 FROM s1),
        s3 AS (SELECT *, regexp_replace(t2, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g') AS t3 FROM s2),
        s4 AS (SELECT *, regexp_replace(t3, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t4 FROM s3),
        s5 AS (SELECT *, regexp_replace(t4, '([A-Za-zÀ-ÿ])-\n\s*([a-zà-ÿ])', '\1\2', 'g') AS t5 FROM s4),
        s6 AS (SELECT *, array_to_string(list_transform(string_split(t5, chr(10)), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'), ' ')), chr(10)) AS t6 FROM s5),
        s7 AS (SELECT *, regexp_replace(regexp_replace(t6, '\A(?:[ \t]*[0-9]{1,3}[ \t]*(?:\n|\z))+', ''), '(?:(?:\n|\A)[ \t]*[0-9]{1,3}[ \t]*)+\z', '') AS t7 FROM s6),
        s8 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t7, '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+', ''), '\s+\z', '') AS t8 FROM s7)
        SELECT doc_id, sha256(t8) AS text_hash, CAST(length(t8) AS BIGINT) AS n_chars,
          coalesce(nullif(concat_ws(',', CASE WHEN t0 <> t1 THEN 'normalized_line_endings' END, CASE WHEN t1 <> t2 THEN 'normalized_nbsp' END, CASE WHEN t2 <> t3 THEN 'removed_invisible_characters' END,
            CASE WHEN t3 <> t4 THEN 'removed_control_characters' END, CASE WHEN t4 <> t5 THEN 'recomposed_safe_hyphenation' END, CASE WHEN t5 <> t6 THEN 'normalized_whitespace' END,
            CASE WHEN t6 <> t7 THEN 'removed_isolated_page_number' END, CASE WHEN t7 <> t8 THEN 'normalized_excess_blank_lines' END), ''), 'no_changes') AS actions FROM s8""",
    "page_numbers": r"""
        SELECT doc_id, sha256(regexp_replace(regexp_replace(p, '\A(?:[ \t]*[0-9]{1,3}[ \t]*(?:\n|\z))+', ''), '(?:(?:\n|\A)[ \t]*[0-9]{1,3}[ \t]*)+\z', '')) AS text_hash
        FROM (SELECT doc_id, concat(doc_id % 1000, chr(10), ' 7 ', chr(10), coalesce(text, ''), chr(10), '12', chr(10), ' 3') AS p FROM documents)""",
    "folded": f"""
        SELECT doc_id, sha256({sql_fold('text')}) AS folded_hash, md5({sql_slug('text')}) AS slug_hash,
               sha256(trim(regexp_replace({sql_fold('text')}, '[^a-z0-9]+', ' ', 'g'))) AS scope_hash, sha256(text) AS text_hash FROM ({DOCS})""",
    "word_tokens": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t, regexp_extract_all({sql_fold('text')}, '\w+') AS w FROM ({DOCS})),
        k AS (SELECT *, list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 4 AND NOT list_contains({_STOP}, x)), lambda x: CASE WHEN length(x) > 5 THEN regexp_replace(x, 's$', '') ELSE x END)) AS k FROM d)
        SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, CAST(len(k) AS BIGINT) AS n_topic_terms, sha256(array_to_string(list_sort(k), ' ')) AS terms_hash FROM k""",
    "page_profile": f"""
        SELECT source, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (length(text) < 500) AS short_pages, count(*) FILTER (trim(text) = '') AS empty_pages,
               round(avg(length(text)), 2) AS mean_chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM ({DOCS}) GROUP BY source""",
    "marker_validation": f"SELECT source, {', '.join(f'''bool_or(contains(t, '{m}')) AS has_{m}''' for m in MARKERS)} FROM (SELECT source, {sql_fold('text')} AS t FROM ({DOCS})) GROUP BY source",
    "page_zone": rf"""
        SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN contains(t, 'preambulo') THEN 'preamble_or_body'
          WHEN regexp_matches(text, '(?i)^CAP[ÍI]TULO\s+([IVXLCDM]+|[0-9]+)\b(?:\s*([^\n]*))?\z') OR regexp_matches(text, '(?i)^SE[ÇC][ÃA]O\s+([IVXLCDM]+|[0-9]+)\b(?:\s*([^\n]*))?\z') OR regexp_matches(text, '^Art\.?\s*[0-9]+')
            OR contains(t, 'das disposicoes') OR contains(t, 'dos principios') THEN 'normative_body' ELSE 'unknown' END AS zone
        FROM (SELECT doc_id, text, {sql_fold('text')} AS t FROM ({DOCS}))""",
    "flat_lines": f"""
        WITH {_LINES} SELECT document_id, count(*) AS n_lines, max(line_index) AS last_index, CAST(max(length(line)) AS BIGINT) AS longest, count(*) FILTER ({_UPPER}) AS n_headings FROM lines GROUP BY document_id""",
    "carried_heading": f"""
        WITH {_LINES} SELECT document_id, line_index, md5(coalesce(last_value(CASE WHEN length(line) < 80 THEN line END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')) AS heading_hash FROM lines""",
    "line_segments": f"""
        WITH {_LINES}, s AS (SELECT *, CAST(sum(CASE WHEN length(line) < 80 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM lines)
        SELECT document_id, segment, count(*) AS n_lines, min(line_index) AS first_line, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY ALL""",
    "next_heading": f"""
        WITH {_LINES} SELECT document_id, line_index, coalesce(min(CASE WHEN length(line) < 80 THEN line_index END) OVER (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS next_index FROM lines""",
    "item_markers": f"""WITH {_LINES}, m AS (SELECT *, length(line) % 9 AS i FROM lines)
        SELECT document_id, line_index, CASE WHEN i < 3 THEN 'paragraph' WHEN i = 3 THEN 'alinea' ELSE 'inciso' END AS kind, CASE i WHEN 0 THEN '2º' WHEN 1 THEN '3º' WHEN 2 THEN 'único' WHEN 3 THEN 'a' WHEN 4 THEN 'IV' WHEN 6 THEN 'XII' END AS value
        FROM m WHERE i IN (0, 1, 2, 3, 4, 6)""",
    "roman_numerals": f"""WITH {_LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_index) AS place FROM lines)
        SELECT document_id, count(*) AS n, CAST(sum((place - 1) % {len(vocab.ROMANS)} + 1) AS BIGINT) AS total, {sql_list(vocab.ROMANS)}[(max(place) - 1) % {len(vocab.ROMANS)} + 1] AS last FROM p GROUP BY document_id""",
    "citation_compaction": f"""
        WITH {_LINES}, n AS (SELECT document_id, list(len ORDER BY line_index) AS c FROM (SELECT *, length(line) % 6 AS len FROM lines) GROUP BY document_id),
        u AS (SELECT document_id, c, list_filter(c, lambda x, i: x BETWEEN 1 AND 4 AND NOT list_contains(c[1:i - 1], x)) AS used FROM n)
        SELECT document_id, array_to_string(list_transform(c, lambda x: '[' || CASE WHEN list_contains(used, x) THEN list_position(used, x) ELSE x END || ']'), '') AS cited, array_to_string(list_transform(used, lambda x: CAST(x AS VARCHAR)), ',') AS numbers FROM u""",
    "length_parts": f"""
        WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS x FROM ({DOCS})), p AS (SELECT doc_id, {split_sql('x')} AS parts FROM d)
        SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_parts, CAST(list_max(list_transform(parts, lambda p: length(p))) AS BIGINT) AS longest, CAST(list_sum(list_transform(parts, lambda p: length(p))) AS BIGINT) AS chars FROM p""",
    "answer_cleanup": rf"""
        WITH d AS (SELECT doc_id, 'αβγ ' || text AS t FROM ({DOCS})),
        c AS (SELECT doc_id, regexp_replace(t, '[\x{{370}}-\x{{3ff}}\x{{1f00}}-\x{{1fff}}\x{{590}}-\x{{5ff}}]+', '', 'g') AS t FROM d)
        SELECT doc_id, sha256(regexp_replace(t, '\s+', '', 'g')) AS clean_hash FROM c""",
}
