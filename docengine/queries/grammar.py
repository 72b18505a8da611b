"""Queries over grammars of lines: automata, canons, references with markers, number sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import grammar as G
from docengine.operators import lines as L
from docengine.queries.common import documents
from docengine.queries.texts import _LINES

STATES = ("a", "b", "c", "d")
TABLE = (("a", "x", "b"), ("b", "x", "c"), ("c", "x", "a"), ("b", "y", "d"), ("c", "y", "a"), ("d", "z", "a"), ("a", "z", "c"))
HEADS = ("Capítulo {} ", "Artigo {} — ", "Rejeição de Erros", "Erro {} ", "Refutação", "Conclusão")


def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of an automaton whose signs are the lengths of lines."""
    sign = F.element_at(F.array(*map(F.lit, ("x", "y", "z", "other"))), (F.length("line") % 4 + 1).cast("int"))
    return G.line_states(L.flatten(documents(spark, sf_dir)), sign, TABLE, STATES).select("document_id", "line_index", "state")


def _canons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of texts, of which those of some lengths open parts of canons and others are references."""
    rows = L.flatten(documents(spark, sf_dir))
    n, i = F.length("line") % 19, F.col("line_index").cast("string")
    line = (
        F.when(n == 0, F.concat(F.lit("Capítulo "), i)).when(n < 4, F.concat(F.lit("Artigo "), i, F.lit(" — "), F.substring("line", 1, 9))).when(n == 4, "Rejeição de Erros").when(n < 7, F.concat(F.lit("Erro "), i)).when(n < 9, "Refutação")
        .when((n == 9) & (F.col("line_index") > 30), "Conclusão").when(n < 12, F.concat(F.lit("Rm 3:"), i, F.lit("; Jo 1.2 e 1Co 2:3"))).otherwise(F.concat("line", F.lit(" (Mt 5:"), i, F.lit(")")))
    )
    return rows.withColumn("line", line)


def canon_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What canons open: chapters, articles with their references, rejections, errors, refutations, the conclusion."""
    u = G.canon_units(_canons(spark, sf_dir))
    return u.select("document_id", F.col("unit").cast("long").alias("unit"), "kind", F.col("chapter").cast("long").alias("chapter"), F.coalesce("number", F.lit("")).alias("number"), "first_line", "last_line", F.md5("body").alias("body_hash"), F.md5("references").alias("references_hash"), F.size("markers").cast("long").alias("n_markers"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's lines as an answer with markers and a block of references, some incomplete, doubled or without a book."""
    rows = L.flatten(documents(spark, sf_dir))
    i, n = F.col("line_index").cast("string"), F.length("line") % 8
    answer = F.when(n == 7, "palavra").otherwise(F.concat(F.lit("palavra"), i))
    entry = F.when(n < 3, F.concat(i, F.lit(". Rm 3:"), i)).when(n == 3, F.concat(i, F.lit(" Sl "), i, F.lit(".1"))).when(n == 4, F.concat(i, F.lit(". 12:"), i)).when(n == 5, F.concat(F.lit("texto "), i)).when(n == 6, F.concat(i, F.lit(". Jo 1.2 "), i, F.lit(". Mt 5:6")))
    order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", c.alias("x")))), lambda s: s["x"]), " ")
    return rows.groupBy("document_id").agg(order(answer).alias("answer"), order(F.coalesce(entry, F.lit("fim"))).alias("block"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _blocks(spark, sf_dir).withColumn("markers", G.answer_markers(F.col("answer"))).withColumn("entries", G.reference_entries(F.col("block")))
    return d.withColumn("mapped", G.reference_map(F.col("entries"), F.col("markers")))


def reference_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the markers of an answer."""
    return _mapped(spark, sf_dir).select("document_id", F.explode("mapped").alias("marker", "reference"))


def reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers without a reference, and markers with several."""
    return _mapped(spark, sf_dir).select("document_id", F.inline(G.reference_issues(F.col("markers"), F.col("entries"), F.col("mapped"))))


def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each text's lines, of which some are dropped, doubled, misread or begin anew, against the numbers that should be there."""
    rows = L.flatten(documents(spark, sf_dir))
    n = F.length("line") % 17
    number = F.when(n == 0, F.lit(1)).when(n == 1, F.col("line_index") * 10).when(n == 2, F.col("line_index") - 1).otherwise(F.col("line_index"))
    return G.sequence_gaps(rows.where(n != 3).select("document_id", "line_index", number.alias("number")))


_FNS = (line_states, canon_units, reference_map, reference_issues, sequence_gaps)
QUERIES = {f.__name__: f for f in _FNS}

_values = lambda table: ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in table)


def _states_sql(source: str, table, first: str) -> str:
    """Common table expressions that end in st (document_id, line_index, sign, line, state): one line after another."""
    return f"""tb(state, sign, nxt) AS (VALUES {_values(table)}), nb AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_index) AS k FROM {source}),
      st AS (SELECT document_id, k, line_index, sign, line, coalesce((SELECT nxt FROM tb WHERE tb.state = '{first}' AND tb.sign = nb.sign), '{first}') AS state FROM nb WHERE k = 1
        UNION ALL SELECT nb.document_id, nb.k, nb.line_index, nb.sign, nb.line, coalesce(tb.nxt, st.state) FROM st JOIN nb ON nb.document_id = st.document_id AND nb.k = st.k + 1 LEFT JOIN tb ON tb.state = st.state AND tb.sign = nb.sign)"""


_CANON = f"""{_LINES}, cl AS (SELECT document_id, line_index, CASE WHEN n = 0 THEN 'Capítulo ' || line_index WHEN n < 4 THEN 'Artigo ' || line_index || ' — ' || substr(line, 1, 9) WHEN n = 4 THEN 'Rejeição de Erros' WHEN n < 7 THEN 'Erro ' || line_index WHEN n < 9 THEN 'Refutação'
      WHEN n = 9 AND line_index > 30 THEN 'Conclusão' WHEN n < 12 THEN 'Rm 3:' || line_index || '; Jo 1.2 e 1Co 2:3' ELSE line || ' (Mt 5:' || line_index || ')' END AS line,
      CASE WHEN n = 0 THEN 'chapter' WHEN n < 4 THEN 'article' WHEN n = 4 THEN 'rejection' WHEN n < 7 THEN 'error' WHEN n < 9 THEN 'refutation' WHEN n = 9 AND line_index > 30 THEN 'conclusion' END AS sign FROM (SELECT *, length(line) % 19 AS n FROM lines))"""
_ENTRY = f"""{_LINES}, r AS (SELECT document_id, line_index AS i, length(line) % 8 AS n FROM lines),
    m AS (SELECT document_id, i, n FROM r WHERE n <> 7),
    e AS (SELECT document_id, i, 1 AS part, n, i AS marker, CASE WHEN n < 3 THEN 'Rm 3:' || i WHEN n = 3 THEN 'Sl ' || i || '.1' WHEN n = 4 THEN '12:' || i ELSE 'Jo 1.2' END AS body, CASE WHEN n = 3 THEN ' ' ELSE '. ' END AS sep, n <> 4 AS valid FROM r WHERE n IN (0, 1, 2, 3, 4, 6)
      UNION ALL SELECT document_id, i, 2, n, i, 'Mt 5:6', '. ', true FROM r WHERE n = 6),
    -- what stands between an entry and the next belongs to it
    f AS (SELECT document_id, i, 0 AS part, CASE WHEN n = 5 THEN 'texto ' || i ELSE 'fim' END AS t FROM r WHERE n IN (5, 7)),
    a AS (SELECT document_id, i, part, body AS t, true AS opens, marker, sep, valid FROM e UNION ALL SELECT document_id, i, part, t, false, NULL, NULL, NULL FROM f),
    g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i, part) AS k FROM a),
    x AS (SELECT document_id, k, any_value(marker) AS marker, any_value(sep) AS sep, bool_or(valid) AS valid, string_agg(t, ' ' ORDER BY i, part) AS t, min(i) AS i FROM g WHERE k > 0 GROUP BY document_id, k)"""

ORACLE_SQL = {
    "line_states": f"""WITH RECURSIVE {_LINES}, sg AS (SELECT *, ['x', 'y', 'z', 'other'][length(line) % 4 + 1] AS sign FROM lines), {_states_sql('sg', TABLE, 'a')} SELECT document_id, line_index, state FROM st""",
    "canon_units": f"""WITH RECURSIVE {_CANON}, {_states_sql('cl', G.CANON_TABLE, 'start')},
        o AS (SELECT *, coalesce(sign = state AND NOT (state = 'conclusion' AND coalesce(prior, '') = 'conclusion') AND (sign <> 'refutation' OR prior = 'error'), false) AS opens FROM (SELECT *, lag(state) OVER (PARTITION BY document_id ORDER BY line_index) AS prior FROM st)),
        u AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS unit, sum(CASE WHEN opens AND state = 'chapter' THEN 1 ELSE 0 END) OVER w AS chapter FROM o WINDOW w AS (PARTITION BY document_id ORDER BY line_index)),
        t AS (SELECT *, bool_and(NOT opens AND state = 'article' AND line LIKE 'Rm 3:%; Jo 1.2 e 1Co 2:3') OVER (PARTITION BY document_id, unit ORDER BY line_index DESC) AS tail FROM u WHERE unit > 0)
        SELECT document_id, CAST(unit AS BIGINT) AS unit, min(state) AS kind, CAST(min(chapter) AS BIGINT) AS chapter, CASE WHEN min(state) IN ('article', 'error') THEN CAST(min(line_index) AS VARCHAR) ELSE '' END AS number, min(line_index) AS first_line, max(line_index) AS last_line,
          md5(coalesce(string_agg(CASE WHEN NOT opens AND NOT tail THEN trim(line) END, ' ' ORDER BY line_index), '')) AS body_hash, md5(coalesce(string_agg(CASE WHEN tail THEN trim(line) END, ' ' ORDER BY line_index), '')) AS references_hash,
          CAST(coalesce(sum(CASE WHEN NOT opens AND NOT tail THEN len(list_filter(regexp_extract_all(line, '\\(([^)]*)\\)', 1), lambda p: regexp_matches(p, '(?i)\\b(mt|rm|jo)\\.?\\s*[0-9]'))) ELSE 0 END), 0) AS BIGINT) AS n_markers FROM t GROUP BY document_id, unit""",
    "reference_map": f"WITH {_ENTRY}, l AS (SELECT *, row_number() OVER (PARTITION BY document_id, marker ORDER BY k DESC) AS last FROM x WHERE valid) SELECT l.document_id, CAST(marker AS VARCHAR) AS marker, t AS reference FROM l JOIN m ON m.document_id = l.document_id AND m.i = l.marker WHERE last = 1",
    "reference_issues": f"""WITH {_ENTRY} SELECT m.document_id, CAST(m.i AS VARCHAR) AS marker, NULL AS raw, 'missing_reference_entry' AS issue FROM m WHERE n = 5
        UNION ALL SELECT document_id, CAST(marker AS VARCHAR), marker || sep || t, 'missing_bible_book' FROM x WHERE NOT valid
        UNION ALL SELECT x.document_id, CAST(x.marker AS VARCHAR), x.marker || x.sep || x.t, 'duplicated_reference_marker_suspected' FROM x JOIN r ON r.document_id = x.document_id AND r.i = x.marker WHERE r.n = 6""",
}
