"""Queries over questions, chat history, evidence and evaluation, and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.functions import vocab
from docengine.operators import evaluation as E
from docengine.operators import questions as Q
from docengine.queries.common import DOCS, documents, sql_fold, sql_list, table
from docengine.streaming.events import windowed_counts

#: What words of a text stand for in a question of the domain, by their length and place: the texts of the tables are of no domain.
DOMAIN = (
    *[names[0] for _, _, names in vocab.DOCUMENT_ALIASES], "doutrina", "ensina", "batismo", "salvação", "fé", "graça", "igreja local", "ordenação", "ministros", "disciplina", "artigo", "aliança", "congregacional", "governo", "confissão", "professada",
    "expiação", "regeneração", "compare", "quais documentos orientam", "liste", "resuma", "o que diz e ensina", "isso", "explique melhor", "não entendi", "ela", "fora do corpus", "entre os", "à luz de",
)


def _question(text: Column) -> Column:
    """The text, in which about one word in 31 is replaced by what it stands for."""
    terms, n = F.array(*map(F.lit, DOMAIN)), F.length(text)
    return F.array_join(F.transform(F.split(text, " "), lambda w, i: F.when((F.length(w) * 5 + i + 1) % 31 == 0, F.element_at(terms, ((F.length(w) * 3 + (i + 1) * 7 + n) % len(DOMAIN) + 1).cast("int"))).otherwise(w)), " ")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("question", _question(F.coalesce("text", F.lit(""))))


def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return _asked(spark, sf_dir).select("conv_id", "turn", Q.intent(q).alias("intent"), Q.is_overview(q).alias("overview"), Q.asks_inventory(q).alias("inventory"), Q.is_bridge(q).alias("bridge"), Q.names_document(q).alias("names_document"), Q.is_followup(q).alias("followup"))


def query_scope_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _asked(spark, sf_dir).select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("question").alias("text"))
    s = Q.document_scope(a, fuzzy=False)
    return a.join(s, "question_id").select("conv_id", "turn", "scope_document", "scope_alias")


def query_scope_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a letter taken out of each long word: aliases are found by their likeness."""
    typo = F.regexp_replace("question", r"(\p{L}{4})\p{L}(\p{L}{3})", "$1$2")
    a = _asked(spark, sf_dir).select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("question_id"), typo.alias("text"))
    return a.join(Q.document_scope(a), "question_id").select("conv_id", "turn", "scope_document", "match_type")


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Q.history(table(spark, sf_dir, "conversations"))
    return h.select("conv_id", "turn", "role", F.md5("content").alias("content_hash"))


def followup_contextualize(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Q.last_question(_asked(spark, sf_dir))
    return a.select("conv_id", "turn", F.md5(Q.contextualized(F.col("question"), F.col("previous_question"))).alias("query_hash"))


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.significant_terms(F.concat_ws(" ", "question", F.when(F.col("turn") % 2 == 0, F.lit("expiação regeneração"))))
    return _asked(spark, sf_dir).select("conv_id", "turn", F.array_join(F.sort_array(t), ",").alias("terms"), F.array_join(F.sort_array(T.expand_terms(t)), ",").alias("expanded"))


def evidence_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the package of a question, with priorities and statuses that follow from its id."""
    d = documents(spark, sf_dir)
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*values), (i % len(values) + 1).cast("int"))
    arrays = lambda *xs: [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in xs]
    p = d.select(
        "doc_id", _question(F.substring_index("text", "\n", 1)).alias("query"), F.when(i % 11 == 0, 0).otherwise(2).alias("context_count"), F.length("text").alias("total_chars"), (i % 13 != 0).alias("has_source_map"),
        pick(arrays(["doctrinal"], ["normative"], ["introductory"], ["contextual", "introductory"])).alias("priorities"), pick(arrays(["expanded"], ["anchor_only", "anchor_only_consolidated"], ["anchor_only"])).alias("statuses"),
        F.concat_ws(" ", "text", F.when(i % 3 == 0, _question(F.substring_index("text", "\n", 1)))).alias("context_text"),
    )
    return Q.evidence(p).select("doc_id", "reason", "can_answer")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as evaluation records; categories are languages."""
    r = table(spark, sf_dir, "labels").join(documents(spark, sf_dir), "doc_id", "left")
    i = F.col("doc_id")
    flag = F.when(i % 7 == 0, "não").when(i % 9 == 0, "com_ressalva").when(i % 23 == 0, None).otherwise(" Sim ")
    contexts = F.when(i % 29 != 0, F.when(i % 31 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source", "lang")))
    r = r.withColumn("flag", flag).withColumn("contexts", contexts)
    error, answer = F.when(i % 17 == 0, "timeout"), F.when(i % 19 != 0, F.col("source"))
    return r.withColumn("skip_reason", E.skip_reason(error, F.col("text"), answer, F.col("flag"), F.col("contexts"), F.col("lang")))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy(F.coalesce("skip_reason", F.lit("evaluated")).alias("outcome")).agg(F.count("*").alias("n"))


def eval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.means(_records(spark, sf_dir), ["quality", "toxic"])


def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.means(_records(spark, sf_dir), ["quality", "toxic"], ["lang"])


def behavioural_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histograms(_records(spark, sf_dir).where(F.lower(F.trim(F.coalesce("flag", F.lit("")))) != "sim"), ["flag", "lang", "toxic"])


def join_unique_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", E.join_unique(F.coalesce("contexts", F.array().cast("array<string>"))).alias("sources"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of an hour by type, as the streaming job counts them."""
    w = windowed_counts(table(spark, sf_dir, "events"), None)
    return w.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


_FNS = (query_intent, query_scope_exact, query_scope_fuzzy, history_window, followup_contextualize, query_expansion, evidence_decision, skip_reasons, eval_means, eval_by_category, behavioural_histograms, join_unique_sources, event_windows)
QUERIES = {f.__name__: f for f in _FNS}

_QUESTION = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w, i: CASE WHEN (length(w) * 5 + i) % 31 = 0 THEN {sql_list(DOMAIN)}[(length(w) * 3 + i * 7 + length({x})) % {len(DOMAIN)} + 1] ELSE w END), ' ')"
_FIRST = "split_part(text, chr(10), 1)"
_Q = f"q AS (SELECT *, {_QUESTION("coalesce(text, '')")} AS question FROM conversations), f AS (SELECT *, {sql_fold('question')} AS folded FROM q), w AS (SELECT *, list_distinct(regexp_extract_all(folded, '\\w+')) AS w FROM f)"
_has = lambda terms: f"list_has_any(w, {sql_list(terms)})"
_match = lambda patterns, x="folded": "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"
_contains = lambda marks, x="folded": "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"
_NORM = [t for t in vocab.NORMATIVE_TERMS if t not in vocab.DENOMINATIONAL_SCOPE_TERMS]
_INTENT = f"CASE WHEN {_has(vocab.DOCTRINAL_TERMS)} AND {_has(_NORM)} THEN 'mixed' WHEN {_has(_NORM)} THEN 'normative' WHEN {_has(vocab.DOCTRINAL_TERMS)} THEN 'doctrinal' WHEN {_has(vocab.NORMATIVE_TERMS)} THEN 'normative' ELSE 'general' END"
_FOLLOW = f"({_contains(vocab.FOLLOWUP_MARKERS)} OR (len(regexp_extract_all(folded, '[a-z0-9]+')) <= 5 AND list_has_any(regexp_extract_all(folded, '[a-z0-9]+'), {sql_list(vocab.FOLLOWUP_PRONOUNS)})))"
_ALIAS = ", ".join(f"('{d}', '{a}')" for d, _, names in vocab.DOCUMENT_ALIASES for a in names)
_sig = lambda x: f"list_distinct(list_filter(regexp_extract_all({sql_fold(x)}, '[a-z0-9]+'), lambda t: length(t) >= 4 AND NOT list_contains({sql_list(vocab.EVIDENCE_STOPWORDS)}, t)))"
_EXP = "MAP {" + ", ".join(f"'{k}': {sql_list(v)}" for k, v in vocab.QUERY_TERM_EXPANSIONS.items()) + "}"
_expand = lambda t: f"list_distinct(list_concat({t}, flatten(list_transform({t}, lambda x: coalesce({_EXP}[x], []::VARCHAR[])))))"
_R = f"""r0 AS (SELECT l.*, d.text, d.lang, d.source, CASE WHEN l.doc_id % 7 = 0 THEN 'não' WHEN l.doc_id % 9 = 0 THEN 'com_ressalva' WHEN l.doc_id % 23 = 0 THEN NULL ELSE ' Sim ' END AS flag,
      CASE WHEN l.doc_id % 29 <> 0 THEN CASE WHEN l.doc_id % 31 = 0 THEN []::VARCHAR[] ELSE [d.lang, d.source, d.lang] END END AS contexts FROM labels l LEFT JOIN ({DOCS}) d USING (doc_id)),
    r AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'linha possui erro da execução do chatbot' WHEN trim(coalesce(text, '')) = '' THEN 'question vazio' WHEN doc_id % 19 = 0 OR trim(coalesce(source, '')) = '' THEN 'answer vazio'
      WHEN lower(trim(coalesce(flag, ''))) <> 'sim' THEN 'fora da média RAGAS principal: deve_responder = ' || coalesce(nullif(trim(flag), ''), 'não informado') WHEN contexts IS NULL THEN 'contexts não é lista'
      WHEN len(contexts) = 0 THEN 'contexts vazio' WHEN trim(coalesce(lang, '')) = '' THEN 'ground_truth vazio' END AS skip_reason FROM r0)"""
_MEANS = "count(*) FILTER (skip_reason IS NULL) AS count, round(avg(quality::DOUBLE) FILTER (skip_reason IS NULL), 6) AS mean_quality, round(avg(toxic::DOUBLE) FILTER (skip_reason IS NULL), 6) AS mean_toxic"
_PREV = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "query_intent": f"""WITH {_Q} SELECT conv_id, turn, {_INTENT} AS intent, {_match(vocab.OVERVIEW_PATTERNS)} AS overview, {_match(vocab.INVENTORY_PATTERNS)} AS inventory,
        {_has(vocab.CONGREGATIONAL_SCOPE_TERMS)} AND {_has(vocab.DOCTRINAL_BRIDGE_TERMS)} AND {_has(vocab.INSTITUTIONAL_TERMS)} AS bridge,
        {_has(vocab.SPECIFIC_DOCUMENT_TERMS)} OR (list_contains(w, 'congregacional') AND {_has(['confissao', 'fe'])}) AS names_document, {_FOLLOW} AS followup FROM w""",
    "query_scope_exact": f"""WITH {_Q}, s AS (SELECT conv_id, turn, trim(regexp_replace(folded, '[^a-z0-9]+', ' ', 'g')) AS s FROM f),
        a AS (SELECT * FROM (VALUES {_ALIAS}) v(document, alias)),
        m AS (SELECT s.*, document, alias FROM s JOIN a ON contains(' ' || s || ' ', ' ' || alias || ' ') WHERE NOT {_match(vocab.COMPARATIVE_PATTERNS, 's')}),
        g AS (SELECT conv_id, turn, first(document ORDER BY length(alias) DESC, alias DESC) AS scope_document, first(alias ORDER BY length(alias) DESC, alias DESC) AS scope_alias FROM m GROUP BY ALL HAVING count(DISTINCT document) = 1)
        SELECT s.conv_id, s.turn, scope_document, scope_alias FROM s LEFT JOIN g USING (conv_id, turn)""",
    "history_window": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
        SELECT conv_id, turn, CASE WHEN lower(trim(role)) = 'bot' THEN 'assistant' ELSE lower(trim(role)) END AS role, md5(substr({_PREV}, 1, 1600)) AS content_hash FROM n
        WHERE n <= 8 AND lower(trim(role)) IN ('user', 'assistant', 'bot') AND {_PREV} <> ''""",
    "followup_contextualize": f"""WITH {_Q}, p AS (SELECT *, coalesce(last_value(CASE WHEN lower(trim(role)) = 'user' AND {_PREV} <> '' THEN {_PREV} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev FROM f)
        SELECT conv_id, turn, md5(CASE WHEN NOT {_FOLLOW} OR prev = '' THEN clean WHEN {_contains(vocab.CLARIFICATION_MARKERS)} THEN 'Explique novamente, em linguagem mais simples, a resposta documental sobre: ' || prev
          ELSE clean || ' Contexto da pergunta anterior: ' || prev END) AS query_hash FROM (SELECT *, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS clean FROM p)""",
    "query_expansion": f"""WITH {_Q}, t AS (SELECT conv_id, turn, {_sig("concat_ws(' ', question, CASE WHEN turn % 2 = 0 THEN 'expiação regeneração' END)")} AS t FROM q)
        SELECT conv_id, turn, array_to_string(list_sort(t), ',') AS terms, array_to_string(list_sort({_expand('t')}), ',') AS expanded FROM t""",
    "evidence_decision": f"""
        WITH p0 AS (SELECT doc_id, {_QUESTION(_FIRST)} AS query, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 2 END AS n, length(text) AS chars, doc_id % 13 <> 0 AS has_map,
            [['doctrinal'], ['normative'], ['introductory'], ['contextual', 'introductory']][doc_id % 4 + 1] AS pri, doc_id % 3 <> 0 AS anchors, text FROM ({DOCS})),
        p AS (SELECT *, concat_ws(' ', text, CASE WHEN doc_id % 3 = 0 THEN query END) AS ctx, {sql_fold('query')} AS folded FROM p0),
        t AS (SELECT *, {_sig('query')} AS asked, {_sig('ctx')} AS there, list_distinct(regexp_extract_all(folded, '\\w+')) AS w FROM p),
        u AS (SELECT *, len(list_intersect(asked, there)) AS own, len(list_intersect({_expand('asked')}, there)) AS met, {_INTENT} AS kind, list_contains(pri, 'doctrinal') AS doc, list_contains(pri, 'normative') AS nor FROM t),
        r AS (SELECT doc_id, CASE WHEN n < 1 THEN 'no_context' WHEN {_contains(vocab.OUTSIDE_MARKERS)} THEN 'requested_material_outside_active_corpus' WHEN chars < 500 THEN 'context_too_short' WHEN NOT has_map THEN 'missing_source_map'
          WHEN pri = ['introductory'] THEN 'only_introductory_context' WHEN anchors AND NOT ((doc OR nor) AND has_map) THEN 'only_anchor_context'
          WHEN (len(asked) > 0 AND met = 0) OR (len(asked) = 1 AND met = 0) OR (len(asked) = 2 AND own < 2) THEN 'insufficient_query_context_overlap' WHEN len(asked) = 0 THEN 'insufficient_query_specificity'
          WHEN kind = 'doctrinal' AND NOT doc THEN 'no_doctrinal_context' WHEN kind = 'normative' AND NOT nor THEN 'no_normative_context_for_normative_query' WHEN kind IN ('mixed', 'general') AND NOT (doc OR nor) THEN 'no_relevant_documentary_context'
          ELSE 'sufficient_documentary_evidence' END AS reason FROM u)
        SELECT doc_id, reason, reason = 'sufficient_documentary_evidence' AS can_answer FROM r""",
    "skip_reasons": f"WITH {_R} SELECT coalesce(skip_reason, 'evaluated') AS outcome, count(*) AS n FROM r GROUP BY 1",
    "eval_means": f"WITH {_R} SELECT {_MEANS} FROM r",
    "eval_by_category": f"WITH {_R} SELECT lang, {_MEANS} FROM r GROUP BY lang",
    "behavioural_histograms": f"""WITH {_R}, b AS (SELECT * FROM r WHERE lower(trim(coalesce(flag, ''))) <> 'sim')
        SELECT 'flag' AS kind, flag AS value, count(*) AS n FROM b GROUP BY flag UNION ALL SELECT 'lang', lang, count(*) FROM b GROUP BY lang UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM b GROUP BY toxic""",
    "join_unique_sources": f"WITH {_R} SELECT doc_id, CASE WHEN contexts IS NULL OR len(contexts) = 0 OR lang IS NULL THEN '' ELSE lang || ' | ' || source END AS sources FROM r",
    "event_windows": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
