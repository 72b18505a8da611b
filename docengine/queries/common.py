"""Tables in the roles that the operators give them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import vocab


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; texts in fewer files than the session has cores are dealt to all of them."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in ("documents", "conversations") and len(found.inputFiles()) < cores else found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, document_id, text, lang, position; CHUNKS_OF texts of neighbouring ids are the chunks of one document at any size of the table; types and roles follow from id and source."""
    d = documents(spark, sf_dir)
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("d"), F.floor(F.col("doc_id") / CHUNKS_OF).cast("string")).alias("document_id"),
        "text",
        "lang",
        F.col("doc_id").alias("position"),
        pick(CHUNK_TYPES, F.col("doc_id")).alias("chunk_type"),
        pick(DOCUMENT_TYPES, F.length("source") + F.ascii(F.substring("source", -1, 1))).alias("document_type"),
        (F.length("text") % 10).cast("string").alias("article_number"),
    )


CHUNKS_OF = 40
CHUNK_TYPES = ("doctrinal_article", "confession_paragraph", "preface", "special_layout", "note", "summary", "normative_article")
DOCUMENT_TYPES = ("confession_of_faith", "constitution", "letter", "catechism", "other")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_fold(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), '{vocab.ACCENTED}', '{vocab.PLAIN}'), '[^\\x00-\\x7F]', '', 'g')"


def sql_slug(x: str, empty: str = "sem-chave") -> str:
    return f"coalesce(nullif(trim(regexp_replace({sql_fold(x)}, '[^a-z0-9]+', '-', 'g'), '-'), ''), '{empty}')"


def split_sql(x: str, limit: int = 3200) -> str:
    """Parts of up to `limit` characters of a text as a list, by a fold over paragraphs with a fold over sentences inside."""
    made = lambda parts, now: f"{{'parts': {parts}, 'now': {now}}}"
    empty = "CAST([] AS VARCHAR[])"
    flush = lambda a: f"CASE WHEN {a}.now = '' THEN {a}.parts ELSE list_append({a}.parts, {a}.now) END"
    sentences = "string_split(regexp_replace(p.now, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    also = "CASE WHEN b.now = '' THEN s.now ELSE trim(b.now || ' ' || s.now) END"
    inner = f"list_reduce(list_prepend({made(flush('a'), chr(39) * 2)}, list_transform({sentences}, lambda piece: {made(empty, 'piece')})), lambda b, s: CASE WHEN length({also}) <= {limit} THEN {made('b.parts', also)} ELSE {made(flush('b'), 's.now')} END)"
    more = "CASE WHEN a.now = '' THEN p.now ELSE trim(a.now || chr(10) || chr(10) || p.now) END"
    outer = f"list_reduce(list_prepend({made(empty, chr(39) * 2)}, list_transform(string_split({x}, chr(10) || chr(10)), lambda piece: {made(empty, 'piece')})), lambda a, p: CASE WHEN length({more}) <= {limit} THEN {made('a.parts', more)} ELSE {inner} END)"
    return f"CASE WHEN length({x}) <= {limit} THEN [{x}] ELSE list_transform([{outer}], lambda a: {flush('a')})[1] END"


DOCS = "SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents"
CHUNKS = f"""SELECT doc_id AS chunk_id, 'd' || doc_id // {CHUNKS_OF} AS document_id, coalesce(text, '') AS text, lang, doc_id AS position,
    {sql_list(CHUNK_TYPES)}[doc_id % {len(CHUNK_TYPES)} + 1] AS chunk_type,
    {sql_list(DOCUMENT_TYPES)}[(length(source) + ascii(right(source, 1))) % {len(DOCUMENT_TYPES)} + 1] AS document_type,
    CAST(length(coalesce(text, '')) % 10 AS VARCHAR) AS article_number FROM documents"""
