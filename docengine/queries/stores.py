"""Queries over files, collections and contracts: numbered lines, versions of records, declared constraints, warnings of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import contracts as K
from docengine.operators import retrieval as R
from docengine.queries.common import CHUNKS, CHUNKS_OF, DOCS, chunk_rows, documents, table
from docengine.queries.retrieval import _asked, _vectors
from docengine.sources import numbered
from docengine.sources.collection import Collection, index_metadata
from docengine.sources.shared import new_path

#: Documents whose records share a file.
FILE_ROWS = 5_000


def _files(spark: SparkSession, sf_dir: str) -> str:
    """documents as files of JSON lines by source; some lines are cut, some are lists, some follow a blank one, as the length of the text has it."""
    n = F.length("text")
    record = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"), {"ignoreNullFields": "false"})
    line = F.when(n % 7 == 0, F.substring(record, 1, 9)).when(n % 11 == 0, F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))).otherwise(record)
    d = documents(spark, sf_dir).select(F.concat(F.when(n % 5 == 0, F.lit(" \n")).otherwise(F.lit("")), line).alias("value"), "doc_id", F.col("source").alias("of"), F.floor(F.col("doc_id") / FILE_ROWS).alias("file_no"))
    path = new_path(spark, "lines")
    d.repartition("of", "file_no").sortWithinPartitions("of", "file_no", "doc_id").drop("doc_id").write.partitionBy("of", "file_no").text(path)
    return path


def jsonl_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON lines with the number of their line in the file."""
    d = numbered.ordered_records(spark, _files(spark, sf_dir), "doc_id long, lang string, source string, n_chars long", strict=False)
    return d.select("of", F.col("file_no").cast("long").alias("file_no"), "document_order", "doc_id", "lang", "n_chars")


def jsonl_line_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the same files that are no records."""
    return numbered.line_issues(spark, _files(spark, sf_dir)).select("of", F.col("file_no").cast("long").alias("file_no"), "line_number", "issue")


def _collection(spark: SparkSession, sf_dir: str) -> Collection:
    """Vectors of two thirds of the labels, then all with an even id under a new label."""
    v = _vectors(spark, sf_dir)
    c = Collection(spark, new_path(spark, "collection"), space="cosine")
    c.upsert(v.where("label % 3 <> 0"))
    c.upsert(v.where("chunk_id % 2 = 0").withColumn("label", F.col("label") + 100))
    return c


def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection holds after two upserts."""
    return _collection(spark, sf_dir).read().select("chunk_id", F.col("label").cast("long").alias("label"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest records of the collection to each hundredth vector, with what is stored beside them."""
    held = _collection(spark, sf_dir).read()
    found = R.dense(held, _asked(_vectors(spark, sf_dir)), 5).join(held.select("chunk_id", "label"), "chunk_id")
    return found.select("question_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"), F.col("label").cast("long").alias("label"))


def index_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of chunks as they go beside vectors, read back from their JSON."""
    c = chunk_rows(spark, sf_dir).withColumn("article_number", F.when(F.col("article_number") != "0", F.col("article_number"))).withColumns({"language": F.col("lang"), "biblical_references": F.split("lang", ""), "page_start": F.col("position"), "is_doctrinal": F.lit(True)})
    c = c.withColumn("m", index_metadata(c))
    get = lambda name: F.get_json_object("m", f"$.{name}").alias(name)
    return c.select("chunk_id", F.size(F.json_object_keys("m")).cast("long").alias("n_fields"), get("document_id"), get("language"), get("article_number"), get("biblical_references"), get("page_start").cast("long"), get("is_doctrinal"))


def _constraints(spark: SparkSession, sf_dir: str, d: DataFrame) -> list:
    labels = table(spark, sf_dir, "labels").withColumn("expected", F.col("doc_id") + F.when(F.col("toxic") == 1, 1_000_000_000).otherwise(0))
    return [
        K.required("text"), K.required("source"), K.one_of("lang", ("en", "de", "fr")), K.matches("source", "^src[0-9]$", "warning"), K.equal("n_chars", "n_points"), K.Unique("unique:digest", ("digest",), "warning"), K.Unique("unique:doc_id", ("doc_id",)),
        K.Refers("refers:doc_id", "doc_id", labels, "doc_id", "warning"), K.Covers("covers:labels", "doc_id", labels, "expected"), K.Total("total:n_chars", F.sum("n_chars"), F.sum(F.length("text"))), K.Total("total:rows", F.count("*"), F.lit(0)),
    ]


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("digest", F.sha2("text", 256)).withColumn("n_points", F.length("text"))
    return K.report(d, _constraints(spark, sf_dir, d), "doc_id")


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared constraints on documents: how often each is broken, and where first."""
    return _checked(spark, sf_dir).select("constraint", "severity", "n_breaches", F.array_join("examples", ",").alias("examples"))


def contract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.status(_checked(spark, sf_dir))


def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of neighbouring ids as the pages of one document; those of some lengths have lost theirs, others are missing."""
    d = documents(spark, sf_dir)
    n = F.length("text")
    pages = d.where(n % 13 != 0).select(F.floor(F.col("doc_id") / CHUNKS_OF).alias("document_id"), F.col("doc_id").alias("page_number"), F.when(n % 9 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("text"))
    return K.page_warnings(pages, 2_400).select("document_id", F.array_join("warnings", ";").alias("warnings"))


_FNS = (jsonl_ordinals, jsonl_line_issues, collection_upsert, collection_search, index_fields, contract_violations, contract_status, page_warnings)
QUERIES = {f.__name__: f for f in _FNS}

_FILES = f"""f AS (SELECT *, length(text) AS n, source AS of, doc_id // {FILE_ROWS} AS file_no FROM (SELECT d.*, coalesce(o.n_chars, 0) AS n_chars FROM ({DOCS}) d JOIN (SELECT doc_id, n_chars FROM documents) o USING (doc_id))),
    l AS (SELECT *, n % 5 = 0 AS after_blank, CAST(sum(1 + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY of, file_no ORDER BY doc_id) AS BIGINT) AS line_number FROM f)"""
_UPSERTED = "u AS (SELECT vec_id AS chunk_id, embedding, CAST(CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS BIGINT) AS label FROM embeddings WHERE vec_id % 2 = 0 OR label % 3 <> 0)"
_BREACHES = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars, sha256(coalesce(text, '')) AS digest FROM documents),
    b AS (SELECT 'required:text' AS c, CAST(doc_id AS VARCHAR) AS x FROM d WHERE NOT regexp_matches(text, '\\S') UNION ALL SELECT 'required:source', CAST(doc_id AS VARCHAR) FROM d WHERE NOT regexp_matches(coalesce(source, ''), '\\S')
      UNION ALL SELECT 'one_of:lang', CAST(doc_id AS VARCHAR) FROM d WHERE NOT coalesce(lang IN ('en', 'de', 'fr'), false) UNION ALL SELECT 'matches:source', CAST(doc_id AS VARCHAR) FROM d WHERE NOT coalesce(regexp_matches(source, '^src[0-9]$'), false)
      UNION ALL SELECT 'equal:n_chars=n_points', CAST(doc_id AS VARCHAR) FROM d WHERE n_chars IS DISTINCT FROM length(text)
      UNION ALL SELECT 'unique:digest', digest FROM (SELECT digest, unnest(range(1, count(*))) FROM d GROUP BY digest) UNION ALL SELECT 'unique:doc_id', CAST(doc_id AS VARCHAR) FROM (SELECT doc_id, unnest(range(1, count(*))) FROM d GROUP BY doc_id)
      UNION ALL SELECT 'refers:doc_id', CAST(doc_id AS VARCHAR) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT DISTINCT 'covers:labels', CAST(doc_id + 1000000000 AS VARCHAR) FROM labels WHERE toxic = 1 UNION ALL SELECT DISTINCT 'covers:labels', CAST(doc_id AS VARCHAR) FROM labels WHERE coalesce(toxic, 0) <> 1 AND doc_id NOT IN (SELECT doc_id FROM d)
      UNION ALL SELECT 'total:n_chars', sum(n_chars) || ' <> ' || sum(length(text)) FROM d HAVING sum(n_chars) IS DISTINCT FROM sum(length(text)) UNION ALL SELECT 'total:rows', count(*) || ' <> 0' FROM d HAVING count(*) <> 0),
    k AS (SELECT * FROM (VALUES ('required:text', 'error'), ('required:source', 'error'), ('one_of:lang', 'error'), ('matches:source', 'warning'), ('equal:n_chars=n_points', 'error'), ('unique:digest', 'warning'), ('unique:doc_id', 'error'), ('refers:doc_id', 'warning'),
      ('covers:labels', 'error'), ('total:n_chars', 'error'), ('total:rows', 'error')) v(c, severity)),
    r AS (SELECT k.c AS "constraint", severity, count(b.c) AS n_breaches, coalesce(array_to_string(list(b.x ORDER BY b.x)[1:5], ','), '') AS examples FROM k LEFT JOIN b USING (c) GROUP BY k.c, severity)"""

ORACLE_SQL = {
    "jsonl_ordinals": f"WITH {_FILES} SELECT of, file_no, line_number AS document_order, doc_id, lang, n_chars FROM l WHERE n % 7 <> 0 AND n % 11 <> 0",
    "jsonl_line_issues": f"""WITH {_FILES} SELECT of, file_no, line_number - 1 AS line_number, 'blank_line' AS issue FROM l WHERE after_blank
        UNION ALL SELECT of, file_no, line_number, CASE WHEN n % 7 = 0 THEN 'invalid_json' ELSE 'not_an_object' END FROM l WHERE n % 7 = 0 OR n % 11 = 0""",
    "collection_upsert": f"WITH {_UPSERTED} SELECT chunk_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM u",
    "collection_search": f"""WITH {_UPSERTED}, n AS (SELECT q.vec_id AS question_id, u.chunk_id, u.label, round(list_cosine_distance(u.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, u WHERE q.vec_id % 100 = 0)
        SELECT question_id, chunk_id, distance, rank, label FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM n) WHERE rank <= 5""",
    "index_fields": f"""WITH c AS ({CHUNKS}) SELECT chunk_id, CAST(8 + CASE WHEN article_number <> '0' THEN 1 ELSE 0 END AS BIGINT) AS n_fields, document_id, lang AS language, nullif(article_number, '0') AS article_number,
        '["' || array_to_string(string_split(lang, ''), '","') || '"]' AS biblical_references, position AS page_start, 'true' AS is_doctrinal FROM c""",
    "contract_violations": f"WITH {_BREACHES} SELECT * FROM r",
    "contract_status": f"WITH {_BREACHES} SELECT CASE WHEN count(*) FILTER (n_breaches > 0 AND severity = 'error') > 0 THEN 'FAIL' WHEN count(*) FILTER (n_breaches > 0) > 0 THEN 'PARTIAL' ELSE 'PASS' END AS status, count(*) AS n_constraints, count(*) FILTER (n_breaches > 0) AS n_broken FROM r",
    "page_warnings": f"""WITH p AS (SELECT doc_id // {CHUNKS_OF} AS document_id, doc_id, CASE WHEN length(text) % 9 = 0 THEN ' ' || chr(10) ELSE text END AS x, length(text) % 9 = 0 OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS empty FROM ({DOCS}) WHERE length(text) % 13 <> 0),
        g AS (SELECT document_id, first(empty ORDER BY doc_id) AS first_empty, count(*) FILTER (empty) AS n_empty, avg(length(x)) AS mean, max(doc_id) - min(doc_id) + 1 - count(*) AS missing FROM p GROUP BY document_id)
        SELECT document_id, concat_ws(';', CASE WHEN first_empty THEN 'first_page_without_text' END, CASE WHEN n_empty > 0 THEN 'pages_without_text:' || n_empty END, CASE WHEN mean < 2400 THEN 'short_pages' END, CASE WHEN missing > 0 THEN 'missing_pages:' || missing END) AS warnings FROM g""",
}
