"""Evaluation rows from packages: nested records whose members may be missing, null or of another type, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an evaluation row that are no scores (fixed values).
NO_SCORES = (
    "id", "categoria", "pergunta", "documentos_esperados", "escopo_esperado", "mistura_permitida", "referencia_esperada", "resposta_esperada_ground_truth", "deve_responder", "observacao", "question", "answer", "ground_truth",
    "contexts", "retrieved_sources", "ragas_error", "chatbot_status", "raw_response", "_ragas_model_config", "ragas_metric_warning",
)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def member(v: Column, path: str, kind: str = "string") -> Column:
    """A member as a type, null where it is missing or does not fit; texts are trimmed, and lists or records are no texts."""
    got = F.try_variant_get(v, path, kind)
    if kind != "string":
        return got
    plain = ~F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    return F.when(plain, F.trim(got))


def members(v: Column, path: str) -> Column:
    """The elements of a list; none where there is no list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def package_contexts(packages: DataFrame, key: str = "question_id", package: str = "package") -> DataFrame:
    """key, context_index (from 1), source_id, context (variant), source (variant of the source map, or null): the records among the contexts of each package; a package that is no JSON object has none."""
    read = packages.select(key, F.try_parse_json(package).alias("_p")).where(is_object(F.col("_p")))
    every = F.filter(members(F.col("_p"), "$.contexts"), is_object)
    each = read.select(key, F.col("_p"), F.posexplode(every).alias("_n", "context"))
    sources = F.try_variant_get("_p", "$.source_map", "map<string,variant>")
    source_id = F.concat(F.lit("source_"), (F.col("_n") + 1).cast("string"))
    return each.select(key, (F.col("_n") + 1).cast("long").alias("context_index"), source_id.alias("source_id"), "context", F.try_element_at(sources, source_id).alias("source"))


def package_sources(packages: DataFrame, key: str = "question_id", package: str = "package") -> DataFrame:
    """key, context_index, source_id, chunk_id, document_id, article_number, page_start, page_end, is_anchor, text: each included chunk of each context; a context without any stands for itself and is its own anchor."""
    rows = package_contexts(packages, key, package)
    c = F.col("context")
    chunks, anchors = members(c, "$.metadata.included_chunks"), F.coalesce(F.try_variant_get(c, "$.anchor_chunk_ids", "array<string>"), F.array().cast("array<string>"))
    rows = rows.withColumn("_chunks", chunks).withColumn("_anchors", anchors)
    own = rows.where(F.size("_chunks") == 0).withColumn("_c", c).withColumn("_of", F.lit(False))
    listed = rows.where(F.size("_chunks") > 0).select("*", F.explode(F.filter("_chunks", is_object)).alias("_c")).withColumn("_of", F.lit(True))
    every = own.unionByName(listed)
    x = F.col("_c")
    chunk_id = F.when(F.col("_of"), member(x, "$.chunk_id")).otherwise(F.try_element_at("_anchors", F.lit(1)))
    return every.select(
        key, "context_index", "source_id", chunk_id.alias("chunk_id"), F.coalesce(member(x, "$.document_id"), member(c, "$.document_id")).alias("document_id"), member(x, "$.article_number").alias("article_number"),
        member(x, "$.page_start", "int").alias("page_start"), member(x, "$.page_end", "int").alias("page_end"), (~F.col("_of") | F.coalesce(F.array_contains("_anchors", chunk_id), F.lit(False))).alias("is_anchor"),
        F.coalesce(F.when(F.col("_of"), member(x, "$.text")).otherwise(member(x, "$.context_text")), F.lit("")).alias("text"),
    )


def audit_fields(packages: DataFrame, mode: str = "prompt", used: str | None = None, key: str = "question_id", package: str = "package") -> DataFrame:
    """key, contexts, prompt_contexts (arrays of texts, in order), n_contexts, n_sources, n_anchors of each package; those without any contexts have empty lists.

    mode: prompt takes all contexts, cited those whose source_id is in the column `used`, chunks the texts of included chunks in place of their context's. Packages meet by key alone: one package's texts in a row, as they were before.
    """
    rows = package_contexts(packages, key, package)
    text = member(F.col("context"), "$.context_text")
    full = rows.withColumn("_t", F.nullif(F.coalesce(text, F.lit("")), F.lit("")))
    if mode == "cited":
        full = full.join(packages.select(key, F.col(used).alias("_used")), key).withColumn("_take", F.array_contains("_used", F.col("source_id")) | (F.size("_used") == 0))
    else:
        full = full.withColumn("_take", F.lit(True))
    chunks = F.filter(F.transform(F.filter(members(F.col("context"), "$.metadata.included_chunks"), is_object), lambda x: F.coalesce(member(x, "$.text"), F.lit(""))), lambda t: t != "")
    own = F.when(F.col("_t").isNotNull(), F.array("_t")).otherwise(F.array().cast("array<string>"))
    taken = F.when(F.size(members(F.col("context"), "$.metadata.included_chunks")) > 0, chunks).otherwise(own) if mode == "chunks" else own
    full = full.withColumn("_taken", F.when(F.col("_take"), taken).otherwise(F.array().cast("array<string>"))).withColumn("_own", own)
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("context_index", c))), lambda x: x[c]))
    texts = full.groupBy(key).agg(ordered("_taken").alias("contexts"), ordered("_own").alias("prompt_contexts"), F.count("*").alias("n_contexts"))
    sources = package_sources(packages, key, package).groupBy(key).agg(F.count("*").alias("n_sources"), F.count_if("is_anchor").alias("n_anchors"))
    out = packages.select(key).join(texts, key, "left").join(sources, key, "left").na.fill(0, ["n_contexts", "n_sources", "n_anchors"])
    empty = F.array().cast("array<string>")
    return out.withColumn("contexts", F.coalesce("contexts", empty)).withColumn("prompt_contexts", F.coalesce("prompt_contexts", empty))


def score_columns(rows: DataFrame, record: str = "record", excluded: tuple[str, ...] = NO_SCORES) -> DataFrame:
    """name, n_rows, n_scored, mean of the members of JSON records that are numbers or null somewhere: the scores that nobody declared. Booleans count as 0 and 1."""
    read = rows.select(F.try_parse_json(record).alias("v")).where(is_object(F.col("v")))
    each = rows.sparkSession.sql("SELECT key, schema_of_variant(value) AS kind, value FROM {read}, LATERAL variant_explode(v)", read=read).where(~F.col("key").isin(*excluded))
    numeric = F.col("kind").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|BOOLEAN|VOID)")
    value = F.when(F.col("kind") == "BOOLEAN", F.try_variant_get("value", "$", "boolean").cast("double")).when(numeric, F.try_variant_get("value", "$", "double"))
    found = each.groupBy(F.col("key").alias("name")).agg(F.count("*").alias("n_rows"), F.count(value).alias("n_scored"), F.avg(value).alias("mean"), F.count_if(numeric).alias("_numeric"))
    return found.where("_numeric > 0").drop("_numeric")
