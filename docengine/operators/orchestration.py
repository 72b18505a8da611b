"""Steps around retrieval: supplements, guards, retries, roles, source maps, audits, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supplemented(found: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """found and what of extra has no equal keys among it; of keys that repeat inside extra the first by rank."""
    new = extra.join(found.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where("_n = 1").drop("_n")
    return found.unionByName(new)


def guarded(contexts: DataFrame, scope: DataFrame) -> DataFrame:
    """Contexts of questions with a scope (question_id, scope_document) without those of other documents; ranks anew, with the question's remaining count and characters."""
    kept = contexts.join(scope, "question_id", "left").where(F.col("scope_document").isNull() | (F.col("scope_document") == F.col("document_id")))
    q = Window.partitionBy("question_id")
    return kept.withColumn("rank", F.row_number().over(q.orderBy("rank"))).withColumn("context_count", F.count("*").over(q)).withColumn("total_chars", F.sum("n_chars").over(q)).drop("scope_document")


def first_attempt(attempts: DataFrame) -> DataFrame:
    """Of each question the rows of its first attempt that found anything."""
    return attempts.withColumn("_first", F.min("attempt").over(Window.partitionBy("question_id"))).where("attempt = _first").drop("_first")


def by_roles(candidates: DataFrame, roles: list[str], most: int) -> DataFrame:
    """question_id, role, chunk_id, document_id: for each role in turn the best candidate (question_id, chunk_id, document_id, roles array, rank) of a document not used yet.

    A question's candidates are few; they are folded in one row.
    """
    row = F.struct("rank", "chunk_id", "document_id", "roles")
    listed = candidates.groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("_all"))
    none = F.array().cast("array<struct<role:string,chunk_id:bigint,document_id:string>>")

    def pick(picks: Column, role: Column) -> Column:
        used = F.transform(picks, lambda p: p["document_id"])
        fit = F.filter("_all", lambda x: F.array_contains(x["roles"], role) & ~F.array_contains(used, x["document_id"].cast("string")))
        room = F.when(F.size(picks) < most, 1).otherwise(0)
        return F.concat(picks, F.transform(F.slice(fit, F.lit(1), room), lambda x: F.struct(role.alias("role"), x["chunk_id"].cast("bigint").alias("chunk_id"), x["document_id"].cast("string").alias("document_id"))))

    listed = listed.select("question_id", F.aggregate(F.array(*map(F.lit, roles)), none, pick).alias("_picks"))
    return listed.select("question_id", F.explode("_picks").alias("p")).select("question_id", "p.*")


def source_map(contexts: DataFrame, most: int = 8) -> DataFrame:
    """question_id, source, label: numbered sources of each question with their citation labels."""
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "document_id", F.lit(", p. "), F.col("page").cast("string"), F.lit("."))
    return contexts.where(F.col("rank") <= most).select("question_id", F.concat(F.lit("source_"), F.col("rank").cast("string")).alias("source"), label.alias("label"))


def candidate_audit(candidates: DataFrame, final: DataFrame) -> DataFrame:
    """Each candidate with the rank of its parent among the final contexts and whether it was selected."""
    return candidates.join(final.select("question_id", "parent_key", F.col("rank").alias("final_rank")), ["question_id", "parent_key"], "left").withColumn("selected", F.col("final_rank").isNotNull())


def joined_pt(values: Column) -> Column:
    """a, b e c."""
    head = F.array_join(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), ", ")
    return F.when(F.size(values) == 0, "").when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.concat(head, F.lit(" e "), F.element_at(values, -1)))


def suggestions(answers: DataFrame, most: int = 3) -> DataFrame:
    """id, place, question: the questions of a JSON array in content, fenced or not; equal ones without regard to case once; cut to 220 characters."""
    body = F.regexp_replace("content", r"(?s)\A\s*```(?:json)?\s*|\s*```\s*\z", "")
    each = answers.select("id", F.posexplode(F.from_json(body, "array<struct<question:string>>")).alias("_p", "_x")).select("id", "_p", F.trim(F.regexp_replace("_x.question", r"\s+", " ")).alias("question")).where("question <> ''")
    once = each.withColumn("_n", F.row_number().over(Window.partitionBy("id", F.lower("question")).orderBy("_p"))).where("_n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("_p"))).where(F.col("place") <= most).select("id", F.col("place").cast("long").alias("place"), F.substring("question", 1, 220).alias("question"))


def merged_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows (position, skip_reason) with scores (place): the n-th row without skip_reason gets the n-th score; NaN is null; adds warnings of missing ones."""
    n = F.when(F.col("skip_reason").isNull(), F.row_number().over(Window.partitionBy("shard", F.col("skip_reason").isNull()).orderBy("position")))
    placed = rows.withColumn("place", n)
    value = F.when(~F.isnan("score"), F.col("score"))
    out = placed.join(scores, ["shard", "place"], "left").withColumn("score", value)
    return out.withColumn("warning", F.when(F.col("skip_reason").isNull() & F.col("score").isNull(), "missing_score"))
