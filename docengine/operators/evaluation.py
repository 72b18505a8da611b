"""Evaluation records: skip rules, means, histograms, joined sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skip_reason(error: Column, question: Column, answer: Column, flag: Column, contexts: Column, truth: Column) -> Column:
    """The first rule that keeps a record out of the means; null if none does."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    shown = F.coalesce(F.nullif(F.trim(flag), F.lit("")), F.lit("não informado"))
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "linha possui erro da execução do chatbot")
        .when(blank(question), "question vazio")
        .when(blank(answer), "answer vazio")
        .when(F.lower(F.trim(F.coalesce(flag, F.lit("")))) != "sim", F.concat(F.lit("fora da média RAGAS principal: deve_responder = "), shown))
        .when(contexts.isNull(), "contexts não é lista")
        .when(F.size(contexts) == 0, "contexts vazio")
        .when(blank(truth), "ground_truth vazio")
    )


def means(records: DataFrame, scores: list[str], by: list[str] = ()) -> DataFrame:
    """Mean of each score over records without skip_reason, per group; groups without such records are listed with count 0."""
    used = F.col("skip_reason").isNull()
    value = lambda c: F.when(used & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return records.groupBy(*by).agg(F.count_if(used).alias("count"), *[F.round(F.avg(value(c)), 6).alias(f"mean_{c}") for c in scores])


def histograms(records: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value, n: a histogram of each column, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]))
    return records.select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def join_unique(values: Column) -> Column:
    """Distinct values that are not empty, in order, joined."""
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), " | ")
