"""Subject rules: which one a question falls under, and how contexts fit it. Rules are data that the caller gives."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import fold_ascii, words_lit

#: What a context gains by a pattern that speaks for it, and loses by one against it (fixed values).
GAIN, LOSS = 4, 3


@dataclass(frozen=True)
class Unit:
    """An article of a document, or one paragraph of it, that belongs to a subject."""

    document_id: str
    article: str
    priority: int = 0
    paragraph: str | None = None


@dataclass(frozen=True)
class SubjectRule:
    """A question falls under a rule if it names one of the subject's aliases and one of the intent's. Aliases and patterns are folded; patterns are matched on folded text."""

    id: str
    subject: tuple[str, ...]
    intent: tuple[str, ...]
    units: tuple[Unit, ...] = ()
    framing: tuple[tuple[str, str], ...] = ()
    terms: str = ""
    least_contexts: int | None = None
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = field(default=())


def names_any(folded: Column, words: Column, aliases: tuple[str, ...]) -> Column:
    """Whether a folded text holds an alias: one word among its words, several as they stand."""
    single, several = [a for a in aliases if a and " " not in a], [a for a in aliases if " " in a]
    found = F.arrays_overlap(words, words_lit(single)) if single else F.lit(False)
    for a in several:
        found = found | folded.contains(a)
    return found


def subject_scope(questions: DataFrame, rules: tuple[SubjectRule, ...], text: str = "text") -> DataFrame:
    """Questions with rule_id, coverage_query and least_contexts: the one rule that a question falls under; null where none or several."""
    folded = questions.withColumn("_f", fold_ascii(text)).withColumn("_w", F.array_distinct(F.regexp_extract_all("_f", F.lit(r"\w+"), F.lit(0))))
    under = [names_any(F.col("_f"), F.col("_w"), r.subject) & names_any(F.col("_f"), F.col("_w"), r.intent) for r in rules]
    found = folded.withColumn("_one", F.concat_ws(",", *[F.when(u, F.lit(r.id)) for u, r in zip(under, rules, strict=True)]))  # several ids are no rule's id
    pick = lambda values, kind: reduce(lambda rest, pair: F.when(F.col("_one") == pair[0].id, F.lit(pair[1]).cast(kind)).otherwise(rest), zip(rules, values, strict=True), F.lit(None).cast(kind))
    query = F.trim(F.concat_ws(" ", text, F.nullif(pick([r.terms for r in rules], "string"), F.lit(""))))
    least = pick([None if r.least_contexts is None else max(1, r.least_contexts) for r in rules], "int")
    return found.select(*questions.columns, pick([r.id for r in rules], "string").alias("rule_id"), F.when(pick([True for _ in rules], "boolean"), query).otherwise(F.col(text)).alias("coverage_query"), least.alias("least_contexts"))


def framing_chunks(scoped: DataFrame, rules: tuple[SubjectRule, ...]) -> DataFrame:
    """question_id, document_id, chunk_id: the chunks that frame the subject of each question; a join with a table of rules, fixed by them."""
    rows = [(r.id, d, c) for r in rules for d, c in r.framing]
    table = scoped.sparkSession.createDataFrame(rows, "rule_id string, document_id string, chunk_id string")
    return scoped.select("question_id", "rule_id").join(F.broadcast(table), "rule_id").drop("rule_id")


def subject_match(contexts: DataFrame, rules: tuple[SubjectRule, ...], text: str = "text") -> DataFrame:
    """Contexts (rule_id, text ...) with subject_score: GAIN for each pattern of the rule that speaks for the text, less LOSS for each against it; 0 without a rule.

    A text is folded once and looks at the patterns of its own rule only.
    """
    rows = contexts.withColumn("_f", fold_ascii(text))
    score = F.lit(0)
    for r in rules:
        points = sum([F.when(F.col("_f").rlike(p), GAIN).otherwise(0) for p in r.positive] + [F.when(F.col("_f").rlike(p), -LOSS).otherwise(0) for p in r.negative], F.lit(0))
        score = F.when(F.col("rule_id") == r.id, points).otherwise(score)
    return rows.withColumn("subject_score", F.when(F.col("rule_id").isNull(), F.lit(0)).otherwise(score)).drop("_f")


def unit_match(contexts: DataFrame, rules: tuple[SubjectRule, ...], key: list[str]) -> DataFrame:
    """Contexts with unit_matches and unit_priority: whether a context is one of its rule's units, and the highest priority of those.

    contexts (rule_id, document_id, parent_key, reference, included: array of (article_number, paragraph_number)), told apart by key. A
    unit is a chunk of that article and paragraph among the included ones; else the parent's key or the reference has to name it.
    """
    rows = [(r.id, u.document_id, u.article, u.paragraph, u.priority) for r in rules for u in r.units]
    table = contexts.sparkSession.createDataFrame(rows, "rule_id string, document_id string, _article string, _paragraph string, _priority int")
    table = table.withColumn("_article", fold_ascii("_article")).withColumn("_paragraph", fold_ascii(F.coalesce("_paragraph", F.lit(""))))
    both = contexts.select(*key, "rule_id", "document_id", fold_ascii(F.coalesce("parent_key", F.lit(""))).alias("_key"), fold_ascii(F.coalesce("reference", F.lit(""))).alias("_ref"), "included").join(F.broadcast(table), ["rule_id", "document_id"])
    part = lambda x, name: fold_ascii(F.coalesce(x[name], F.lit("")))
    inside = F.exists(F.coalesce("included", F.array().cast("array<struct<article_number:string,paragraph_number:string>>")), lambda x: (part(x, "article_number") == F.col("_article")) & (part(x, "paragraph_number") == F.col("_paragraph")))
    quoted = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9])", r"\\$1")
    article = F.concat(F.lit(r"(?:::article::"), quoted("_article"), F.lit(r"\b|\bart\.?\s*"), quoted("_article"), F.lit(r"\b)"))
    paragraph = F.concat(F.lit(r"(?:::paragraph::"), quoted("_paragraph"), F.lit(r"\b|\b"), quoted("_paragraph"), F.lit(r"\b)"))
    like = lambda pattern: F.regexp_like("_key", pattern) | F.regexp_like("_ref", pattern)
    bare = ~F.col("_key").contains("::paragraph::") & ~F.col("_ref").rlike(r"\b\d+o\b")
    named = (F.col("_article") != "") & like(article) & F.when(F.col("_paragraph") != "", like(paragraph)).otherwise(bare)
    found = both.where(inside | named).groupBy(*key).agg(F.max("_priority").alias("unit_priority"))
    return contexts.join(found, key, "left").withColumn("unit_matches", F.col("unit_priority").isNotNull()).na.fill(0, ["unit_priority"])
