"""Contexts that cover documents of several roles: bridges between doctrine and norms, inventories of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import fold_ascii, truncated
from docengine.operators.orchestration import by_roles

#: Words that tie a context to institutions, with weights (fixed values).
BRIDGE_WEIGHTS = (
    (r"\bigrejas?\b", 3),
    (r"\bgoverno\b", 3),
    (r"\bordem\b", 3),
    (r"\binstituicao\b", 3),
    (r"\binstitucional\b", 2),
    (r"\binstitucionais\b", 2),
    (r"\bnormas?\b", 2),
    (r"\bpalavra\b", 1),
    (r"\bescrituras?\b", 1),
    (r"\bdoutrina\b", 1),
)
#: Words for documents that an inventory lists (fixed patterns).
INVENTORY_TERMS = (
    r"\bconstituicao\b",
    r"\bregimento\b",
    r"\bconfissao\b",
    r"\bcodigo\b",
    r"\betica\b",
    r"\bdecisoes?\b",
    r"\bconciliares?\b",
    r"\bresolucoes?\b",
    r"\bdiretoria\s+nacional\b",
)
#: Roles in the order in which they are filled (fixed values).
BRIDGE_ROLES = ("alliance_confession", "constitution", "internal_regiment", "normative_ethics", "administrative_resolution")
INVENTORY_ROLES = ("document_inventory", "alliance_confession", "normative_ethics", "constitution", "internal_regiment", "administrative_resolution")
#: Types of documents that are roles of their own (fixed values).
TYPE_ROLES = ("constitution", "internal_regiment", "normative_ethics", "administrative_resolution")
LONG_STRATEGIES = ("overview_structural_group", "normative_unit_list")


def _counted(title: Column, text: Column, chars: int, weighted: tuple[tuple[str, int], ...]) -> Column:
    shown = fold_ascii(F.concat_ws(" ", title, F.substring(text, 1, chars)))
    return sum((F.when(shown.rlike(p), w).otherwise(0) for p, w in weighted), F.lit(0))


def bridge_score(title: Column, text: Column) -> Column:
    """Weights of the institutional words in a context's title and first 3,000 characters."""
    return _counted(title, text, 3000, BRIDGE_WEIGHTS)


def inventory_count(title: Column, text: Column) -> Column:
    """How many kinds of documents a context's title and first 4,000 characters name."""
    return _counted(title, text, 4000, tuple((p, 1) for p in INVENTORY_TERMS))


def coverage_role(inventory: Column, own_confession: Column, document_type: Column, source_category: Column, priority: Column) -> Column:
    """A context's role: an inventory from three kinds of documents on, else by its document."""
    return (
        F.when(inventory >= 3, "document_inventory").when(own_confession, "alliance_confession").when(document_type.isin(*TYPE_ROLES), document_type)
        .when(source_category == "denominational_normative_document", "other_normative").when(priority == "doctrinal", "other_doctrinal").otherwise("other")
    )


def char_limit(strategies: Column, each: int, total: int) -> Column:
    """Characters of a group's context: half as many more, within the total, if a strategy of it asks for long ones."""
    return F.when(F.arrays_overlap(strategies, F.array(*map(F.lit, LONG_STRATEGIES))), max(each, min(total, int(each * 1.5)))).otherwise(each)


def promoted_by_role(ranked: DataFrame, kind: str, k: int = 6, most_chars: int = 4200) -> DataFrame:
    """Adds applied, reason, promoted; puts the best context of each role first, of different documents, k at most; cuts promoted texts to most_chars; renews rank.

    ranked (question_id, parent_key, document_id, document_type, role, rank, ranking_score, bridge, unit_match, inventory,
    text). kind: bridge (needs the own confession and a normative role) or inventory (needs two
    roles). A question without enough of them stays as it was. The best of a role is the one of most bridge weight and a matching unit
    (for bridges), most kinds of documents, best score, first rank. A context fills the role it has and that of its document's type.
    """
    roles = list(BRIDGE_ROLES if kind == "bridge" else INVENTORY_ROLES)
    q = Window.partitionBy("question_id")
    by_bridge = [F.desc("bridge"), F.desc("unit_match")] if kind == "bridge" else []
    best = F.row_number().over(q.orderBy(*by_bridge, F.desc("inventory"), F.desc(F.coalesce("ranking_score", F.lit(0.0))), F.asc("rank")))
    candidates = ranked.select("question_id", F.col("rank").cast("long").alias("chunk_id"), "document_id", F.array_compact(F.array("role", F.when(F.col("document_type").isin(*TYPE_ROLES), F.col("document_type")))).alias("roles"), best.alias("rank"))
    picks = by_roles(candidates, roles, k).select("question_id", F.col("chunk_id").alias("_rank"), F.col("role").alias("_for"))
    rows = ranked.withColumnRenamed("rank", "_rank").join(picks.withColumn("_order", F.array_position(F.array(*map(F.lit, roles)), F.col("_for"))), ["question_id", "_rank"], "left")
    chosen = F.col("_order").isNotNull()
    enough = F.count_if(chosen).over(q) >= 2
    if kind == "bridge":
        own = lambda test: F.coalesce(F.bool_or(chosen & test).over(q), F.lit(False))
        enough = enough & own(F.col("role") == BRIDGE_ROLES[0]) & own(F.col("role").isin(*BRIDGE_ROLES[1:]))
    done, lack = ("institutional_doctrinal_bridge_coverage_promoted", "insufficient_doctrinal_normative_coverage") if kind == "bridge" else ("document_inventory_coverage_promoted", "insufficient_document_inventory_coverage")
    rows = rows.withColumn("applied", enough).withColumn("reason", F.when(F.col("applied"), done).otherwise(lack)).withColumn("promoted", F.col("applied") & chosen)
    rows = rows.withColumn("text", F.when(F.col("promoted"), truncated("text", most_chars)).otherwise(F.col("text")))
    order = q.orderBy(F.desc("promoted"), F.when(F.col("promoted"), F.col("_order")), F.asc("_rank"))
    return rows.withColumn("rank", F.row_number().over(order)).drop("_rank", "_for", "_order")
