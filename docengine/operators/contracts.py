"""Declared constraints on a table, checked together: what breaks them, how often, and where first."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.sources.shared import written


@dataclass(frozen=True)
class Rule:
    """Holds of each row where `holds` is not false; a null result counts as broken."""

    name: str
    holds: Column
    severity: str = "error"


@dataclass(frozen=True)
class Unique:
    """No two rows are equal in these columns. Rows with a null there are left to required()."""

    name: str
    columns: tuple[str, ...]
    severity: str = "error"


@dataclass(frozen=True)
class Refers:
    """Each value of the column is one of the other table's; null refers to nothing and is no breach."""

    name: str
    column: str
    table: DataFrame
    other: str
    severity: str = "error"


@dataclass(frozen=True)
class Covers:
    """Each value of the other table is one of this column's: expected keys that are missing."""

    name: str
    column: str
    table: DataFrame
    other: str
    severity: str = "error"


@dataclass(frozen=True)
class Total:
    """An aggregate of the whole table equals a value, or another aggregate."""

    name: str
    value: Column
    expected: Column
    severity: str = "error"


def required(column: str, severity: str = "error") -> Rule:
    """Neither null nor blank."""
    return Rule(f"required:{column}", F.col(column).cast("string").rlike(r"\S"), severity)


def one_of(column: str, values, severity: str = "error") -> Rule:
    return Rule(f"one_of:{column}", F.col(column).isin(*values), severity)


def matches(column: str, pattern: str, severity: str = "error") -> Rule:
    return Rule(f"matches:{column}", F.col(column).rlike(pattern), severity)


def equal(column: str, other: str, severity: str = "error") -> Rule:
    return Rule(f"equal:{column}={other}", F.col(column).eqNullSafe(F.col(other)), severity)


def breaches(rows: DataFrame, constraints: list, key: str) -> DataFrame:
    """constraint, at: one row for each breach, `at` the key of the row, the repeated or unknown value, or what a total is.

    Rules on rows are columns of one pass. Repeated and unknown values meet
    by a count and an anti join; a value that a third of all rows hold is one row for each task by then.
    """
    found = []
    if rules := [c for c in constraints if isinstance(c, Rule)]:
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(c.holds, F.lit(False)), F.lit(c.name)) for c in rules]))
        found.append(rows.select(F.explode(broken).alias("constraint"), F.col(key).cast("string").alias("at")))
    text = lambda columns: F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    for c in constraints:
        if isinstance(c, Unique):
            known = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c.columns])
            again = rows.where(known).groupBy(*c.columns).agg(F.count("*").alias("_n")).where("_n > 1")
            found.append(again.select(F.lit(c.name).alias("constraint"), F.explode(F.array_repeat(text(c.columns), (F.col("_n") - 1).cast("int"))).alias("at")))
        elif isinstance(c, Refers):
            values = rows.where(F.col(c.column).isNotNull()).groupBy(c.column).agg(F.count("*").alias("_n"))
            unknown = values.join(c.table.select(F.col(c.other).alias(c.column)).distinct(), c.column, "left_anti")
            found.append(unknown.select(F.lit(c.name).alias("constraint"), F.explode(F.array_repeat(F.col(c.column).cast("string"), F.col("_n").cast("int"))).alias("at")))
        elif isinstance(c, Covers):
            wanted = c.table.select(F.col(c.other).alias(c.column)).where(F.col(c.column).isNotNull()).distinct()
            found.append(wanted.join(rows.select(c.column).distinct(), c.column, "left_anti").select(F.lit(c.name).alias("constraint"), F.col(c.column).cast("string").alias("at")))
    if totals := [c for c in constraints if isinstance(c, Total)]:
        each = [F.when(~c.value.eqNullSafe(c.expected), F.struct(F.lit(c.name).alias("constraint"), F.concat_ws(" <> ", F.coalesce(c.value.cast("string"), F.lit("null")), F.coalesce(c.expected.cast("string"), F.lit("null"))).alias("at"))) for c in totals]
        found.append(rows.agg(F.array_compact(F.array(*each)).alias("_all")).select(F.inline("_all")))
    return reduce(DataFrame.unionByName, found)


def report(rows: DataFrame, constraints: list, key: str, examples: int = 5) -> DataFrame:
    """constraint, severity, n_breaches, examples: each declared constraint, also those that hold; the first `examples` places in order of their text.

    Breaches are written once, then counted and ranked; Spark keeps the first few of each task before they meet.
    """
    spark = rows.sparkSession
    found = written(breaches(rows, constraints, key), "breaches")
    declared = spark.createDataFrame([(c.name, c.severity) for c in constraints], "constraint string, severity string")
    counts = found.groupBy("constraint").agg(F.count("*").alias("n_breaches"))
    place = F.row_number().over(Window.partitionBy("constraint").orderBy("at"))
    first = found.withColumn("_n", place).where(F.col("_n") <= examples).groupBy("constraint").agg(F.sort_array(F.collect_list("at")).alias("examples"))
    out = declared.join(counts, "constraint", "left").join(first, "constraint", "left").na.fill(0, ["n_breaches"])
    return out.withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def status(found: DataFrame) -> DataFrame:
    """status, n_constraints, n_broken of a report: FAIL where an error was found, PARTIAL where only warnings, else PASS."""
    error, other = F.count_if((F.col("n_breaches") > 0) & (F.col("severity") == "error")), F.count_if((F.col("n_breaches") > 0) & (F.col("severity") != "error"))
    return found.agg(F.when(error > 0, "FAIL").when(other > 0, "PARTIAL").otherwise("PASS").alias("status"), F.count("*").alias("n_constraints"), (error + other).alias("n_broken"))


def page_warnings(pages: DataFrame, short: int = 500) -> DataFrame:
    """document_id, warnings of (document_id, page_number, text): the first page without text, pages without text, mean length under `short`, gaps in the numbers; in that order, none an empty list."""
    empty = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    found = pages.groupBy("document_id").agg(
        F.min_by(empty, "page_number").alias("_first"), F.count_if(empty).alias("_empty"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("_mean"), F.min("page_number").alias("_a"), F.max("page_number").alias("_b"), F.count_distinct("page_number").alias("_n")
    )
    each = [
        F.when(F.col("_first"), "first_page_without_text"), F.when(F.col("_empty") > 0, F.concat(F.lit("pages_without_text:"), F.col("_empty").cast("string"))), F.when(F.col("_mean") < short, "short_pages"),
        F.when(F.col("_b") - F.col("_a") + 1 > F.col("_n"), F.concat(F.lit("missing_pages:"), (F.col("_b") - F.col("_a") + 1 - F.col("_n")).cast("string"))),
    ]
    return found.select("document_id", F.array_compact(F.array(*each)).alias("warnings"))


def write_report(found: DataFrame, path: str, title: str, columns: tuple[str, ...] = ("constraint", "severity", "n_breaches")) -> None:
    """The rows of a report, as many as there are constraints or documents, as JSON lines and as a Markdown table, each one file of Spark's writer."""
    found.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines = found.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "_at long, value string").coalesce(1)
    body = found.select((F.monotonically_increasing_id() + len(head)).alias("_at"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("value"))
    lines.unionByName(body).coalesce(1).sortWithinPartitions("_at").select("value").write.mode("overwrite").text(f"{path}/markdown")
