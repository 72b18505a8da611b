"""Text and JSON lines with their line numbers, over files that Spark reads in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, value: str = "line") -> DataFrame:
    """file, line_number (from 1), line, and the columns of the path's partitions: every physical line, blank ones too.

    A file is read in pieces by as many tasks. Lines of a piece come in
    order, so a line's place in it is the distance of two row numbers; the
    lines of each piece are counted first, and their running sum by file is where the next
    piece begins. What is joined is one row for each piece, not each line. A file that cannot be split is one piece.
    """
    rows = spark.read.text(path)
    place = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_id"))
    pieces = place.groupBy("file", "_piece").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("file", "_piece", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = place.join(pieces, ["file", "_piece"])
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return found.select("file", number.alias("line_number"), F.col("value").alias(value), *[c for c in rows.columns if c != "value"])


def line_issue(line: Column) -> Column:
    """blank_line, invalid_json, not_an_object, or null for a line that holds a JSON object."""
    parsed = F.try_parse_json(line)
    return F.when(F.trim(F.regexp_replace(line, r"\s+", " ")) == "", "blank_line").when(parsed.isNull(), "invalid_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object")


def line_issues(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """file, line_number, issue of the lines that are no records; with blank=False blank lines are none."""
    found = numbered_lines(spark, path).withColumn("issue", line_issue(F.col("line"))).where("issue is not null")
    found = found if blank else found.where("issue <> 'blank_line'")
    return found.drop("line")


def ordered_records(spark: SparkSession, path: str, schema: str, order: str = "document_order", strict: bool = True) -> DataFrame:
    """Records of JSON lines by a schema, with file and line number (as `order`); blank lines count but give no row.

    strict: a line that is no record fails the job with its file and number; else it gives no row.
    """
    lines = numbered_lines(spark, path).withColumn("_issue", line_issue(F.col("line"))).where("_issue is null or _issue <> 'blank_line'")
    if strict:
        wrong = F.raise_error(F.concat(F.col("_issue"), F.lit(" in "), F.col("file"), F.lit(":"), F.col("line_number").cast("string")))
        lines = lines.withColumn("line", F.when(F.col("_issue").isNotNull(), wrong.cast("string")).otherwise(F.col("line")))
    else:
        lines = lines.where("_issue is null")
    partitions = [c for c in lines.columns if c not in ("file", "line_number", "line", "_issue")]
    return lines.select(F.from_json("line", schema).alias("_r"), "file", F.col("line_number").alias(order), *partitions).select("_r.*", "file", order, *partitions)
