"""Line streams: flattening, carried headings, segments, pairing, splitting by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten(docs: DataFrame, document: str = "doc_id", text: str = "text") -> DataFrame:
    """document_id, line_index (from 1), line: the lines of each text that are not blank nor one to three digits only."""
    rows = docs.select(F.col(document).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_p", "line"))
    rows = rows.select("document_id", (F.col("_p") + 1).cast("long").alias("line_index"), F.trim("line").alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").rlike(r"^[0-9]{1,3}$"))


def ordered(*more: str) -> Window:
    return Window.partitionBy("document_id", *more).orderBy("line_index")


def below() -> Window:
    """The lines under each one, read from the last line up: one pass over a text, whatever its length."""
    return Window.partitionBy("document_id").orderBy(F.desc("line_index")).rowsBetween(Window.unboundedPreceding, -1)


def carried(lines: DataFrame, heading: Column, name: str = "heading") -> DataFrame:
    """Each line with the last heading at or above it."""
    return lines.withColumn(name, F.last(F.when(heading, F.col("line")), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


def segmented(lines: DataFrame, boundary: Column, name: str = "segment") -> DataFrame:
    """Each line with the number of boundaries at or above it."""
    return lines.withColumn(name, F.sum(F.when(boundary, 1).otherwise(0)).over(ordered().rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def next_match(lines: DataFrame, matches: Column, name: str = "next_index") -> DataFrame:
    """Each line with the index of the first match below it."""
    return lines.withColumn(name, F.min(F.when(matches, F.col("line_index"))).over(below()))


def merged_markers(lines: DataFrame, marker: Column, follower: Column) -> DataFrame:
    """A line that is only a marker and a fitting next one as one line. Of markers in a row, every other one is a start."""
    pair = lines.withColumn("_next", F.lead("line").over(ordered())).withColumn("_is", marker)
    pair = pair.withColumn("_starts", F.col("_is") & F.coalesce(follower, F.lit(False)))
    # in a run of starts the consumed line cannot start another pair: parity inside the run decides
    pair = pair.withColumn("_run", F.sum(F.when(F.col("_starts"), 0).otherwise(1)).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("document_id", "_run", "_starts").orderBy("line_index"))
    pair = pair.withColumn("_takes", F.col("_starts") & (place % 2 == 1))
    pair = pair.withColumn("_taken", F.coalesce(F.lag("_takes").over(ordered()), F.lit(False)))
    out = pair.where(~F.col("_taken")).withColumn("line", F.when(F.col("_takes"), F.concat_ws(" ", "line", "_next")).otherwise(F.col("line")))
    return out.select(*lines.columns)


def greedy_fit(sizes: Column, limit: int) -> Column:
    """Places (from 1) of the sizes that fit in order, what does not being skipped; the first always fits."""
    zero = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("at"))

    def add(a: Column, size: Column) -> Column:
        fits = (F.size(a["kept"]) == 0) | (a["total"] + size <= limit)
        return F.struct(
            F.when(fits, F.concat(a["kept"], F.array(a["at"] + 1))).otherwise(a["kept"]).alias("kept"), F.when(fits, a["total"] + size).otherwise(a["total"]).cast("long").alias("total"), (a["at"] + 1).alias("at")
        )

    return F.aggregate(sizes, zero, add, lambda a: a["kept"])


def split_by_length(text: Column, limit: int = 3200) -> Column:
    """Parts of a text of up to limit characters: paragraphs packed greedily, then sentences; a longer sentence stays whole.

    One fold over all pieces: a paragraph that fits is one piece, another gives its sentences.
    """
    paragraphs = F.split(text, "\n\n")
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("parts"), F.lit("").alias("now"))
    flush = lambda a: F.when(a["now"] == "", a["parts"]).otherwise(F.concat(a["parts"], F.array(a["now"])))

    def sentence(a: Column, s: Column) -> Column:
        candidate = F.when(a["now"] == "", s).otherwise(F.trim(F.concat_ws(" ", a["now"], s)))
        fits = F.length(candidate) <= limit
        return F.struct(F.when(fits, a["parts"]).otherwise(flush(a)).alias("parts"), F.when(fits, candidate).otherwise(s).alias("now"))

    def paragraph(a: Column, p: Column) -> Column:
        candidate = F.when(a["now"] == "", p).otherwise(F.trim(F.concat_ws("\n\n", a["now"], p)))
        fits = F.length(candidate) <= limit
        fresh = F.struct(flush(a).alias("parts"), F.lit("").alias("now"))
        return F.when(fits, F.struct(a["parts"].alias("parts"), candidate.alias("now"))).otherwise(F.aggregate(F.split(p, r"(?<=[.!?])\s+"), fresh, sentence))

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(paragraphs, zero, paragraph, flush))
