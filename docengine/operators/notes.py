"""Paragraphs with numbered Bible references below them: body and notes apart, notes parsed, both joined again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.operators.structure import BOOKS, joined_lines

#: A line that opens a numbered reference, and one that stands inside a line (fixed patterns).
NOTE = rf"(?iu)^([0-9]{{1,3}})\.\s*({BOOKS}\.?\s*[0-9].*)$"
INNER_NOTE = rf"(?iu)\s+([0-9]{{1,3}})\.\s*(?={BOOKS}\.?\s*[0-9])"

_KEYS = ("document_id", "paragraph")


def body_and_notes(lines: DataFrame) -> DataFrame:
    """Lines (document_id, paragraph, line_index, line) with part, body or notes: a paragraph's notes begin with its first numbered reference; where that stands inside a line, the line is cut before it."""
    opens = F.col("line").rlike(NOTE)
    rows = lines.withColumn("_opens", opens).withColumn("_first", F.min(F.when(opens | F.col("line").rlike(INNER_NOTE), F.col("line_index"))).over(Window.partitionBy(*_KEYS)))
    head = F.split("line", INNER_NOTE, 2)[0]
    piece = lambda part, text: F.struct(F.lit(part).alias("part"), F.trim(text).alias("line"))
    cut = F.array(piece("body", head), piece("notes", F.col("line").substr(F.length(head) + 1, F.length("line"))))
    pieces = F.when(F.col("_first").isNull() | (F.col("line_index") < F.col("_first")), F.array(piece("body", F.col("line")))).when((F.col("line_index") == F.col("_first")) & ~F.col("_opens"), cut).otherwise(F.array(piece("notes", F.col("line"))))
    return rows.select(*_KEYS, "line_index", F.explode(pieces).alias("_x")).select(*_KEYS, "line_index", "_x.part", "_x.line").where("line <> ''")


def footnotes(parts: DataFrame) -> DataFrame:
    """document_id, paragraph, place (from 1), marker, reference: the references of body_and_notes(), with the lines that continue them; what several share one line is split."""
    upto = Window.partitionBy(*_KEYS).orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.where("part = 'notes'").withColumn("_note", F.sum(F.col("line").rlike(NOTE).cast("long")).over(upto))
    listed = F.array_sort(F.collect_list(F.struct("line_index", "line")))
    whole = rows.groupBy(*_KEYS, "_note").agg(F.array_join(F.transform(listed, lambda x: x["line"]), " ").alias("_text"))
    each = F.split(F.regexp_replace("_text", INNER_NOTE, "\u0001$1. "), "\u0001")
    found = whole.select(*_KEYS, "_note", F.posexplode(each).alias("_p", "_x"))
    found = found.select(*_KEYS, "_note", "_p", F.regexp_extract("_x", r"^([0-9]{1,3})\.", 1).alias("marker"), F.trim(F.regexp_replace("_x", r"^[0-9]{1,3}\.\s*", "")).alias("reference")).where("reference <> ''")
    place = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("_note", "_p")).cast("long")
    return found.select(*_KEYS, place.alias("place"), "marker", "reference")


def with_notes(parts: DataFrame) -> DataFrame:
    """document_id, paragraph, text, n_notes: the joined body of body_and_notes(), and its references listed below it."""
    body = parts.where("part = 'body'").groupBy(*_KEYS).agg(joined_lines().alias("_body"))
    line = F.struct("place", F.concat("marker", F.lit(". "), "reference").alias("line"))
    notes = footnotes(parts).groupBy(*_KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("_notes"), F.count("*").alias("n_notes"))
    text = F.concat(F.coalesce("_body", F.lit("")), F.when(F.col("_notes").isNotNull(), F.concat(F.lit("\n\nReferências bíblicas:\n"), "_notes")).otherwise(""))
    return body.join(notes, list(_KEYS), "full").select(*_KEYS, F.regexp_replace(text, r"\A\s+|\s+\z", "").alias("text"), F.coalesce("n_notes", F.lit(0)).alias("n_notes"))
