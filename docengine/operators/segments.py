"""Documents of headed lines: boundaries, titles that run on, chapters and sections carried to preambles and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import ARTICLE, CHAPTER, SECTION, fold_ascii, upper_heading
from docengine.operators.lines import segmented
from docengine.operators.structure import article_heading


def line_kind(line: Column | str) -> Column:
    """What a line opens: preamble, chapter, section or article; null for all others."""
    s = F.trim(F.col(line) if isinstance(line, str) else line)
    return F.when(F.trim(fold_ascii(s)) == "preambulo", "preamble").when(s.rlike(CHAPTER), "chapter").when(s.rlike(SECTION), "section").when(s.rlike(ARTICLE), "article")


def segments(lines: DataFrame, most_titles: int = 3, cover: tuple[str, ...] = ()) -> DataFrame:
    """document_id, segment, kind, number, title, first_line, last_line, lines: the stretches that boundaries open, in order; kind is null before the first.

    The title of a chapter or section is what follows its number on the line
    and the capital lines right below, most_titles parts at most; lines of
    `cover` (folded) end it. `lines` holds what is left of the stretch, the
    boundary itself included. A document is one group; none spans two.
    """
    rows = lines.withColumn("_kind", line_kind("line")).withColumn("_upper", upper_heading("line") & ~F.trim(fold_ascii("line")).isin(*cover) if cover else upper_heading("line"))
    cut = segmented(rows, F.col("_kind").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("line_index", "line", F.coalesce("_kind", F.lit("")).alias("kind"), "_upper")))
    found = cut.groupBy("document_id", "segment").agg(listed.alias("_all")).withColumn("kind", F.nullif(F.col("_all")[0]["kind"], F.lit("")))
    head = F.trim(F.col("_all")[0]["line"])
    part = lambda n: F.when(F.col("kind") == "chapter", F.regexp_extract(head, CHAPTER, n)).when(F.col("kind") == "section", F.regexp_extract(head, SECTION, n))
    inline = F.nullif(F.trim(part(2)), F.lit(""))
    below = F.slice("_all", 2, F.size("_all"))
    run = F.array_position(F.transform(below, lambda x: x["_upper"]), F.lit(False)).cast("int")
    leading = F.when(run == 0, F.size(below)).otherwise(run - 1)
    titles = F.when(F.col("kind").isin("chapter", "section"), F.least(leading, most_titles - inline.isNotNull().cast("int"))).otherwise(0)
    found = found.withColumn("_titles", titles).withColumn("_below", below)
    title = F.nullif(F.concat_ws(" ", inline, F.array_join(F.transform(F.slice("_below", 1, F.col("_titles")), lambda x: F.trim(x["line"])), " ")), F.lit(""))
    number = F.coalesce(F.upper(part(1)), article_heading(head)["number"])
    kept = F.concat(F.slice("_all", 1, 1), F.slice("_below", F.col("_titles") + 1, F.size("_all")))
    return found.select(
        "document_id", "segment", "kind", F.when(F.col("kind") != "preamble", number).alias("number"), F.trim(title).alias("title"), F.col("_all")[0]["line_index"].alias("first_line"),
        F.element_at("_all", -1)["line_index"].alias("last_line"), F.transform(kept, lambda x: x["line"]).alias("lines"),
    )


def in_context(parts: DataFrame) -> DataFrame:
    """Preambles and articles of segments() with chapter_number, chapter_title, section_number and section_title; a chapter ends the section before it."""
    order = Window.partitionBy("document_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.struct(F.col(c).alias("x")))
    found = parts.withColumn("_chapters", F.sum((F.coalesce("kind", F.lit("")) == "chapter").cast("int")).over(order))
    inner = Window.partitionBy("document_id", "_chapters").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    for name, column in (("number", "number"), ("title", "title")):
        found = found.withColumn(f"chapter_{name}", F.last(of("chapter", column), ignorenulls=True).over(order)["x"]).withColumn(f"section_{name}", F.last(of("section", column), ignorenulls=True).over(inner)["x"])
    return found.where(F.col("kind").isin("preamble", "article")).drop("_chapters")


def unhandled_headings(parts: DataFrame) -> DataFrame:
    """document_id, line: capital lines that neither open anything nor belong to a title, in stretches before the first boundary or under chapters and sections."""
    rest = parts.where("kind is null or kind in ('chapter', 'section')").select("document_id", F.explode("lines").alias("line"))
    return rest.where(upper_heading("line"))
