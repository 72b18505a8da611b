"""Structural parsing beyond single lines: joined text, pairs, repaired numbering, linked notes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.operators.lines import below, ordered, segmented

#: Books of the Bible and their abbreviations (a fixed pattern).
BOOKS = (
    r"(?:[1-3]\s*)?(?:gn|g[eê]n(?:esis)?|ex|[eê]x(?:odo)?|lv|lev[ií]tico|nm|n[uú]m(?:eros)?|dt|js|jz|rt|sm|rs|reis|cr|ed|ne|et|j[oó]|sl|pv|ec|ct|is|jr|lm|ez|dn|os|jl|am|ob|jn|mq|na|hc|sf|ag|zc|ml"
    r"|mt|mateus|mc|marcos|lc|lucas|jo|jo[aã]o|at|atos|rm|romanos|co|cor[ií]ntios|gl|g[aá]latas|ef|ef[eé]sios|fl|fp|filipenses|cl|colossenses|ts|tessalonicenses|tm|tim[oó]teo|tt|tito|fm|filemom"
    r"|hb|hebreus|tg|tiago|pe|pd|pedro|jd|judas|ap|apocalipse)"
)
REFERENCE = rf"(?i)\b{BOOKS}\.?\s*[0-9]+(?:[:.][0-9]+)?(?:[-–][0-9]+)?"


def biblical_references(text: Column) -> Column:
    """Contents of parentheses that hold a book and a number, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x.rlike(REFERENCE))


def article_heading(line: Column) -> Column:
    """(number, display, remainder) of an article's first line, else null."""
    pattern = r"^Art\.?\s*([0-9]+)([º°]?)(?:\.|\s*[–—-]|\s+(?=[A-ZÁÉÍÓÚÂÊÔÃÕ]))\s*(.*)$"
    s = F.trim(line)
    part = lambda n: F.regexp_extract(s, pattern, n)
    return F.when(s.rlike(pattern), F.struct(part(1).alias("number"), F.concat(F.lit("Art. "), part(1), part(2)).alias("display"), F.trim(part(3)).alias("remainder")))


def joined_lines() -> Column:
    """A group's lines in order, joined by spaces; a line that ends in a hyphen joins without."""
    piece = F.when(F.col("line").endswith("-"), F.regexp_replace("line", "-$", "")).otherwise(F.concat("line", F.lit(" ")))
    listed = F.array_sort(F.collect_list(F.struct("line_index", piece.alias("piece"))))
    return F.trim(F.concat_ws("", F.transform(listed, lambda x: x["piece"])))


def joined_paragraphs(lines: DataFrame, starts: Column) -> DataFrame:
    """document_id, paragraph, text: lines joined from each start on."""
    return segmented(lines, starts, "paragraph").groupBy("document_id", "paragraph").agg(joined_lines().alias("text"))


def forward_pairs(lines: DataFrame, left: Column, right: Column) -> DataFrame:
    """document_id, left_index, right_index, end_index: each left line with the next right line below it; it ends before the next left line after that. Lines without a partner are left out."""
    found = lines.withColumn("_l", left).withColumn("_r", right).withColumn("_last", F.max("line_index").over(Window.partitionBy("document_id")))
    found = found.withColumn("_next", F.min(F.when(F.col("_l"), F.col("line_index"))).over(below()))
    found = found.withColumn("_pair", F.min(F.when(F.col("_r"), F.struct("line_index", "_next"))).over(below())).where("_l and _pair is not null")
    end = F.coalesce("_pair._next", F.col("_last") + 1) - 1
    return found.select("document_id", F.col("line_index").alias("left_index"), F.col("_pair.line_index").alias("right_index"), end.alias("end_index"))


def repaired_numbers(numbers: Column) -> Column:
    """Numbers (as text, in order) of which a cut-off one is completed if the expected next begins with it; the repaired value sets the next expectation."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("int").alias("last"))

    def step(a: Column, x: Column) -> Column:
        due = a["last"] + 1
        value = F.when(due.isNotNull() & (due.cast("string") != x) & due.cast("string").startswith(x), due).otherwise(x.cast("int"))
        return F.struct(F.concat(a["out"], F.array(value)).alias("out"), value.alias("last"))

    return F.aggregate(numbers, zero, step, lambda a: a["out"])


def linked_notes(markers: DataFrame, references: DataFrame) -> DataFrame:
    """document_id, marker, reference, link: markers (document_id, position, marker) with references (document_id, position, number, reference).

    Equal sets of numbers are joined by number; else equal counts by position;
    else by number, markers without a reference staying without.
    """
    m = markers.groupBy("document_id").agg(F.sort_array(F.collect_set("marker")).alias("_ms"), F.count("*").alias("_mn"))
    r = references.groupBy("document_id").agg(F.sort_array(F.collect_set("number")).alias("_rs"), F.count("*").alias("_rn"))
    kind = m.join(r, "document_id", "left").select("document_id", F.when(F.col("_ms") == F.col("_rs"), "exact").when(F.col("_mn") == F.col("_rn"), "position").otherwise("number").alias("_kind"))
    marked = markers.join(kind, "document_id")
    by_number = marked.where("_kind <> 'position'").join(references.select("document_id", F.col("number").alias("marker"), "reference"), ["document_id", "marker"], "left")
    by_number = by_number.select("document_id", "marker", "reference", F.when(F.col("reference").isNull(), "missing_source_reference").otherwise("exact").alias("link"))
    by_place = marked.where("_kind = 'position'").join(references.select("document_id", "position", "reference"), ["document_id", "position"])
    return by_number.unionByName(by_place.select("document_id", "marker", "reference", F.lit("position_inferred_number_mismatch").alias("link")))


def table_rows(lines: DataFrame, columns: int) -> DataFrame:
    """document_id, row, cells: lines regrouped, `columns` to a row."""
    place = F.row_number().over(ordered()) - 1
    put = lines.withColumn("row", F.floor(place / columns).cast("long"))
    return put.groupBy("document_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"]), " | ").alias("cells"))


def article_audit(detected: DataFrame, chunked: DataFrame) -> DataFrame:
    """document_id, n_detected, n_chunked, n_missing, n_duplicate, status, of (document_id, article): found in the text against made into chunks."""
    d = detected.groupBy("document_id").agg(F.count_distinct("article").alias("n_detected"))
    each = chunked.groupBy("document_id", "article").agg(F.count("*").alias("_n"))
    c = each.groupBy("document_id").agg(F.count("*").alias("n_chunked"), F.count_if(F.col("_n") > 1).alias("n_duplicate"))
    missing = detected.select("document_id", "article").distinct().join(each, ["document_id", "article"], "left_anti").groupBy("document_id").agg(F.count("*").alias("n_missing"))
    out = d.join(c, "document_id", "left").join(missing, "document_id", "left").na.fill(0, ["n_chunked", "n_duplicate", "n_missing"])
    return out.withColumn("status", F.when(F.col("n_missing") > 0, "FAIL").when(F.col("n_duplicate") > 0, "PARTIAL").otherwise("PASS"))


def article_units(lines: DataFrame, marker: Column) -> DataFrame:
    """document_id, unit, paragraph, inciso, alinea, text: an article's lines split at item markers (kind, value).

    A paragraph resets inciso and alínea, an inciso resets the alínea. Unit 0 is
    what stands before the first marker.
    """
    m = lines.withColumn("_m", marker).withColumn("_k", F.col("_m.kind")).withColumn("_v", F.col("_m.value"))
    upto = lambda *keys: ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)
    value = lambda kind: F.when(F.col("_k") == kind, F.col("_v"))
    m = m.withColumn("unit", F.sum(F.col("_k").isNotNull().cast("long")).over(upto())).withColumn("_p", F.sum((F.coalesce("_k", F.lit("")) == "paragraph").cast("int")).over(upto()))
    m = m.withColumn("_i", F.sum(F.coalesce("_k", F.lit("")).isin("paragraph", "inciso").cast("int")).over(upto()))
    m = m.withColumn("paragraph", F.last(value("paragraph"), True).over(upto())).withColumn("inciso", F.last(value("inciso"), True).over(upto("_p"))).withColumn("alinea", F.last(value("alinea"), True).over(upto("_i")))
    listed = F.array_sort(F.collect_list(F.struct("line_index", "line")))
    return m.groupBy("document_id", "unit").agg(F.min("paragraph").alias("paragraph"), F.min("inciso").alias("inciso"), F.min("alinea").alias("alinea"), F.concat_ws(" ", F.transform(listed, lambda x: x["line"])).alias("text"))
