"""Articles to chunks: an article that is short stays whole, a long one falls into its paragraphs, incisos and alíneas, each behind the article's head; and the full record of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import ARTICLE, fold_ascii, item_marker, slug
from docengine.operators.chunks import labelled_text
from docengine.operators.lines import split_by_length
from docengine.operators.records import full_reference
from docengine.operators.segments import line_kind
from docengine.operators.structure import article_heading, biblical_references

#: Characters of a chunk (fixed value).
MOST = 3200
PART = ["document_id", "segment"]


def block_text(lines: Column) -> Column:
    """Lines of one block as one: joined by blanks, after a hyphen without it and without a blank; a hyphen at the very end stays."""
    last = F.size(lines) - 1
    return F.trim(F.concat_ws("", F.transform(lines, lambda x, i: F.when(i == last, x).when(x.endswith("-"), F.regexp_replace(x, "-$", "")).otherwise(F.concat(x, F.lit(" "))))))


def article_lines(lines: DataFrame) -> DataFrame:
    """Lines (document_id, line_index, line, page) of preambles and articles, with segment (by document), kind and the chapter and section that hold them.

    A stretch begins at each preamble, chapter, section or article; titles of
    chapters and sections are what follows their number and the capital lines right below, three parts at most. All of it is
    running columns over a document's lines: no stretch is gathered.
    """
    from docengine.functions.text import CHAPTER, SECTION, upper_heading

    upto = lambda *keys: Window.partitionBy("document_id", *keys).orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    s = F.trim("line")
    rows = lines.withColumn("_kind", line_kind("line")).withColumn("segment", F.sum(F.col("_kind").isNotNull().cast("int")).over(upto()))
    rows = rows.withColumn("kind", F.first("_kind").over(upto("segment"))).withColumn("_place", F.row_number().over(Window.partitionBy(*PART).orderBy("line_index")))
    head = lambda n: F.when(F.col("_kind") == "chapter", F.regexp_extract(s, CHAPTER, n)).when(F.col("_kind") == "section", F.regexp_extract(s, SECTION, n))
    inline = F.nullif(F.trim(head(2)), F.lit(""))
    # capital lines without a gap below a head: as many of them as lines so far
    run = F.sum(F.when((F.col("_place") > 1) & upper_heading("line"), 1).otherwise(0)).over(upto("segment")) == F.col("_place") - 1
    rows = rows.withColumn("_number", F.upper(head(1))).withColumn("_inline", inline).withColumn("_parts", (F.first("_inline").over(upto("segment")).isNotNull()).cast("int") + F.col("_place") - 1)
    titles = F.col("kind").isin("chapter", "section") & run & (F.col("_place") > 1) & (F.col("_parts") <= 3)
    rows = rows.withColumn("_title", F.when(F.col("_place") == 1, F.col("_inline")).when(titles, s))
    whole = F.array_join(F.collect_list("_title").over(upto("segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), " ")
    heads = rows.where("kind in ('chapter', 'section')").withColumn("_all", F.nullif(whole, F.lit(""))).where("_place = 1")
    heads = heads.select("document_id", "segment", F.struct("_number", F.col("_all").alias("_title")).alias("_head"))
    rows = rows.join(heads, PART, "left")
    chapters = F.sum((F.coalesce("_kind", F.lit("")) == "chapter").cast("int")).over(upto())
    rows = rows.withColumn("_chapters", chapters)
    rows = rows.withColumn("_c", F.last(F.when(F.col("kind") == "chapter", F.col("_head")), True).over(upto())).withColumn("_s", F.last(F.when(F.col("kind") == "section", F.col("_head")), True).over(upto("_chapters")))
    context = [F.col(f"_{k[0]}._{c}").alias(f"{k}_{c}") for k in ("chapter", "section") for c in ("number", "title")]
    return rows.where("kind in ('preamble', 'article')").select("document_id", "segment", "kind", "line_index", "page", "line", *context)


def article_chunks(lines: DataFrame, most: int = MOST, kind: Column | None = None) -> DataFrame:
    """Chunks of the lines of article_lines(): chunk_id, structure_type, article and item columns, pages, text, warnings, in order by `place`.

    * A stretch of up to `most` characters is one chunk.
    * A longer article falls into units, at markers of paragraph, inciso and
      alínea; each unit's text is the lines before the first marker and its own. Units over the limit are split at paragraphs, then
      sentences. An article without markers is split so as a whole.
    * Pages are those of the unit's own lines. Ids are made of what the unit
      is under; equal ones are told apart by unique_ids().

    kind: the structure type of an article's chunks. Lines meet by document
    and stretch, in blocks, then units; nothing larger than a document's text meets in a row.
    """
    kind = F.lit("normative_article") if kind is None else kind
    upto = lambda *keys: Window.partitionBy(*PART, *keys).orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*PART).orderBy("line_index")) == 1
    rows = lines.withColumn("line", F.trim("line")).withColumn("_first", first).withColumn("_m", F.when(~F.col("_first") & (F.col("kind") == "article"), item_marker("line")))
    rows = rows.withColumn("_k", F.coalesce("_m.kind", F.lit(""))).withColumn("_v", F.col("_m.value"))
    rows = rows.withColumn("unit", F.sum((F.col("_k") != "").cast("int")).over(upto()))
    block = F.col("_first") | F.col("line").rlike(ARTICLE) | item_marker("line").isNotNull()
    rows = rows.withColumn("_block", F.sum(block.cast("int")).over(upto()))
    value = lambda k: F.when(F.col("_k") == k, F.col("_v"))
    rows = rows.withColumn("_p", F.sum((F.col("_k") == "paragraph").cast("int")).over(upto())).withColumn("_i", F.sum(F.col("_k").isin("paragraph", "inciso").cast("int")).over(upto()))
    rows = rows.withColumn("paragraph_number", F.last(value("paragraph"), True).over(upto())).withColumn("inciso", F.last(value("inciso"), True).over(upto("_p"))).withColumn("alinea", F.last(value("alinea"), True).over(upto("_i")))
    head = article_heading(F.col("line"))
    carried = ["kind", *[c for c in ("chapter_number", "chapter_title", "section_number", "section_title") if c in rows.columns]]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"])
    blocks = rows.groupBy(*PART, "unit", "_block").agg(
        listed.alias("_lines"), F.min_by("page", "line_index").alias("page_start"), F.max_by("page", "line_index").alias("page_end"), F.max(F.when(F.col("_first"), head)).alias("_head"),
        *[F.min(c).alias(c) for c in ("paragraph_number", "inciso", "alinea")], F.max("_k").alias("_k"), F.min("line_index").alias("_at"), *[F.first(c).alias(c) for c in carried],
    ).withColumn("_text", block_text(F.col("_lines")))
    units = blocks.groupBy(*PART, "unit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_text"))), lambda x: x["_text"]), "\n\n").alias("_text"), F.min_by("page_start", "_block").alias("page_start"), F.max_by("page_end", "_block").alias("page_end"),
        F.max("_head").alias("_head"), *[F.min(c).alias(c) for c in ("paragraph_number", "inciso", "alinea")], F.max("_k").alias("_k"), *[F.first(c).alias(c) for c in carried],
    )
    every = F.array_sort(F.collect_list(F.struct("unit", "_text", "page_start", "page_end", "paragraph_number", "inciso", "alinea", "_k")))
    parts = units.groupBy(*PART).agg(every.alias("_u"), F.max("_head").alias("_head"), *[F.first(c).alias(c) for c in carried])
    parts = parts.withColumn("_whole", F.array_join(F.transform("_u", lambda x: x["_text"]), "\n\n"))
    fits, bare = (F.length("_whole") <= most) | (F.col("kind") == "preamble"), F.size("_u") == 1
    null = F.lit(None).cast("string")
    own = lambda x, text, how: F.struct(text.alias("_text"), x["page_start"].alias("page_start"), x["page_end"].alias("page_end"), x["paragraph_number"].alias("paragraph_number"), x["inciso"].alias("inciso"), x["alinea"].alias("alinea"), x["_k"].alias("_k"), F.lit(how).alias("_how"))
    all_ = lambda how: F.array(F.struct(F.col("_whole").alias("_text"), F.col("_u")[0]["page_start"].alias("page_start"), F.element_at("_u", -1)["page_end"].alias("page_end"), null.alias("paragraph_number"), null.alias("inciso"), null.alias("alinea"), F.lit("").alias("_k"), F.lit(how).alias("_how")))
    each = F.transform(F.slice("_u", 2, F.greatest(F.size("_u"), F.lit(1))), lambda x: own(x, F.concat_ws("\n\n", F.col("_u")[0]["_text"], x["_text"]), "unit"))
    made = parts.select(*PART, *carried, "_head", F.posexplode(F.when(fits, all_("whole")).when(bare, all_("bare")).otherwise(each)).alias("_n", "_c")).select(*PART, *carried, "_head", "_n", "_c.*")
    split = F.when(F.col("_how") == "whole", F.array("_text")).otherwise(split_by_length(F.col("_text"), most))
    made = made.withColumn("_parts", split).select("*", F.size("_parts").alias("_of"), F.posexplode("_parts").alias("_part", "text"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    number = F.col("_head.number")
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(3)), "0")
    named = lambda name, c: F.when(F.col(c).isNotNull(), slug(F.concat(F.lit(f"{name}-"), F.col(c))))
    ids = [F.concat(F.lit("artigo-"), padded), named("paragrafo", "paragraph_number"), named("inciso", "inciso"), named("alinea", "alinea"), F.when((F.col("_of") > 1) | (F.col("_how") == "bare"), F.concat(F.lit("parte-"), two(F.col("_part") + 1)))]
    preamble = F.sum((F.col("kind") == "preamble").cast("int")).over(Window.partitionBy("document_id").orderBy("segment"))
    tail = F.when(F.col("kind") == "preamble", F.concat(F.lit("preambulo-"), two(preamble))).otherwise(F.concat_ws("_", *ids))
    warned = F.array_compact(F.array(
        F.when(F.col("_how") == "bare", "article_split_by_length_without_structural_children"), F.when(F.col("_how") == "unit", "article_split_by_structural_children"), F.when((F.col("_how") == "unit") & (F.col("_of") > 1), "structural_child_split_by_length"),
    ))
    type_ = F.when(F.col("kind") == "preamble", F.lit("preamble")).when(F.col("_how") == "unit", F.col("_k")).otherwise(kind)
    label = F.when(F.col("_k") == "paragraph", F.when(F.col("paragraph_number") == "único", "Parágrafo único").otherwise(F.concat(F.lit("§ "), "paragraph_number"))).when(F.col("_k") == "inciso", F.concat(F.lit("inciso "), "inciso")).when(F.col("_k") == "alinea", F.concat(F.lit("alínea "), "alinea"))
    return made.where(F.trim("text") != "").select(
        F.concat_ws("_", F.col("document_id").cast("string"), tail).alias("chunk_id"), "document_id", "segment", F.struct("segment", "_n", "_part").alias("place"), type_.alias("structure_type"),
        number.alias("article_number"), F.col("_head.display").alias("article_display"), "paragraph_number", "inciso", "alinea", label.alias("item_label"), "page_start", "page_end", F.trim("text").alias("text"), warned.alias("warnings"),
        *[c for c in carried if c != "kind"],
    )


def told_apart(chunks: DataFrame) -> DataFrame:
    """Chunks whose ids are unique: of equal ones of a document, in order of place, all but the first get _duplicata-NN and a warning."""
    n = F.row_number().over(Window.partitionBy("document_id", "chunk_id").orderBy("place"))
    again = F.concat(F.col("chunk_id"), F.lit("_duplicata-"), F.when(F.col("_n") < 10, F.concat(F.lit("0"), F.col("_n").cast("string"))).otherwise(F.col("_n").cast("string")))
    more = F.when(F.col("_n") > 1, F.concat("warnings", F.array(F.lit("duplicate_chunk_id_disambiguated")))).otherwise(F.col("warnings"))
    return chunks.withColumn("_n", n).withColumn("warnings", more).withColumn("chunk_id", F.when(F.col("_n") > 1, again).otherwise(F.col("chunk_id"))).drop("_n")


def topics(titles: list[str], text: Column | str, rules: list[tuple[str, str, tuple[str, ...]]], default: Column) -> Column:
    """(topic, subtopic): of the first rule (topic, subtopic, keywords) of which the titles and the text hold a keyword, else the default of the document."""
    hay = fold_ascii(F.concat_ws(" ", *[F.col(t) for t in titles], text))
    out = default
    for topic, subtopic, words in reversed(rules):
        held = F.exists(F.array(*map(F.lit, words)), lambda w: hay.contains(w)) if words else F.lit(False)
        out = F.when(held, F.struct(F.lit(topic).alias("topic"), F.lit(subtopic).alias("subtopic"))).otherwise(out)
    return out


def chunk_records(chunks: DataFrame, documents: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]] = (), schema_version: str = "1.0", namespace: str = "normative") -> DataFrame:
    """The full record of each chunk: what its document says, its reference, topic, texts for embedding, digest and references to the Bible.

    documents (document_id, title, document_type, label, style, default_topic,
    default_subtopic, and whatever else is to be carried) is a table of documents, joined by id. Chunks of documents that it lacks are left out.
    """
    extra = [c for c in documents.columns if c not in ("document_id", "label", "style", "default_topic", "default_subtopic", "title")]
    both = told_apart(chunks).withColumn("subsection_title", F.lit(None).cast("string")).join(documents, "document_id")
    both = both.withColumn("full_reference", full_reference(F.col("label"), F.col("style")))
    default = F.struct(F.coalesce("default_topic", F.lit("denominational_governance")).alias("topic"), F.coalesce("default_subtopic", F.lit("general_governance")).alias("subtopic"))
    both = both.withColumn("_topic", topics(["chapter_title", "section_title", "subsection_title"], F.col("text"), list(rules), default))
    labels = [("Documento", F.col("title")), ("Corpus", F.lit("Normativo Congregacional")), ("Tipo documental", F.col("document_type")), ("Referência", F.col("full_reference")), ("Tópico", F.concat_ws(" / ", "_topic.topic", "_topic.subtopic"))]
    return both.select(
        "chunk_id", F.lit(schema_version).alias("schema_version"), F.lit(namespace).alias("retrieval_namespace"), "document_id", F.col("document_id").alias("doc_id"), F.col("title").alias("document"), F.col("title").alias("document_title"), *extra,
        F.col("structure_type").alias("chunk_type"), F.col("structure_type").alias("document_structure_type"), F.lit("normative").alias("content_role"), F.lit(False).alias("is_doctrinal"), "chapter_number", "chapter_title",
        F.concat(F.lit("Capítulo "), "chapter_number").alias("chapter_reference"), "section_number", "section_title", "subsection_title", F.col("full_reference").alias("section_reference"), "full_reference", "article_number", F.col("article_display").alias("article_label"),
        "paragraph_number", "inciso", "alinea", "item_label", "page_start", "page_end", "text", labelled_text(labels, F.col("text")).alias("embedding_text"), F.sha2("text", 256).alias("text_hash"),
        biblical_references(F.col("text")).alias("biblical_references"), "_topic.topic", "_topic.subtopic", "warnings",
    )


def document_chunks(lines: DataFrame, documents: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]] = (), most: int = MOST) -> DataFrame:
    """From lines (document_id, line_index, page, line) and a table of documents to chunk records: preambles and articles, those of ethics under their own type."""
    ethics = documents.select("document_id", F.when(F.col("document_type") == "normative_ethics", "ethics_article").otherwise("normative_article").alias("_type"))
    chunks = article_chunks(article_lines(lines), most).join(ethics, "document_id")
    chunks = chunks.withColumn("structure_type", F.when(F.col("structure_type") == "normative_article", F.col("_type")).otherwise(F.col("structure_type"))).drop("_type")
    return chunk_records(chunks, documents, rules)
