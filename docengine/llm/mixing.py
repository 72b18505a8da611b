"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import text_of, WORD, written

#: Rows of one source and size that one task numbers, about.
BLOCK = 200_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources in sizes (_source, _total), whose number is small beside the rows': one window holds them all.

    Sources in code-point order, null last, weigh weights, repeated. They
    share `share` times all sizes in proportion to their weights, but none
    gets more than `most` times its own size; the rest goes to the others by
    weight. This is the level l at which sum(min(cap, l * weight)) is the
    total. With the sources in order of cap / weight, l is the largest of
    (total - caps before) / (weights from here on), over all places.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weighed = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("_cap", F.col("_total") * F.lit(most))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = weighed.select(
        "*",
        F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_full"),
        F.sum("_weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)).alias("_left"),
        (F.sum("_total").over(everything) * F.lit(share)).alias("_goal"),
    )
    level = F.max((F.col("_goal") - F.col("_full")) / F.col("_left")).over(everything)
    leveled = filled.withColumn("_level", level)
    return leveled.select("_source", "_total", F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), F.col("_cap")).alias("_target"))


def systematic_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mix takes each document: _id, _source, _size, _source_size, _target, _copies and carry.

    A document's size is its number of words. All documents of a source
    expect the same number of copies, target / source size; with S(i) the
    prefix sum of the first i documents' expectations and u the source's
    offset in [0, 1), document i is emitted floor(S(i) + u) - floor(S(i-1) + u)
    times: once for each integer crossed, so never more than `most` times when
    that is a whole number. Documents stand in order of size, so the copies
    are spread over all sizes and the words taken come near the target. The
    offset comes from an MD5 of seed and source: reruns agree.

    The position of a document is found in two steps: counts by (source,
    size, block) are aggregated before the shuffle, prefix-summed, and added
    to a row number inside each block of about BLOCK rows. So neither a
    source nor a size that holds a third of all rows meets in one task.

    Null text has size 0; null is a source of its own; a source without words
    has target 0 and is not taken. Repeated rows are separate documents. An
    empty table gives no rows.
    """
    carried = [F.col(c).alias(f"_carry_{c}") for c in carry]
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("_source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_size"),
        *carried,
    )
    # words are counted once: all that follows reads ids, sources and sizes
    return _numbered(written(rows, "sizes"), weights, share, most, seed).withColumnsRenamed({f"_carry_{c}": c for c in carry})


def _numbered(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    by_size = rows.groupBy("_source", "_size").agg(F.count("*").alias("_n"))
    # ids of any kind are spread by a block number, with more blocks where a size has more rows
    blocks = F.ceil(F.col("_n") / F.lit(BLOCK)).cast("long")
    sizes = by_size.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_total"))
    targets = source_targets(sizes, weights, share, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("\0")))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = targets.select(F.col("_source").alias("_s"), F.col("_total").alias("_source_size"), "_target")
    plan = by_size.select("_source", "_size", blocks.alias("_blocks"), before.alias("_before"))
    plan = plan.join(t, F.col("_source").eqNullSafe(F.col("_s"))).select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), "_blocks", "_before", "_source_size", "_target")
    joined = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))).drop("_s", "_z")
    block = F.pmod(F.xxhash64("_id"), F.col("_blocks"))
    joined = joined.withColumn("_block", block)
    # blocks of one size: their counts, prefix-summed
    counts = joined.where("_blocks > 1").groupBy("_source", "_size", "_block").agg(F.count("*").alias("_m"))
    shift = counts.select(
        F.col("_source").alias("_s"),
        F.col("_size").alias("_z"),
        F.col("_block").alias("_k"),
        F.coalesce(F.sum("_m").over(Window.partitionBy("_source", "_size").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
    )
    joined = joined.join(shift, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_block") == F.col("_k")), "left").drop("_s", "_z", "_k")
    place = F.row_number().over(Window.partitionBy("_source", "_size", "_block").orderBy("_id")) + F.col("_before") + F.coalesce(F.col("_shift"), F.lit(0))
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    crossed = lambda n: F.floor(n * each + offset)
    placed = joined.withColumn("_place", place).withColumn("_copies", (crossed(F.col("_place")) - crossed(F.col("_place") - 1)).cast("long"))
    return placed.drop("_before", "_blocks", "_block", "_shift", "_place")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    Only ids, sources and sizes go through the counting; the texts are written
    once under a row number and joined to the copies once.
    """
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source"}
    rows = written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mix")
    columns = [F.col("_doc")[options.pop(k, c)].alias(k) for k, c in names.items()]
    taken = systematic_mix(rows.select("_row", *columns), **{k: k for k in names}, carry=("_row",), **options)
    taken = taken.where("_copies > 0").select(F.col("_row").alias("_taken"), F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return rows.join(taken, F.col("_row") == F.col("_taken")).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
