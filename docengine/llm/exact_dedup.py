"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import text_of, written


def _exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = 256) -> DataFrame:
    """As exact_groups(); the carried columns are named _carry_<name>."""
    carried = [f"_carry_{c}" for c in carry]
    held = f"_carry_{text_col}" if text_col in carry else "_text"  # a carried text is not held twice
    rows = docs.select(F.col(id_col).alias("_id"), *([] if text_col in carry else [F.col(text_col).alias("_text")]), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    rows = rows.withColumn("_len", F.octet_length(text_of(held))).withColumn("_prefix", F.xxhash64(F.substring(text_of(held), 1, prefix_chars)))
    lengths = written(rows.groupBy("_len").count().where("count > 1").select("_len"), "lengths")
    pairs = rows.select("_len", "_prefix").join(lengths, "_len", "left_semi").groupBy("_len", "_prefix").count()
    pairs = written(pairs.where("count > 1").select("_len", "_prefix", F.lit(True).alias("_again")), "pairs")
    key = ["_len", "_prefix", "_sha"]
    hashed = rows.join(pairs, ["_len", "_prefix"], "left").select("_id", "_len", "_prefix", F.when(F.col("_again"), F.sha2(text_of(held), 256)).alias("_sha"), *carried)
    # counted by id first: no group meets in one task, and it is known where ids repeat
    each = hashed.where("_sha is not null").groupBy(*key, "_id").agg(F.count("*").alias("_n"))
    groups = each.groupBy(*key).agg(F.max(F.struct("_id", "_n")).alias("_top"), F.sum("_n").alias("_size")).where("_size > 1")
    groups = written(groups.select(*key, F.col("_top._id").alias("_keep"), F.col("_top._n").alias("_twins"), "_size"), "groups")
    joined = hashed.join(groups, key, "left").withColumn("_best", F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep")
    result = lambda df, kept: df.select("_id", keep, F.coalesce("_size", F.lit(1)).alias("_size"), kept.alias("_kept"), *carried)
    if groups.where("_twins > 1").isEmpty():
        return result(joined, F.col("_best"))
    twin = F.col("_best") & (F.coalesce("_twins", F.lit(1)) > 1)
    again = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    return result(joined.where(~twin), F.col("_best")).unionByName(result(joined.where(twin), again == 1))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = 256) -> DataFrame:
    """Groups of rows whose texts are identical; of each group the row with the largest id stays.

    Returns one row per input row: _id, _keep (id of the row that stays),
    _size (rows of the group), _kept, and the columns named in carry.

    1. Lengths in bytes that occur once need no further look.
    2. Of the others, pairs (length, hash of the first characters) that occur once need none either.
    3. Only rows of the remaining pairs have their full text hashed (SHA-256).

    Counts are aggregated before they are shuffled, so a group that holds a
    third of all rows is one row per task. The tables of repeated lengths and
    pairs are written out first: the planner broadcasts them where their
    files are below spark.sql.autoBroadcastJoinThreshold and otherwise uses a
    sort-merge join whose skewed partitions adaptive execution splits.

    Null text counts as empty. Null ids are smaller than all others. Of rows
    that repeat both id and text, one is kept. An empty table gives no rows.
    Other columns have no influence, whatever their names.
    """
    found = _exact_groups(docs, id_col, text_col, carry, prefix_chars)
    return found.withColumnsRenamed({f"_carry_{c}": c for c in carry})


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """The rows of docs without all but one of each group of identical texts; columns as they were. Nulls, ties and repeated rows as in exact_groups()."""
    found = _exact_groups(docs, id_col, text_col, tuple(docs.columns), prefix_chars)
    return found.where("_kept").select(*[F.col(f"_carry_{c}").alias(c) for c in docs.columns])
