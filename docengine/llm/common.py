"""What several operators share: reading, shared-folder tables, words, components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; texts in fewer files than the session has cores are dealt to all of them."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in ("documents", "pages") and len(found.inputFiles()) < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; a cluster session is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of an Arrow batch while a table is written: rows hold whole texts, and a Python worker keeps what its largest batch took.
BATCH = 1_000


def written(df: DataFrame, name: str = "part", slot: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends and the planner knows the size.

    The shuffle files behind the rows are dropped when the write has ended: what
    follows reads the table. Arrow batches hold BATCH rows at most for the length of the write.
    With slot, a table written under the same name and slot before is replaced.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docengine-{name}-{slot or uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = min(int(spark.conf.get(key)), BATCH)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(spark, key, str(rows if rows > 0 else BATCH)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows. Spark ends a batch of texts at spark.sql.execution.arrow.maxBytesPerBatch; what a task makes of one slice is a part of that."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # a worker waits for its next task with no more than it holds


def text_of(column: str) -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that the edges (a, b) connect each id with.

    Each round joins the neighbours' labels and the label's own label (pointer
    jumping), so that the rounds grow with the logarithm of a chain's length.
    A vertex with very many neighbours is reduced by partial aggregation. The
    tables of a round replace those of the round before the last.
    """
    run = uuid.uuid4().hex
    both = written(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels", f"{run}-0")
    for n in count(1):
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        step = written(step, "step", run)
        up = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        after = written(step.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"), "was"), "labels", f"{run}-{n % 2}")
        if after.where("component <> was").isEmpty():
            break
        labels = after.select("id", "component")
    return after.select("id", "component")


def held_out(id_column: str, modulus: int, remainder: int) -> F.Column:
    """Whether a row is kept from training: by CRC-32 of its id as text. Null ids are kept from training."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: F.Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_text, _label): texts of at most `rows` labelled ids that may be learned from, chosen by a hash of the id.

    Labels are cut to the sample before they meet the texts, so the
    broadcast side has a fixed bound and the documents are not shuffled.
    Rows whose label is null or not 0 or 1 are left out; of a repeated id's
    labels the largest counts, and each of its texts.
    """
    ids = labels.where(F.col(label).isin(0, 1)).where(~held).groupBy(F.col(id_col).alias("_labelled")).agg(F.max(label).cast("int").alias("_label"))
    chosen = ids.orderBy(F.xxhash64("_labelled"), "_labelled").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return texts.join(F.broadcast(chosen), F.col("_id") == F.col("_labelled")).select("_id", "_text", "_label")


def lasting(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, one thing at a time: made again when another name is asked for."""
    held = sys.modules.setdefault("_docengine_lasting", types.ModuleType("_docengine_lasting")).__dict__
    if held.get("name") != name:
        held["name"], held["value"] = name, make()
    return held["value"]
