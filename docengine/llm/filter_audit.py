"""Interaction of document filters: what each removes, in every order of application, from one contingency tensor per part."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import WORD, text_of

#: Names of the columns that audit() gives after _part, filter_order and step.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions of filters that look at one text: A few words, B few distinct words, C many capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals.cast("long") > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def patterns(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", failures=text_failures, good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(_part, _pattern, _n, _good, _toxic): documents by which of the filters they fail, bit i of _pattern for filter i in order of the names; the last filter is that of copies.

    A copy fails if a row of a smaller id has the identical text, anywhere in
    the table. That needs no join of rows: rows are counted by (digest, part,
    id), then by (digest, part) with the count of the least id apart, and only
    these groups meet their digest's least id. A text that a third of all rows
    hold is one row for each part by then.
    """
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(good) == 1).cast("int")).alias("_g"), F.max((F.col(toxic) == 1).cast("int")).alias("_t"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), text_of(text_col).alias("_text"))
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(failures(F.col("_text")).values())), F.lit(0))
    rows = rows.select("_id", "_part", F.sha2("_text", 256).alias("_digest"), bits.alias("_bits"))
    each = rows.groupBy("_digest", "_part", "_id").agg(F.count("*").alias("_n"), F.min("_bits").alias("_bits")).join(marks, "_id", "left")
    weighed = each.select("*", (F.col("_n") * F.coalesce("_g", F.lit(0))).alias("_good"), (F.col("_n") * F.coalesce("_t", F.lit(0))).alias("_toxic"))
    nothing = F.col("_id").isNull()  # neither smaller nor larger than any
    sums = [F.sum(F.when(~nothing, F.col(c))).alias(c) for c in ("_n", "_good", "_toxic")]
    first = F.min(F.when(~nothing, F.struct("_id", "_n", "_good", "_toxic")))
    groups = weighed.groupBy("_digest", "_part").agg(F.min("_bits").alias("_bits"), first.alias("_first"), F.sum(F.when(nothing, F.col("_n"))).alias("_null"), *sums)
    least = F.min("_first._id").over(Window.partitionBy("_digest"))
    groups = groups.withColumn("_has", F.coalesce(F.col("_first._id") == least, F.lit(False)))
    copy, zero = 1 << len(failures(F.col("_"))), F.lit(0)
    own = lambda c: F.when(F.col("_has"), F.col(f"_first.{c}")).otherwise(zero)
    count = lambda c: F.coalesce(F.col(c), zero)
    kept = F.struct(F.col("_bits").alias("_pattern"), (own("_n") + count("_null")).alias("_n"), own("_good").alias("_good"), own("_toxic").alias("_toxic"))
    gone = F.struct((F.col("_bits") + copy).alias("_pattern"), (count("_n") - own("_n")).alias("_n"), (count("_good") - own("_good")).alias("_good"), (count("_toxic") - own("_toxic")).alias("_toxic"))
    cells = groups.select("_part", F.inline(F.array(kept, gone))).where("_n > 0")
    return cells.groupBy("_part", "_pattern").agg(*[F.sum(c).cast("long").alias(c) for c in ("_n", "_good", "_toxic")])


def selectors(n: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of n filters, and for each count the vectors (orders * steps, n, 2) that select pass, fail or all along each axis."""
    take_pass, take_fail, take_all = (1, 0), (0, 1), (1, 1)
    orders = list(permutations(range(n)))
    rows: dict[str, list] = {"kept": [], "removed": [], "fails": [], "unique": []}
    for order in orders:
        for step, own in enumerate(order):
            before = set(order[:step])
            rows["kept"].append([take_pass if i in before or i == own else take_all for i in range(n)])
            rows["removed"].append([take_fail if i == own else take_pass if i in before else take_all for i in range(n)])
            rows["fails"].append([take_fail if i == own else take_all for i in range(n)])
            rows["unique"].append([take_fail if i == own else take_pass for i in range(n)])
    return orders, {k: np.array(v, np.int64) for k, v in rows.items()}


def contract(tensors: np.ndarray, selected: np.ndarray) -> np.ndarray:
    """For each tensor (tensors, 2, ..., 2) and each row of selectors the sum of the selected cells."""
    n = selected.shape[1]
    axes = list(range(2, 2 + n))
    operands = [x for i in range(n) for x in (selected[:, i], [1, axes[i]])]
    return np.einsum(tensors, [0, *axes], *operands, [0, 1], optimize=True)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", failures=text_failures) -> DataFrame:
    """One row per part, order of the filters and step: _part, filter_order, step (from 1) and COUNTS (long).

    Of the part's documents: kept are those left after this step, removed
    those that the step's filter takes, redundant those that fail it but were
    taken before, unique_fails those that fail it and no other; good_lost and
    toxic_lost are the removed ones with label 1; shapley is what the filter
    removes, summed over all orders.

    The texts are read once. What is left of a part are the counts of at most
    2^n patterns, its tensor; every count is a contraction of that with
    vectors that select pass, fail or all along each axis. Parts are
    rows, so tasks take them apart, and nothing passes the driver.

    Null text counts as empty, null part as the empty string. Null ids have no
    label, are copies of nothing and make no copies. Repeated rows of one id
    count each and are no copies of each other. Of an id's
    repeated labels the largest counts. An empty table gives no rows. Columns
    beside those named have no influence.
    """
    names = [*failures(F.col("_")), "E"]
    cells = patterns(docs, labels, id_col, text_col, part_col, failures)
    parts = cells.groupBy("_part").agg(F.collect_list(F.struct("_pattern", "_n", "_good", "_toxic")).alias("_cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        orders, chosen = selectors(n)
        title = ["".join(names[i] for i in o) for o in orders for _ in range(n)]
        own = np.array(orders).ravel()
        for batch in batches:
            for part, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                flat = np.zeros((3, 2**n), np.int64)
                for cell in found:
                    flat[:, cell["_pattern"]] = cell["_n"], cell["_good"], cell["_toxic"]
                tensors = flat.reshape((3, *[2] * n)).transpose(0, *range(n, 0, -1))  # bit 0 varies fastest
                removed, good, toxic = contract(tensors, chosen["removed"])
                kept, fails, unique = (contract(tensors[:1], chosen[k])[0] for k in ("kept", "fails", "unique"))
                shapley = np.zeros(n, np.int64)
                np.add.at(shapley, own, removed)
                counts = (kept, removed, fails - removed, unique, good, toxic, shapley[own])
                columns = [pa.array([part] * len(own)), pa.array(title), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))), *map(pa.array, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["_part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "_part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


ORACLE = r"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
         m AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x),
         l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id),
         f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                      'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x), 'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS fails
               FROM w JOIN m USING (x) LEFT JOIN l USING (doc_id)),
         c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
         v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
         o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
         s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
         g AS (SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS own, n, good, toxic, fails[o[step]] AS bad,
                      len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS earlier, len(list_filter(o, lambda k: fails[k])) = 1 AS single FROM c, s),
         r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
                      sum(CASE WHEN NOT earlier AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT earlier AND bad THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN earlier AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN single AND bad THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN NOT earlier AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT earlier AND bad THEN toxic ELSE 0 END) AS toxic_lost
               FROM g GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
