"""Byte-level BPE encoding and decoding of texts in overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.llm.common import lasting, slices, text_of

#: Characters of a chunk, and how many of the next chunk's it also holds.
CHUNK, OVERLAP = 32_768, 512
#: Pre-tokens whose ids a worker keeps in each of two tables; when the younger is full it replaces the older, so what is in use stays.
CACHE = 150_000


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbouring parts, the pair of least rank, leftmost first, merges until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 500:
        return _merge_long(piece, ranks)
    get, none = ranks.get, len(ranks) + 2**32
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) != none:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), by a heap over linked parts, for pre-tokens of any length."""
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := end[i]) < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and alive[j] and end[j] == e):
            continue
        alive[j] = False
        end[i] = e
        if e < n:
            before[e] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PieceIds(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers, computed once each while they fit."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = b"".join([x.to_bytes(4, "little") for x in merge(piece.encode(), self.ranks)])
        if len(piece) < 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two frames (_id, _row, _piece, _ids), of texts of one piece and of longer ones: the ids of each document's pieces, in order of _piece, as little-endian 32-bit integers.

    Texts of up to chunk + overlap characters are one piece. Longer ones are cut
    into chunks of that many characters that start every `chunk` characters.
    Each is pre-tokenised by itself, and only the places where pre-tokens
    begin inside the overlaps are gathered: the first place on which two
    neighbours agree, not within a few characters of the end of the text that
    the earlier one sees, is where one stops and the next starts, for from a
    common boundary on the same pattern finds the same pre-tokens. Where two
    neighbours agree nowhere (one pre-token covers the overlap), the rest of
    the document joins the earlier one, exactly, at whatever length. Pieces are then
    encoded apart; a piece never exceeds its document. With decoded, the same
    task decodes the ids again, as decode() does, into _bytes: one Python worker instead of two.

    ranks is the whole vocabulary (fixed by its file, not by the data) and
    goes to the executors as a broadcast variable. Null text counts as empty:
    one piece without ids. Repeated rows are encoded each; _row tells them
    apart. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    # workers keep the ids of pre-tokens from task to task, for this vocabulary only
    name = "bpe-" + hashlib.sha256(repr(sorted((r, b) for b, r in ranks.items())).encode()).hexdigest()
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    length = F.char_length("_text")
    short = rows.where(length <= chunk + overlap).select("_id", F.lit(None).cast("string").alias("_row"), F.lit(0).alias("_piece"), "_text")
    many = rows.where(length > chunk + overlap).withColumn("_row", F.sha2("_text", 256))
    starts = F.sequence(F.lit(0), F.floor((F.char_length("_text") - overlap - 1) / chunk).cast("int"))
    cut = many.select("_id", "_row", "_text", F.posexplode(starts).alias("_n", "_k")).select(
        "_id", "_row", F.col("_k").alias("_piece"), F.col("_text").substr(F.col("_k") * chunk + 1, F.lit(chunk + overlap)).alias("_text"), F.char_length("_text").alias("_length")
    )
    # twins: rows that repeat id and text give equal pieces; they are numbered, so that each is stitched alone
    twin = Window.partitionBy("_id", "_row", "_piece").orderBy(F.lit(1))
    cut = cut.withColumn("_row", F.concat_ws("-", "_row", F.row_number().over(twin)))
    margin = 8  # characters before the end of a chunk that are not used: look-ahead could see more there

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in slices(batches):
            heads, tails = [], []
            for k, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at = [m.start() for m in find(text)]
                heads.append([x + k * chunk for x in at if x < overlap - margin] if k else [])
                tails.append([x + k * chunk for x in at if chunk <= x < chunk + overlap - margin])
            extra = [pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *extra], ["_id", "_row", "_piece", "_text", "_length", "_heads", "_tails"])

    seen = cut.mapInArrow(boundaries, f"_id {id_type}, _row string, _piece int, _text string, _length int, _heads array<long>, _tails array<long>")
    chain = Window.partitionBy("_id", "_row").orderBy("_piece")
    meet = F.array_min(F.array_intersect("_heads", F.lag("_tails").over(chain)))
    met = seen.withColumn("_from", F.when(F.col("_piece") == 0, F.lit(0)).otherwise(meet)).drop("_heads", "_tails")
    # places found after a chunk that met none are not sure to be true boundaries
    met = met.withColumn("_from", F.when(F.min(F.col("_from").isNotNull()).over(chain), F.col("_from")))
    met = met.withColumn("_run", F.sum(F.col("_from").isNotNull().cast("int")).over(chain)).withColumn("_to", F.lead("_from").over(chain))
    # chunks of a run that never met their predecessor give the part after the predecessor's start
    last = F.row_number().over(Window.partitionBy("_id", "_row", "_run").orderBy(F.desc("_piece"))) == 1
    met = met.withColumn("_last", last).withColumn("_start", F.coalesce("_from", F.col("_piece") * chunk))
    stop = F.when(~F.col("_last"), (F.col("_piece") + 1) * chunk).otherwise(F.coalesce("_to", F.col("_length").cast("long")))
    part = F.col("_text").substr((F.col("_start") - F.col("_piece") * chunk + 1).cast("int"), (stop - F.col("_start")).cast("int"))
    runs = met.select("_id", "_row", "_run", "_piece", part.alias("_part")).groupBy("_id", "_row", "_run").agg(F.array_sort(F.collect_list(F.struct("_piece", "_part"))).alias("_parts"))
    long = runs.select("_id", "_row", F.col("_run").cast("int").alias("_piece"), F.concat_ws("", "_parts._part").alias("_text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        table = lasting(name, lambda: PieceIds(shared.value))
        known = table.__getitem__
        for batch in slices(batches):
            out = [b"".join(map(known, find(text))) for text in batch.column(3).to_pylist()]
            columns = [*(batch.column(i) for i in range(3)), pa.array(out, pa.binary())]
            if decoded:
                columns.append(pa.array([_bytes_of(x, table.tokens) for x in out], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["_id", "_row", "_piece", "_ids", *(["_bytes"] if decoded else [])]
    schema = f"_id {id_type}, _row string, _piece int, _ids binary" + (", _bytes binary" if decoded else "")
    return short.mapInArrow(ids, schema), long.mapInArrow(ids, schema)


def _bytes_of(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(pieces: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """pieces with _bytes: the tokens' bytes, concatenated. An id outside the vocabulary raises KeyError."""
    shared = pieces.sparkSession.sparkContext.broadcast({r: b for b, r in ranks.items()})
    columns = pieces.columns
    place = columns.index("_ids")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [_bytes_of(x.as_py() or b"", shared.value) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*columns, "_bytes"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return pieces.mapInArrow(back, f"{kinds}, _bytes binary")


def joined(whole: DataFrame, pieces: DataFrame) -> DataFrame:
    """(_id, _ids, _bytes) of each encoded and decoded document; only documents of several pieces are shuffled."""
    one = whole.select("_id", "_ids", "_bytes")
    every = pieces.groupBy("_id", "_row").agg(F.array_sort(F.collect_list(F.struct("_piece", "_ids", "_bytes"))).alias("_all"))
    # arrays of binary have no built-in concatenation: through hexadecimal text
    put = lambda c: F.unhex(F.concat_ws("", F.transform(F.col("_all"), lambda x: F.hex(x[c]))))
    return one.union(every.select("_id", put("_ids").alias("_ids"), put("_bytes").alias("_bytes")))


def digests(whole: DataFrame, pieces: DataFrame) -> DataFrame:
    """(_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return joined(whole, pieces).select(
        "_id", (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256")
    )
