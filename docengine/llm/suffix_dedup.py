"""Removal of byte strings of 100 bytes or more that also occur earlier, within and across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import slices, text_of, written

#: Bytes of a string that is removed, and of the strings whose ranks it is the pair of.
LENGTH = 100
HALF = LENGTH // 2
#: Places of one rank that meet in one task, about.
BLOCK = 10_000
_A, _B, _C, _SHIFT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 31))
_BYTES = np.arange(1, 257, dtype=np.uint64) * _A


def ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint ranks of the strings of `length` bytes at all positions, by doubling: that of 2n bytes is made of the pair at distance n, that of the rest of an overlapping pair."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    r, n = _BYTES[raw], 1
    while 2 * n <= length:
        r, rest = r[:-n] * _B, r[n:]
        r += rest
        r ^= r >> _SHIFT
        n *= 2
    m = len(raw) - length + 1
    if n < length:
        r, rest = r[:m] * _C, r[length - n : length - n + m]
        r += rest
        r ^= r >> _SHIFT
    return r


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over all runs of `size` values."""
    n = 1
    while 2 * n <= size:
        x = pick(x[:-n], x[n:])
        n *= 2
    rest = size - n
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all strings of HALF bytes, their least in each string of LENGTH bytes, and the positions that are the least of one, with the first and the last."""
    g = ranks(raw, HALF)
    span = LENGTH - HALF + 1
    if len(g) < span:
        return g, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = _sliding(g, span, np.minimum)
    wide = np.zeros(len(least) + 2 * (span - 1), np.uint64)
    wide[span - 1 : span - 1 + len(least)] = least
    chosen = _sliding(wide, span, np.maximum)[: len(g)] == g
    chosen[[0, -1]] = True
    return g, least, np.flatnonzero(chosen)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def open_parts(text: bytes, at: np.ndarray, first: np.ndarray, shift: np.ndarray, own: np.ndarray) -> tuple[list[int], list[tuple[int, int, bytes]]]:
    """Of one document: stretches known to occur earlier, and what is still open.

    at: positions of the anchors that occur more than once; first: a number of the document
    where each occurs first, shift: the distance from here to there, own: whether this is the
    first. Anchors that follow each other within HALF bytes and have their first
    occurrence in the same document at the same distance are one stretch that is
    equal there. Strings whose anchor (their least rank) occurs only once are unique. Others
    that lie in no such stretch are open: (rank, start, bytes) for each run
    of them that has the same anchor.
    """
    raw = np.frombuffer(text, np.uint8)
    known: list[int] = []
    if len(raw) < LENGTH or not len(at):
        return known, []
    g, least, chosen = anchors(raw)
    count = len(raw) - LENGTH + 1
    settled = np.zeros(count + 1, np.int64)
    joined = (first[1:] == first[:-1]) & (shift[1:] == shift[:-1]) & ~own[1:] & ~own[:-1] & (np.diff(at) <= HALF)
    begin, end = _spans(joined)
    for i, j in zip(begin.tolist(), end.tolist(), strict=True):
        low, high = int(at[i]), int(at[j]) + HALF
        if high - low >= LENGTH:
            known += (low, high)
            settled[low] += 1
            settled[high - LENGTH + 1] -= 1
    again = np.zeros(len(g), bool)
    again[at] = True
    here = np.arange(count)
    owner = np.searchsorted(chosen, here)
    while (miss := g[chosen[owner]] != least).any():
        owner[miss] += 1
    where = chosen[owner]
    open_ = again[where] & (np.cumsum(settled[:count]) == 0)
    change = np.flatnonzero(np.diff(where)) + 1
    bounds = np.concatenate([[0], change, [count]])
    parts = []
    for s, e in zip(*_spans(open_), strict=True):
        cuts = [s, *bounds[np.searchsorted(bounds, s, "right") : np.searchsorted(bounds, e, "left")].tolist(), e]
        parts += [(int(g[where[a]].view(np.int64)), int(a), text[a : b + LENGTH - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return known, parts


def later_windows(rank: np.ndarray, row: np.ndarray, seen: tuple[int | None, np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple[int, np.ndarray]]:
    """For rows in order of (rank, place): the numbers of those strings of LENGTH bytes in texts that occur in an earlier row, as (text, offset); seen: strings of the last rank so far.

    row numbers the places: rows of equal number are the same place, given
    twice. The strings of one row all hold its anchor at another distance, so none
    of them is equal to another. A row whose rank no other has cannot match.
    """
    again = np.zeros(len(rank), bool)
    again[1:] = rank[1:] == rank[:-1]
    again[:-1] |= again[1:]
    again[0] |= seen[0] == rank[0]
    again[-1] = True  # the next batch may go on with it
    used = np.flatnonzero(again)
    sizes = np.array([len(texts[i]) for i in used.tolist()])
    all_ranks = ranks(np.frombuffer(b"".join([texts[i] for i in used.tolist()]), np.uint8), LENGTH)
    counts = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(used)), counts)
    skipped = np.repeat(np.arange(len(used)) * (LENGTH - 1), counts)
    key = all_ranks[np.arange(len(of)) + skipped] ^ (rank[used].view(np.uint64) * _A)[of]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = row[used][of[order]]
    later = np.zeros(len(key), bool)
    later[order] = place != place[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    if seen[0] == rank[0]:
        mine = slice(0, int(counts[: int(np.searchsorted(rank[used] != rank[0], True))].sum()))
        later[mine] |= np.isin(key[mine], seen[1])
    tail = int(counts[np.flatnonzero(rank[used] == rank[-1])[0] :].sum())
    kept = np.unique(key[len(key) - tail :])
    if seen[0] == rank[-1]:
        kept = np.union1d(kept, seen[1])
    hit = np.flatnonzero(later)
    return used[of[hit]], hit - (np.cumsum(counts) - counts)[of[hit]], (int(rank[-1]), kept)


def _as_before(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return same.to_numpy(zero_copy_only=False).astype(bool)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: _id, _bytes, _removed, _spans (counts) and _kept (binary, what is left).

    Texts are their UTF-8 bytes. A byte is removed if a string of LENGTH bytes
    that covers it also starts earlier: in a row of smaller id, or further up in the
    same one. All strings are judged on the input. Matches never cross documents.

    Prefix doubling, begun at HALF bytes and pruned at every step:

    1. Ranks of strings of HALF bytes are 64-bit fingerprints, computed in each
       task by doubling offsets. Of each string of LENGTH bytes only the one of least rank inside it
       (about one position in 25) goes to Spark, which counts equal ranks. Unique ones end there.
    2. The first place of each rank, aggregated in the same step, is joined to the others, in
       blocks of about BLOCK places where a rank is very common. Stretches of a document
       whose anchors all have their first occurrence at the same distance in one earlier document are
       equal to it and settled; copies are, mostly.
    3. The rest is ranked at LENGTH bytes, the pair of ranks at offset HALF,
       among strings with the same anchor, sorted by place: all but the
       first of equal ones are removed.

    Only what is open after a step is shuffled in the next. Steps 1 to 3 hold one text, or one
    batch of rows with the distinct strings of one anchor, in a task at a time.

    Null text counts as empty and null ids come first. Other columns are ignored, whatever their names. Rows with the same id
    but different texts are ordered by a hash of the text; identical rows are one
    document, each with its result. Empty tables give no rows.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_tie"), F.encode(text_of(text_col), "UTF-8").alias("_text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, rank = [], []
            for text in batch.column(2):
                g, _, chosen = anchors(np.frombuffer(text.as_buffer(), np.uint8))
                at.append(chosen.astype(np.int32))
                rank.append(g[chosen].view(np.int64))
            of = np.repeat(np.arange(batch.num_rows), [len(x) for x in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(np.concatenate([*at, np.zeros(0, np.int32)])), pa.array(np.concatenate([*rank, np.zeros(0, np.int64)]))],
                ["_id", "_tie", "_at", "_rank"],
            )

    marks = rows.where(F.octet_length("_text") >= LENGTH).mapInArrow(mark, f"_id {id_type}, _tie long, _at int, _rank long")
    first = F.min(F.struct("_id", "_tie", "_at")).alias("_first")
    again = marks.groupBy("_rank").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"), F.count("*").alias("_n"), first).where("_n > 1")
    again = written(again.select("_rank", F.col("_blocks").cast("int").alias("_blocks"), "_first"), "again")
    # places of a very common rank are dealt over several blocks; such ranks are few, one for BLOCK places at most
    common = again.where("_blocks > 1").select("_rank", F.col("_blocks").alias("_common"))
    dealt = marks.join(common, "_rank", "left").withColumn("_block", F.coalesce(F.pmod(F.xxhash64("_tie", "_at"), F.col("_common")).cast("int"), F.lit(0))).drop("_common")
    firsts = again.select("_rank", "_first", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    found = dealt.join(firsts, ["_rank", "_block"])
    own = F.col("_first._id").eqNullSafe(F.col("_id")) & (F.col("_first._tie") == F.col("_tie")) & (F.col("_first._at") == F.col("_at"))
    found = found.select("_id", "_tie", F.struct("_at", F.xxhash64("_first._id", "_first._tie").alias("_in"), (F.col("_first._at") - F.col("_at")).alias("_shift"), own.alias("_own")).alias("_mark"))
    lists = written(found.groupBy("_id", "_tie").agg(F.sort_array(F.collect_set("_mark")).alias("_marks")), "marks")

    def match(a: DataFrame, b: DataFrame, kind: str = "inner") -> DataFrame:
        b = b.withColumnsRenamed({"_id": "_id_b", "_tie": "_tie_b"})
        return a.join(b, F.col("_id").eqNullSafe(F.col("_id_b")) & (F.col("_tie") == F.col("_tie_b")), kind).drop("_id_b", "_tie_b")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known, counts, rank, start, part = [], [0], [], [], []
            for text, listed in zip(batch.column(2), batch.column(3), strict=True):
                flat = listed.values
                at, in_, shift, mine = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                k, parts = open_parts(text.as_py(), at.astype(np.int64), in_, shift, mine.astype(bool))
                known.append(k)
                counts.append(counts[-1] + len(parts))
                for r, s, x in parts:
                    rank.append(r)
                    start.append(s)
                    part.append(x)
            inner = pa.StructArray.from_arrays([pa.array(rank, pa.int64()), pa.array(start, pa.int32()), pa.array(part, pa.binary())], ["_rank", "_start", "_part"])
            parts = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known, pa.list_(pa.int32())), parts], ["_id", "_tie", "_known", "_parts"])

    opened = match(rows, lists).select("_id", "_tie", "_text", "_marks").mapInArrow(
        split, f"_id {id_type}, _tie long, _known array<int>, _parts array<struct<_rank: long, _start: int, _part: binary>>"
    )
    opened = written(opened, "open")
    parts = opened.select("_id", "_tie", F.explode("_parts").alias("_p")).select("_p._rank", "_id", "_tie", "_p._start", "_p._part")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        before = None
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            head, tail = ([c[i].as_py() for c in batch.columns[:4]] for i in (0, batch.num_rows - 1))
            same = np.ones(batch.num_rows - 1, bool)
            for c in batch.columns[:4]:
                same &= _as_before(c)
            row = np.concatenate([[0], np.cumsum(~same)])
            twins = int(np.searchsorted(row, 0, "right")) if head == before else 0
            before = tail
            batch, row = batch.slice(twins), row[twins:]  # identical rows, cut off from their twin by the batch's end
            if not batch.num_rows:
                continue
            text, offset, seen = later_windows(batch.column(0).to_numpy(), row, seen, batch.column(4).to_pylist())
            if not len(text):
                continue
            # runs of neighbouring strings of one row
            first = np.ones(len(text), bool)
            first[1:] = (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
            begin = np.flatnonzero(first)
            end = np.concatenate([begin[1:], [len(text)]]) - 1
            start = batch.column(3).to_numpy()[text[begin]]
            cuts = np.stack([start + offset[begin], start + offset[end] + LENGTH], 1).astype(np.int32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cuts) + 1, 2), pa.int32()), pa.array(cuts))
            which = pa.array(text[begin])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(which), batch.column(2).take(which), lists], ["_id", "_tie", "_known"])

    sorted_parts = parts.repartition("_rank").sortWithinPartitions("_rank", "_id", "_tie", "_start")
    judged = sorted_parts.mapInArrow(judge, f"_id {id_type}, _tie long, _known array<int>")
    every = opened.select("_id", "_tie", "_known").where(F.size("_known") > 0).union(judged)
    cuts = written(every.groupBy("_id", "_tie").agg(F.flatten(F.collect_list("_known")).alias("_cuts")), "cuts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, removed, spans, kept = [], [], [], []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone, pieces, end, n = 0, [], 0, 0
                for low, high in sorted(zip(cut[::2], cut[1::2], strict=True)) if cut else ():
                    if low > end or not n:
                        pieces.append(text[end:low])
                        n += 1
                        gone += high - low
                    else:
                        gone += max(0, high - end)
                    end = max(end, high)
                pieces.append(text[end:])
                sizes.append(len(text))
                removed.append(gone)
                spans.append(n)
                kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["_id", "_bytes", "_removed", "_spans", "_kept"])

    return match(rows, cuts, "left").select("_id", "_text", "_cuts").mapInArrow(remove, f"_id {id_type}, _bytes long, _removed long, _spans long, _kept binary")

