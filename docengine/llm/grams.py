"""Counts of word n-grams by 64-bit hash: tasks count slices of texts in numpy, Spark deals the packed counts by ranges of the hash, tasks add up one range at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import text_of

#: Tokens that a task counts at a time; tokens of the corpus for each range of hashes; least ranges.
SLICE, RANGE_TOKENS, LEAST_RANGES = 1_500_000, 4_000_000, 64
#: Rows of packed counts: a range of hashes, what they count, how many, and their columns.
PACKED = "shard int, kind int, n long, data binary"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, order counts; for either held fixed no two of the other collide."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def ranges(docs: DataFrame, text_col: str = "text") -> int:
    """How many ranges of hashes: in proportion to the bytes of the texts, so that a range's counts fit a task at any size."""
    total = docs.agg(F.sum(F.octet_length(text_of(text_col)))).head()[0] or 0
    return max(LEAST_RANGES, total // (6 * RANGE_TOKENS))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _planes(values: np.ndarray) -> bytes:
    """A column in as few bytes as its largest value needs, byte by byte: equal high bytes of neighbours then compress in the shuffle."""
    values = values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)
    return bytes([values.itemsize]) + values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = data[at]
    planes = np.frombuffer(data, np.uint8, n * size, at + 1).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"u{size}").ravel(), at + 1 + n * size


def pack(columns: list[np.ndarray], words: int = 0) -> bytes:
    """Unsigned columns as bytes. Of the first `words` columns each distinct value is held once, with a number for each row; rows are put in order of the first."""
    out, coded = [bytes([len(columns), words])], []
    for c in columns[:words]:
        values, number = np.unique(c, return_inverse=True)
        out += [len(values).to_bytes(4, "little"), _planes(values)]
        coded.append(number)
    columns = [*coded, *columns[words:]]
    if words:
        order = np.argsort(coded[0], kind="stable")
        columns = [c[order] for c in columns]
    return b"".join(out + [_planes(c) for c in columns])


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    """The columns of pack(), as 64-bit numbers; rows may have changed their order, in all columns alike."""
    words, values, out, at = data[1], [], [], 2
    for _ in range(words):
        m = int.from_bytes(data[at : at + 4], "little")
        held, at = _from_planes(data, at + 4, m)
        values.append(held)
    for i in range(data[0]):
        column, at = _from_planes(data, at, n)
        out.append((values[i][column] if i < words else column).astype(np.uint64))
    return out


def summed(keys: np.ndarray, values: list[np.ndarray], firsts: list[np.ndarray] = ()) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys, the sums of each value, and what firsts hold for each key."""
    if not len(keys):
        return keys, values, list(firsts)
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    start = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    return held[start], [np.add.reduceat(v[order], start) for v in values], [f[order[start]] for f in firsts]


def dealt(kind: int, keys: np.ndarray, columns: list[np.ndarray], shards: int, words: int = 0) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of PACKED for sorted keys and the columns that belong to them; keys are a column only where named."""
    bounds = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for s in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        a, b = bounds[s], bounds[s + 1]
        yield s, kind, int(b - a), pack([c[a:b] for c in columns], words)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    shard, kind, n, data = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["shard", "kind", "n", "data"])


def gathered(table: pa.Table, kind: int) -> list[np.ndarray] | None:
    """The columns of all rows of a kind, one behind the other."""
    found = [unpack(d, n) for k, n, d in zip(table["kind"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else None


class Splitter:
    """Finds and hashes the words of a text in numpy: a word's hash is a polynomial of its bytes, mixed; letters A to Z count as a to z.

    blank and parting: bytes that words end at; the number of parting ones before a word is the number of its piece.
    """

    #: Bytes looked at together, so that what is made of them stays in a cache; longer words are hashed block by block.
    BLOCK = 1 << 17
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, blank: bytes, parting: bytes = b""):
        self.kind = np.zeros(256, np.uint8)
        self.kind[list(blank)], self.kind[list(parting)] = 1, 2
        values = np.random.default_rng(20_240).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]
        self.values = values
        power = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(2 * self.BLOCK, b % 2**64, np.uint64))))
        self.powers, self.inverses = power(self.BASE), power(pow(self.BASE, -1, 2**64))

    def _sum(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(self.values[block] * self.powers[: len(block)], out=out[1:])
        return out

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte, end and piece of each word."""
        found, at, piece, every = [], 0, 0, np.frombuffer(data, np.uint8)
        while at < len(data):
            block = every[at : at + self.BLOCK]
            kind = self.kind[block]
            if at + len(block) < len(data):  # stop behind the last byte that is in no word
                last = len(kind) - int(np.argmax(kind[::-1] > 0)) if kind.any() else 0
                if not last:
                    at, one = self._long(every, at, piece)
                    found.append(one)
                    continue
                block, kind = block[:last], kind[:last]
            edge = np.flatnonzero(np.diff(np.concatenate(([True], kind > 0, [True])).view(np.int8)))
            start, end = edge[::2], edge[1::2]
            sums = self._sum(block)
            parted = np.cumsum(kind == 2) + piece
            found.append(((sums[end] - sums[start]) * self.inverses[start], start + at, end + at, parted[start] if len(start) else start))
            piece = int(parted[-1])
            at += len(block)
        x, start, end, pieces = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        return mixed(x, np.uint64(0)), start, end, pieces

    def _long(self, every: np.ndarray, at: int, piece: int) -> tuple[int, tuple]:
        """A word that begins here and fills a block, and where it ends."""
        total, end = 0, at
        while end < len(every):
            block = every[end : end + self.BLOCK]
            stop = np.flatnonzero(self.kind[block])
            block = block[: stop[0]] if len(stop) else block
            total += int(self._sum(block)[-1]) * pow(self.BASE, end - at, 2**64)
            end += len(block)
            if len(stop):
                break
        return end, (np.array([total % 2**64], np.uint64), np.array([at]), np.array([end]), np.array([piece]))


def text_slices(batches: Iterator[pa.RecordBatch], tokens: int | None = None, text: int = 0) -> Iterator[list[pa.RecordBatch]]:
    """Rows in runs of about SLICE tokens, judged by bytes of text; a longer single text is a run of its own."""
    most, held, size = 6 * (tokens or SLICE), [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            take = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most - size, "right")))
            held.append(batch.slice(at, take))
            size += int(sizes[at : at + take].sum())
            at += take
            if size >= 0.9 * most:
                yield held
                held, size = [], 0
    if held:
        yield held
    pa.default_memory_pool().release_unused()
