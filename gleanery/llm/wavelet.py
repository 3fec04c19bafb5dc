"""Operator 7, token files as wavelet matrices.

Documents are dealt by ranges of their id and sorted; a task cuts its stream of ids into shards of about SHARD_TOKENS,
always between documents, and each shard becomes one record of a compressed Parquet file: a wavelet matrix of the ids,
and the ids and lengths of the documents. A wavelet matrix has one bit-plane per bit of the largest id; each plane is
stably dealt into zeros and ones before the next, and a directory of counts makes rank fast, so access, counting and
lookup of occurrences work on the planes without decoding.

Defined cases: a null or empty text holds the end id alone; a null id comes before any other; rows that share an id
are kept each, next to each other; a document longer than a shard makes a shard of its own; an empty table gives no
rows. Other columns are not stored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices
from .tokens import SLICE, chunk_cache, encode_texts

SHARD_TOKENS = 1 << 20
BLOCK_BITS = 512


class WaveletMatrix:
    """Planes of packed bits (first bit lowest), zeros per plane, and ones before each block of BLOCK_BITS."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        values = np.asarray(values)
        n, levels = len(values), max(1, int(values.max(initial=0)).bit_length())
        values = values.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (values & values.dtype.type(1 << level)) != 0
            plane = np.zeros(-(-max(n, 1) // BLOCK_BITS) * (BLOCK_BITS // 8), np.uint8)
            packed = np.packbits(bits, bitorder="little")
            plane[: len(packed)] = packed
            counts = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
            ones = np.count_nonzero(bits)
            dealt = np.empty_like(values)
            dealt[: n - ones], dealt[n - ones :] = values[~bits], values[bits]
            values = dealt
            zeros.append(n - ones)
        return cls(n, planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sQI", b"GWM1", self.n, len(self.planes)) + np.array(self.zeros, "<u8").tobytes()
        return head + b"".join(p.tobytes() + r.astype("<u4").tobytes() for p, r in zip(self.planes, self.ranks, strict=True))

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        mark, n, levels = struct.unpack_from("<4sQI", raw)
        if mark != b"GWM1":
            raise ValueError("not a wavelet matrix")
        at = 16
        zeros = np.frombuffer(raw, "<u8", levels, at).tolist()
        at += 8 * levels
        blocks = -(-max(n, 1) // BLOCK_BITS)
        planes, ranks = [], []
        for _ in range(levels):
            planes.append(np.frombuffer(raw, np.uint8, blocks * BLOCK_BITS // 8, at))
            at += blocks * BLOCK_BITS // 8
            ranks.append(np.frombuffer(raw, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
        return cls(n, planes, zeros, ranks)

    def _ones(self, level: int, position: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        block = position // BLOCK_BITS
        ones = self.ranks[level][block].astype(np.int64)
        plane = self.planes[level]
        words = plane[: len(plane) // 8 * 8].view("<u8")
        first, last = block * (BLOCK_BITS // 64), position // 64
        for step in range(BLOCK_BITS // 64):
            word = first + step
            inside = word < last
            ones += np.where(inside, np.bitwise_count(words[np.minimum(word, len(words) - 1)]), 0).astype(np.int64)
        rest = (position % 64).astype(np.uint64)
        tail = words[np.minimum(last, len(words) - 1)] & ((np.uint64(1) << rest) - np.uint64(1))
        return ones + np.bitwise_count(tail).astype(np.int64)

    def access(self, positions) -> np.ndarray:
        position = np.asarray(positions, np.int64)
        value = np.zeros(len(position), np.uint32)
        for level, zeros in enumerate(self.zeros):
            bit = (self.planes[level][position >> 3] >> (position & 7).astype(np.uint8)) & 1
            ones = self._ones(level, position)
            value = (value << np.uint32(1)) | bit
            position = np.where(bit == 1, zeros + ones, position - ones)
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        edge = np.array([start, stop], np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, edge)
            edge = zeros + ones if value >> (len(self.zeros) - 1 - level) & 1 else edge - ones
        return int(edge[0]), int(edge[1])

    def count(self, value: int, stop: int | None = None, start: int = 0) -> int:
        """How often a value stands at positions start..stop - 1."""
        if value >> len(self.zeros):
            return 0
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of a value, ascending: from its range in the last plane back up by select."""
        if value >> len(self.zeros):
            return np.zeros(0, np.int64)
        a, b = self._range(value, 0, self.n)
        position = np.arange(a, b)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = value >> (len(self.zeros) - 1 - level) & 1
            position = self._select(level, one, position - self.zeros[level] if one else position)
        return position

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Position of the nth (from 0) bit of this value in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK_BITS - ranks
        block = np.searchsorted(before, nth, side="right") - 1
        size = BLOCK_BITS // 8
        rows = np.unpackbits(self.planes[level].reshape(-1, size)[block], axis=1, bitorder="little") == bit
        reached = np.cumsum(rows, axis=1, dtype=np.int32) == (nth - before[block] + 1)[:, None]
        return block * BLOCK_BITS + reached.argmax(axis=1)

    def values(self) -> np.ndarray:
        """All values in order: the planes put together from the last to the first."""
        out = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for place, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(out)
            above[~bits] = out[:zeros]
            above[bits] = out[zeros:] | np.array(1 << place, out.dtype)
            out = above
        return out.astype(np.uint32)


RECORD = "part int, shard int, first_token long, n_tokens long, doc_ids array<long>, doc_lengths array<long>, matrix binary"


def write_tokens(docs: DataFrame, to: str, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id") -> None:
    """Encodes every text, `end_id` after each, and writes the shards to the new folder `to`."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        part, cache, state = TaskContext.get().partitionId(), chunk_cache(path), {"shard": 0, "first": 0}
        ids, held, size = [], [], 0

        def flush():
            lengths = [len(h) >> 2 for h in held]
            total = sum(lengths)
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4")).to_bytes()
            record = [[part], [state["shard"]], [state["first"]], [total], [list(ids)], [lengths], [matrix]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "shard", "first_token", "n_tokens", "doc_ids", "doc_lengths", "matrix"]
            state["shard"] += 1
            state["first"] += total
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(record, types, strict=True)], names=names)

        for batch in batches:
            column, names = batch.column("text"), batch.column("id")
            for start, stop in text_slices(column, SLICE):
                made = encode_texts(path, column.slice(start, stop - start), cache, end)
                for i, doc in zip(names.slice(start, stop - start).to_pylist(), made, strict=True):
                    if held and size + (len(doc) >> 2) > shard_tokens:
                        yield flush()
                        ids, held, size = [], [], 0
                    ids.append(i)
                    held.append(doc)
                    size += len(doc) >> 2
        if held:
            yield flush()

    # Rows of one id may lie in any order, so that many of them are dealt by their number.
    rows = docs.select(F.col(id_column).cast("long").alias("id"), "text", F.monotonically_increasing_id().alias("row"))
    rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").mapInArrow(run, RECORD).write.option("compression", "zstd").parquet(to)


def read_tokens(spark: SparkSession, at: str, id_column: str = "doc_id") -> DataFrame:
    """Reads the files of write_tokens back: id, start (ids of all documents before it), ids (binary).

    The driver adds up one number per partition of the writing job, of which there are as many as shuffle partitions.
    """
    shards = spark.read.schema(RECORD).parquet(at)
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([0, *(r["n"] for r in sums)]).tolist()
    before = spark.createDataFrame([(r["part"], e) for r, e in zip(sums, ends, strict=False)], "part int, before long")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = WaveletMatrix.from_bytes(row["matrix"]).values().astype("<u4")
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                ids = [values[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                first = row["before"] + row["first_token"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(first + starts), pa.array(ids, pa.binary())], names=[id_column, "start", "ids"])

    return shards.join(F.broadcast(before), "part").mapInArrow(run, f"{id_column} long, start long, ids binary")


def occurrences(spark: SparkSession, at: str, token: int) -> DataFrame:
    """part, shard, count of a token per shard and its positions there, from the planes alone."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = WaveletMatrix.from_bytes(row["matrix"]).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["shard"]], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["part", "shard", "n", "positions"])

    return spark.read.schema(RECORD).parquet(at).select("part", "shard", "matrix").mapInArrow(run, "part int, shard int, n long, positions array<long>")
