"""Operator 3, exact deduplication over a cuckoo-filter index.

Each row becomes a digest (SHA-256 of its text), made in the JVM; texts are never shuffled. A first index in each map
task folds the rows of a batch that share a digest into one (greatest id, count), so that a group of copies, however
large, sends one row per batch. Those rows are dealt by digest, and the index of each partition inserts their digests:
a 16-bit fingerprint in one of two buckets of four slots. A filter hit is no answer yet: it is verified against the
content kept in the bucket (whole digest, a second hash and the length of the text), and a mere fingerprint collision
is inserted as its own entry. A full table is rebuilt at twice the size from the stored keys. Deleting a live digest
frees its slot.

Defined cases: null counts as the empty text; a null id counts as less than any other; of equal texts the row with the greatest id stays; rows that repeat an
id are counted each, and all of them carry the same result; an empty table gives no rows. Other columns of the input
do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_ID, join_with_hot, number_or_least, written

SLOTS = 4


class CuckooIndex:
    """Digests in buckets of SLOTS, each with a 16-bit fingerprint, its whole key and a payload (greatest id, count)."""

    def __init__(self, buckets: int = 256, seed: int = 7):
        self._random = np.random.default_rng(seed)
        self._make(buckets)

    def _make(self, buckets: int) -> None:
        self.buckets = buckets  # a power of two
        self.marks = np.zeros((buckets, SLOTS), np.uint16)  # 0: free
        self.keys = np.zeros((buckets, SLOTS, 6), np.uint64)
        self.largest = np.zeros((buckets, SLOTS), np.int64)
        self.counts = np.zeros((buckets, SLOTS), np.int64)
        self.size = 0

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (((mark.astype(np.int64) * 0x5BD1E995) >> 7) & (self.buckets - 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, slot) of each key, -1 where it is absent: fingerprints first, and each hit held against the kept key."""
        mark, first, second = self._places(keys)
        bucket, slot = np.full(len(keys), -1), np.full(len(keys), -1)
        for place in (first, second):
            for s in range(SLOTS):
                hit = np.flatnonzero((self.marks[place, s] == mark) & (bucket < 0))
                real = hit[(self.keys[place[hit], s] == keys[hit]).all(axis=1)]
                bucket[real], slot[real] = place[real], s
        return bucket, slot

    def add(self, keys: np.ndarray, largest: np.ndarray, counts: np.ndarray) -> None:
        """Adds rows whose keys differ from each other; known keys gather the count and the greatest id."""
        bucket, slot = self.find(keys)
        known = bucket >= 0
        at = bucket[known], slot[known]
        self.largest[at] = np.maximum(self.largest[at], largest[known])
        self.counts[at] += counts[known]
        self._insert(keys[~known], largest[~known], counts[~known])

    def _insert(self, keys: np.ndarray, largest: np.ndarray, counts: np.ndarray) -> None:
        while (self.size + len(keys)) > 0.85 * self.buckets * SLOTS:
            self._grow()
        self.size += len(keys)
        mark, first, second = self._places(keys)
        place, tries = first, 0
        while len(keys):
            # Of the keys that want one bucket, each round seats or swaps one.
            order = np.unique(place, return_index=True)[1]
            turn = np.zeros(len(keys), bool)
            turn[order] = True
            b = place[order]
            free = self.marks[b] == 0
            has = free.any(axis=1)
            s = np.where(has, free.argmax(axis=1), self._random.integers(0, SLOTS, len(b)))
            out = [x[b[~has], s[~has]].copy() for x in (self.marks, self.keys, self.largest, self.counts)]
            for x, new in ((self.marks, mark), (self.keys, keys), (self.largest, largest), (self.counts, counts)):
                x[b, s] = new[order]
            wait = ~turn
            waiting = place[wait] if tries % 2 else self._other(place[wait], mark[wait])
            place = np.concatenate([waiting, self._other(b[~has], out[0])])
            mark, keys, largest, counts = (np.concatenate([x[wait], y]) for x, y in zip((mark, keys, largest, counts), out, strict=True))
            tries += 1
            if tries > 500 and len(keys):  # no seat: rebuild from the stored keys
                self.size -= len(keys)
                self._grow()
                return self._insert(keys, largest, counts)

    def _grow(self) -> None:
        live = self.marks != 0
        keys, largest, counts = self.keys[live], self.largest[live], self.counts[live]
        self._make(self.buckets * 2)
        self._insert(keys, largest, counts)

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Frees the slots of live keys; tells which were live."""
        bucket, slot = self.find(keys)
        live = bucket >= 0
        self.marks[bucket[live], slot[live]] = 0
        self.size -= int(live.sum())
        return live

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        live = self.marks != 0
        return self.keys[live], self.largest[live], self.counts[live]


def _folded(keys: np.ndarray, largest: np.ndarray, counts: np.ndarray):
    """Rows with equal keys become one."""
    if not len(keys):
        return keys, largest, counts
    order = np.lexsort(keys.T)
    keys, largest, counts = keys[order], largest[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[starts], np.maximum.reduceat(largest, starts), np.add.reduceat(counts, starts)


def _read(batch: pa.RecordBatch, count: bool):
    n = batch.num_rows
    digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(n, 4)
    keys = np.empty((n, 6), np.uint64)
    keys[:, :4] = digest
    keys[:, 4] = batch.column("second").to_numpy().view(np.uint64)
    keys[:, 5] = batch.column("bytes").to_numpy()
    return keys, batch.column("id").to_numpy(), batch.column("n").to_numpy() if count else np.ones(n, np.int64)


def _write(keys: np.ndarray, largest: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    digest = [x.tobytes() for x in keys[:, :4].astype(">u8")]
    arrays = [pa.array(digest, pa.binary()), pa.array(keys[:, 4].view(np.int64)), pa.array(keys[:, 5].astype(np.int64)), pa.array(largest), pa.array(counts)]
    return pa.RecordBatch.from_arrays(arrays, names=["digest", "second", "bytes", "id", "n"])


SCHEMA = "digest binary, second long, bytes long, id long, n long"
WHOLE = 1 << 16


def _fold_batches(batches):
    for batch in batches:
        if batch.num_rows:
            yield _write(*_folded(*_read(batch, False)))


def _index_partition(batches):
    index = CuckooIndex()
    for batch in batches:
        if batch.num_rows:
            index.add(*_folded(*_read(batch, True)))
    keys, largest, counts = index.items()
    for at in range(0, len(keys), WHOLE):
        yield _write(keys[at : at + WHOLE], largest[at : at + WHOLE], counts[at : at + WHOLE])


def digests(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(number_or_least(F.col(id_column)).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("second"), F.octet_length(text).cast("long").alias("bytes"))


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct text of `digests`: its key, the greatest id and the number of rows."""
    folded = rows.select("digest", "second", "bytes", "id").mapInArrow(_fold_batches, SCHEMA)
    return folded.repartition("digest").mapInArrow(_index_partition, SCHEMA).select("digest", "second", "bytes", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Each row finds its group by `join_with_hot`.
    """
    rows, _ = written(digests(docs, id_column), "digests")
    found, _ = written(groups(rows), "groups")
    both = join_with_hot(rows, found, ["digest", "second", "bytes"], "group_size", rows.count())
    real = [F.nullif(F.col(c), F.lit(LEAST_ID)).alias(n) for c, n in (("id", id_column), ("keep_id", "keep_id"))]
    return both.select(*real, "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
