"""Operator 6, packing token ids into windows of fixed capacity by Karmarkar-Karp differencing.

A document's ids are cut into full windows and a rest. Full windows stand alone. Rests are dealt by a hash of their
row's number, not of its id, into shards of about SHARD_DOCS, each of which is packed by itself: every item is a partition of the window
set with one filled part; the two partitions of greatest imbalance are merged again and again, the fullest parts of
one with the emptiest of the other, which leaves windows of nearly equal sums. If the fullest exceeds the capacity, the
window count rises and the shard is packed anew. Items are cut once more, at CUT ids, before that: smaller items
level better.

Defined cases: a null or empty text holds the end id alone; a document of many windows is spread over shards piece by
piece; repeated rows are packed each; an empty table gives no rows. rows of a null or repeated id are
spread over all shards like any others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_groups
from .tokens import token_ids

SHARD_DOCS = 512
CUT = 1024
#: Sequence ids of one shard lie in a range of this many.
STRIDE = 1 << 32


def differencing(sizes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals items into `parts` windows: (window of each item, sum of each window)."""
    n = len(sizes)
    if parts == 1:
        return np.zeros(n, np.int64), np.array([int(sizes.sum())])
    # A partial partition holds its windows in ascending order of their sums. What a window holds is a node of a
    # binary forest: the items first, then a node for each two that were joined; -1 is nothing.
    below: list[np.ndarray] = []
    count = n
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums, held = np.zeros(parts, np.int64), np.full(parts, -1)
        sums[-1], held[-1] = size, i
        heap.append((-size, i, sums, held))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, sums, held = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        sums, more = sums + other[::-1], more[::-1]
        both = (held >= 0) & (more >= 0)
        joined = np.where(held >= 0, held, more)
        k = int(both.sum())
        if k:
            below.append(np.stack([held[both], more[both]], axis=1))
            joined[both] = np.arange(count, count + k)
            count += k
        order = np.argsort(sums, kind="stable")
        sums, joined = sums[order], joined[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), turn, sums, joined))
        turn += 1
    _, _, sums, held = heap[0]
    window = np.full(count, -1)
    window[held[held >= 0]] = np.flatnonzero(held >= 0)
    at = count
    for children in reversed(below):
        at -= len(children)
        for side in (0, 1):
            window[children[:, side]] = window[at : at + len(children)]
    return window[:n], sums


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none fuller than `capacity`; the window count starts at the least that could do."""
    parts = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = differencing(sizes, parts)
        if sums.max(initial=0) <= capacity:
            return window
        parts += 1


def _pack(capacity: int):
    def run(batches):
        for batch, starts in whole_groups(batches, ["shard"]):
            n = batch.num_rows
            length = batch.column("length").to_numpy()
            shard = batch.column("shard").to_numpy()
            sequence, offset = np.empty(n, np.int64), np.zeros(n, np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                if shard[a] & 1:  # full windows
                    sequence[a:b] = shard[a] * STRIDE + np.arange(b - a)
                    continue
                window = fill(length[a:b], capacity)
                order = np.argsort(window, kind="stable")
                ends = np.cumsum(length[a:b][order])
                begins = ends - length[a:b][order]
                first = np.concatenate([[True], np.diff(window[order]) > 0])
                offset[a + order] = begins - np.repeat(begins[first], np.diff(np.append(np.flatnonzero(first), b - a)))
                dense = np.cumsum(first) - 1
                sequence[a + order] = shard[a] * STRIDE + dense
            kept = [x for x in batch.schema.names if x != "shard"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pieces(ids: DataFrame, capacity: int, shards: int, id_column: str = "doc_id", cut: int = CUT) -> DataFrame:
    """Cuts doc_id, ids into full windows and items of at most `cut` ids: id, start, length, ids, doc_tokens, shard (odd: full windows). Each row has a number of its own in _row."""
    whole = ids.select(id_column, "_row", "ids", (F.octet_length("ids") / 4).cast("long").alias("doc_tokens"))
    full = (F.col("doc_tokens") - F.col("doc_tokens") % capacity).alias("full")
    at = F.concat(
        F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1, F.lit(capacity).cast("long"))).otherwise(F.array().cast("array<long>")),
        F.when(F.col("full") < F.col("doc_tokens"), F.sequence(F.col("full"), F.col("doc_tokens") - 1, F.lit(cut).cast("long"))).otherwise(F.array().cast("array<long>")),
    )
    cuts = whole.select("*", full).select("*", F.explode(at).alias("start"))
    is_full = F.col("start") < F.col("full")
    length = F.when(is_full, F.lit(capacity)).otherwise(F.least(F.lit(cut), F.col("doc_tokens") - F.col("start"))).cast("long")
    dealt = F.when(is_full, 2 * F.pmod(F.xxhash64("_row", "start"), F.lit(shards)) + 1).otherwise(2 * F.pmod(F.xxhash64("_row"), F.lit(shards)))
    bits = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return cuts.select("*", length.alias("length")).select(id_column, "start", "length", bits.alias("ids"), "doc_tokens", dealt.cast("long").alias("shard"))


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, id_column: str = "doc_id") -> DataFrame:
    """A row per piece: id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    numbered = docs.select(id_column, "text", F.monotonically_increasing_id().alias("_row"))
    cut = pieces(token_ids(numbered, path, end_id), capacity, shards, id_column)
    out = T.StructType([*(f for f in cut.schema.fields if f.name != "shard"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return cut.repartition("shard").sortWithinPartitions("shard", id_column, "start").mapInArrow(_pack(capacity), out)
