"""Operator 4, SimHash near-duplicates.

A fingerprint has a bit set if it is set in over half of the XXH64 hashes of the text's shingles. Two fingerprints of
64 bits that differ in at most k bits agree in at least 8 - k of their 8 bytes. The inverted index therefore goes by
byte position; as one position alone has only 256 values, a posting is named by three positions and the bytes there,
of the least family of position triples of which any 4 positions hold one (20 of the 56). Within a posting, the bytes that two
fingerprints share are tallied over all 8 positions; those with fewer than the guaranteed 4 go, and the rest are
verified by their differing bits. A posting of more than POSTING fingerprints leaves its task: it is dealt by a fourth
shared byte, never by a fifth, as more are not guaranteed, and what is still too large in pairs of blocks. Postings hold distinct fingerprints only, so exact copies weigh nothing. A posting
yields a spanning forest of its links, not all pairs, which leaves the components as they are: a large group of near
copies costs one row per member.

Defined cases: null and wordless texts have fingerprint zero and link like any other; fewer words than a shingle has make
one shingle; repeated shingles count each; a null id counts as less than any other; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_ID, SLICE_BYTES, join_with_hot, merge_forest, number_or_least, remove, whole_groups, written
from .components import connected_components

SEED = 42
BITS = 4
#: Above so many fingerprints, a posting is dealt anew by a fourth shared byte, and a part of it in pairs of blocks.
POSTING = 20_000
BLOCK = 1 << 20


def position_triples() -> list[tuple[int, int, int]]:
    """A family of triples of the positions 0..7 such that any 4 positions hold one of them: within a class of three, or two of one class and one of the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    kind = {p: i for i, c in enumerate(classes) for p in c}
    found = []
    for t in itertools.combinations(range(8), 3):
        counts = [sum(kind[p] == i for p in t) for i in range(3)]
        if 3 in counts or any(counts[i] == 2 and counts[(i + 1) % 3] == 1 for i in range(3)):
            found.append(t)
    return found


#: _LANES[b]: the bits of byte b, each in a byte of its own.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str | None, width: int) -> bytes:
    words = (text or "").encode().lower().split()
    if not words:
        return b""
    if len(words) < width:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])


def fingerprints_of(texts: list[str | None], width: int) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    hashes = [shingle_hashes(t, width) for t in texts]
    counts = np.array([len(h) >> 3 for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    counts = counts[some]
    flat = np.frombuffer(b"".join(hashes), ">u8").astype("<u8").view(np.uint8).reshape(-1, 8)
    # The lanes of a block hold up to 255 each, so blocks of 255 hashes are summed without a carry.
    blocks = (counts + 254) // 255
    first = np.cumsum(blocks) - blocks
    inside = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    starts = np.repeat(np.cumsum(counts) - counts, blocks) + 255 * inside
    sums = np.empty((len(some), 64), np.int64)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[flat[:, j]], starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        sums[:, 8 * j : 8 * j + 8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    bits = np.packbits((2 * sums > counts[:, None]).astype(np.uint8), axis=1, bitorder="little")
    out[some] = bits.view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", width: int = 4) -> DataFrame:
    """id, print (signed 64-bit) of each row of docs."""

    def run(batches):
        for batch in batches:
            texts, made, held, size = batch.column("text"), [], [], 0
            for text in texts:
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size > SLICE_BYTES:
                    made.append(fingerprints_of(held, width))
                    held, size = [], 0
            made.append(fingerprints_of(held, width))
            prints = np.concatenate(made).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints)], names=["id", "print"])

    return docs.select(number_or_least(F.col(id_column)).alias("id"), "text").mapInArrow(run, "id long, print long")


def posting_keys(column) -> list:
    """For each triple of positions: its number and the three bytes there, in one long."""
    def byte(p):
        return F.shiftrightunsigned(column, 8 * p).bitwiseAND(F.lit(255).cast("long"))

    return [F.lit(i << 24).cast("long") + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c) for i, (a, b, c) in enumerate(position_triples())]


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs share the guaranteed number of bytes and differ in at most `bits` bits."""
    differing = a ^ b
    shared = (differing.view(np.uint8).reshape(*differing.shape, 8) == 0).sum(axis=-1)
    return (shared >= 8 - bits) & (np.bitwise_count(differing) <= bits)


def posting_links(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: what a reached one links to leaves the rest that is still held against later ones."""
    rest, a, b = prints, [], []
    while len(rest) > 1:
        reached, rest = rest[:1], rest[1:]
        while len(reached) and len(rest):
            step = max(1, BLOCK // len(rest))
            found = []
            for at in range(0, len(reached), step):
                part = reached[at : at + step]
                links = _near(np.repeat(part, len(rest)).reshape(len(part), -1), np.broadcast_to(rest, (len(part), len(rest))).copy(), bits)
                hit = links.any(axis=0)
                if hit.any():
                    a.append(part[links[:, hit].argmax(axis=0)])
                    b.append(rest[hit])
                    found.append(rest[hit])
                    rest = rest[~hit]
                    if not len(rest):
                        break
            reached = np.concatenate(found) if found else prints[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def fourth_positions() -> list[list[int]]:
    """For each triple the positions that it is split by: of each 4 positions, the first triple among them has the split."""
    family = [set(t) for t in position_triples()]
    first = {four: next(i for i, t in enumerate(family) if t <= set(four)) for four in itertools.combinations(range(8), 4)}
    return [sorted(next(iter(set(four) - t)) for four, owner in first.items() if owner == i) for i, t in enumerate(family)]


def dealt(prints: np.ndarray, key: int, most: int):
    """Yields (key, block_a, block_b, fingerprints) of the parts of a large posting, each by one more shared byte, which the 4 shared ones guarantee; a part of more than `most` comes as pairs of blocks, of which any two fingerprints share one."""
    view = prints.view(np.uint8).reshape(-1, 8)
    for p in fourth_positions()[key >> 24]:
        order = np.argsort(view[:, p], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(view[order, p])) + 1):
            name = (key << 11) | (p << 8) | int(view[part[0], p])
            if len(part) <= most:
                if len(part) > 1:
                    yield name, 0, 0, prints[part]
                continue
            blocks = -(-2 * len(part) // most)
            for a, b in itertools.combinations(range(blocks), 2):
                yield name, a, b, np.concatenate([prints[part[a::blocks]], prints[part[b::blocks]]])


LINKS = "key long, block_a int, block_b int, a long, b long"


def _edges(a: list[np.ndarray], b: list[np.ndarray]):
    """One forest for all postings of a batch: no more edges than fingerprints; a null key marks an edge."""
    if not a or not sum(map(len, a)):
        return
    x, y = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    parent = merge_forest(np.arange(len(nodes)), at[: len(x)], at[len(x) :])
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    none = [pa.nulls(len(child), t) for t in (pa.int64(), pa.int32(), pa.int32())]
    yield pa.RecordBatch.from_arrays([*none, pa.array(nodes[child].view(np.int64)), pa.array(nodes[parent[child]].view(np.int64))], names=["key", "block_a", "block_b", "a", "b"])


def _partition_links(bits: int, most: int | None, group: tuple[str, ...] = ("key",)):
    """Edges of the postings of a partition; those of more than `most` fingerprints (None: of any number) are not held together but go on as rows, with the fingerprint as a, for a second deal."""
    def run(batches):
        for batch, starts in whole_groups(batches, list(group)):
            prints = batch.column("print").to_numpy().view(np.uint64)
            sizes = np.diff(np.append(starts, len(prints)))
            owner = np.repeat(np.arange(len(starts)), sizes)
            a, b = [], []
            # Small postings all at once: each row against the row `shift` further on.
            small = np.flatnonzero(sizes[owner] <= 16)
            for shift in range(1, 16):
                left, right = small[:-shift], small[shift:]
                same = owner[left] == owner[right]
                left, right = prints[left[same]], prints[right[same]]
                if not len(left):
                    break
                hit = _near(left, right, bits)
                a.append(left[hit])
                b.append(right[hit])
            for g in np.flatnonzero(sizes > 16):
                posting = prints[starts[g] : starts[g] + sizes[g]]
                if most is None or len(posting) <= most:
                    x, y = posting_links(posting, bits)
                    a.append(x)
                    b.append(y)
                    continue
                for name, one, two, part in dealt(posting, batch.column("key")[int(starts[g])].as_py(), most):
                    n = len(part)
                    named = [pa.array(np.full(n, x, t)) for x, t in ((name, np.int64), (one, np.int32), (two, np.int32))]
                    yield pa.RecordBatch.from_arrays([*named, pa.array(part.view(np.int64)), pa.nulls(n, pa.int64())], names=["key", "block_a", "block_b", "a", "b"])
            yield from _edges(a, b)

    return run


def links(prints: DataFrame, bits: int = BITS) -> tuple[DataFrame, str]:
    """Edges a, b between distinct fingerprints that have the components of all links at `bits` or fewer differing bits, and the table that they read; bits is at most 4.

    Postings of up to POSTING fingerprints are settled where they lie; larger ones are dealt anew by a fourth shared byte and in pairs of blocks.
    """
    if bits > BITS:
        raise ValueError("the position triples guarantee a shared posting up to 4 differing bits")
    postings = prints.select("print", F.explode(F.array(*posting_keys(F.col("print")))).alias("key"))
    first, path = written(postings.repartition("key").sortWithinPartitions("key").mapInArrow(_partition_links(bits, POSTING), LINKS), "posting-links")
    edges = first.where("key IS NULL").select("a", "b")
    large = first.where("key IS NOT NULL").select("key", "block_a", "block_b", F.col("a").alias("print"))
    if large.isEmpty():
        return edges, path
    where = ("key", "block_a", "block_b")
    second = large.repartition(*where).sortWithinPartitions(*where).mapInArrow(_partition_links(bits, None, where), LINKS)
    return edges.unionByName(second.select("a", "b")), path


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", width: int = 4, bits: int = BITS) -> DataFrame:
    """A row per row of docs: id, fingerprint in hex, component_id (the least id that it reaches)."""
    rows, _ = written(fingerprints(docs, id_column, width), "prints")
    distinct, distinct_path = written(rows.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-prints")
    edges, edges_path = links(distinct.select("print"), bits)
    nodes = connected_components(edges).withColumnsRenamed({"node": "print"})
    remove(docs.sparkSession, edges_path)
    least = nodes.join(distinct, "print").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = nodes.join(least, "root").select("print", "component_id")
    table, _ = written(distinct.join(linked, "print", "left").select("print", "n", F.coalesce("component_id", "least").alias("component_id")), "print-components")
    remove(docs.sparkSession, distinct_path)
    both = join_with_hot(rows, table, ["print"], "n", rows.count())
    real = [F.nullif(F.col(c), F.lit(LEAST_ID)).alias(n) for c, n in (("id", id_column), ("component_id", "component_id"))]
    return both.select(real[0], F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), real[1])
