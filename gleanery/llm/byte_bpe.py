"""Operator 2, byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern; a piece that is itself a token is that token. Any other piece becomes
bytes, and a segment tree over the byte positions holds, for each live position, the rank of the pair that starts
there: the root names the leftmost pair of least rank. A merge changes three leaves (the pair itself, its live
neighbour on the left, and the position that went), each a logarithmic point update. Short pieces go through many
trees at once, one per row of an array; long ones through a tree of their own. Pieces that recur are remembered, up to
CACHE_PIECES of them.

Defined cases: a null or empty text gives no ids and decodes to no bytes. Ids come as one binary, little-endian
unsigned 32-bit. Very long texts are split like others, and a single piece of n bytes costs n log n. Repeated rows
are encoded alike; other columns pass through, but for ones named as a result column, which are replaced.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import gather, schema_with, text_slices, with_columns

CACHE_PIECES = 300_000
IDS_AT_ONCE = 1 << 16
#: Longest piece, in bytes, that shares an array of trees with others.
TOGETHER = 128
NONE = np.int64(1) << 40


class ByteBpe:
    """The ranks of one vocabulary file; token ids are ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # White space is what Unicode calls so, without the four separators that Python adds.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 20) | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece by a segment tree of its own."""
        n = len(piece)
        token = self.single[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(1, (n - 1).bit_length())
        empty = (int(NONE), width)
        tree = [empty] * (2 * width)
        pairs, none = self.pairs, int(NONE)
        for i in range(n - 1):
            tree[width + i] = (pairs.get((token[i] << 20) | token[i + 1], none), i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: tuple[int, int]) -> None:
            node = width + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        while tree[1][0] < none:
            rank, at = tree[1]
            gone = after[at]
            token[at], after[at] = rank, after[gone]
            put(gone, empty)
            if after[at] < n:
                before[after[at]] = at
                put(at, (pairs.get((rank << 20) | token[after[at]], none), at))
            else:
                put(at, empty)
            if before[at] >= 0:
                left = before[at]
                put(left, (pairs.get((token[left] << 20) | rank, none), left))
        out, at = [], 0
        while at < n:
            out.append(token[at])
            at = after[at]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as little-endian bytes, of pieces of at most TOGETHER bytes: one tree in each row of an array."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        out: list[bytes] = [b""] * len(pieces)
        width = 2
        while width < 2 * TOGETHER:
            chosen = np.flatnonzero((lengths <= width) & (lengths > (width >> 1 if width > 2 else 0)))
            for part in np.array_split(chosen, max(1, len(chosen) * width // (1 << 18) + 1)):
                if len(part):
                    for i, ids in zip(part.tolist(), self._merge_rows([pieces[i] for i in part.tolist()], width), strict=True):
                        out[i] = ids
            width *= 2
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        rows = len(pieces)
        n = np.array([len(p) for p in pieces], np.int64)
        filled = np.arange(width) < n[:, None]
        token = np.zeros((rows, width + 1), np.int64)
        token[:, :width][filled] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        position = np.arange(width)
        rank = np.full((rows, width), NONE)
        starts = position < (n - 1)[:, None]
        rank[starts] = self.pair_ranks(token[:, :-1][starts], token[:, 1:][starts])
        tree = np.full((rows, 2 * width), NONE * width)  # a node: rank * width + position, so that the least is leftmost
        tree[:, width:] = rank * width + position
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        after = np.broadcast_to(position + 1, (rows, width)).copy()
        before = np.broadcast_to(position - 1, (rows, width)).copy()
        alive = filled.copy()

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[row, node] = value
            while (node := node >> 1)[0]:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < NONE * width)
        while len(row):
            root = tree[row, 1]
            at, merged = root % width, root // width
            gone = after[row, at]
            following = after[row, gone]
            token[row, at], after[row, at], alive[row, gone] = merged, following, False
            put(row, gone, NONE * width + gone)
            more = following < n[row]
            before[row[more], following[more]] = at[more]
            fresh = np.where(more, self.pair_ranks(merged, token[row, following]), NONE)
            put(row, at, fresh * width + at)
            left = before[row, at]
            some = left >= 0
            if some.any():
                r, b = row[some], left[some]
                put(r, b, self.pair_ranks(token[r, b], merged[some]) * width + b)
            row = row[tree[row, 1] < NONE * width]
        kept = token[:, :width][alive].astype("<u4")
        ends = np.cumsum(alive.sum(axis=1))
        return [kept[e - s : e].tobytes() for e, s in zip(ends.tolist(), alive.sum(axis=1).tolist(), strict=True)]

    def ids_of(self, pieces: list[str], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each of these distinct pieces, as bytes; what was seen before comes from the cache."""
        found = [cache.get(p) for p in pieces]
        missing = [i for i, x in enumerate(found) if x is None]
        short, shorter = [], []
        for i in missing:
            raw = pieces[i].encode()
            if (whole := self.ranks.get(raw)) is not None:
                found[i] = whole.to_bytes(4, "little")
            elif len(raw) <= TOGETHER:
                short.append(raw)
                shorter.append(i)
            else:
                found[i] = np.array(self.merge_one(raw), "<u4").tobytes()
        for i, ids in zip(shorter, self.merge_many(short), strict=True):
            found[i] = ids
        if len(cache) + len(missing) > CACHE_PIECES:
            cache.clear()
        for i in missing[:CACHE_PIECES]:
            if len(pieces[i]) <= 64:
                cache[pieces[i]] = found[i]
        return found


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _encoded(bpe: ByteBpe, cache: dict[str, bytes], column: pa.Array) -> list[bytes]:
    out: list[bytes] = []
    for start, stop in text_slices(column):
        out += _encode_slice(bpe, cache, column.slice(start, stop - start))
    return out


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs without text, with ids: binary, the token ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        bpe, cache = vocabulary(path, pattern), {}
        for batch in batches:
            yield with_columns(batch, ("text",), {"ids": pa.array(_encoded(bpe, cache, batch.column("text")), pa.binary())})

    return docs.mapInArrow(run, schema_with(docs, ("text",), "ids binary"))


def _encode_slice(bpe: ByteBpe, cache: dict[str, bytes], texts: pa.Array) -> list[bytes]:
    pieces: list[str] = []
    ends = [len(pieces)]
    for text in texts.to_pylist():
        if text:
            pieces += bpe.split.findall(text)
        ends.append(len(pieces))
    if not pieces:
        return [b""] * len(texts)
    coded = pa.array(pieces, pa.large_string()).dictionary_encode()
    ids = bpe.ids_of(coded.dictionary.to_pylist(), cache)
    sizes = np.array([len(x) >> 2 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    codes = coded.indices.to_numpy()
    lengths = sizes[codes]
    joined = gather(flat, (np.cumsum(sizes) - sizes)[codes], lengths)
    at = np.concatenate([[0], np.cumsum(lengths)])[np.array(ends)].tolist()
    return [joined[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def token_table(path: str) -> list[bytes | None]:
    """The bytes of each id."""
    with open(path, "rb") as lines:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [tokens.get(i) for i in range(max(tokens) + 1)]


def decoded_bytes(table: list[bytes | None], ids: bytes) -> bytes:
    """What ids stand for, IDS_AT_ONCE at a time, so that a very long text is never a list of numbers."""
    flat = np.frombuffer(ids, "<u4")
    return b"".join(b"".join(map(table.__getitem__, flat[at : at + IDS_AT_ONCE].tolist())) for at in range(0, len(flat), IDS_AT_ONCE))


def decode(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """encoded without ids, with decoded: binary, the bytes that the ids stand for. An id outside the vocabulary fails the task. No pattern is needed; callers may name the same as for `encode`."""

    def run(batches):
        table = token_table(path)
        for batch in batches:
            out = [decoded_bytes(table, x.as_py() or b"") for x in batch.column("ids")]
            yield with_columns(batch, ("ids",), {"decoded": pa.array(out, pa.binary())})

    return encoded.mapInArrow(run, schema_with(encoded, ("ids",), "decoded binary"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs without text, with ids, and decoded from the ids alone: `encode` and `decode` in one pass, as two would have two Python workers for each task."""

    def run(batches):
        bpe, cache, table = vocabulary(path, pattern), {}, token_table(path)
        for batch in batches:
            ids = _encoded(bpe, cache, batch.column("text"))
            decoded = pa.array((decoded_bytes(table, x) for x in ids), pa.binary())
            yield with_columns(batch, ("text",), {"ids": pa.array(ids, pa.binary()), "decoded": decoded})

    return docs.mapInArrow(run, schema_with(docs, ("text",), "ids binary, decoded binary"))
