"""Operator 11, phrase collocations from count tries.

Each task cuts its texts into shards and makes of each shard and language a trie of word sequences, MOST words deep,
with counts. A trie is written as its sorted paths: how many words a path shares with the one before, its further
words, and its count. Sorted tries are cut at splitters into prefix ranges, and each range into chunks. A range's chunks
come to one task in the order of their first path, where they are merged k ways: all paths below the first path of the
next chunk are final. What is held at a time is one chunk of each shard and MERGE paths. The splitters are quantiles of
a bounded sample of paths; they decide only who merges what.

Of the merged trie the nodes with `least` occurrences go on, each with its language, phrase and count, and the nodes on
the edge of what was merged at once, whose parts are summed then. The root of a language's trie counts all its words.
Left parts of a phrase are found by walking to the parent, right parts by suffix links; both are joins of a level of the
trie with the one above, which has what its own walks and links found.

Defined cases: a null text is empty; a null language is `und`; pieces without a word give nothing; equal rows count each;
an empty table gives no row. A text may be of any length, but one piece without any separator is held as a whole. Counts
pass 64 bits in no result, products are decimals of 38 digits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, remove, text_slices, written

#: Words of the longest phrase.
MOST = 4
#: Bytes of text in one shard.
SHARD = 8 << 20
#: Paths of a chunk, and paths that are merged at once.
CHUNK = 4096
MERGE = 400_000
#: Bytes of text that one range should hold, and the greatest number of ranges.
RANGE = 16 << 20
MOST_RANGES = 4096
#: Bytes of text (in expectation) and paths from which the splitters are drawn, and bytes of one of them.
SAMPLE = 8 << 20
SAMPLE_PATHS = 20_000
SPLITTER = 64
#: Parts that a language's best phrases are first chosen in.
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 part of a word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


class Trie:
    """Sorted distinct paths. names: words, each with a blank behind it, in byte order; paths: numbers of words from 1 on, 0 where a path is shorter; counts.

    With the blank, byte order of joined words is the order of the numbers, word by word.
    """

    def __init__(self, names: pa.Array, paths: np.ndarray, counts: np.ndarray):
        self.names, self.paths, self.counts = names, paths, counts

    def key(self, i: int) -> bytes:
        return b"".join(self.names[int(w) - 1].as_py() for w in self.paths[i] if w)

    def below(self, key: bytes) -> int:
        """How many paths come before the key."""
        return bisect_left(range(len(self.paths)), key, key=self.key)


def _ranked(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The names in byte order, and the number (from 1) of each."""
    order = pc.array_sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return names.take(pa.array(order)), rank


def _counted(paths: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorts paths and adds up the counts of equal ones (1 each where counts is None)."""
    pair = lambda a, b: (paths[:, a] << 32) | paths[:, b]
    order = np.lexsort((pair(2, 3), pair(0, 1)))
    paths = paths[order]
    new = np.ones(len(paths), bool)
    new[1:] = (paths[1:] != paths[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    sums = np.diff(np.append(starts, len(paths))) if counts is None else np.add.reduceat(counts[order], starts)
    return paths[starts], sums.astype(np.int64)


def shard_trie(data: bytes) -> Trie | None:
    """The trie of a run of text."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    kind = _KIND[raw]
    word = kind == 0
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return None
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    all_words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])]).cast(pa.binary())
    coded = all_words.dictionary_encode()
    names, rank = _ranked(pc.binary_join_element_wise(coded.dictionary, b"", b" "))
    codes = rank[coded.indices.to_numpy()]
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts]
    paths = np.zeros((len(codes), MOST), np.int64)
    paths[:, 0] = codes
    for d in range(1, min(MOST, len(codes))):
        paths[:-d, d] = np.where(piece[d:] == piece[:-d], codes[d:], 0)
    return Trie(names, *_counted(paths, None))


def _runs(data: bytes):
    """Cuts a long text at ends of pieces, into runs of about SHARD bytes."""
    at = 0
    while len(data) - at > SHARD:
        ends = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, SHARD, at)] == 2)
        if len(ends):
            stop = at + int(ends[-1]) + 1
        else:
            rest = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, -1, at)] == 2)
            stop = at + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[at:stop]
        at = stop
    if at < len(data):
        yield data[at:]


def shards(batches):
    """(language, trie) of each shard and language of the batches (text, lang)."""
    for batch in batches:
        texts, langs = batch.column("text").cast(pa.large_binary()), batch.column("lang").to_pylist()
        for start, stop in text_slices(texts, SHARD):
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[start:stop], texts.slice(start, stop - start).to_pylist(), strict=True):
                if text:
                    of.setdefault(lang, []).append(text)
            for lang, many in of.items():
                for run in _runs(b"\n".join(many)):
                    trie = shard_trie(run)
                    if trie is not None:
                        yield lang, trie


def packed(trie: Trie, start: int, stop: int) -> bytes:
    """Paths start to stop of a trie in their order: words shared with the path before, further words, counts, and the words themselves."""
    paths = trie.paths[start:stop]
    used, local = np.unique(paths, return_inverse=True)
    local = local.reshape(paths.shape)
    if used[0] == 0:
        used = used[1:]
    else:
        local = local + 1
    depth = (paths > 0).sum(axis=1)
    shared = np.zeros(len(paths), np.int64)
    shared[1:] = np.minimum(np.cumprod(paths[1:] == paths[:-1], axis=1).sum(axis=1), depth[1:])
    place = np.arange(MOST)
    further = local[(place >= shared[:, None]) & (place < depth[:, None])]
    names = trie.names.take(pa.array(used - 1))
    sizes = pc.binary_length(names).to_numpy()
    head = np.array([len(paths), len(further), len(names)], np.uint32)
    parts = [head, shared.astype(np.uint8), depth.astype(np.uint8), further.astype(np.uint16), trie.counts[start:stop].astype(np.uint64), sizes.astype(np.uint32)]
    return zstandard.ZstdCompressor(1).compress(b"".join(p.tobytes() for p in parts) + b"".join(names.to_pylist()))


def unpacked(blob: bytes) -> Trie:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, more, vocabulary = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    at = 12

    def read(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    shared, depth, further, counts, sizes = read(np.uint8, n), read(np.uint8, n), read(np.uint16, more), read(np.uint64, n), read(np.uint32, vocabulary)
    names = pa.Array.from_buffers(pa.binary(), vocabulary, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(data[at:])])
    place = np.arange(MOST)
    fresh = (place >= shared[:, None]) & (place < depth[:, None])
    paths = np.zeros((n, MOST), np.int64)
    paths[fresh] = further
    # A shared word is that of the last path that spelt it out at this depth.
    for d in range(MOST):
        source = np.maximum.accumulate(np.where(place[d] >= shared, np.arange(n), 0))
        paths[:, d] = np.where(place[d] < depth, paths[source, d], 0)
    return Trie(names, paths, counts.astype(np.int64))


def merged(tries: list[Trie]) -> Trie:
    names = pa.concat_arrays([t.names for t in tries]).dictionary_encode()
    distinct, rank = _ranked(names.dictionary)
    codes = rank[names.indices.to_numpy()]
    paths, at = [], 0
    for t in tries:
        paths.append(np.concatenate([[0], codes[at : at + len(t.names)]])[t.paths])
        at += len(t.names)
    return Trie(distinct, *_counted(np.concatenate(paths), np.concatenate([t.counts for t in tries])))


def nodes(trie: Trie, stop: int, least: int) -> tuple[list[str], list[int], list[int]]:
    """(phrases, their numbers of words, counts) of the first `stop` paths' nodes with `least` occurrences or on the edge, the root among them."""
    paths, counts = trie.paths[:stop], trie.counts[:stop]
    phrases, depths, found = [""], [0], [int(counts.sum())]
    new = np.zeros(stop, bool)
    new[0] = True
    for d in range(MOST):
        new[1:] |= paths[1:, d] != paths[:-1, d]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(counts, starts)
        keep = (sums >= least) | (starts == 0) | (np.append(starts[1:], stop) == stop)
        keep &= paths[starts, d] > 0
        for words, n in zip(paths[starts[keep], : d + 1], sums[keep].tolist(), strict=True):
            phrases.append(b"".join(x.as_py() for x in trie.names.take(pa.array(words - 1)))[:-1].decode("utf-8", "replace"))
            depths.append(d + 1)
            found.append(n)
    return phrases, depths, found


def merge_ranges(batches, least: int):
    """Merges chunks (range, lang, first, blob) that are sorted by the first three: batches of (lang, phrase, words, f)."""
    held, pool, size, limit = None, [], 0, MERGE

    def batch(lang, trie, stop):
        phrases, depths, found = nodes(trie, stop, least)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(depths, pa.int32()), pa.array(found, pa.int64())], names=["lang", "phrase", "words", "f"])

    for b in batches:
        for place, lang, first, blob in zip(*(b.column(c).to_pylist() for c in ("range", "lang", "first", "blob")), strict=True):
            if held is not None and held != (place, lang):
                whole = merged(pool)
                yield batch(held[1], whole, len(whole.paths))
                pool, size, limit = [], 0, MERGE
            elif size >= limit:
                whole = merged(pool)
                stop = whole.below(first)
                if stop:
                    yield batch(lang, whole, stop)
                rest = Trie(whole.names, whole.paths[stop:], whole.counts[stop:])
                pool = [rest] if len(rest.paths) else []
                size = len(rest.paths)
                limit = max(MERGE, 2 * size)
            held = place, lang
            pool.append(unpacked(blob))
            size += len(pool[-1].paths)
    if pool:
        whole = merged(pool)
        yield batch(held[1], whole, len(whole.paths))


def _splitters(rows: DataFrame, parts: int) -> tuple[list[tuple[str, bytes]], int]:
    """Up to `parts` ranges, or more for many texts: their lower bounds (language, key) but for the first, and their number."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(parts, -(-size // RANGE)))
    share = min(1.0, SAMPLE / max(1, size))
    step = max(1, int(size * share / 4 / SAMPLE_PATHS))

    def keys(batches):
        rng = np.random.default_rng(11)
        for lang, trie in shards(batches):
            ends = np.cumsum(trie.counts)
            at = np.searchsorted(ends, np.arange(rng.integers(step), int(ends[-1]), step), side="right")
            found = [trie.key(int(i))[:SPLITTER] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary())], names=["lang", "key"])

    sample = rows.where(F.rand(11) < share).mapInArrow(keys, "lang string, key binary").toArrow()
    found = sorted(zip((x.encode() for x in sample["lang"].to_pylist()), sample["key"].to_pylist(), strict=True))
    bounds = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    return bounds, len(bounds) + 1


def counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words, f of all phrases of up to MOST words that occur `least` times, and of each language's root (0 words), whose f is its number of words."""
    spark = docs.sparkSession
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).where(F.length("text") > 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, ranges = _splitters(rows, parts)
    shared = spark.sparkContext.broadcast(bounds)

    def chunks(batches):
        bounds = shared.value
        for lang, trie in shards(batches):
            name = lang.encode()
            low, high = bisect_left(bounds, (name, b"")), bisect_right(bounds, (name + b"\x00",))
            cuts = [0, *[trie.below(key) for _, key in bounds[low:high]], len(trie.paths)]
            places, firsts, blobs = [], [], []
            for i, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for at in range(start, stop, CHUNK):
                    places.append(low + i)
                    firsts.append(trie.key(at))
                    blobs.append(packed(trie, at, min(at + CHUNK, stop)))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([lang] * len(places), pa.string()), pa.array(firsts, pa.binary()), pa.array(blobs, pa.binary())], names=["range", "lang", "first", "blob"])

    cut = rows.mapInArrow(chunks, "range int, lang string, first binary, blob binary")
    dealt = cut.repartitionById(ranges, "range").sortWithinPartitions("range", "lang", "first")
    merged_nodes = dealt.mapInArrow(lambda batches: merge_ranges(batches, least), "lang string, phrase string, words int, f long")
    summed = merged_nodes.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return summed.where((F.col("f") >= least) | (F.col("words") == 0))


def mine(docs: DataFrame, least: int = 30, most_ranks: int = 2000, covered: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    spark = docs.sparkSession
    folder = new_path(spark, "phrases")
    table, path = written(counts(docs, least), "phrase-counts")
    none = F.array().cast("array<bigint>")
    level = table.where("words = 1").select("lang", "phrase", F.col("f").alias("a"), none.alias("lefts"), none.alias("rights"))
    paths, levels = [path], []
    for words in range(2, MOST + 1):
        known = level.select("lang", F.col("phrase").alias("part"), F.struct("a", "lefts", "rights").alias("up"))
        here = table.where(F.col("words") == words).select("lang", "phrase", F.col("f").alias("a"), F.substring_index("phrase", " ", words - 1).alias("parent"), F.substring_index("phrase", " ", 1 - words).alias("suffix"))
        walked = here.join(known.select("lang", F.col("part").alias("parent"), F.col("up").alias("left")), ["lang", "parent"])
        linked = walked.join(known.select("lang", F.col("part").alias("suffix"), F.col("up").alias("right")), ["lang", "suffix"])
        level = linked.select("lang", "phrase", "a", "parent", "suffix", F.concat("left.lefts", F.array("left.a")).alias("lefts"), F.concat(F.array("right.a"), "right.rights").alias("rights"))
        level.write.parquet(f"{folder}/words={words}")
        level = spark.read.schema(level.schema).parquet(f"{folder}/words={words}")
        levels.append(level)
    found = None
    for here, longer in zip(levels, [*levels[1:], None], strict=True):
        # A phrase within one of several more words is within one of a single more, which occurs at least as often.
        if longer is None:
            over = here.select("lang", "phrase", "a", "lefts", "rights")
        else:
            within = longer.select("lang", "a", F.explode(F.array("parent", "suffix")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
            over = here.join(within, ["lang", "phrase"], "left").where(F.coalesce(F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered, F.lit(True))).select("lang", "phrase", "a", "lefts", "rights")
        found = over if found is None else found.unionByName(over)
    cut = "transform(sequence(1, size(lefts)), k -> struct((2000000BD * cast(a as decimal(20,0))) div (cast(lefts[k - 1] as decimal(20,0)) + cast(rights[k - 1] as decimal(20,0))) as score, k, lefts[k - 1] as l, rights[k - 1] as r))"
    scored = found.withColumn("cut", F.array_min(F.expr(cut))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most_ranks)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most_ranks)
    totals = table.where("words = 0").select("lang", F.col("f").alias("n"))
    result, _ = written(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    for p in (*paths, folder):
        remove(spark, p)
    return result
