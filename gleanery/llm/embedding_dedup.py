"""Operator 10, near-duplicate embeddings by randomised-rotation binary codes.

Rows with equal label and equal vector become one representative first, named by a number of its own and not by an id,
which may be null or repeated. Each representative is turned by several seeded
random rotations; the signs are its code, and with each rotation is stored the inner product of the vector and its code,
the correction factor that makes the estimated inner product of another vector unbiased. Candidates come from the codes:
`tables` disjoint groups of `bits` code bits name the buckets that a vector lies in. In a bucket, a pair is looked at
only in the first table in which the two meet; the estimate and its confidence bound decide which pairs are worth an
exact cosine in double precision, and only that cosine makes a link. Buckets that hold one representative are dropped
before any vector moves; large ones are dealt out in blocks. A bucket sends on the number of links of each
representative and a spanning forest, not pairs.

bits is log2 of the largest label plus 3, at least 12, so a bucket holds an eighth of a chance neighbour; tables follows from the probability
that the code bits of two vectors at the threshold agree, so that a pair there is missed with probability `miss`.

Defined cases: a null label, a null, empty or zero vector, and one with a null or non-finite component links with
nothing and is a component of its own; vectors of different lengths never link; equal vectors link (their cosine is
1); a null id counts as less than any other; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEAST_ID, join_with_hot, merge_forest, number_or_least, remove, whole_groups, written
from .components import connected_components

SEED = 11
#: Largest block of a bucket that is compared in one piece.
BLOCK = 512
PAIRS = 1 << 17
#: Width of the confidence bound in standard errors.
EPSILON = 4.0


@functools.lru_cache(maxsize=8)
def rotations(size: int, count: int) -> np.ndarray:
    """`count` random rotations of a space, one below the other."""
    out = []
    for i in range(count):
        q, r = np.linalg.qr(np.random.default_rng((SEED, size, i)).standard_normal((size, size)))
        out.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(out)


def plan(rows_of_label: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for labels of up to so many rows."""
    bits = max(12, math.ceil(math.log2(max(2, rows_of_label))) + 3)
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    met = agree**bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-met))) if met < 1 else 1


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For unit vectors in rows: the bucket number of each in each table."""
    turn = rotations(vectors.shape[1], -(-bits * tables // vectors.shape[1]))
    signs = (vectors @ turn[: bits * tables].T > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = flat.reshape(len(column), -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _by_size(batch: pa.RecordBatch):
    """Parts of a batch whose vectors have one length."""
    sizes = batch.column("dim").to_numpy()
    for size in np.unique(sizes):
        yield batch.filter(pa.array(sizes == size))


def _keys(bits: int, tables: int):
    def run(batches):
        for batch in batches:
            for part in _by_size(batch):
                found = codes(unit(part.column("vector")), bits, tables)
                n = part.num_rows
                take = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep").take(take), part.column("label").take(take), part.column("dim").take(take), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(found.ravel())],
                    names=["rep", "label", "dim", "tab", "code"],
                )

    return run


def _pairs(size: int, salt: np.ndarray, whole: bool):
    """Index pairs i < j in pieces; of a pair of different blocks only those across."""
    for at in range(0, size, max(1, PAIRS // max(size, 1))):
        stop = min(size, at + max(1, PAIRS // max(size, 1)))
        i = np.repeat(np.arange(at, stop), size)
        j = np.tile(np.arange(size), stop - at)
        keep = (i < j) if whole else (i < j) & (salt[i] != salt[j])
        yield i[keep], j[keep]


def _small_pairs(starts: np.ndarray, sizes: np.ndarray):
    """Index pairs of many small groups at once."""
    for size in np.unique(sizes):
        if size > 1:
            i, j = np.triu_indices(int(size), 1)
            first = starts[sizes == size]
            step = max(1, PAIRS // len(i))
            for at in range(0, len(first), step):
                yield (first[at : at + step, None] + i).ravel(), (first[at : at + step, None] + j).ravel()


def _linked(v: np.ndarray, all_codes: np.ndarray, table: np.ndarray, signs: np.ndarray, turned: np.ndarray, factor: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float):
    """The pairs that this table owns and whose exact cosine reaches the threshold."""
    same = all_codes[i] == all_codes[j]
    own = same.argmax(axis=1) == table[i]
    i, j = i[own], j[own]
    estimate = np.einsum("ij,ij->i", signs[i], turned[j]) / factor[i]
    bound = EPSILON * np.sqrt(np.maximum(0, 1 - factor[i] ** 2) / factor[i] ** 2 / max(1, v.shape[1] - 1))
    near = estimate + bound >= threshold
    i, j = i[near], j[near]
    exact = np.einsum("ij,ij->i", v[i], v[j])
    return i[exact >= threshold], j[exact >= threshold]


def _bucket_links(bits: int, tables: int, threshold: float):
    def run(batches):
        for batch, starts in whole_groups(batches, ["bucket", "block_a", "block_b"]):
            n = batch.num_rows
            ends = np.append(starts[1:], n)
            dims, owner = batch.column("dim").to_numpy(), np.repeat(np.arange(len(starts)), ends - starts)
            # Groups are of one length each, but for a rare meeting of hashes; rows keep apart by label and length below.
            reps, weights = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            table, salt, group_label = batch.column("tab").to_numpy(), batch.column("salt").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
            links, parent = np.zeros(n, np.int64), np.arange(n)
            for size in np.unique(dims):
                rows = np.flatnonzero(dims == size)
                v = unit(batch.column("vector").take(pa.array(rows)))
                turned = v @ rotations(int(size), 1).T
                signs = np.where(turned > 0, 1.0, -1.0) / math.sqrt(size)
                factor = np.einsum("ij,ij->i", signs, turned)
                mine = codes(v, bits, tables)
                own = owner[rows]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                sizes = np.diff(np.append(first, len(rows)))
                a, b = batch.column("block_a").to_numpy()[rows], batch.column("block_b").to_numpy()[rows]
                small = (sizes <= 64) & (a[first] == b[first])

                def all_pairs(first=first, sizes=sizes, small=small, a=a, b=b, rows=rows):
                    yield from _small_pairs(first[small], sizes[small])
                    for f, s in zip(first[~small].tolist(), sizes[~small].tolist(), strict=True):
                        for i, j in _pairs(s, salt[rows[f : f + s]], a[f] == b[f]):
                            yield i + f, j + f

                for i, j in all_pairs():
                    alike = (group_label[rows[i]] == group_label[rows[j]]) & (table[rows[i]] == table[rows[j]])
                    i, j = _linked(v, mine, table[rows], signs, turned, factor, i[alike], j[alike], threshold)
                    i, j = rows[i], rows[j]
                    np.add.at(links, i, weights[j])
                    np.add.at(links, j, weights[i])
                    parent = merge_forest(parent, i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(links[some]), pa.array(reps[parent[some]])], names=["rep", "links", "root"])

    return run


def near_duplicates(table: DataFrame, threshold: float = 0.98, miss: float = 1e-4, id_column: str = "vec_id") -> DataFrame:
    """A row per row of table: id, n_links, component_id, kept."""
    rows = table.select(number_or_least(F.col(id_column)).alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(sound & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", "label", F.when(valid, F.col("vector")).alias("vector"))
    grouped = rows.where(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    reps, _ = written(grouped.select(F.monotonically_increasing_id().alias("rep"), "least", "label", F.size("vector").alias("dim"), "vector", "n"), "representatives")
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(most, threshold, miss)
    key_schema = T.StructType([reps.schema["rep"], reps.schema["label"], reps.schema["dim"], T.StructField("tab", T.IntegerType()), T.StructField("code", T.LongType())])
    keys = reps.select("rep", "label", "dim", "vector").mapInArrow(_keys(bits, tables), key_schema)
    bucket = F.xxhash64("label", "dim", "tab", "code")
    keyed, keyed_path = written(keys.select("rep", "tab", bucket.alias("bucket")), "buckets")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = keyed.join(sizes, "bucket")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    salt = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = met.select("rep", "tab", "bucket", salt.alias("salt"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("rep", "tab", "bucket", "salt", F.least("salt", "other").alias("block_a"), F.greatest("salt", "other").alias("block_b"))
    carried = dealt.join(reps.drop("least"), "rep")
    where = ["bucket", "block_a", "block_b"]
    found = carried.repartition(*where).sortWithinPartitions(*where).mapInArrow(_bucket_links(bits, tables, threshold), "rep long, links long, root long")
    found, found_path = written(found, "links")
    remove(table.sparkSession, keyed_path)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "rep"})
    named = roots.join(reps.select("rep", "least"), "rep")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(counts, "rep")
    linked, _ = written(named.select("rep", "links", "component_id"), "linked")
    remove(table.sparkSession, found_path)
    answers = reps.select("rep", "least", "label", "vector", "n").join(linked, "rep", "left")
    answers = answers.select("label", "vector", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    told = join_with_hot(rows.where(F.col("vector").isNotNull()), answers, ["label", "vector"], "n", table.count()).select("id", "n_links", "component_id")
    alone = rows.where(F.col("vector").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    real = [F.nullif(F.col(c), F.lit(LEAST_ID)).alias(n) for c, n in (("id", id_column), ("component_id", "component_id"))]
    return told.unionByName(alone).select(real[0], "n_links", real[1], (F.col("id") == F.col("component_id")).alias("kept"))
