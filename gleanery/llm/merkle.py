"""Operator 12, a Merkle manifest of a dataset and proofs for each row, by Pregel-style supersteps over RDDs.

Each row is a leaf, each source a tree of its leaves in the order of ids, and the trees' roots are the leaves of one more
tree in the order of sources. A node of at most FAN children is a vertex (tree, level, place). Upward, each superstep
brings the messages of finished children to their parents; a parent that has all of its children hashes them and sends
its digest on, others wait for the next superstep. Downward, the supersteps run in reverse: each vertex sends its
children the path of siblings between them and the root, and a parent of leaves folds the (tampered) leaves with it.

Rows are numbered by a sort over all tasks: from each partition one line reaches the driver, its first and last source
with their counts. No group is gathered but a source that lies within one partition, and a vertex's FAN children. Texts
are hashed where they are read and never shuffled. Each superstep ends in a checkpoint in the shared folder, so a lost
executor costs one superstep.

Defined cases: null values count as `-`; rows with null ids come first in their source and are never tampered; rows of
one id are ordered by their leaf's digest, and equal rows are leaves each; an empty table gives no row; a table of one
row has its leaf as root. Other columns of the input are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, remove, shared_dir, written

FAN = 16
#: The tree of the trees' roots; the trees of sources are numbered from 0 on.
TOP = -1
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*values: Column) -> Column:
    """H of values: `-` for a null, else its number of UTF-8 bytes, a colon, and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def kept(rdd: RDD) -> RDD:
    """rdd, computed once and checkpointed in the shared folder; its blocks on executors are dropped."""
    context = rdd.context
    if not context._jsc.sc().getCheckpointDir().isDefined():
        from pyspark.sql import SparkSession

        context.setCheckpointDir(shared_dir(SparkSession.getActiveSession()))
    rdd = rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    rdd.count()
    return rdd.unpersist()


def numbered(rows: RDD) -> tuple[RDD, int]:
    """For rows (source, doc_id, leaf, other) sorted by source over the partitions: (tree, place in it, its leaves, doc_id, leaf, other), and the number of trees."""

    def summary(part, it):
        runs = [(source, sum(1 for _ in same)) for source, same in groupby(it, key=lambda r: r[0])]
        if runs:
            yield part, len(runs), runs[0], runs[-1]

    tree, whole, begins = -1, {}, {}  # whole: leaves of each tree that reaches an end of a partition
    last = None
    for part, n, (first, count), (end, end_count) in sorted(rows.mapPartitionsWithIndex(summary).collect(), key=lambda x: x[0]):
        goes_on = last is not None and last[0] == first
        tree += 0 if goes_on else 1
        begins[part] = (tree, whole.get(tree, 0))
        whole[tree] = whole.get(tree, 0) + count
        if n > 1:
            tree += n - 1
            whole[tree] = end_count
        last = (end,)
    known = rows.context.broadcast((begins, whole))

    def number(part, it):
        begins, whole = known.value
        if part not in begins:
            return
        first, before = begins[part]
        for k, (_, same) in enumerate(groupby(it, key=lambda r: r[0])):
            n = whole.get(first + k)
            if n is None:
                same = list(same)
                n = len(same)
            for place, (_, *row) in enumerate(same, before if k == 0 else 0):
                yield first + k, place, n, *row

    return rows.mapPartitionsWithIndex(number), tree + 1


def message(tree: int, level: int, place: int, n: int, trees: int, child: tuple):
    """What a finished vertex, one of n in its level of its tree, sends: (parent, (its place among the siblings, digest, leaf's data, superstep, level)). None from the root."""
    if n == 1 and tree != TOP:
        tree, level, place, n = TOP, 0, tree, trees
    if n == 1:
        return None
    return (tree, level + 1, place // FAN), (n, [(place % FAN, *child)])


def merge(a, b):
    return a[0], a[1] + b[1]


def finished(vertex) -> bool:
    (_, _, place), (n, children) = vertex
    return len(children) == min(FAN, n - place * FAN)


def narrowed(parts: int, step: int) -> int:
    """Partitions of a superstep: each has a FANth of the vertices of the one before."""
    return max(1, parts // FAN ** (step - 1))


def build(leaves: RDD, trees: int, parts: int) -> tuple[list[RDD], tuple]:
    """The finished vertices of each superstep, and the root: (vertex, digest); leaves are (tree, place, n, doc_id, leaf, other)."""
    messages = leaves.map(lambda r: message(r[0], 0, r[1], r[2], trees, (r[4], (r[3], r[5]), 0, 0)))
    steps = []
    while True:
        step = len(steps) + 1
        pool = kept(messages.reduceByKey(merge, parts).coalesce(narrowed(parts, step)))
        steps.append(pool.filter(finished).mapValues(lambda v: (v[0], sorted(v[1]))))

        def sent(v, step=step):
            """A vertex that waits, as it is; or the message of a finished one, and None with the root."""
            if not finished(v):
                return v
            (tree, level, place), (n, children) = v
            found = joined([c[1] for c in sorted(children)])
            return message(tree, level, place, -(-n // FAN), trees, (found, None, step, level)) or (None, (v[0], found))

        messages = pool.map(sent)
        root = messages.filter(lambda m: m[0] is None).values().collect()
        if root:
            return steps, root[0]


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    for slot, run in path:
        leaf = joined([*run[:slot], leaf, *run[slot + 1 :]])
    return leaf


def row(doc_id, leaf: str, other: str | None, subroot: str, root: str, path: list[tuple[int, list[str]]]):
    siblings = [d for slot, run in path for i, d in enumerate(run) if i != slot]
    folded = fold(other or leaf, path)
    return doc_id, leaf, subroot, root, joined(siblings), folded, folded == root


def prove(steps: list[RDD], top: tuple, parts: int) -> RDD:
    """The rows of all leaves: from the last superstep to the first, each vertex gets its path and sends its children theirs."""
    vertex, root = top

    def told(v):
        (tree, level, place), ((_, children), (subroot, path)) = v
        run = [c[1] for c in children]
        for slot, found, leaf, step, below in children:
            known, longer = (found if tree == TOP and level == 1 else subroot), [(slot, run), *path]
            if leaf:
                yield None, row(leaf[0], found, leaf[1], known, root, longer)
            else:
                yield step, ((place * FAN + slot, below, 0) if tree == TOP and level == 1 else (tree, level - 1, place * FAN + slot), (known, longer))

    context = steps[0].context
    sent = [context.parallelize([(len(steps), (vertex, (None if vertex[0] == TOP else root, [])))], 1)]
    out = []
    for number in range(len(steps), 0, -1):
        incoming = context.union([s.filter(lambda m, number=number: m[0] == number).values() for s in sent])
        made = steps[number - 1].join(incoming, parts).coalesce(narrowed(parts, number)).flatMap(told)
        if number > 1:
            made = kept(made)
            sent.append(made)
        out.append(made.filter(lambda m: m[0] is None).values())
    return context.union(out)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Tampered are rows whose id's crc32 5 divides: their texts in lower case (A-Z)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").rlike("[A-Z]")
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), digest(*fields, F.col("text")).alias("leaf"), F.when(tampered, digest(*fields, ascii_lower(F.col("text")))).alias("other"))
    rows, path = written(rows, "leaves")
    # Equal rows may change places, so any number of them can be dealt by their row.
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf", "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    leaves, trees = numbered(kept(dealt.drop("_row").rdd.map(tuple)))
    remove(spark, path)
    if not trees:
        return spark.createDataFrame([], SCHEMA)
    if trees == 1 and len(alone := leaves.take(2)) == 1:
        return spark.createDataFrame([row(*alone[0][3:], alone[0][4], alone[0][4], [])], SCHEMA)
    steps, top = build(leaves, trees, parts)
    return spark.createDataFrame(prove(steps, top, parts), SCHEMA, verifySchema=False)
