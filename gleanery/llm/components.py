"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each task first turns the edges that it has, at most CHUNK at a time, into a forest of stars, which leaves the
components as they are and most of the rounds out. A round is two aggregations that combine on the map side and two
sort-merge joins on node ids; where the hub of a large group makes a partition large, adaptive execution splits it, as
the other side of the join has one row per node. The driver sees only a count and a checksum. Each round is written to
the shared folder, which ends its lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merge_forest, release, remove, written

#: Edges that a task holds at once.
CHUNK = 1 << 20


def _forests(batches):
    """Stars with the components of the edges: u, v with v the least node that u reaches among the edges at hand."""
    held: list[pa.RecordBatch] = []

    def stars():
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = merge_forest(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[parent[child]])], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield stars()
            held.clear()
    if held:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: long a, b. Returns node, root for each node of an edge; root is the least node that it reaches."""
    spark = edges.sparkSession
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, path = written(pairs.mapInArrow(_forests, "u long, v long"), "edges")
    before = None
    while True:
        checksum = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if checksum == before or not checksum[0]:
            break
        before = checksum
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        old = path
        stars, path = written(small, "edges")
        remove(spark, old)
        del both, least, large, lower, small
        release(spark)
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
