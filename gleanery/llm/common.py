"""Helpers that several operators share: the shared folder, written tables, text slices."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a Python worker holds expanded, in bytes; a longer single text is taken alone.
SLICE_BYTES = 2 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in a local session (tests), a new temporary one, remembered in the session. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gleanery.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("gleanery.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gleanery/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and rereads it: the lineage ends there, and any executor may be lost later."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written` made, through Hadoop's file system, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Frees what no frame holds any more. Spark's context cleaner drops the shuffles and broadcasts of old plans only when the driver collects its garbage, which a large heap may put off for the whole of an iterative job."""
    gc.collect()
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """Yields (start, stop) row ranges of a string column, each of at most `most` bytes or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, rows = 0, len(column)
    while at < rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, stop
        at = stop


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenates flat[starts[i]:starts[i] + lengths[i]] for all i."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return flat[index]


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without `drop` and any column named as one of `more`, then `more`."""
    names = [n for n in batch.schema.names if n not in drop and n not in more]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more.values()], names=[*names, *more])


def schema_with(df: DataFrame, drop: tuple[str, ...], more: str):
    """The schema that `with_columns` gives: `more` is a DDL string."""
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(more)
    return T.StructType([f for f in df.schema.fields if f.name not in drop and f.name not in added.names] + added.fields)


#: Stands for a null id inside an operator; it comes before any other.
LEAST_ID = -(1 << 63)
#: A key that holds over one in this many rows is hot; at most so many are, which bounds their broadcast.
HOT_SHARE = 1000


def number_or_least(column):
    return F.coalesce(column.cast("long"), F.lit(LEAST_ID))


def join_with_hot(rows: DataFrame, table: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """rows with the row of `table` for their key; table has one row per key, and in `count` its number of rows.

    Hot keys, at most HOT_SHARE of them, are looked up in a broadcast of just those; all others are joined by shuffle,
    where no key then holds more than one row in HOT_SHARE.
    """
    hot = F.col(count) > max(1, total // HOT_SHARE)
    more = [c for c in table.columns if c not in key]
    marked = rows.join(F.broadcast(table.where(hot).withColumnsRenamed({c: f"_hot_{c}" for c in more})), key, "left")
    easy = marked.where(F.col(f"_hot_{count}").isNotNull()).select(*rows.columns, *(F.col(f"_hot_{c}").alias(c) for c in more))
    rest = marked.where(F.col(f"_hot_{count}").isNull()).select(*rows.columns).join(table.where(~hot), key).select(*rows.columns, *more)
    return easy.unionByName(rest)


def whole_groups(batches, keys: list[str]):
    """For batches of a partition sorted by `keys` (integers): yields (batch, starts), where each batch holds whole groups and starts has the first row of each."""
    held: list[pa.RecordBatch] = []

    def cuts(batch):
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= x[1:] != x[:-1]
        changed[0] = True
        return np.flatnonzero(changed)

    def joined(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = cuts(batch)
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            done = joined(held)
            yield done, cuts(done)
            held = []
        last = int(starts[-1])
        if last:
            done = joined([*held, batch.slice(0, last)])
            yield done, cuts(done)
            held = []
        held.append(batch.slice(last))
    if held:
        done = joined(held)
        yield done, cuts(done)


def merge_forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a[i], b[i]) into the forest `parent`, in which each node points to the least of its tree."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
