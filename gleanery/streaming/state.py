"""Source health and feedback as keyed state.

A fetch attempt updates its source's ledger row: failures in a row (0 after a success), the last attempt and the last
success. In batch this is one aggregation with a partial fold per task; as a stream each micro-batch folds its own
attempts and merges them with the ledger table, whose versions lie next to each other in one folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GOOD = ("success", "not_modified")


def failure_streaks(attempts: DataFrame, keys: list[str], ts: str = "at", status: str = "status", position: str = "pos") -> DataFrame:
    """attempts with `failures`: how many in a row up to and with each one had failed."""
    order = Window.partitionBy(*keys).orderBy(ts, position)
    failed = ~F.col(status).isin(*GOOD)
    run = F.sum((~failed).cast("int")).over(order)
    within = Window.partitionBy(*keys, "_run").orderBy(ts, position)
    return attempts.withColumn("_run", run).withColumn("failures", F.sum(failed.cast("int")).over(within).cast("long")).drop("_run")


def ledger(attempts: DataFrame, keys: list[str], ts: str = "at", status: str = "status", position: str = "pos") -> DataFrame:
    """One row per source: last attempt, its status, last success, failures in a row since.

    The failures are those after the last success, so two aggregations do without ordering a source's attempts.
    """
    order = F.struct(ts, position)
    good = F.col(status).isin(*GOOD)
    state = attempts.groupBy(*keys).agg(F.max(ts).alias("last_attempt"), F.max_by(status, order).alias("status"), F.max(F.when(good, F.col(ts))).alias("last_success"), F.max(F.when(good, order)).alias("_last"), F.count("*").alias("attempts"))
    since = attempts.join(state.select(*keys, "_last"), keys).where(~good & (F.col("_last").isNull() | (order > F.col("_last")))).groupBy(*keys).agg(F.count("*").alias("failures"))
    return state.drop("_last").join(since, keys, "left").withColumn("failures", F.coalesce("failures", F.lit(0)).cast("long"))


def merge_ledger(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A ledger and a later one: the later state counts; without a success in it, failures add up and the last success stays."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, keys, "full_outer")
    fresh = F.col("n.last_attempt").isNotNull()
    carried = F.when(F.col("n.last_success").isNull(), F.coalesce("o.failures", F.lit(0))).otherwise(0)
    return both.select(
        *keys, F.coalesce("n.last_attempt", "o.last_attempt").alias("last_attempt"), F.coalesce("n.status", "o.status").alias("status"),
        F.coalesce("n.last_success", "o.last_success").alias("last_success"), (F.coalesce("o.attempts", F.lit(0)) + F.coalesce("n.attempts", F.lit(0))).alias("attempts"),
        F.when(fresh, F.col("n.failures") + carried).otherwise(F.col("o.failures")).cast("long").alias("failures"),
    )


def stream_ledger(attempts: DataFrame, keys: list[str], to: str, checkpoint: str) -> StreamingQuery:
    """Keeps a ledger of a stream of attempts: version n is `to`/v=n, written by micro-batch n from version n - 1.

    A batch that runs again after a failure overwrites its own version only, so each attempt counts once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = ledger(batch, keys)
        if number:
            new = merge_ledger(batch.sparkSession.read.parquet(f"{to}/v={number - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{to}/v={number}")

    return attempts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_streaks(attempts: DataFrame, keys: list[str], ts: str = "at", status: str = "status") -> DataFrame:
    """A stream of keys, at, failures: the streak after each attempt, from custom state of two numbers per key."""
    names = ", ".join(f"`{k}` {attempts.schema[k].dataType.simpleString()}" for k in keys)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for frame in frames:
            out = []
            for row in frame.sort_values(ts, kind="stable").itertuples():
                failures = 0 if getattr(row, status) in GOOD else failures + 1
                out.append((*key, getattr(row, ts), failures))
            yield pd.DataFrame(out, columns=[*keys, "at", "failures"])
        state.update((failures,))

    return attempts.groupBy(*keys).applyInPandasWithState(run, f"{names}, at timestamp, failures long", "failures long", "append", "NoTimeout")


def retained(stream: DataFrame, ts: str = "ts", late: str = "6 hours", hours: int = 36) -> DataFrame:
    """Rows per rolling window of so many hours, one step an hour, later than the watermark by no more than `late`."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, f"{hours} hours", "1 hour")).agg(F.count("*").alias("n"))


def close_in_time(left: DataFrame, right: DataFrame, keys: list[str], ts: str, hours: float) -> DataFrame:
    """Pairs of rows of equal keys at most so many hours apart: buckets of that length and their neighbours make it an equi join. Columns of right get `_other`."""
    span = hours * 3600
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    a = left.withColumn("_bucket", F.floor(at / span))
    b = right.withColumnsRenamed({c: f"{c}_other" for c in right.columns if c not in keys})
    other = F.unix_micros(F.col(f"{ts}_other").cast("timestamp")) / 1e6
    home = F.floor(other / span)
    b = b.withColumn("_bucket", F.explode(F.array(home - 1, home, home + 1)))
    return a.join(b, [*keys, "_bucket"]).where(F.abs(at - other) <= span).drop("_bucket")


def close_stream(left: DataFrame, right: DataFrame, keys: list[str], ts: str, hours: float, late: str = "6 hours") -> DataFrame:
    """The same pairs of two streams: an interval join. Either side waits for rows of the other that are up to so many hours apart, and its state goes when the watermark, `late` behind the latest row seen, has passed them.

    Rows later than the watermark may be dropped. Columns of right get `_other`, keys stand once. Null keys and times meet nothing.
    """
    a = left.withWatermark(ts, late).alias("a")
    b = right.withColumnsRenamed({c: f"{c}_other" for c in right.columns}).withWatermark(f"{ts}_other", late).alias("b")
    span = F.make_dt_interval(secs=F.lit(hours * 3600.0))
    met = F.col(f"{ts}_other").between(F.col(ts) - span, F.col(ts) + span)
    for k in keys:
        met = met & (F.col(k) == F.col(f"{k}_other"))
    return a.join(b, met).drop(*[f"{k}_other" for k in keys])


def record_feedback(spark: SparkSession, events: DataFrame, decisions: DataFrame, to: str, labels: tuple[str, ...]) -> DataFrame:
    """Appends the valid events to the log and returns the others with a reason: a label outside the domain, a note that
    is too long, or a candidate that the run decided nothing about."""
    known = decisions.select("run_id", "candidate_id", F.lit(True).alias("_known")).distinct()
    judged = events.join(known, ["run_id", "candidate_id"], "left")
    reason = F.when(~F.col("label").isin(*labels), "invalid_label").when(F.length("note") > 1000, "note_too_long").when(F.col("_known").isNull(), "unknown_candidate").otherwise("")
    told = judged.withColumn("reason", reason).drop("_known")
    told.where("reason = ''").drop("reason").write.mode("append").parquet(to)
    return told.where("reason != ''")
