"""Joins with a name: registry look-ups, semi and anti joins, latest per key, full outer records, re-association."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host_suffixes


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the order; the fold is on the map side, so a hot key costs one row per task."""
    kept = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in kept])


def keep_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    kept = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in kept])


def registry_join(rows: DataFrame, registry: DataFrame, key: str, overrides: list[str]) -> DataFrame:
    """Left join on the lower-cased key; a match replaces the columns in `overrides`. Whether the registry is broadcast is left to its size."""
    names = {c: f"_registry_{c}" for c in overrides}
    table = keep_first(registry.withColumn("_key", F.lower(key)), ["_key"], [F.col(key)]).select("_key", *[F.col(c).alias(n) for c, n in names.items()])
    joined = rows.withColumn("_key", F.lower(key)).join(table, "_key", "left")
    return joined.select(*[F.coalesce(names[c], F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


def domain_join(rows: DataFrame, registry: DataFrame, url: str) -> DataFrame:
    """rows with the registry row of the longest registered domain that is its url's host or a parent of it: an equi join on the suffixes of each distinct host, whatever ids the rows have."""
    host = F.get(host_suffixes(F.col(url)), F.lit(0))
    hosts = rows.select(host.alias("_host"), host_suffixes(F.col(url)).alias("_all")).where("_host IS NOT NULL").dropDuplicates(["_host"])
    found = hosts.select("_host", F.posexplode("_all").alias("_depth", "domain")).join(registry, "domain")
    nearest = keep_first(found, ["_host"], [F.col("_depth")]).drop("_depth")
    return rows.withColumn("_host", host).join(nearest, "_host", "left").drop("_host")


def latest(events: DataFrame, keys: list[str], ts: str, position: str, null_as_oldest: bool = False) -> DataFrame:
    """The latest event per key, of equal times the last one. Events without a time are left out, or count as the oldest."""
    known = events if null_as_oldest else events.where(F.col(ts).isNotNull())
    return keep_last(known, keys, [F.coalesce(F.col(ts).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.col(position)])


def records(candidates: DataFrame, analyses: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of the three sides of a run; within a side the last row of a key counts."""
    sides = [keep_last(d, keys, [F.col("pos")]).drop("pos") for d in (candidates, analyses, decisions)]
    return sides[0].join(sides[1], keys, "full_outer").join(sides[2], keys, "full_outer")


def without(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(excluded.select(*keys).distinct(), keys, "left_anti")


def within(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str], position: str) -> DataFrame:
    """left minus right, each row of right taking away one equal row of left, the first ones first."""
    order = Window.partitionBy(*keys).orderBy(position)
    numbered = left.withColumn("_nth", F.row_number().over(order))
    gone = right.groupBy(*keys).agg(F.count("*").alias("_gone"))
    return numbered.join(gone, keys, "left").where(F.col("_nth") > F.coalesce("_gone", F.lit(0))).drop("_nth", "_gone")


def reassociate(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """key and state of each key on either side: matched, missing (no answer), duplicate (several) or unmapped (nobody asked)."""
    a = asked.groupBy(key).agg(F.count("*").alias("_asked"))
    b = answers.groupBy(key).agg(F.count("*").alias("_answers"))
    state = F.when(F.col("_asked").isNull(), "unmapped").when(F.col("_answers").isNull(), "missing").when(F.col("_answers") > 1, "duplicate").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails the job unless each key of the left side stands once on either side."""
    a = left.groupBy(key).agg(F.count("*").alias("_left"))
    b = right.groupBy(key).agg(F.count("*").alias("_right"))
    checked = a.join(b, key, "left").select(key, F.assert_true((F.col("_left") == 1) & (F.coalesce("_right", F.lit(0)) == 1), "keys must match one to one").alias("_ok"))
    return left.join(checked.where(F.col("_ok").isNull()).select(key), key).join(right, key)
