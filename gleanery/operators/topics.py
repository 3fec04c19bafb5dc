"""Topics: rows that name one entity under alike titles, led by the best of them, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.anchors import entities
from ..functions.text import clean_title
from .dedup import METRICS, similar_titles, title_classes
from .lineage import settled
from .repeats import stayers

ALIKE = 0.4


def topic_clusters(rows: DataFrame, scope: str, order: Column, names: tuple[str, ...], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """The leaders of rows, with what they took in: all columns of rows, and absorbed, the number of rows that joined them.

    rows: scope, id (of one row only), title, source and metrics. `order` compares as the order does (the least comes
    first) and differs between any two rows. In that order a row joins the first leader that it shares an entity of its
    title with and whose title is alike, else it leads. A leader's metrics become the greatest, its source names those
    of all that joined, and its cross_source_count grows by one for each, in order.

    Rows of one title are one class: if its first row leads, the others join it, else all join whom that row joins; so
    copies are never paired. Classes meet in the title join and settle in the rounds of `stayers`.
    """
    held = settled(rows.withColumn("_at", order).withColumn("_named", entities(F.col("title"), names)))
    named = held.where(F.size("_named") > 0).select(F.col(scope).cast("string").alias("_s"), "_at", "title", "_named", "id")
    classes = title_classes(named, F.col("title"), "id", scope="_s")
    firsts = named.groupBy("_s", clean_title(F.col("title")).alias("clean")).agg(F.min("_at").alias("first"), F.first("_named").alias("named"))
    known = settled(classes.select("class", F.col("parts.clean").alias("clean"), F.expr("substring(mark, 1, length(mark) - 1)").alias("_s")).join(firsts, ["_s", "clean"]))
    of = lambda side: known.select(F.col("class").alias(side), "_s", F.struct("_s", "first").alias(f"_{side}"), F.col("named").alias(f"n{side}"))
    pairs = similar_titles(classes, ALIKE).select("a", "b").join(of("a"), "a").join(of("b").drop("_s"), "b").where(F.arrays_overlap("na", "nb"))
    told = stayers(pairs.select(F.least("_a", "_b").alias("better"), F.greatest("_a", "_b").alias("worse")))
    led = known.join(told.select(F.col("id._s").alias("_s"), F.col("id.first").alias("first"), F.col("because_of.first").alias("because")), ["_s", "first"], "left")
    led = led.select("_s", "clean", F.coalesce("because", "first").alias("_leader"))
    whole = held.withColumn("_s", F.col(scope).cast("string")).withColumn("clean", F.when(F.size("_named") > 0, clean_title(F.col("title"))))
    whole = settled(whole.join(led, ["_s", "clean"], "left").withColumn("_leader", F.coalesce("_leader", "_at")).drop("clean", "_named"))
    joined = whole.where("_leader != _at").groupBy("_s", F.col("_leader").alias("_at")).agg(
        F.array_sort(F.collect_list(F.struct("_at", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("cross_source_count", F.lit(0)).alias("cross")))).alias("_came"),
        *[F.max(m).alias(f"_max_{m}") for m in metrics if m != "cross_source_count"],
    )
    out = whole.where("_leader = _at").join(joined, ["_s", "_at"], "left")
    came = F.coalesce("_came", F.array().cast(joined.schema["_came"].dataType))
    crossed = F.aggregate(came, F.coalesce(F.col("cross_source_count").cast("long"), F.lit(0).cast("long")), lambda n, x: F.greatest(n, x["cross"].cast("long")) + 1)
    changed = {m: F.greatest(F.col(m), F.coalesce(f"_max_{m}", F.col(m))).alias(m) for m in metrics if m != "cross_source_count"}
    changed |= {"source": F.array_join(F.concat(F.array(F.coalesce("source", F.lit(""))), F.transform(came, lambda x: x["source"])), " | ").alias("source"), "cross_source_count": crossed.alias("cross_source_count")}
    return out.select(*[changed.get(c, F.col(c)) for c in rows.columns], F.size(came).alias("absorbed"))
