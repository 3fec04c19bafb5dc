"""Whether two reports tell of the same event: features once per row, blocked pairs, one cascade of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import anchors
from ..functions.people import mentioned_in, people_in
from ..functions.text import folded, folded_plain, normalized, once
from ..functions.times import seconds
from ..functions.urls import relation_url, status_id
from .lineage import settled

FEATURES = ("url", "status", "thread", "item", "at", "title", "actions", "asserted", "people", "candidates", "mentioned", "models", "organizations", "qualifiers")


def documents(rows: DataFrame) -> DataFrame:
    """id and the features of each row: what its title and whole evidence name, and what its title asserts."""

    def named(text, plain, low):
        found = {"people": people_in(text, low), "mentioned": mentioned_in(low), "actions": anchors.actions_in(low), "models": anchors.models_in(plain, low), "organizations": anchors.organizations_in(low), "qualifiers": anchors.qualifiers_in(low)}
        return F.struct(*[c.alias(f) for f, c in found.items()])

    # Whole texts are normalized and folded once, for all that is looked for in them. No column is named inside: there, title would be the folded one.
    told = once(F.concat_ws("\n", "title", "evidence"), lambda text: once(normalized(text), lambda plain: once(folded_plain(plain), lambda low: named(text, plain, low))))
    made = rows.select(
        "id", relation_url(F.col("url")).alias("url"), status_id(F.col("url")).alias("status"), F.coalesce("thread_id", F.lit("")).alias("thread"), F.coalesce("item_id", F.lit("")).alias("item"), seconds(F.col("published_at")).alias("at"),
        folded(F.col("title")).alias("title"), anchors.asserted_actions(F.col("title")).alias("asserted"), told.alias("_t"),
    )
    names = ("actions", "mentioned", "models", "organizations", "qualifiers")
    return settled(made).select("*", *[F.col(f"_t.{f}").alias(f) for f in names], *[F.col(f"_t.people.{f}").alias(f) for f in ("people", "candidates")]).drop("_t")


def relationship(a: dict[str, Column], b: dict[str, Column], window_hours: float = 48.0) -> Column:
    """same_event, review or distinct, by the first rule that holds. A person is shared too if one names it and the other's text mentions it."""

    def shares(f):
        both = F.arrays_overlap(a[f], b[f])
        return both | F.arrays_overlap(a[f], b["mentioned"]) | F.arrays_overlap(b[f], a["mentioned"]) if f in ("people", "candidates") else both

    apart = lambda f: (F.size(a[f]) > 0) & (F.size(b[f]) > 0) & ~shares(f)
    strong = shares("people") | shares("models")
    return (
        F.when((a["url"] != "") & (a["url"] == b["url"]), "same_event")
        .when((a["status"] != "") & (a["status"] == b["status"]), "same_event")
        .when(F.abs(a["at"] - b["at"]) > window_hours * 3600, "distinct")
        .when(apart("actions") | apart("people") | apart("candidates") | apart("models"), "distinct")
        .when(anchors.conflicting(a["qualifiers"], b["qualifiers"]), "distinct")
        .when(apart("organizations"), "distinct")
        .when((a["thread"] != "") & (a["thread"] == b["thread"]) & (a["item"] != b["item"]) & strong & ((F.size(a["asserted"]) > 0) | (F.size(b["asserted"]) > 0)), "review")
        .when(strong & shares("asserted"), "same_event")
        .when((a["title"] != "") & (a["title"] == b["title"]) & ~shares("candidates") & shares("asserted"), "same_event")
        .when(shares("actions") & (shares("organizations") | shares("candidates")), "review")
        .otherwise("distinct")
    )


def _near_pairs(docs: DataFrame, window_hours: float) -> DataFrame:
    """id < other of the pairs within the window that any rule but those of equal urls and status ids may relate.

    A rule that gives anything but distinct needs an equal url or status id, or, within the window, a shared action along
    with a shared person, model, candidate or organization, a shared asserted action along with a shared person or model or
    an equal title, or an equal thread with a shared person or model. Those are the keys of the equi join; a person whom one names and the other
    mentions counts as its own; the window goes in as a bucket of time and its neighbours.
    """
    bucket = F.floor(F.col("at") / (window_hours * 3600))
    strong = F.array_distinct(F.concat("people", "candidates", "mentioned", "models"))
    subjects = F.array_distinct(F.concat(strong, F.col("organizations")))
    acts = F.flatten(F.transform("actions", lambda x: F.transform(subjects, lambda s: F.concat(F.lit("a:"), x, F.lit("|"), s))))
    none = F.array().cast("array<string>")
    titled = F.when(F.col("title") != "", F.transform("asserted", lambda x: F.concat(F.lit("h:"), x, F.lit("|"), F.col("title")))).otherwise(none)
    threaded = F.when(F.col("thread") != "", F.transform(strong, lambda s: F.concat(F.lit("t:"), F.col("thread"), F.lit("|"), s))).otherwise(none)
    said = F.flatten(F.transform("asserted", lambda x: F.transform(F.array_distinct(F.concat("people", "mentioned", "models")), lambda s: F.concat(F.lit("s:"), x, F.lit("|"), s))))
    timed = F.concat(acts, said, titled, threaded)
    home = docs.select("id", F.explode(timed).alias("key"), bucket.alias("bucket"))
    near = home.select(F.col("id").alias("other"), "key", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    return home.join(near, ["key", "bucket"]).where("id < other").select("id", "other").distinct()


def _related(docs: DataFrame, pairs: DataFrame, window_hours: float) -> DataFrame:
    """a, b, relation and linked (by an equal url or status id) of the pairs (id, other) that are not distinct."""
    side = lambda name: docs.select(F.col("id").alias(name), F.struct(*FEATURES).alias(f"_{name}"))
    both = pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).join(side("a"), "a").join(side("b"), "b")
    of = lambda name: {f: F.col(f"_{name}.{f}") for f in FEATURES}
    equal = lambda f: (F.col(f"_a.{f}") != "") & (F.col(f"_a.{f}") == F.col(f"_b.{f}"))
    return both.select("a", "b", relationship(of("a"), of("b"), window_hours).alias("relation"), (equal("url") | equal("status")).alias("linked")).where("relation != 'distinct'")


def related_pairs(docs: DataFrame, window_hours: float = 48.0) -> DataFrame:
    """a < b and relation of all pairs of `documents` that are not distinct: those of `_near_pairs`, and all with an equal url or status id."""
    fixed = F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), c)) for c in ("url", "status")]))
    same = docs.select("id", F.explode(fixed).alias("key"))
    linked = same.join(same.withColumnRenamed("id", "other"), "key").where("id < other").select("id", "other")
    return _related(docs, _near_pairs(docs, window_hours).unionByName(linked).distinct(), window_hours).drop("linked")


def related_counts(docs: DataFrame, window_hours: float = 48.0) -> DataFrame:
    """A row per document: id, same_events and reviews, the numbers of its pairs of either kind.

    Documents with one url or status id tell of one event whatever else they say, and at any distance in time: they are
    counted by url, by status id and, as those counts hold them twice, by both, and are not paired.
    """
    pairs = _related(docs, _near_pairs(docs, window_hours), window_hours).where(~F.col("linked"))
    both = pairs.select(F.col("a").alias("id"), "relation").unionByName(pairs.select(F.col("b").alias("id"), "relation"))
    counts = both.groupBy("id").agg(F.count_if(F.col("relation") == "same_event").alias("same_events"), F.count_if(F.col("relation") == "review").alias("reviews"))
    named = docs.select("id", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("url", "status")])
    # What has no url or no status id meets nothing; by its id, so that not all of it goes to one task.
    alone = F.concat(F.lit(" "), F.col("id").cast("string"))
    told = named.join(counts, "id", "left").select("*", *[F.coalesce(c, alone).alias(f"_{c}") for c in ("url", "status")])
    for name, keys in (("_urls", ["url"]), ("_statuses", ["status"]), ("_both", ["url", "status"])):
        groups = named.dropna(subset=keys).groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg((F.count("*") - 1).alias(name))
        told = told.join(groups, [f"_{c}" for c in keys], "left")
    known = lambda c: F.coalesce(c, F.lit(0))
    same = known("same_events") + known("_urls") + known("_statuses") - known("_both")
    return told.select("id", same.cast("long").alias("same_events"), known("reviews").cast("long").alias("reviews"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All candidates of several sources; columns that a source lacks are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
