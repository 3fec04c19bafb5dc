"""Repeats in rank order: who stays first, and what happens to the rest.

`stayers` keeps the rows of a relation that a walk in rank order would keep, at any size, in parallel rounds. The final
dedup of an edition replaces keepers while it walks, so it is a fold of one bounded pool; which rows of a pool tell of
one event is a join of keys before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprints
from .clustering import with_partners
from .dedup import expanded, near_hashes, similar_titles, title_classes
from .lineage import settled


def stayers(edges: DataFrame) -> DataFrame:
    """Of pairs (better, worse), where better comes first in the order: id, stays, because_of (the first row in the order that stays and is related), for all rows in a pair.

    In the order, a row goes if a row that stays is related to it. better and worse are structs or numbers that compare
    in the order. In each round all rows without an undecided better one stay and take their neighbours out; a row
    that is gone takes its pairs with it. The pairs shrink with each round; the number of rounds is that of the longest
    chain of rows that had to wait for each other, a few where ranks do not follow the relation.
    """
    both = F.array(F.struct(F.col("better").alias("id")), F.struct(F.col("worse").alias("id")))
    left = all_pairs = settled(edges.select("better", "worse").distinct())
    gone = None
    while not left.isEmpty():
        roots = left.select(F.col("better").alias("root")).distinct().join(left.select(F.col("worse").alias("root")).distinct(), "root", "left_anti")
        out = settled(left.join(roots, left["better"] == roots["root"], "left_semi").select(F.col("worse").alias("out")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        # Pairs of roots end with it: their worse ends are out.
        left = settled(left.join(out, left["worse"] == out["out"], "left_anti").join(out, left["better"] == out["out"], "left_anti"))
    rows = all_pairs.select(F.inline(both)).distinct()
    if gone is None:
        return rows.select("id", F.lit(True).alias("stays"), F.col("id").alias("because_of")).limit(0)
    told = rows.join(gone.select(F.col("out").alias("id"), F.lit(False).alias("_out")), "id", "left").select("id", F.coalesce("_out", F.lit(True)).alias("stays"))
    first = all_pairs.join(told.where("stays").select(F.col("id").alias("better")), "better").groupBy(F.col("worse").alias("id")).agg(F.min("better").alias("because_of"))
    return told.join(first, "id", "left").select("id", "stays", F.when(~F.col("stays"), F.col("because_of")).alias("because_of"))


def kept_pictures(rows: DataFrame, scope: str, most: int = 4) -> DataFrame:
    """A row per row: scope, id, kept, reason (empty, `same content` or `near picture`) and because_of, the id of the first kept picture that it repeats.

    rows: scope, id, rank, sha (digest of the content, null without one), h (64-bit hash, null where none is known).
    Within a scope rows go by rank, then id. Equal contents, and equal hashes, are one class, represented by its first
    row: all of a class have the same neighbours, so the class stays or goes with that row.
    """
    at = F.struct("rank", "id")
    held = rows.select(F.col(scope).alias("_s"), "id", "rank", "sha", "h")
    hashed = settled(held.withColumn("_class", F.when(F.col("h").isNotNull(), F.struct(F.lit("h").alias("by"), F.col("h").cast("string").alias("value"))).when(F.col("sha").isNotNull(), F.struct(F.lit("s").alias("by"), F.col("sha").alias("value"))).otherwise(F.struct(F.lit("i").alias("by"), F.col("id").cast("string").alias("value")))))
    classes = settled(hashed.groupBy("_s", "_class").agg(F.min(at).alias("first"), F.min("h").alias("h")))
    # Different classes with one content: a hash that is missing or was computed otherwise.
    by_sha = hashed.where(F.col("sha").isNotNull()).select("_s", "_class", "sha").distinct()
    mixed = by_sha.groupBy("_s", "sha").agg(F.count("*").alias("n")).where("n > 1").select("_s", "sha")
    several = by_sha.join(mixed, ["_s", "sha"]).join(classes.select("_s", "_class", "first"), ["_s", "_class"]).select("_s", "sha", "first")
    same = several.withColumnRenamed("first", "better").join(several.withColumnRenamed("first", "worse"), ["_s", "sha"]).where("better < worse").select("_s", "better", "worse")
    near = near_hashes(classes.where(F.col("h").isNotNull()), "h", "first", most, scope="_s").select("_s", F.col("a").alias("better"), F.col("b").alias("worse"))
    edge = lambda c: F.struct("_s", F.col(c).alias("at"))
    told = stayers(same.unionByName(near).select(edge("better").alias("better"), edge("worse").alias("worse")))
    settled_classes = classes.select("_s", "_class", "first").join(told.select(F.col("id._s").alias("_s"), F.col("id.at").alias("first"), "stays", F.col("because_of.at").alias("because")), ["_s", "first"], "left")
    whole = hashed.join(settled_classes, ["_s", "_class"]).withColumn("_stays", F.coalesce("stays", F.lit(True)))
    kept = F.col("_stays") & (F.struct("rank", "id") == F.col("first"))
    why = F.when(kept, F.lit(None)).otherwise(F.when(F.col("_stays"), F.col("first")).otherwise(F.col("because")))
    keeper = hashed.select("_s", F.struct("rank", "id").alias("why"), F.col("sha").alias("_sha"))
    out = whole.withColumn("kept", kept).withColumn("why", why).join(keeper, ["_s", "why"], "left")
    reason = F.when(F.col("kept"), "").when(F.col("sha") == F.col("_sha"), "same content").otherwise("near picture")
    return out.select(F.col("_s").alias(scope), "id", "kept", reason.alias("reason"), F.col("why.id").alias("because_of"))


#: At least so similar are two titles of one event by themselves, and with a fingerprint that supports it.
ALIKE, SUPPORTED = 0.58, 0.35


def fingerprint_keys(print_: Column) -> Column:
    """array<string>: what two rows of one event have in common whatever their titles say: person, firm and kind of act; or two firms and a suit."""
    of_kind = lambda name: F.exists(print_["actions"], lambda w: w.isin(*fingerprints.CATEGORIES[name]))
    kinds = [F.when(of_kind(name), F.lit(name)) for name in fingerprints.CATEGORIES]
    person = F.transform(print_["people"], lambda p: F.transform(print_["companies"], lambda c: F.concat_ws("|", F.lit("p"), p, c)))
    events = F.transform(F.array_compact(F.array(*kinds)), lambda k: F.transform(F.flatten(person), lambda pc: F.concat_ws("|", pc, k)))
    sued = of_kind("legal")
    pairs = F.transform(print_["companies"], lambda a: F.transform(F.filter(print_["companies"], lambda b: b > a), lambda b: F.concat_ws("|", F.lit("l"), a, b)))
    return F.concat(F.flatten(events), F.when(sued, F.flatten(pairs)).otherwise(F.array().cast("array<string>")))


def event_rule(sim: Column, a: Column, b: Column) -> Column:
    """The first rule by which two rows tell of one event, or null: alike titles; one person, firm and kind of act; two firms and a suit; alike enough titles whose fingerprints overlap."""
    shares = lambda f: F.arrays_overlap(a[f], b[f])
    legal = lambda x: F.exists(x["actions"], lambda w: w.isin(*fingerprints.CATEGORIES["legal"]))
    return (
        F.when(sim >= ALIKE, "title_similarity")
        .when(shares("people") & shares("companies") & fingerprints.same_category(a["actions"], b["actions"]), "same_person_company_event")
        .when((F.size(F.array_intersect(a["companies"], b["companies"])) >= 2) & legal(a) & legal(b), "same_companies_legal_event")
        .when((shares("companies") | shares("products")) & (shares("people") | shares("actions")) & (sim >= SUPPORTED), "event_fingerprint_overlap")
    )


def event_pairs(pools: DataFrame, scope: str) -> DataFrame:
    """scope, a < b and relation, the rule, of all pairs of a pool that tell of one event. pools: scope, id (of one row only), title, print.

    Candidates have titles alike enough for the weakest rule, by the title join within the pool, or meet at a key of
    their fingerprints.
    """
    rows = settled(pools.select(F.col(scope).alias("_s"), "id", "title", "print"))
    alike = expanded(title_classes(rows, F.col("title"), "id", scope="_s"), lambda classes: similar_titles(classes, SUPPORTED, inclusive=True), rows, F.col("title"), "id", scope="_s")
    keyed = rows.select("_s", "id", F.explode(F.array_distinct(fingerprint_keys(F.col("print")))).alias("key"))
    met = keyed.withColumnRenamed("id", "a").join(keyed.withColumnRenamed("id", "b"), ["_s", "key"]).where("a < b").select("_s", "a", "b").distinct()
    both = alike.select("_s", "a", "b", "sim").join(met, ["_s", "a", "b"], "full_outer")
    of = lambda side: rows.select("_s", F.col("id").alias(side), F.col("print").alias(f"_{side}"))
    judged = both.join(of("a"), ["_s", "a"]).join(of("b"), ["_s", "b"])
    rule = event_rule(F.coalesce("sim", F.lit(0.0)), F.col("_a"), F.col("_b"))
    return judged.select(F.col("_s").alias(scope), "a", "b", rule.alias("relation")).where("relation IS NOT NULL")


def final_dedup(pools: DataFrame, pairs: DataFrame, scope: str) -> DataFrame:
    """scope, id, rank, slot, kept, reason, stayed, merged, merged_count.

    pools: scope, id, rank, keeper (see fingerprints.keeper_key). In rank order a row meets the keepers in the order of
    their slots, and joins the first that it tells of one event with: the rule is its reason, and the better of the two
    has the slot from then on, with all that was merged into it (`stayed`, as of then). A row that meets none opens a
    slot. A keeper has in `merged` the rows that came to its slot, in order, with their reasons.
    """
    merged = "array<struct<id: {0}, reason: string>>"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        order, came, of, reason, stayed = [], [], {}, {}, {}
        best = {r.id: tuple(r.keeper.values()) if isinstance(r.keeper, dict) else tuple(r.keeper) for r in f.itertuples()}
        for row in f.sort_values(["rank", "id"], kind="stable").itertuples():
            near = {p["other"]: p["relation"] for p in row.partners} if row.partners is not None else {}
            slot = next((i for i, k in enumerate(order) if k in near), None)
            if slot is None:
                slot = len(order)
                order.append(row.id)
                came.append([])
            else:
                reason[row.id] = near[order[slot]]
                came[slot].append({"id": row.id, "reason": reason[row.id]})
                if best[row.id] > best[order[slot]]:
                    order[slot] = row.id
                stayed[row.id] = order[slot]
            of[row.id] = slot
        kept = [order[of[i]] == i for i in f["id"]]
        return f.assign(
            slot=[of[i] + 1 for i in f["id"]], kept=kept, reason=[reason.get(i, "") for i in f["id"]], stayed=pd.Series([stayed.get(i) for i in f["id"]], index=f.index, dtype="object"),
            merged=[came[of[i]] if k else [] for i, k in zip(f["id"], kept, strict=True)], merged_count=[len(came[of[i]]) if k else 0 for i, k in zip(f["id"], kept, strict=True)],
        )[[scope, "id", "rank", "slot", "kept", "reason", "stayed", "merged", "merged_count"]]

    made = with_partners(pools, pairs, [scope]).join(pools.select(scope, "id", "keeper"), [scope, "id"])
    kinds = {c: made.schema[c].dataType.simpleString() for c in (scope, "id", "rank")}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", slot int, kept boolean, reason string, stayed {kinds['id']}, merged {merged.format(kinds['id'])}, merged_count int"
    return made.groupBy(scope).applyInPandas(run, schema)


def refilled(chosen: DataFrame, reserves: DataFrame, scope: str, target: int) -> DataFrame:
    """The kept rows of a scope by slot, then as many reserves by turn as are owed up to `target`, each address once. scope, id, url, place, from_reserve.

    chosen: scope, id, slot, url; reserves: scope, id, turn, url. A missing address counts as an empty one.
    """
    from pyspark.sql import Window

    from .joins import keep_first

    url = F.coalesce("url", F.lit("")).alias("url")
    first = chosen.select(scope, "id", url, F.row_number().over(Window.partitionBy(scope).orderBy("slot")).alias("place"))
    counts = first.groupBy(scope).agg(F.count("*").alias("_held"))
    fresh = keep_first(reserves.select(scope, "id", "turn", url), [scope, "url"], [F.col("turn")]).join(first.select(scope, "url"), [scope, "url"], "left_anti")
    ranked = fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(scope).orderBy("turn")))
    more = ranked.join(counts, scope).withColumn("place", F.col("_held") + F.col("_nth")).where(F.col("place") <= target)
    both = first.withColumn("from_reserve", F.lit(False)).unionByName(more.select(scope, "id", "url", F.col("place").cast("int").alias("place"), F.lit(True).alias("from_reserve")))
    return both.where(F.col("place") <= target)
