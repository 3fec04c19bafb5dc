"""Ranking and selection under quotas.

A selection works on pools: the best `pool` rows of each run, by rank. The bound is the feature (an edition has a few
dozen candidates), so a run's fold is one small group; runs are spread over the cluster.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POOL = 45
AUTHORITY = {"official": 0, "research": 1, "media": 2, "community": 3}


def pool(rows: DataFrame, keys: list[str], order: list, size: int = POOL) -> DataFrame:
    """The first `size` rows of each group with their rank from 1. The limit on the rank cuts each task's rows before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= size)


def top(rows: DataFrame, order: list, size: int) -> DataFrame:
    return rows.orderBy(*order).limit(size)


def evidence_order(score: str = "score") -> list:
    """Authority, official first, posts last, long evidence, score, late time, address."""
    rank = F.lit(99)
    for name, value in AUTHORITY.items():
        rank = F.when(F.col("authority") == name, value).otherwise(rank)
    return [rank, F.col("official").cast("int").desc(), (F.col("channel") == "x").cast("int"), F.length("evidence").desc(), F.col(score).desc(), F.col("published_at").desc(), F.col("url")]


def event_order() -> list:
    """The selector's own order of events: community repositories last, then score, authority, late time and key."""
    rank = F.lit(99)
    for name, value in AUTHORITY.items():
        rank = F.when(F.col("authority") == name, value).otherwise(rank)
    late = (F.col("channel") == "github") & (F.col("authority") == "community")
    return [F.coalesce(late, F.lit(False)).cast("int"), F.desc("score"), rank, F.desc_nulls_last("published_at"), F.col("event_key")]


def selector_queue(events: DataFrame, keys: list[str], size: int = POOL, **caps) -> DataFrame:
    """The best `size` events of each group in the selector's order with `place`, their place once repeated publishers and topics stand back.

    events: event_key, channel, authority, score, published_at, publisher_id, reasons. An event's topic is what follows
    `topic:` in the first of its reasons that starts so, else its key; events of officials and research are primary.
    """
    named = F.get(F.filter("reasons", lambda r: r.startswith("topic:")), F.lit(0))
    topic = F.coalesce(F.lower(F.trim(F.substring(named, F.lit(len("topic:") + 1), F.length(named)))), F.col("event_key"))
    pools = pool(events, keys, event_order(), size).select(*keys, "event_key", "rank", F.col("publisher_id").alias("source"), topic.alias("topic"), F.coalesce(F.col("authority").isin("official", "research"), F.lit(False)).alias("primary"))
    return demote_repeats(pools, keys, **caps)


def _fold(pools: DataFrame, keys: list[str], step, extra: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pools.schema.fields)
    columns = pools.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("rank", kind="stable").reset_index(drop=True)
        return step(ordered)[[*columns, *[x.split()[0] for x in extra.split(", ")]]]

    return pools.groupBy(*keys).applyInPandas(run, f"{schema}, {extra}")


def demote_repeats(pools: DataFrame, keys: list[str], per_source: int = 2, per_topic: int = 2, least_primary: int = 2) -> DataFrame:
    """Re-ranks each pool: the next row is the first whose source and topic are below their caps and, as long as primary
    rows are owed, that is primary; if none is, simply the next. No row goes away. Columns: rank, source, topic, primary.
    Adds `place`, from 1."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        left, sources, topics, primaries, place = list(f.index), Counter(), Counter(), 0, {}
        owed = bool(f["primary"].any())
        rows = {i: (f.at[i, "source"], f.at[i, "topic"], bool(f.at[i, "primary"])) for i in left}
        while left:
            pick = next((i for i in left if not (owed and primaries < least_primary and not rows[i][2]) and sources[rows[i][0]] < per_source and topics[rows[i][1]] < per_topic), left[0])
            left.remove(pick)
            place[pick] = len(place) + 1
            sources[rows[pick][0]] += 1
            topics[rows[pick][1]] += 1
            primaries += rows[pick][2]
        return f.assign(place=[place[i] for i in f.index])

    return _fold(pools, keys, step, "place int")


def select_edition(pools: DataFrame, keys: list[str], target: int, per_source: int = 2, per_topic: int = 2, least_primary: int = 2, per_event: int = 1, soft_score: float = 8.5) -> DataFrame:
    """Chooses `target` rows of each pool in three passes: primary rows until enough, then any row, then strong rows under a
    softer source cap. Columns: rank, source, topic, event, primary, radar, score. Adds `turn`, from 1; 0 is a reserve."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        counts = {"source": Counter(), "topic": Counter(), "event": Counter()}
        turn: dict[int, int] = {}
        soft = max(per_source, target // 2)

        def fits(r, cap: int) -> bool:
            limits = {"source": cap, "topic": per_topic, "event": per_event}
            return not r.radar and all(not getattr(r, c) or counts[c][getattr(r, c)] < n for c, n in limits.items())

        def take(i, r) -> None:
            turn[i] = len(turn) + 1
            for c in counts:
                counts[c][getattr(r, c)] += 1

        rows = list(f.itertuples())
        primaries = 0
        for r in rows:
            if len(turn) >= target:
                break
            if r.primary and fits(r, per_source):
                take(r.Index, r)
                primaries += 1
                if primaries >= least_primary:
                    break
        for cap, least in ((per_source, None), (soft, soft_score)):
            for r in rows:
                if len(turn) >= target:
                    break
                if r.Index not in turn and fits(r, cap) and (least is None or r.score >= least):
                    take(r.Index, r)
        return f.assign(turn=[turn.get(i, 0) for i in f.index])

    return _fold(pools, keys, step, "turn int")


def balance(pools: DataFrame, keys: list[str], target: int, caps: dict[str, int], value_caps: dict[str, dict[str, int]] | None = None, floor: tuple[str, str, int] | None = None, soft: tuple[str, ...] = (), firm: tuple[str, str] | None = None) -> DataFrame:
    """Balances each pool in rank order and adds `turn`, from 1 (0: a reserve), and `relaxed`, the pass that took a row.

    caps: column to the most rows of any one of its values; value_caps: column to the most rows of single values. A
    column may hold an array, of which every value counts; null and empty values are free. All rows that fit are taken,
    also beyond `target`. Reserves follow as long as rows are owed: rows of the value that `floor` (column, value,
    number) names, under all caps; any rows under all caps; under all caps but those of the columns in `soft`; and at last
    any but those whose value in `firm` (column, value) has reached its cap.
    """

    def values_of(value) -> list:
        return [v for v in (value if isinstance(value, (list, tuple)) or hasattr(value, "tolist") else [value]) if v is not None and v == v and v != ""]

    def step(f: pd.DataFrame) -> pd.DataFrame:
        columns = sorted({*caps, *(value_caps or {})})
        rows = {i: {c: values_of(f.at[i, c]) for c in columns} for i in f.index}
        counts = {c: Counter() for c in columns}
        turn, relaxed = {}, {}

        def most(c, value):
            return min((value_caps or {}).get(c, {}).get(value, len(f) + 1), caps.get(c, len(f) + 1))

        def fits(i, free=()) -> bool:
            return all(counts[c][v] < most(c, v) for c in columns if c not in free for v in rows[i][c])

        def take(i, why) -> None:
            turn[i], relaxed[i] = len(turn) + 1, why
            for c in columns:
                counts[c].update(rows[i][c])

        for i in f.index:
            if fits(i):
                take(i, "")
        if floor:
            column, value, least = floor
            for i in f.index:
                if i not in turn and value in rows[i][column] and counts[column][value] < least and fits(i):
                    take(i, "")
        for free, why in (((), ""), (soft, "soft")):
            for i in f.index:
                if i not in turn and len(turn) < target and fits(i, free):
                    take(i, why)
        for i in f.index:
            held = firm and firm[1] in rows[i][firm[0]] and counts[firm[0]][firm[1]] >= most(*firm)
            if i not in turn and len(turn) < target and not held:
                take(i, "all")
        return f.assign(turn=[turn.get(i, 0) for i in f.index], relaxed=[relaxed.get(i, "") for i in f.index])

    return _fold(pools, keys, step, "turn int, relaxed string")


def diversify(pools: DataFrame, keys: list[str], target: int, most: int = 2) -> DataFrame:
    """The first `target` rows of a pool, where each row beyond `most` of one entity gives way to the next reserve whose
    entity is not full; where no reserve fits, it stays. Adds `kept`."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        first, reserves = list(f.index[:target]), list(f.index[target:])
        counts, out = Counter(), []
        for i in first:
            entity = f.at[i, "entity"]
            if pd.isna(entity) or counts[entity] < most:
                pick = i
            else:
                pick = next((j for j in reserves if pd.isna(f.at[j, "entity"]) or (f.at[j, "entity"] != entity and counts[f.at[j, "entity"]] < most)), i)
                if pick != i:
                    reserves.remove(pick)
            if not pd.isna(f.at[pick, "entity"]):
                counts[f.at[pick, "entity"]] += 1
            out.append(pick)
        chosen = set(out)
        return f.assign(kept=[i in chosen for i in f.index])

    return _fold(pools, keys, step, "kept boolean")
