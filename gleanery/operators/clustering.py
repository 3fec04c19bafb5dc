"""Order-dependent clustering of pools: leaders, and events with quarantine.

The relations between the rows of a pool come from a Spark join of that pool; the fold of a pool only walks them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_partners(pools: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of a pool with the rows related to it: array<struct<other, relation>>. pairs: keys, a, b, relation, each pair once."""
    both = pairs.select(*keys, F.col("a").alias("id"), F.struct(F.col("b").alias("other"), "relation").alias("p")).unionByName(pairs.select(*keys, F.col("b").alias("id"), F.struct(F.col("a").alias("other"), "relation").alias("p")))
    near = both.groupBy(*keys, "id").agg(F.collect_list("p").alias("partners"))
    return pools.join(near, [*keys, "id"], "left").select(*keys, "id", "rank", "partners")


def leaders(pools: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """In rank order each row joins the first earlier leader that it is paired with, or becomes one. keys, id, leader."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", kind="stable")
        order, leader = [], {}
        for row in f.itertuples():
            near = {p["other"] for p in row.partners} if row.partners is not None else set()
            found = next((x for x in order if x in near), None)
            leader[row.id] = row.id if found is None else found
            if found is None:
                order.append(row.id)
        return f.assign(leader=[leader[i] for i in f["id"]])[[*keys, "id", "leader"]]

    made = with_partners(pools, pairs.withColumn("relation", F.lit("same")), keys)
    schema = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in [*keys, "id"]) + f", leader {made.schema['id'].dataType.simpleString()}"
    return made.groupBy(*keys).applyInPandas(run, schema)


def events(pools: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, event (the first member's id, or null) and state: event, merged or quarantined.

    In rank order each row is held against every member of every event so far. An event is confirmed if any member is
    the same event, else uncertain if any is to be reviewed. If any event is uncertain, the first event it touched stays, all
    others it touched are dissolved and their members quarantined, and so is the row. Else several confirmed events
    become one, and without any the row starts its own.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", kind="stable")
        groups: list[list] = []
        quarantined = set()
        for row in f.itertuples():
            near = {p["other"]: p["relation"] for p in row.partners} if row.partners is not None else {}
            touched = []
            for g in groups:
                kinds = {near[m] for m in g if m in near}
                if kinds:
                    touched.append((g, "same_event" in kinds))
            if any(not sure for _, sure in touched):
                for g, _ in touched[1:]:
                    quarantined.update(g)
                    groups.remove(g)
                quarantined.add(row.id)
            elif touched:
                keeper = touched[0][0]
                for g, _ in touched[1:]:
                    keeper.extend(g)
                    groups.remove(g)
                keeper.append(row.id)
            else:
                groups.append([row.id])
        event = {m: g[0] for g in groups for m in g}
        state = ["quarantined" if i in quarantined else "event" if event[i] == i else "merged" for i in f["id"]]
        return f.assign(event=[event.get(i) for i in f["id"]], state=state).astype({"event": "object"})[[*keys, "id", "event", "state"]]

    made = with_partners(pools, pairs, keys)
    kind = made.schema["id"].dataType.simpleString()
    schema = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in [*keys, "id"]) + f", event {kind}, state string"
    return made.groupBy(*keys).applyInPandas(run, schema)


def accepted_duplicates(pools: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """In rank order a row is accepted unless an accepted one is related to it; a stronger row (greater score) takes the
    place of all weaker ones that it is related to. keys, id, accepted, because_of."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", kind="stable")
        score = dict(zip(f["id"], f["score"], strict=True))
        accepted, why = [], {}
        for row in f.itertuples():
            near = {p["other"] for p in row.partners} if row.partners is not None else set()
            rivals = [x for x in accepted if x in near]
            if all(score[row.id] > score[x] for x in rivals):
                for x in rivals:
                    accepted.remove(x)
                    why[x] = row.id
                accepted.append(row.id)
            else:
                why[row.id] = rivals[0]
        chosen = set(accepted)
        return f.assign(accepted=[i in chosen for i in f["id"]], because_of=pd.Series([why.get(i) for i in f["id"]], index=f.index, dtype="object"))[[*keys, "id", "accepted", "because_of"]]

    made = with_partners(pools, pairs.withColumn("relation", F.lit("same")), keys).join(pools.select(*keys, "id", "score"), [*keys, "id"])
    kind = made.schema["id"].dataType.simpleString()
    schema = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in [*keys, "id"]) + f", accepted boolean, because_of {kind}"
    return made.groupBy(*keys).applyInPandas(run, schema)
