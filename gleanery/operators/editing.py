"""The edition loop: drafts are tried, checked, tried once more, and accepted under quotas, without two reports of one event.

What a draft of each attempt is worth follows from its row alone, so Spark settles that for all rows before (`attempt`);
related rows come from a join. The fold only walks one pool, which is bounded (see `selection.pool`).
"""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clustering import with_partners

INVALID = "invalid_builder_response"
MOST_ATTEMPTS = 2


@dataclass(frozen=True)
class Limits:
    """Sizes of an edition. Up to `facts` facts and `wanted_posts` posts come first; `posts` and `opinions` are caps."""

    items: int = 15
    facts: int = 3
    opinions: int = 3
    posts: int = 8
    wanted_posts: int = 5
    batch: int = 5


def attempt(reason: Column, number: int, permanent: tuple[str, ...] = ()) -> Column:
    """struct<action, reason> of a draft: accept without a reason, rebuild the first one unless its reason is permanent, else reject."""
    why = F.coalesce(reason, F.lit(INVALID))
    again = ~why.isin(*permanent) if permanent else F.lit(True)
    return F.struct(F.when(why == "", "accept").when(F.lit(number < MOST_ATTEMPTS) & again, "rebuild").otherwise("reject").alias("action"), why.alias("reason"))


def edit(pools: DataFrame, pairs: DataFrame, keys: list[str], limits: Limits | None = None) -> DataFrame:
    """keys, id, rank, state (accepted, rejected or not_selected), reason, because_of (the row it gave way to), tries.

    pools: keys, id, rank, strength (the less, the stronger), opinion, post, author, attempts (array of `attempt`).
    pairs: keys, a, b, relation (same_event or review), each pair once. Rows wait by rank; one that is to be rebuilt goes
    first. A row that is related to accepted ones replaces them if it is stronger than all, else it is rejected. A
    missing attempt counts as an invalid one. Posts over the cap wait until a place is free. An opinion without an
    author, or whose author has one, is not accepted.
    """
    bounds = limits or Limits()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = list(f.sort_values(["rank", "id"], kind="stable").itertuples(index=False))
        pool = _Pool(rows, bounds)
        pool.work()
        lines = [(*(getattr(r, k) for k in keys), r.id, r.rank, *pool.end[r.id], pool.tries[r.id]) for r in rows]
        return pd.DataFrame(lines, columns=[*keys, "id", "rank", "state", "reason", "because_of", "tries"]).astype({"because_of": "object"})

    facts = pools.select(*keys, "id", "strength", "opinion", "post", F.trim(F.lower(F.coalesce("author", F.lit("")))).alias("author"), "attempts")
    made = with_partners(pools, pairs, keys).join(facts, [*keys, "id"])
    kind = made.schema["id"].dataType.simpleString()
    schema = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in [*keys, "id", "rank"]) + f", state string, reason string, because_of {kind}, tries int"
    return made.groupBy(*keys).applyInPandas(run, schema)


class _Pool:
    """The state of one walk: who waits, who is accepted, and how each row ended."""

    def __init__(self, rows: list, limits: Limits):
        self.limits = limits
        self.rows = {r.id: r for r in rows}
        self.near = {r.id: {p["other"]: p["relation"] for p in r.partners} if r.partners is not None else {} for r in rows}
        self.accepted: list = []
        self.tries: Counter = Counter()
        self.end = {r.id: ("rejected", "x_limit", None) if r.post and not limits.posts else ("not_selected", "target_reached", None) for r in rows}
        self.waiting = [r for r in rows if not self.barrier(r, ())]
        self.again: deque = deque()
        self.parked: list = []

    def count(self, what: str, leave: tuple = ()) -> int:
        return sum(bool(getattr(self.rows[i], what)) for i in self.accepted if i not in leave)

    def facts(self) -> int:
        return len(self.accepted) - self.count("opinion")

    def barrier(self, r, leave: tuple) -> str:
        """Why the quotas keep r out if the accepted rows in `leave` went, or an empty string."""
        if r.post and self.count("post", leave) >= self.limits.posts:
            return "x_limit"
        if r.opinion and self.count("opinion", leave) >= self.limits.opinions:
            return "opinion_limit"
        authors = {self.rows[i].author for i in self.accepted if i not in leave and self.rows[i].opinion}
        return "opinion_author_limit" if r.opinion and r.author and r.author in authors else ""

    def reject(self, i, reason: str, because=None) -> None:
        self.end[i] = ("rejected", reason, because)

    def unpark(self) -> None:
        if self.parked and self.count("post") < self.limits.posts:
            self.waiting[:0] = self.parked
            self.parked = []

    def work(self) -> None:
        while self.again or self.waiting:
            batch = self.next_batch()
            for r in batch:
                self.judge(r)
            if batch:
                self.unpark()
        for r in self.parked:
            self.reject(r.id, "x_limit")

    def next_batch(self) -> list:
        room = max(self.limits.items - len(self.accepted), 0)
        free_posts = max(self.limits.posts - self.count("post"), 0)
        alone = not room or (self.again and self.again[0].post)
        size = 1 if alone else min(self.limits.batch, room)
        batch: list = []
        while (self.again or self.waiting) and len(batch) < size:
            if batch and self.again and self.again[0].post:
                break
            posts = sum(bool(r.post) for r in batch)
            r = self.again.popleft() if self.again else self.take(self.facts() + sum(not r.opinion for r in batch), self.count("post") + posts)
            reason = self.barrier(r, ())
            if reason.startswith("opinion"):
                self.reject(r.id, reason)
            elif reason or (r.post and posts >= free_posts):
                self.parked.append(r)
            elif room or any(i in self.near[r.id] and r.strength < self.rows[i].strength for i in self.accepted):
                batch.append(r)
        return batch

    def take(self, facts: int, posts: int):
        """The first waiting row of the kind that is most wanted: a fact in a post, a fact, a post, any."""
        want_fact, want_post = facts < self.limits.facts, posts < self.limits.wanted_posts
        at = max(range(len(self.waiting)), key=lambda n: (2 * (want_fact and not self.waiting[n].opinion) + (want_post and bool(self.waiting[n].post)), -n))
        return self.waiting.pop(at)

    def judge(self, r) -> None:
        done = self.tries[r.id]
        known = list(r.attempts) if r.attempts is not None else []
        found = known[done] if done < len(known) else None
        action, reason = (found["action"], found["reason"]) if found is not None else ("rebuild", INVALID)
        if done >= MOST_ATTEMPTS:
            self.reject(r.id, INVALID)
            return
        self.tries[r.id] += 1
        if action == "rebuild" and done + 1 < MOST_ATTEMPTS:
            self.again.append(r)
        elif action != "accept":
            self.reject(r.id, reason)
        else:
            self.place(r)

    def place(self, r) -> None:
        weaker, why, stronger = [], "", None
        for i in sorted(self.accepted, key=lambda i: self.rows[i].rank):
            relation = self.near[r.id].get(i)
            if relation is None:
                continue
            name = "semantic_duplicate_unresolved" if relation == "review" else "semantic_duplicate"
            if r.strength < self.rows[i].strength:
                weaker.append(i)
                why = name if relation == "review" else why or name
            else:
                stronger, why = i, name
                break
        if stronger is None:
            barrier = self.barrier(r, tuple(weaker)) or ("opinion_author_limit" if r.opinion and not r.author else "")
            if not weaker and len(self.accepted) >= self.limits.items:
                return
            if barrier == "x_limit" and not weaker:
                self.parked.append(r)
                return
            if barrier:
                self.reject(r.id, "selection_rejected")
                return
        for i in weaker:
            self.accepted.remove(i)
            self.reject(i, why, r.id)
        if stronger is None:
            self.accepted.append(r.id)
            self.end[r.id] = ("accepted", "", None)
        else:
            self.reject(r.id, why, stronger)
        self.unpark()
