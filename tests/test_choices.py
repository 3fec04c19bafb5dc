"""Choices, audits and two selections against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.operators import choices, joins
from gleanery.plans import choices as Q
from gleanery.plans.queries import edition_pools

SMALL = "/root/testdata/sf0.001"


def chosen(rows, target, per_source=2, per_topic=2, least_primary=2, per_event=1):
    """Selected ids in order; rows in the order of the pool."""
    counts, out = {"source": Counter(), "topic": Counter(), "event": Counter()}, []

    def fits(r, cap):
        return not r["radar"] and all(not r[c] or counts[c][r[c]] < n for c, n in (("source", cap), ("topic", per_topic), ("event", per_event)))

    def take(r):
        out.append(r)
        for c in counts:
            counts[c][r[c]] += 1

    for r in rows:
        if len(out) >= target:
            break
        if r["primary"] and fits(r, per_source):
            take(r)
            if sum(x["primary"] for x in out) >= least_primary:
                break
    for cap, least in ((per_source, None), (max(per_source, target // 2), 8.5)):
        for r in rows:
            if len(out) < target and r not in out and fits(r, cap) and (least is None or r["editorial_score"] >= least):
                take(r)
    return [r["id"] for r in out]


def test_editorial_choice_equals_a_walk(spark):
    rows, analyses = Q.choice_inputs(spark, SMALL)
    told = {r["id"]: r for r in analyses.collect()}
    by_run = {}
    for r in rows.collect():
        by_run.setdefault(r["run"], []).append(r.asDict())
    want = {}
    for mine in by_run.values():
        for r in mine:
            r["source"] = r["source"].strip().lower()
            r["topic"] = (r["topic_key"] or "").strip().lower() or (r["title"] or "").strip().lower()
            r["event"] = (r["event_key"] or "").strip().lower() or r["topic"]
            r["risk"] = told[r["id"]]["risk_level"] if r["id"] in told else "high"
        pool = sorted((r for r in mine if r["risk"] != "high"), key=lambda r: (-r["editorial_score"], -r["score"], r["pos"]))[:45]
        picked = chosen(pool, Q.TARGET, per_topic=3)
        for r in mine:
            if r["content_quality"] != "ready":
                want[r["id"]] = ("reject", None, f"证据不足 ({r['content_quality']}): {r['quality_reason'] or 'source content is unavailable'}")
            elif r["risk"] == "high":
                want[r["id"]] = ("reject", None, choices.HIGH_RISK)
            elif r["id"] in picked:
                want[r["id"]] = ("write", picked.index(r["id"]) + 1, told[r["id"]]["importance_reason"])
            elif r in pool:
                want[r["id"]] = ("reserve", None, choices.RESERVED)
            else:
                want[r["id"]] = ("reject", None, choices.NOT_CHOSEN)
    found = {r["id"]: r for r in Q.editorial_choice(spark, SMALL).collect()}
    assert {i: (r["action"], r["rank"], r["reason"]) for i, r in found.items()} == want
    assert {w[0] for w in want.values()} == {"write", "reserve", "reject"}
    kinds = {r["id"]: r["source_type"] for mine in by_run.values() for r in mine}
    assert all(tuple(found[i]["brief"]) == choices.BRIEFS["arxiv" if k == "arxiv" else "tools" if k in choices.TOOLS else "other"] for i, k in kinds.items())


def test_audit_gives_each_candidate_one_end(spark):
    found = Q.candidate_audit(spark, SMALL).collect()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert len(found) == rows == len({r["id"] for r in found})
    ends = Counter(r["final_state"] for r in found)
    assert sum(ends.values()) == rows and {"accepted", "rejected", "not_selected"} <= set(ends) <= {"accepted", "rejected", "not_selected", "clustered_duplicate", "quarantined"}
    in_pool = {r["id"] for r in edition_pools(spark, SMALL).collect()}
    assert {r["id"] for r in found if r["reason"] == "beyond_pool"} == {r["id"] for r in found} - in_pool
    assert all((r["duplicate_of"] is None) == (r["relationship"] == "") for r in found)


def test_audit_folds_the_log(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    collected = [(1, i) for i in range(1, 8)]
    pools = [(1, i) for i in range(1, 7)]
    clustered = [(1, 1, 1, "event"), (1, 2, 1, "merged"), (1, 3, None, "quarantined"), (1, 4, 4, "event"), (1, 5, 5, "event"), (1, 6, 6, "event")]
    edited = [(1, 1, 1, "accepted", "", None, 1), (1, 4, 4, "rejected", "semantic_duplicate", 1, 1), (1, 5, 5, "rejected", "semantic_duplicate_unresolved", 1, 2)]
    made = lambda c=collected: choices.audit("run", table(c, "run int, id int"), table(pools, "run int, id int"), table(clustered, "run int, id int, event int, state string"), table(edited, "run int, id int, rank int, state string, reason string, because_of int, tries int"))
    found = {r["id"]: (r["final_state"], r["stage"], r["reason"], r["duplicate_of"], r["relationship"]) for r in made().collect()}
    assert found == {
        1: ("accepted", "edition", "", None, ""), 2: ("clustered_duplicate", "clustering", "same_event", 1, "same_event"), 3: ("quarantined", "clustering", "semantic_duplicate_unresolved", None, ""),
        4: ("rejected", "edition", "semantic_duplicate", 1, "same_event"), 5: ("rejected", "edition", "semantic_duplicate_unresolved", 1, "uncertain"), 6: ("not_selected", "clustering", "target_reached", None, ""), 7: ("not_selected", "collected", "beyond_pool", None, ""),
    }
    for wrong in (collected[1:], [*collected, (1, 1)]):
        with pytest.raises(Exception, match="collected once"):
            made(wrong).collect()


def test_removed_sentences(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "c"], ["a", "c"]), (["a"], []), ([], ["x"])], "o array<string>, f array<string>")
    assert [r["r"] for r in rows.select(choices.removed_sentences(F.col("o"), F.col("f")).alias("r")).collect()] == [["b", "a"], ["a"], []]


def test_comparison_where_a_side_fails(spark):
    first = spark.createDataFrame([(r, i, i) for r in (1, 2, 3) for i in (1, 2, 3)], "run int, id int, rank int")
    second = spark.createDataFrame([(1, 3, 1, True), (1, 9, 2, False), (1, 4, 3, True), (1, 1, 4, True), (2, 1, 1, True), (4, 1, 1, True)], "run int, id int, rank int, ready boolean")
    failed = spark.createDataFrame([(3, "KeyError")], "run int, error string")
    found = {r["run"]: r for r in choices.shadow_comparison(first, second, "run", 3, failed).collect()}
    assert set(found) == {1, 2, 3}
    one = found[1]
    assert (one["status"], one["selected"], one["recommended"], one["dropped"], one["added"]) == ("diagnostic_only", [1, 2, 3], [3, 4, 1], [2], [4])
    assert one["overlap"] == pytest.approx(2 / 3) and one["footrule"] == 2.0
    assert (found[2]["status"], found[2]["fallback_reason"], found[2]["recommended"], found[2]["overlap"]) == ("fallback", "insufficient_ready_write_candidates", [], None)
    assert (found[3]["fallback_reason"], found[3]["selected"]) == ("agent_error:KeyError", [1, 2, 3])


def test_domain_join_goes_by_host(spark):
    """Rows that share an id, or have none, keep the publishers of their own addresses."""
    registry = spark.createDataFrame([("example.com", "com"), ("a.example.com", "a"), ("example.net", "net")], "domain string, publisher string")
    rows = spark.createDataFrame([(1, "http://a.example.com/x"), (1, "http://b.example.net/"), (None, "http://example.com/"), (None, "http://nowhere.org/"), (2, None), (1, "http://z.a.example.com/")], "id int, url string")
    found = sorted((r["url"] or "", r["publisher"]) for r in joins.domain_join(rows, registry, "url").collect())
    assert found == [("", None), ("http://a.example.com/x", "a"), ("http://b.example.net/", "net"), ("http://example.com/", "com"), ("http://nowhere.org/", None), ("http://z.a.example.com/", "a")]


def test_selector_queue_equals_a_walk(spark):
    rank = {"official": 0, "research": 1, "media": 2, "community": 3}
    by_run = {}
    for r in Q.queued_events(spark, SMALL).collect():
        by_run.setdefault(r["run"], []).append(r)
    want = {}
    for rows in by_run.values():
        when = lambda r: r["published_at"].timestamp() if r["published_at"] else float("-inf")
        rows = sorted(rows, key=lambda r: (int(r["channel"] == "github" and r["authority"] == "community"), -r["score"], rank.get(r["authority"], 99), -when(r), r["event_key"]))[:45]
        topic = lambda r: next((x.removeprefix("topic:").strip().lower() for x in r["reasons"] if x.startswith("topic:")), r["event_key"])
        primary = lambda r: r["authority"] in ("official", "research")
        left, sources, topics, n, place = list(rows), Counter(), Counter(), 0, 0
        owed = any(map(primary, left))
        while left:
            fits = lambda r: not (owed and n < 2 and not primary(r)) and sources[r["publisher_id"]] < 2 and topics[topic(r)] < 2  # noqa: B023, E731
            pick = next((r for r in left if fits(r)), left[0])
            left.remove(pick)
            place += 1
            sources[pick["publisher_id"]] += 1
            topics[topic(pick)] += 1
            n += primary(pick)
            want[pick["event_key"]] = (rows.index(pick) + 1, topic(pick), primary(pick), place)
    assert {r["event_key"]: (r["rank"], r["topic"], r["primary"], r["place"]) for r in Q.selector_queue(spark, SMALL).collect()} == want
