"""Payloads, versioned snapshots, the landed data source and the interval join of streams."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gleanery.operators import payloads
from gleanery.sources import landed, versions
from gleanery.streaming import state


def objects_of(value, pointer=""):
    if isinstance(value, dict):
        yield pointer, value
        for k, v in value.items():
            yield from objects_of(v, f"{pointer}/{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from objects_of(v, f"{pointer}/{i}")


def test_walk_equals_recursion(spark):
    rng = random.Random(4)

    def nested(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([1, None, True, "{}", "[1]", 'q"\\é', 2.5, {}, []])
        if kind < 0.7:
            return {rng.choice("zyxabc.") + str(i): nested(depth - 1) for i in range(rng.randint(0, 4))}
        return [nested(depth - 1) for _ in range(rng.randint(0, 4))]

    made = [nested(7) for _ in range(40)] + [{"a": {"b": {"c": {"d": [[[{"e": 1}]]]}}}}]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(made)] + [(100, None), (101, "nope"), (102, "")]
    got = payloads.walk(spark.createDataFrame(rows, "id int, payload string"), "id", "payload").orderBy("id", "path").collect()
    assert [(r["id"], r["pointer"], json.loads(r["raw"])) for r in got] == [(i, p, o) for i, v in enumerate(made) for p, o in objects_of(v)]


def test_posts_of_a_payload(spark):
    post = lambda i, **legacy: {"rest_id": i, "legacy": {"full_text": "t"} | legacy}
    payload = {"z": [post("2", favorite_count="12", reply_count=-3, quote_count=2.9, retweet_count=True)], "a": {"deep": post("1", full_text=" first ", id_str="9")}, "b": [post("1", full_text="again"), post(7), post("x"), post("", id_str="5", in_reply_to_status_id_str=" 8 ", quoted_status_id_str="no"), post("3", full_text=""), {"legacy": []}, post(0, id_str="6")]}
    rows = payloads.posts(payloads.walk(spark.createDataFrame([(1, json.dumps(payload))], "id int, p string"), "id", "p"), "id").orderBy("path").collect()
    assert [(r["post_id"], r["text"]) for r in rows] == [("2", "t"), ("1", "first"), ("5", "t"), ("6", "t")]
    assert [rows[0][c] for c in ("like_count", "reply_count", "quote_count", "repost_count")] == [12, 0, 2, 0]
    assert (rows[2]["reply_to_id"], rows[2]["quoted_id"], rows[2]["thread_id"]) == ("8", "", "5")


ITEM = {"event_key": "e", "chinese_title": "T", "brief": "b", "canonical_source": {"url": "u", "publisher_name": "p", "channel": "rss"}, "published_at": "2024-01-01T00:00:00+00:00", "content_origin": "llm", "validation_mode": "rules_only"}


@pytest.mark.parametrize(("value", "problem"), [
    ({"schema_version": 2, "brief_items": [ITEM], "draft_decision": {"a": 1}, "draft_execution": {}}, ""),
    ({"schema_version": 2, "brief_items": [], "draft_decision": None, "draft_execution": {"status": "failed", "reason": "invalid_configuration"}}, ""),
    ({"schema_version": 2, "brief_items": [], "draft_decision": None, "draft_execution": {"status": "failed", "reason": "other"}}, "invalid v2 latest snapshot"),
    ({"schema_version": 2, "brief_items": [ITEM], "draft_decision": {}}, "invalid v2 latest snapshot"),
    ({"schema_version": 2, "brief_items": [ITEM | {"brief": ""}, ITEM | {"brief": "", "brief_mode": "expanded"}], "draft_decision": {}, "draft_execution": {}}, "invalid v2 latest snapshot"),
    ({"schema_version": 2, "brief_items": [ITEM | {"published_at": "2024-01-01"}], "draft_decision": {}, "draft_execution": {}}, "invalid v2 latest snapshot"),
    ({"schema_version": 2, "brief_items": [ITEM | {"content_type": "attributed_opinion"}], "draft_decision": {}, "draft_execution": {}}, "invalid v2 latest snapshot"),
    ({"schema_version": 2, "brief_items": {}, "draft_execution": {}}, "v2 brief_items must be a list"),
    ({"schema_version": 2, "brief_items": [], "draft_execution": {}, "diagnostics": []}, "v2 diagnostics must be an object"),
    ({"schema_version": 4, "brief_items": []}, "unsupported latest schema version"), ({"schema_version": "2"}, "unsupported latest schema version"),
    ({"news": [1]}, "v1 news must be a list of objects"), ({"news": {}}, "v1 news must be a list of objects"), ({}, ""), ({"schema_version": None, "news": [{"title": "x"}]}, ""), ([], "latest snapshot root must be an object"), (None, "latest snapshot root must be an object"),
])
def test_latest_versions(spark, value, problem):
    row = versions.latest(spark.createDataFrame([(json.dumps(value),)], "text string")).first()
    assert row["problem"] == problem and (row["items"] is None) == bool(problem)


def test_latest_files_of_both_versions(spark, tmp_path):
    new = {"schema_version": 2, "brief_items": [ITEM, ITEM | {"event_key": "f", "brief": ""}], "draft_decision": {"action": "create"}, "draft_execution": {"status": "created"}, "diagnostics": {"n": 1}}
    (tmp_path / "a.json").write_text(json.dumps(new, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"news": [{"title": "old", "summary": "s", "url": "v", "extra": 1}]}))
    (tmp_path / "c.json").write_text("{")
    rows = {r["file"]: r for r in versions.latest(versions.files(spark, str(tmp_path))).collect()}
    assert [(i["event_key"], i["brief_mode"], i["legacy"]) for i in rows["a.json"]["items"]] == [("e", "expanded", False), ("f", "title_only", False)]
    assert [(i["title"], i["brief"], i["url"], i["legacy"]) for i in rows["b.json"]["items"]] == [("old", "s", "v", True)] and rows["b.json"]["version"] == 1
    assert json.loads(rows["a.json"]["decision"]) == {"action": "create"} and rows["a.json"]["diagnostics"] == '{"n":1}'
    assert rows["c.json"]["problem"] == "cannot read latest snapshot"


def test_latest_round_trip(spark):
    rows = spark.createDataFrame([(1, i, f"k{i}", f"brief {i}") for i in range(3)], "edition int, pos int, k string, b string")
    item = F.struct(F.col("k").alias("event_key"), F.col("k").alias("chinese_title"), F.col("b").alias("brief"), F.struct(F.lit("u").alias("url"), F.lit(None).cast("string").alias("publisher_name")).alias("canonical_source"), F.lit("2024-01-01T00:00:00Z").alias("published_at"), F.lit("llm").alias("content_origin"), F.lit("rules_only").alias("validation_mode"))
    text = versions.latest_v2(rows.select("edition", "pos", item.alias("item")), "edition", F.lit('{"a":1}'), F.lit('{"s":2}'), F.lit("{}"))
    row = versions.latest(text).first()
    assert row["problem"] == "" and [(i["event_key"], i["brief"], i["pos"]) for i in row["items"]] == [(f"k{i}", f"brief {i}", i) for i in range(3)]


def test_production_snapshots(spark):
    good = {"schema_version": "production-snapshot-v1", "report_date": "2024-01-31", "generated_at": "2024-01-31T01:00:00+00:00", "items": [{"id": "a", "published_at": "2024-01-30T08:00:00+08:00"}, {"id": "b", "published_at": None}]}
    cases = [(good, ""), (good | {"collection_diagnostics": {"fetched_total": 9}}, ""), (good | {"schema_version": "x"}, "unsupported production snapshot schema"), (good | {"report_date": "31.1.2024"}, "report_date must use YYYY-MM-DD"), (good | {"generated_at": "2024-01-31T01:00:00+08:00"}, "generated_at must use UTC"), (good | {"items": [1]}, "items must contain only objects"), (good | {"items": 1}, "items must be a list"), (good | {"items": [{"source_published_at": "2024-01-30T08:00:00"}]}, "item times must be ISO with an offset"), (good | {"collection_diagnostics": 3}, "collection_diagnostics must be an object")]
    rows = versions.production(spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(cases)], "n int, text string")).orderBy("n").collect()
    assert [r["problem"] for r in rows] == [p for _, p in cases]
    assert [i["published_at"] for i in rows[0]["items"]] == [datetime(2024, 1, 30), None] and [json.loads(i["json"])["id"] for i in rows[0]["items"]] == ["a", "b"]
    assert (rows[0]["returned_candidate_count"], rows[1]["returned_candidate_count"], rows[1]["fetched_total"], rows[2]["items"]) == (2, 2, 9, None)


def test_landed_items(spark, tmp_path):
    landed.register(spark)
    (tmp_path / "rss-a-feed-2024013005.json").write_text(json.dumps([{"id": 1, "title": "x", "metrics": {"stars": 3, "bad": "y"}}, 5]))
    (tmp_path / "hn-front-2024013006.json").write_text('{"id": "p", "title": "one"}\n\nnope\n{"id": "q"}\n')
    (tmp_path / "rss-b-2024013107.json").write_text("[]")
    (tmp_path / "notes.txt").write_text("no source")
    frame = spark.read.format("landed_items").load(str(tmp_path))
    rows = frame.orderBy("landed_at", "pos").collect()
    assert [(r["kind"], r["source"], r["pos"], r["id"], r["broken"]) for r in rows] == [("rss", "a-feed", 0, "1", None), ("rss", "a-feed", 1, None, "5"), ("hn", "front", 0, "p", None), ("hn", "front", 1, None, "nope"), ("hn", "front", 2, "q", None)]
    assert rows[0]["metrics"] == {"stars": 3} and rows[2]["landed_at"] == datetime(2024, 1, 30, 6)
    assert frame.rdd.getNumPartitions() == 3
    some = frame.where((F.col("kind") == "hn") & F.col("title").isNotNull())
    assert [r["id"] for r in some.collect()] == ["p"]
    reader = landed.LandedReader(str(tmp_path))
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    kept = list(reader.pushFilters([EqualTo(("kind",), "rss"), StringStartsWith(("title",), "x"), GreaterThan(("landed_at",), datetime(2024, 1, 31, tzinfo=timezone.utc))]))
    assert [type(f) for f in kept] == [StringStartsWith] and [p.source for p in reader.partitions()] == ["b"]
    recent = frame.where(F.col("landed_at") >= F.lit("2024-01-30 06:00:00").cast("timestamp"))
    assert recent.count() == 3


def test_landed_stream(spark, tmp_path):
    landed.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        query = spark.readStream.format("landed_items").load(f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(120)
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (tmp_path / "in/rss-a-2024013005.json").write_text('[{"id": "1"}]')
    assert run() == ["1"]
    (tmp_path / "in/rss-a-2024013006.json").write_text('[{"id": "2"}, {"id": "3"}]')
    assert run() == ["1", "2", "3"] == run()


def test_close_stream_equals_the_batch_join(spark, tmp_path):
    """Files come in steps; late rows behind the watermark of both sides meet nothing."""
    rng = random.Random(6)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    steps = [[(i * 100 + s, rng.choice(["u", "v", None]), start + timedelta(hours=6 * s + rng.random() * 6)) for i in range(8)] for s in range(5)]
    schema = "id int, who string, ts timestamp"

    def land(rows, side, step):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/{side}")

    def run():
        read = lambda side: spark.readStream.schema(schema).json(f"{tmp_path}/{side}")
        joined = state.close_stream(read("l"), read("r"), ["who"], "ts", 4.0)
        joined.select("id", "id_other").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(180)

    left, right = [], []
    for s, rows in enumerate(steps):
        land(rows[:4], "l", s)
        land(rows[4:], "r", s)
        left, right = left + rows[:4], right + rows[4:]
        run()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    frames = [spark.createDataFrame(rows, schema) for rows in (left, right)]
    batch = sorted((r["id"], r["id_other"]) for r in state.close_in_time(*frames, ["who"], "ts", 4.0).collect())
    assert got == batch and batch
    # Both sides have seen the end of the second day: a row of the first hour is late, a row within the watermark is not.
    last = start + timedelta(hours=40)
    for side in ("l", "r"):
        land([(9000 + (side == "r"), "z", last)], side, 9)
    run()
    run()
    late, fine = (7001, "u", start), (7002, "z", last - timedelta(hours=3))
    land([late, fine], "l", 10)
    run()
    more = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} - set(got)
    assert more == {(9000, 9001), (7002, 9001)}
