"""Readers, writers and keyed state on small files."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gleanery.functions import times, urls
from gleanery.sources import feeds, snapshots
from gleanery.streaming import state


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_registries(spark, tmp_path):
    (tmp_path / "feeds.json").write_text(json.dumps({"sources": [{"name": "A", "url": "https://a.example/feed", "region": "overseas"}, {"name": "B", "url": "u", "region": "china", "tier": "primary"}]}))
    assert {r["name"]: r["tier"] for r in feeds.feed_registry(spark, f"{tmp_path}/feeds.json").collect()} == {"A": "media", "B": "primary"}
    (tmp_path / "good.json").write_text(json.dumps({"schema_version": "x-sources-v1", "sources": [{"name": "N", "handle": "Abc", "tier": "primary", "official": True}]}))
    assert feeds.account_registry(spark, f"{tmp_path}/good.json").first()["handle_key"] == "abc"
    (tmp_path / "bad.json").write_text(json.dumps({"sources": [{"name": "N", "handle": "Abc"}, {"name": "M", "handle": "abc"}]}))
    with pytest.raises(Exception, match="duplicate handle"):
        feeds.account_registry(spark, f"{tmp_path}/bad.json").collect()


def test_rss(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title> One &amp; two </title><link>https://a.example/1</link><pubDate>Wed, 08 Jul 2026 12:00:00 GMT</pubDate><description>&lt;p&gt;Text&lt;/p&gt;</description></item><item><title></title><link>x</link></item><item><title>Dated</title><link>https://a.example/2026/07/08/x</link></item></channel></rss>")
    rows = {r["title"]: r for r in feeds.rss_items(spark, f"{tmp_path}/feed.xml", "A").collect()}
    assert set(rows) == {"One & two", "Dated"}
    assert rows["One & two"]["summary"] == "Text" and rows["One & two"]["published_source"] == "published"
    assert rows["Dated"]["published_source"] == "url_date"
    assert feeds.conform(feeds.rss_items(spark, f"{tmp_path}/feed.xml", "A")).first()["hn_score"] == 0


def post(**more):
    return {"tweet_id": "1", "text": "t", "author": "a", "created_at": "2026-07-08T10:00:00Z", "url": "https://x.com/Abc/status/1", "source_name": "n", "source_handle": "abc", "source_tier": "primary"} | more


@pytest.mark.parametrize("generated, kept", [("2026-07-08T06:00:00Z", 1), ("2026-07-08T05:59:59Z", 0), ("2026-07-08T12:05:00Z", 1), ("2026-07-08T12:05:01Z", 0)])
def test_post_snapshot(spark, tmp_path, generated, kept):
    tweets = [post(), post(text="again"), post(tweet_id="2"), post(tweet_id="x", url="https://x.com/abc/status/x"), post(tweet_id="3", url="https://x.com/abc/status/3", source_tier="other")]
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": "x-feed-v1", "generated_at": generated, "tweets": tweets}))
    rows = snapshots.post_snapshot(spark, f"{tmp_path}/s.json", F.lit("2026-07-08 12:00:00").cast("timestamp")).collect()
    assert [r["text"] for r in rows] == ["t"] * kept


def test_history(spark, tmp_path):
    run = {"schema_version": "shadow-run-v1", "run_id": "r1", "generated_at": "2026-07-08T10:00:00+00:00", "workflow": {"state": "completed"}, "candidates": [{"candidate_id": "c1", "source": "s"}, {"candidate_id": ""}], "analysis": {"items": [{"candidate_id": "c1", "importance_score": 9.0}]}, "editorial": {"decisions": [{"candidate_id": "c2", "action": "write"}]}}
    (tmp_path / "shadow-r1.json").write_text(json.dumps(run))
    (tmp_path / "shadow-r2.json").write_text("{not json")
    (tmp_path / "shadow-r1.feedback.json").write_text("{}")
    runs = snapshots.run_history(spark, str(tmp_path), F.lit("2026-07-01").cast("timestamp"))
    assert {r["file"]: r["broken"] for r in runs.collect()} == {"shadow-r1.json": False, "shadow-r2.json": True}
    c, a, d = snapshots.run_sides(runs)
    from gleanery.operators.joins import records

    found = {r["candidate_id"]: (r["source"], r["importance_score"], r["action"]) for r in records(c, a, d, ["run_id", "candidate_id"]).collect()}
    assert found == {"c1": ("s", 9.0, None), "c2": (None, None, "write")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("e", 2, "t2", "b", "u"), ("e", 1, "t1", "文", "u/1")], "edition string, pos int, title string, brief string, source_url string")
    snapshots.write_once(rows, f"{tmp_path}/once")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        snapshots.write_once(rows, f"{tmp_path}/once")
    import hashlib

    text = '[{"title":"t1","brief":"文","source_url":"u/1"},{"title":"t2","brief":"b","source_url":"u"}]'
    assert snapshots.fingerprint(rows, ["edition"]).first()["fingerprint"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("url, public", [
    ("https://a.example/x?utm_source=y&ref=z#top", "https://a.example/x"), ("https://a.example/x?id=1", ""), ("https://news.ycombinator.com/item?id=12", "https://news.ycombinator.com/item?id=12"),
    ("https://news.ycombinator.com/item?id=1a", ""), ("http://127.0.0.1/", ""), ("http://0x7f.1/", ""), ("https://localhost/x", ""), ("ftp://a.example/", ""), ("https://u:p@a.example/", ""), ("http://a.example:443/", ""), ("HTTPS://A.Example:443/x", "https://a.example/x"), (None, ""),
])
def test_public_url(spark, url, public):
    assert value(spark, urls.public_url(F.lit(url).cast("string"))) == public


def test_times(spark):
    at = datetime(2026, 7, 8, 12, tzinfo=timezone.utc)
    for raw in ("2026-07-08T12:00:00Z", "2026-07-08T14:00:00+02:00", "Wed Jul 08 12:00:00 +0000 2026"):
        assert value(spark, times.post_time(F.lit(raw))).timestamp() == at.replace(tzinfo=None).timestamp() or value(spark, times.seconds(times.post_time(F.lit(raw)))) == at.timestamp()
    assert value(spark, times.post_time(F.lit("2026-07-08T12:00:00"))) is None


def test_ledger_in_steps_equals_ledger_at_once(spark):
    rows = [("a", i, datetime(2026, 7, 1, i), s) for i, s in enumerate(["error", "success", "error", "timeout", "error"])] + [("b", i, datetime(2026, 7, 1, i), "error") for i in range(3)]
    frame = spark.createDataFrame(rows, "name string, pos int, at timestamp, status string")
    once = {r["name"]: r.asDict() for r in state.ledger(frame, ["name"]).collect()}
    steps = state.merge_ledger(state.ledger(frame.where("pos < 2"), ["name"]), state.ledger(frame.where("pos >= 2"), ["name"]), ["name"])
    assert {r["name"]: r.asDict() for r in steps.collect()} == once
    assert once["a"]["failures"] == 3 and once["b"]["failures"] == 3 and once["b"]["last_success"] is None


def test_stream_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, datetime(2026, 7, 1, i), "success" if i == 1 else "error") for i in range(4)], "name string, pos int, at timestamp, status string")
    rows.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state.stream_ledger(stream, ["name"], f"{tmp_path}/ledger", f"{tmp_path}/check").awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "ledger").iterdir())
    found = spark.read.parquet(f"{tmp_path}/ledger/v={last}").first()
    assert found["attempts"] == 4


def test_feedback_log(spark, tmp_path):
    events = spark.createDataFrame([("r", "c1", "good_topic", "n"), ("r", "c1", "odd", "n"), ("r", "c9", "good_topic", "n"), ("r", "c1", "bad_topic", "x" * 1001)], "run_id string, candidate_id string, label string, note string")
    decisions = spark.createDataFrame([("r", "c1")], "run_id string, candidate_id string")
    refused = state.record_feedback(spark, events, decisions, f"{tmp_path}/log", ("good_topic", "bad_topic"))
    assert sorted(r["reason"] for r in refused.collect()) == ["invalid_label", "note_too_long", "unknown_candidate"]
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1
