"""Evidence of sources: what is read, and what it is worth."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import evidence as V

LONG = "A new release that reads the whole of a file at once and says what it found."
FIELDS = ("title", "url", "summary", "source", "kind", "description", "notes", "tag", "article")


def told(spark, **given):
    rows = spark.createDataFrame([tuple(given.get(f) for f in FIELDS)], ", ".join(f"{f} string" for f in FIELDS))
    return rows.select(V.normalized_evidence(*[F.col(f) for f in FIELDS]).alias("e")).first()["e"]


def test_releases(spark):
    full = told(spark, title="T &amp; <b>U</b>", url="https://a.example/r", kind="GitHub", description="Reads files", notes=f"## Changes\n- {LONG} [more](https://x.example) ![p](q)", tag="v1")
    assert (full["title"], full["quality"], full["summary"]) == ("T & U", "ready", f"项目用途：Reads files\n版本 v1 变更：Changes {LONG} more")
    assert full["details"] == {"project_purpose": "Reads files", "release_changes": f"Changes {LONG} more", "release_tag": "v1"}
    pointer = told(spark, kind="github", description="Reads files", notes="See CHANGELOG for all of it, which is long")
    assert (pointer["quality"], pointer["summary"], pointer["details"]["release_changes"]) == ("missing", "项目用途：Reads files", "")
    assert told(spark, kind="github", notes=LONG)["reason"] == V.REASONS["no_purpose"]
    assert told(spark, kind="github", description="d", notes=LONG)["summary"].endswith(f"本次版本变更：{LONG}")


def test_forum(spark):
    envelope = "Article URL: https://a.example/x\nComments URL: https://news.ycombinator.com/item?id=1\nPoints: 3"
    entry = told(spark, source="Hacker News: Front", kind="rss", summary=envelope, url="https://b.example/")
    assert (entry["quality"], entry["url"], entry["summary"], entry["details"]) == ("metadata_only", "https://a.example/x", "", {"article_url": "https://a.example/x"})
    local = told(spark, source="hacker news", summary=envelope.replace("a.example", "127.0.0.1"), url="https://b.example/")
    assert local["url"] == "https://b.example/"
    assert told(spark, kind="hn", summary=LONG)["details"] == {"evidence_origin": "hn_text"}
    assert told(spark, kind="hn", summary="short", url="https://b.example/", article=f"<script>no</script><p>{LONG}</p>")["summary"] == LONG
    assert told(spark, kind="hn", summary="short", url="https://news.ycombinator.com/item?id=1", article=LONG)["quality"] == "too_short"
    assert told(spark, kind="hn")["quality"] == "missing"
    assert told(spark, source="hacker news", summary="Points: 3")["reason"] == V.REASONS["other"]


@pytest.mark.parametrize(("url", "kept"), [("http://10.1.2.3/", False), ("http://172.20.0.1/x", False), ("http://172.32.0.1/x", True), ("https://[::1]/", False), ("https://[fe80::1]/", False), ("ftp://a.example", False), ("https://8.8.8.8/", True), ("https://127.example/", True), (None, False)])
def test_open_url(spark, url, kept):
    row = spark.createDataFrame([(url,)], "u string").select(V.open_url(F.col("u")).alias("v")).first()
    assert row["v"] == (url if kept else "")


def test_pointers_and_texts(spark):
    rows = spark.createDataFrame([("",), (None,), ("Full changelog: x",), ("see changelog " + "y" * 120,), ("notes",)], "n string")
    assert [r["p"] for r in rows.select(V.changelog_pointer(F.col("n")).alias("p")).collect()] == [True, True, True, False, False]
    row = spark.createDataFrame([(" a ", None, "b")], "t string, s string, e string").select(V.evidence_text(F.col("t"), F.col("s"), F.col("e")).alias("x")).first()
    assert row["x"] == "a\nb"
