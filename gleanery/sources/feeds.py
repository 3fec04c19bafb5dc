"""Feeds and registries: JSON registries, RSS and Atom files, candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import bare
from ..functions.text import collapse, known, once, strip_tags, unescape
from ..functions.times import aware, published
from ..functions.urls import is_http
from .pages import image_urls

CANDIDATE = (
    "id string, title string, url string, source string, source_type string, published_at timestamp, published_source string, summary string, author string, tags array<string>, "
    "hn_score int, hn_comments int, github_stars int, github_stars_recent int, hf_likes int, hf_downloads int, arxiv_signal int, cross_source_count int, topic_key string, source_tier string, "
    "image_candidates array<struct<url:string,source:string>>"
)
COUNTS = ("hn_score", "hn_comments", "github_stars", "github_stars_recent", "hf_likes", "hf_downloads", "arxiv_signal", "cross_source_count")
ITEM = "title string, link string, pubDate string, published string, updated string, description string, summary string, author string"


def feed_registry(spark: SparkSession, path: str) -> DataFrame:
    """name, url, region, tier of each feed; a missing tier is media."""
    rows = spark.read.schema("sources array<struct<name:string,url:string,region:string,tier:string>>").option("multiLine", True).json(path)
    return rows.select(F.inline("sources")).withColumn("tier", F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("media")))


def account_registry(spark: SparkSession, path: str) -> DataFrame:
    """Accounts by lower-case handle. A missing or malformed handle, or one that occurs twice, fails the job."""
    rows = spark.read.schema("schema_version string, sources array<struct<name:string,handle:string,tier:string,official:boolean,opinion_eligible:boolean>>").option("multiLine", True).json(path)
    each = rows.select(F.inline("sources")).withColumn("handle_key", F.lower(F.trim("handle")))
    good = F.coalesce(F.col("handle_key").rlike("^[a-z0-9_]{1,15}$"), F.lit(False))
    repeats = each.groupBy("handle_key").agg(F.count("*").alias("_n"))
    checked = each.withColumn("_bad", F.assert_true(good, "invalid handle")).join(repeats, "handle_key").withColumn("_twice", F.assert_true(F.col("_n") == 1, "duplicate handle"))
    return checked.where(F.col("_bad").isNull() & F.col("_twice").isNull()).select("name", "handle", "handle_key", "tier", F.coalesce("official", F.lit(False)).alias("official"), F.coalesce("opinion_eligible", F.lit(False)).alias("opinion_eligible"))


def rss_items(spark: SparkSession, path: str, source: str, row_tag: str = "item") -> DataFrame:
    """Candidates from landed feed files. Items without a title are left out; summaries are plain text of at most 200 characters."""
    rows = spark.read.format("xml").schema(ITEM).option("rowTag", row_tag).load(path)
    english = lambda c: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    time = lambda c: F.coalesce(aware(F.col(c)), english(F.col(c)))
    when = published([("published", F.coalesce(time("pubDate"), time("published"))), ("updated", time("updated"))], known(F.col("link")))
    summary = F.left(strip_tags(F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("description"))), F.lit(200))
    out = rows.select(collapse(F.col("title")).alias("title"), F.trim(known(F.col("link"))).alias("url"), summary.alias("summary"), F.trim(known(F.col("author"))).alias("author"), when.alias("w"))
    return out.where("title != ''").select(stable_id("rss", F.col("url"), F.col("title")).alias("id"), "title", "url", F.lit(source).alias("source"), F.lit("rss").alias("source_type"), "w.ts", "w.label", "summary", "author").withColumnsRenamed({"ts": "published_at", "label": "published_source"})


#: What an entry of a feed links to, as landed.
LINKED = "array<struct<url:string,href:string,type:string,rel:string>>"


def entry_images(media_content: Column, media_thumbnail: Column, links: Column, enclosures: Column, markup: Column) -> Column:
    """array<struct<url, source>>: the pictures of an entry, in the order of its parts; each address once, by its first place, no inline data.

    The first four are of the type LINKED, markup is an array of the entry's texts; any may be null. Links count if they are pictures, enclosures or thumbnails.
    """
    lower = lambda x, f: F.lower(known(x[f]))
    pictured = lambda x: lower(x, "type").contains("image")

    def named(values, source, first, second, kept):
        rows = F.filter(F.coalesce(values, F.array().cast(LINKED)), lambda x: x.isNotNull() & kept(x))
        return F.transform(rows, lambda x: F.struct(F.coalesce(F.nullif(x[first], F.lit("")), x[second]).alias("url"), F.lit(source).alias("source")))

    shown = F.flatten(F.transform(F.coalesce(markup, F.array().cast("array<string>")), image_urls))
    found = F.concat(
        named(media_content, "rss:media_content", "url", "href", lambda x: F.lit(True)), named(media_thumbnail, "rss:media_thumbnail", "url", "href", lambda x: F.lit(True)),
        named(links, "rss:link", "url", "href", lambda x: pictured(x) | lower(x, "rel").isin("enclosure", "thumbnail")), named(enclosures, "rss:enclosure", "href", "url", pictured),
        F.transform(shown, lambda u: F.struct(u.alias("url"), F.lit("rss:html_img").alias("source"))),
    )
    cleaned = lambda u: bare(reduce(lambda x, _: unescape(x), range(3), u))
    placed = F.array_sort(F.transform(found, lambda x, i: F.struct(cleaned(x["url"]).alias("url"), i.alias("at"), x["source"].alias("source"))))
    # Sorted by address and place, a row is the first of its address if the one before has another.
    first = once(placed, lambda p: F.filter(p, lambda x, i: (x["url"] != "") & ~x["url"].startswith("data:") & ((i == 0) | (F.get(p, i - 1)["url"] != x["url"]))))
    ordered = F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["url"].alias("url"), x["source"].alias("source"))))
    return F.transform(ordered, lambda x: F.struct(x["url"].alias("url"), x["source"].alias("source")))


def stable_id(kind: str, url, title):
    """An id from the address, or from the title without one; equal on every run."""
    return F.concat(F.lit(f"{kind}-"), F.sha2(F.when(url != "", url).otherwise(title), 256))


def conform(rows: DataFrame) -> DataFrame:
    """rows with all candidate columns in their order and types: missing counts are 0, other missing columns null."""
    out = []
    for part in CANDIDATE.split(", "):
        name, kind = part.split(" ", 1)
        column = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(column, F.lit(0)) if name in COUNTS else column).alias(name))
    return rows.select(*out)


def first_answer(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Per source the first attempt with items; without one `empty` if all were empty, else the last other status. attempts: keys, attempt, status, items."""
    rows = attempts.groupBy(*keys).agg(
        F.min(F.when(F.col("items") > 0, F.struct("attempt", "status", "items"))).alias("hit"),
        F.max(F.when(F.col("status") != "empty", F.struct("attempt", "status"))).alias("other"),
    )
    return rows.select(*keys, F.coalesce("hit.status", "other.status", F.lit("empty")).alias("status"), F.coalesce("hit.items", F.lit(0)).alias("items"))


def with_address(rows: DataFrame) -> DataFrame:
    return rows.where(is_http(F.col("url")))
