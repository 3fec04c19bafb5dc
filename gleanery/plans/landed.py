"""Queries over JSON as it lands: payloads of unknown depth and snapshots of several versions, made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import payloads
from ..sources import versions
from .publishing import _pick
from .queries import query
from .tables import table

#: Levels around a payload's own object, by the conversation's id.
DEPTHS = 4


def conversation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per conversation: its turns as posts within 0 to 3 objects more, the first one quoted again at the end, and objects before and behind them whose names do not sort that way."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    number = (F.col("conv_id") * 1000 + F.coalesce("turn", F.lit(0))).cast("string")
    legacy = F.struct(F.col("text").alias("full_text"), F.col("turn").alias("favorite_count"), F.lit(True).alias("reply_count"), F.col("turn").cast("string").alias("quote_count"), F.col("conv_id").cast("string").alias("conversation_id_str"))
    user = F.struct(F.struct(F.struct(F.struct(F.struct(F.col("role").alias("screen_name")).alias("legacy")).alias("result")).alias("user_results")).alias("core"))
    entry = F.to_json(F.struct(number.alias("rest_id"), legacy.alias("legacy"), user["core"].alias("core")))
    turns = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(0)).alias("t"), entry.alias("j")))), lambda x: x["j"]).alias("e"))
    own = F.concat(F.lit('{"zeta":{"x":{}},"entries":['), F.array_join("e", ","), F.lit(',7,null,"{}"],"alpha":['), F.get("e", F.lit(0)), F.lit("]}"))
    depth = (F.col("conv_id") % DEPTHS).cast("int")
    return turns.select("conv_id", F.concat(F.repeat(F.lit('{"wrap":'), depth), own, F.repeat(F.lit("}"), depth)).alias("payload"))


_TURNS = f"""t AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(text, '') AS text, role, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0)) - 1 AS n, repeat('/wrap', CAST(conv_id % {DEPTHS} AS INTEGER)) AS base FROM conversations WHERE conv_id IS NOT NULL),
parts AS (SELECT unnest(['', '/legacy', '/core', '/core/user_results', '/core/user_results/result', '/core/user_results/result/legacy']) AS part, unnest([0, 1, 2, 3, 4, 5]) AS p)"""


@query(f"""
WITH {_TURNS}, w AS (SELECT conv_id, base, unnest(range(0, CAST(conv_id % {DEPTHS} AS BIGINT) + 1)) AS k FROM (SELECT DISTINCT conv_id, base FROM t)),
o AS (SELECT conv_id, repeat('/wrap', CAST(k AS INTEGER)) AS pointer, [0, k, 0, 0] AS spot FROM w
    UNION ALL SELECT DISTINCT conv_id, base || '/zeta', [1, 0, 0, 0] FROM t UNION ALL SELECT DISTINCT conv_id, base || '/zeta/x', [1, 1, 0, 0] FROM t
    UNION ALL SELECT conv_id, base || '/entries/' || n || part, [2, n, p, 0] FROM t, parts UNION ALL SELECT conv_id, base || '/alpha/0' || part, [3, 0, p, 0] FROM t, parts WHERE n = 0)
SELECT conv_id, pointer, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS nth, len(string_split(pointer, '/')) - 1 AS depth FROM o""")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object of each payload with its place in depth-first order."""
    found = payloads.walk(conversation_payloads(spark, sf_dir), "conv_id", "payload")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("path"))
    return found.select("conv_id", "pointer", nth.cast("long").alias("nth"), F.size("path").cast("long").alias("depth"))


@query(f"""
WITH {_TURNS}, k AS (SELECT conv_id, conv_id * 1000 + turn AS post_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, role, turn FROM t)
SELECT conv_id, CAST(post_id AS VARCHAR) AS post_id, text, coalesce(regexp_replace(role, '^\\s+|\\s+$', '', 'g'), '') AS author, CAST(conv_id AS VARCHAR) AS thread_id, greatest(turn, 0) AS like_count, 0 AS reply_count, greatest(turn, 0) AS quote_count FROM k WHERE text <> ''""")
def payload_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = payloads.walk(conversation_payloads(spark, sf_dir), "conv_id", "payload")
    return payloads.posts(objects, "conv_id").select("conv_id", "post_id", "text", "author", "thread_id", "like_count", "reply_count", "quote_count")


#: Documents of an edition.
EDITION = 10
SHAPES = ("v2", "v1", "unversioned", "other", "broken", "undecided", "v2")


def edition_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of ten documents as snapshots of either version, one kind of which is of a later version, one cut off, one without a decision."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    n = F.col("doc_id")
    title, brief = F.concat(F.lit("T"), n.cast("string")), F.when(n % 3 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    url = F.concat(F.lit("https://a.example/"), n.cast("string"))
    when = F.lit("2024-01-31T00:00:00+00:00")
    source = F.struct(url.alias("url"), F.coalesce("source", F.lit("")).alias("publisher_name"), F.lit("rss").alias("channel"))
    item = F.struct(F.concat(F.lit("e"), n.cast("string")).alias("event_key"), title.alias("chinese_title"), brief.alias("brief"), source.alias("canonical_source"), when.alias("published_at"), F.lit("source").alias("content_origin"), F.lit("rules_only").alias("validation_mode"))
    edition = F.floor(n / EDITION)
    rows = d.select(edition.alias("edition"), n.alias("pos"), item.alias("item"))
    ready = versions.latest_v2(rows, "edition", F.lit('{"action":"create"}'), F.lit('{"status":"created"}'), F.lit('{"n":1}'))
    news = d.select(edition.alias("edition"), n.alias("pos"), F.to_json(F.struct(title.alias("title"), F.nullif(brief, F.lit("")).alias("summary"), url.alias("url"), F.col("source"))).alias("j"))
    older = news.groupBy("edition").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda x: x["j"]), ",").alias("news"))
    shape = _pick(SHAPES, F.col("edition") % len(SHAPES))
    old = lambda head: F.concat(F.lit("{" + head + '"news":['), "news", F.lit("]}"))
    text = F.when(shape == "v1", old('"schema_version":1,')).when(shape == "unversioned", old("")).when(shape == "other", F.replace("text", F.lit('"schema_version":2'), F.lit('"schema_version":3')))
    text = text.when(shape == "broken", F.expr("left(text, length(text) - 1)")).when(shape == "undecided", F.replace("text", F.lit('"draft_decision":{"action":"create"}'), F.lit('"draft_decision":null'))).otherwise(F.col("text"))
    return ready.join(older, "edition").select("edition", text.alias("text"))


_SHAPE = "['" + "', '".join(SHAPES) + f"'][CAST(doc_id // {EDITION} AS BIGINT) % {len(SHAPES)} + 1]"


@query(f"""
WITH d AS (SELECT doc_id, doc_id // {EDITION} AS edition, {_SHAPE} AS shape, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(text, '') END AS body, source, row_number() OVER (PARTITION BY doc_id // {EDITION} ORDER BY doc_id) - 1 AS pos FROM documents WHERE doc_id IS NOT NULL),
blank AS (SELECT edition, bool_or(doc_id % 3 <> 0 AND trim(body) = '') AS odd FROM d GROUP BY edition)
SELECT d.edition, shape IN ('v1', 'unversioned') AS legacy, pos, CASE WHEN shape LIKE 'v2' THEN 'e' || doc_id END AS event_key, 'T' || doc_id AS title, CASE WHEN shape = 'v2' THEN body ELSE regexp_replace(body, '^\\s+|\\s+$', '', 'g') END AS brief, 'https://a.example/' || doc_id AS url,
    CASE WHEN shape = 'v2' THEN coalesce(source, '') ELSE nullif(source, '') END AS source FROM d WHERE shape IN ('v1', 'v2', 'unversioned')""")
def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all snapshots of a known version, in one shape."""
    read = versions.latest(edition_snapshots(spark, sf_dir))
    each = read.select("edition", F.inline("items"))
    return each.select("edition", "legacy", F.col("pos").cast("long").alias("pos"), "event_key", "title", "brief", "url", "source")


@query(f"""
SELECT DISTINCT doc_id // {EDITION} AS edition, CASE {_SHAPE} WHEN 'v2' THEN 2 WHEN 'v1' THEN 1 WHEN 'unversioned' THEN 1 END AS version,
    CASE {_SHAPE} WHEN 'other' THEN 'unsupported latest schema version' WHEN 'broken' THEN 'cannot read latest snapshot' WHEN 'undecided' THEN 'invalid v2 latest snapshot' ELSE '' END AS problem FROM documents WHERE doc_id IS NOT NULL""")
def latest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest(edition_snapshots(spark, sf_dir)).select("edition", "version", "problem")
