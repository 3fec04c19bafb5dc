"""Versioned JSON snapshots and the history of runs: reading with a gate, writing whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import fresh_snapshot, post_time
from ..operators.joins import keep_first

POST = (
    "tweet_id string, text string, author string, created_at string, url string, source_name string, source_handle string, source_tier string, official boolean, opinion_eligible boolean, "
    "thread_id string, reply_to_id string, quoted_id string, is_repost boolean, context_complete boolean"
)
POSTS = f"schema_version string, generated_at string, tweets array<struct<{', '.join(x.replace(' ', ':', 1) for x in POST.split(', '))}>>"
TIERS = ("primary", "research", "media", "community")
RUN = (
    "schema_version string, run_id string, generated_at string, workflow struct<state:string>, "
    "candidates array<struct<candidate_id:string,source_title:string,source:string,source_type:string>>, "
    "analysis struct<items:array<struct<candidate_id:string,importance_score:double,risk_level:string>>>, "
    "editorial struct<decisions:array<struct<candidate_id:string,action:string,rank:int,reason:string>>>"
)


def post_snapshot(spark: SparkSession, path: str, now, most_hours: float = 6.0) -> DataFrame:
    """The posts of the snapshot files in `path` that have the right version and are fresh enough (both bounds included).

    A post needs all its fields, a known tier, a numeric id and an address that names its id and its account; of posts
    with one id the first stays.
    """
    envelopes = spark.read.schema(POSTS).option("multiLine", True).json(path)
    valid = envelopes.where((F.col("schema_version") == "x-feed-v1") & F.col("tweets").isNotNull() & fresh_snapshot(post_time(F.col("generated_at")), now, most_hours))
    rows = valid.select(F.posexplode("tweets").alias("pos", "t")).select("pos", "t.*").withColumn("published_at", post_time(F.col("created_at")))
    filled = F.lit(True)
    for c in ("tweet_id", "text", "author", "url", "source_name", "source_handle"):
        filled = filled & (F.trim(F.coalesce(c, F.lit(""))) != "")
    parts = F.split(F.regexp_extract("url", r"^https?://(?:www\.)?(?:x|twitter)\.com/([^?#]*)", 1), "/")
    own = (F.size(parts) == 3) & (F.lower(F.get(parts, F.lit(0))) == F.lower("source_handle")) & (F.get(parts, F.lit(1)) == "status") & (F.get(parts, F.lit(2)) == F.col("tweet_id"))
    good = rows.where(filled & F.col("tweet_id").rlike("^[0-9]{1,32}$") & F.col("source_tier").isin(*TIERS) & F.col("published_at").isNotNull() & own)
    return keep_first(good, ["tweet_id"], [F.col("pos")])


def preferred(local: DataFrame, remote: DataFrame, local_is_valid: bool) -> DataFrame:
    """A valid local snapshot counts even if it is empty; else the remote one."""
    return local if local_is_valid else remote


def run_history(spark: SparkSession, folder: str, cutoff) -> DataFrame:
    """Runs of `shadow-*.json` files since the cutoff, one row each; `broken` tells files that hold no valid run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shadow-*.json").load(folder).where(~F.col("path").endswith(".feedback.json"))
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.from_json(F.decode("content", "UTF-8"), RUN).alias("r"))
    at = F.try_to_timestamp(F.col("r.generated_at"))
    broken = F.coalesce((F.col("r.schema_version") != "shadow-run-v1") | at.isNull() | F.col("r.run_id").isNull(), F.lit(True))
    return rows.select("file", broken.alias("broken"), at.alias("at"), "r.*").where(F.col("broken") | (F.col("at") >= cutoff))


def run_sides(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, analyses and decisions of valid runs, each with run_id and pos: the three sides of a record."""
    good = runs.where(~F.col("broken"))

    def side(array) -> DataFrame:
        rows = good.select("run_id", F.posexplode(array).alias("pos", "x")).select("run_id", "pos", "x.*")
        return rows.where(F.coalesce("candidate_id", F.lit("")) != "")

    return side("candidates"), side("analysis.items"), side("editorial.decisions")


def write_once(rows: DataFrame, path: str) -> None:
    """Fails if there is something at the path already."""
    rows.write.mode("errorifexists").json(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_by_day(rows: DataFrame, path: str, day: str = "report_date") -> None:
    """Appends to a history partitioned by day, so that a window of days reads its own folders only."""
    rows.write.mode("append").partitionBy(day).json(path)


def fingerprint(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per edition the digest of its items' title, brief and address as compact JSON in order of `pos`. An edition has a few dozen items at most."""
    one = F.struct("pos", F.to_json(F.struct("title", "brief", "source_url")).alias("j"))
    texts = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"])
    return items.groupBy(*keys).agg(texts.alias("t")).select(*keys, F.sha2(F.concat(F.lit("["), F.array_join("t", ","), F.lit("]")), 256).alias("fingerprint"))
