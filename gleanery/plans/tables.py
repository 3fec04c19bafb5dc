"""The driver's tables as the engine's inputs, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All queries are told the same time.
NOW = "2024-01-31 00:00:00"
KINDS = ("rss", "hn", "github", "huggingface", "arxiv")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_of(text: Column) -> Column:
    """The text up to its first full stop or line end."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^[^\n.]*", 0)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as candidates: the kind, time and metrics follow from the id and the length."""
    d = table(spark, sf_dir, "documents")
    n = F.coalesce("n_chars", F.lit(0))
    hours = (F.col("doc_id") % 60).cast("int")
    return d.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), title_of(F.col("text")).alias("title"), F.coalesce("text", F.lit("")).alias("summary"),
        F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example.com/item/"), (F.col("doc_id") % 400).cast("string"), F.lit("?p="), F.col("doc_id").cast("string")).alias("url"),
        F.coalesce("source", F.lit("")).alias("source"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("source_type"),
        F.when(F.col("doc_id") % 17 != 0, now() - F.make_dt_interval(hours=hours)).alias("published_at"), F.lit("published").alias("published_source"),
        (n % 50).cast("int").alias("hn_score"), (n % 7).cast("int").alias("hn_comments"), (n % 900).cast("int").alias("github_stars"), (n % 60).cast("int").alias("hf_likes"),
        (n * 3).cast("int").alias("hf_downloads"), F.lit(0).alias("cross_source_count"), F.when(F.col("doc_id") % 5 == 4, 8).otherwise(0).alias("arxiv_signal"),
    )


#: The view `c` of `candidates` in SQL.
CANDIDATES = f"""c AS (
    SELECT doc_id AS id, doc_id AS pos, regexp_extract(coalesce(text, ''), '^[^\\n.]*') AS title, coalesce(text, '') AS summary,
        'https://' || coalesce(source, 'none') || '.example.com/item/' || (doc_id % 400) || '?p=' || doc_id AS url, coalesce(source, '') AS source,
        ['rss', 'hn', 'github', 'huggingface', 'arxiv'][doc_id % 5 + 1] AS source_type,
        CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '{NOW}' - to_hours(CAST(doc_id % 60 AS INTEGER)) END AS published_at, 'published' AS published_source,
        CAST(coalesce(n_chars, 0) % 50 AS INTEGER) AS hn_score, CAST(coalesce(n_chars, 0) % 7 AS INTEGER) AS hn_comments, CAST(coalesce(n_chars, 0) % 900 AS INTEGER) AS github_stars,
        CAST(coalesce(n_chars, 0) % 60 AS INTEGER) AS hf_likes, CAST(coalesce(n_chars, 0) * 3 AS INTEGER) AS hf_downloads, 0 AS cross_source_count,
        CASE WHEN doc_id % 5 = 4 THEN 8 ELSE 0 END AS arxiv_signal
    FROM documents)"""
AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(published_at)) / 3.6e9"
FRESH = f"CASE WHEN published_at IS NULL THEN 0.0 WHEN {AGE} <= 6 THEN 100.0 WHEN {AGE} <= 12 THEN 80.0 WHEN {AGE} <= 24 THEN 60.0 WHEN {AGE} <= 36 THEN 35.0 ELSE 0.0 END"
#: `t(title)` as the structure that title_similarity needs, and the similarity of two of them.
PARTS = """
    lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) AS clean,
    regexp_replace(regexp_replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '\\s+', '', 'g'), '[，,。.!！?？:：;；|｜、"''“”‘’（）()【】\\[\\]\\-—_]', '', 'g') AS canon,
    list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda w: w <> '')) AS words"""
SIMILARITY = """CASE WHEN a.clean = b.clean THEN 1.0
    WHEN a.canon <> '' AND a.canon = b.canon THEN 1.0
    WHEN contains(a.clean, b.clean) OR contains(b.clean, a.clean) THEN CAST(least(length(a.clean), length(b.clean)) AS DOUBLE) / greatest(length(a.clean), length(b.clean))
    WHEN a.canon <> '' AND b.canon <> '' AND (contains(a.canon, b.canon) OR contains(b.canon, a.canon)) THEN CAST(least(length(a.canon), length(b.canon)) AS DOUBLE) / greatest(length(a.canon), length(b.canon))
    WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.0
    ELSE CAST(len(list_intersect(a.words, b.words)) AS DOUBLE) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) END"""
