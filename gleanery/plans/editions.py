"""Queries of whole editions: one report per event, the collected news of runs, pictures without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprints
from ..operators import repeats, selection
from ..operators.dedup import METRICS
from ..operators.topics import topic_clusters
from .candidates import collect_news
from .publishing import HEADLINES, MARKS, OBJECTS, SUBJECTS, _list, _pick, headlines
from .queries import ACTS, BRANDS, HOT, PICTURES, PLACES, WEIGHTS, pictures, query
from .signals import _PRINTS, _SAME
from .tables import PARTS, candidates, now, title_of

#: Rows of a run; runs grow in number with the table.
RUN = 200
VOICES = ("Sam Altman", "Jensen Huang", "", "a spokesman", "")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines in runs, some of whose evidence names a person; what decides which of two repeats stays follows from the id."""
    h = headlines(spark, sf_dir)
    n = F.col("doc_id")
    confidence = F.when(n % 5 == 0, "low").when(n % 5 == 1, "medium").otherwise("high")
    keeper = fingerprints.keeper_key(F.col("channel"), n % 3, confidence, n % 2 == 0, (n % 9).cast("double"))
    evidence = F.concat_ws(" ", _pick(VOICES, n % len(VOICES)), "evidence")
    return h.select(F.floor(n / RUN).alias("run"), n.alias("id"), "title", fingerprints.fingerprint(F.col("title"), evidence).alias("print"), keeper.alias("keeper"))


def report_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pool(reports(spark, sf_dir), ["run"], [F.col("id") * 7919 % 1009, F.col("id")])


_CJK = "regexp_matches({0}.clean, '[一-鿿]')"
_PAIRS = "list_distinct(list_transform(range(1, greatest(1, length({0}.clean))), lambda i: substr({0}.clean, i, 2)))"
_SIM = f"""CASE WHEN a.clean = '' OR b.clean = '' THEN 0.0 WHEN a.clean = b.clean THEN 1.0 WHEN a.canon <> '' AND a.canon = b.canon THEN 1.0
    WHEN contains(a.clean, b.clean) OR contains(b.clean, a.clean) THEN CAST(least(length(a.clean), length(b.clean)) AS DOUBLE) / greatest(length(a.clean), length(b.clean))
    WHEN a.canon <> '' AND b.canon <> '' AND (contains(a.canon, b.canon) OR contains(b.canon, a.canon)) THEN CAST(least(length(a.canon), length(b.canon)) AS DOUBLE) / greatest(length(a.canon), length(b.canon))
    WHEN {_CJK.format('a')} OR {_CJK.format('b')} THEN CASE WHEN length(a.clean) < 2 OR length(b.clean) < 2 THEN 0.0 ELSE CAST(len(list_intersect(a.pairs, b.pairs)) AS DOUBLE) / len(list_distinct(list_concat(a.pairs, b.pairs))) END
    WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a.words, b.words)) AS DOUBLE) / len(list_distinct(list_concat(a.words, b.words))) END"""
_LEGAL = _list(fingerprints.CATEGORIES["legal"])


@query(f"""
WITH {HEADLINES.replace('h AS', 'h0 AS', 1)}, h AS (SELECT * REPLACE ({_list(VOICES)}[doc_id % {len(VOICES)} + 1] || ' ' || evidence AS evidence) FROM h0), {_PRINTS},
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // {RUN} ORDER BY doc_id * 7919 % 1009, doc_id) AS rank FROM h),
t0 AS (SELECT doc_id AS id, doc_id // {RUN} AS run, {PARTS} FROM h WHERE doc_id IN (SELECT doc_id FROM k WHERE rank <= {selection.POOL})),
t AS (SELECT t0.*, {_PAIRS.format('t0')} AS pairs, f.companies, f.people, f.products, f.actions FROM t0 JOIN f ON f.doc_id = t0.id),
j AS (SELECT a.run AS run, a.id AS a, b.id AS b, {_SIM} AS sim, list_has_any(a.people, b.people) AS who, list_has_any(a.companies, b.companies) AS firm, list_has_any(a.products, b.products) AS thing, list_has_any(a.actions, b.actions) AS act,
    ({_SAME}) AS same_category, len(list_intersect(a.companies, b.companies)) >= 2 AND list_has_any(a.actions, {_LEGAL}) AND list_has_any(b.actions, {_LEGAL}) AS suit FROM t a JOIN t b ON a.run = b.run AND a.id < b.id)
SELECT * FROM (SELECT run, a, b, CASE WHEN sim >= {repeats.ALIKE} THEN 'title_similarity' WHEN who AND firm AND same_category THEN 'same_person_company_event' WHEN suit THEN 'same_companies_legal_event'
    WHEN (firm OR thing) AND (who OR act) AND sim >= {repeats.SUPPORTED} THEN 'event_fingerprint_overlap' END AS relation FROM j) WHERE relation IS NOT NULL""")
def event_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a pool that tell of one event, with the rule."""
    return repeats.event_pairs(report_pools(spark, sf_dir), "run")


@query()
def final_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = report_pools(spark, sf_dir)
    return repeats.final_dedup(pools, repeats.event_pairs(pools, "run"), "run")


def news_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in runs whose titles name subjects, marks and objects before their own first sentence."""
    c = candidates(spark, sf_dir).where("id IS NOT NULL")
    n = F.col("id")
    said = F.concat_ws(" ", _pick(SUBJECTS, n % len(SUBJECTS)), _pick(MARKS, n * 7 % len(MARKS)), _pick(OBJECTS, F.floor(n / 8) % len(OBJECTS)), title_of(F.col("summary")))
    return c.withColumn("run", F.floor(n / RUN)).withColumn("title", said).withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example.com/item/"), (n % 37).cast("string"), F.lit("?p="), n.cast("string"))).withColumn("x_official", F.lit(False))


#: What the runs' rows are judged by.
HOW = {"hot": HOT, "weights": WEIGHTS, "brands": BRANDS, "places": PLACES, "acts": ACTS}
TOPICS = ("openai", "deepmind", "mistral", "nvidia", "acme", "谷歌")
ON_TOPIC = (("openai", "gpt", "nvidia", "llama", "model"), ("claude", "labs"))


def _news(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prints = fingerprints.fingerprint(F.col("title"), F.col("summary"))
    return collect_news(news_rows(spark, sf_dir), now(), *ON_TOPIC, "run", TOPICS, prints, **HOW)


@query()
def collected_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    news, _ = _news(spark, sf_dir)
    return news.select("run", "place", "id", "title", "source", F.round("score", 6).alias("score"), "from_reserve", "merged_count")


@query()
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage of a run took away."""
    return _news(spark, sf_dir)[1]


@query()
def topic_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics over all rows of a run, with no bound on them."""
    rows = news_rows(spark, sf_dir).select("run", "id", "title", "source", *METRICS)
    led = topic_clusters(rows, "run", F.struct((-F.col("hn_score")).alias("s"), F.col("id").alias("i")), TOPICS)
    return led.select("run", "id", "source", "hn_score", "github_stars", "cross_source_count", "absorbed")


def picture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pictures(spark, sf_dir)
    return p.select(F.coalesce("label", F.lit(-1)).alias("edition"), "id", (F.col("id") * 37 % 101).alias("rank"), F.when(F.col("id") % 3 != 0, F.sha2(F.col("h").cast("string"), 256)).alias("sha"), "h")


@query(f"""
WITH RECURSIVE {PICTURES}, o AS (SELECT coalesce(label, -1) AS edition, id, h, CASE WHEN id % 3 <> 0 THEN sha256(CAST(h AS VARCHAR)) END AS sha, row_number() OVER (PARTITION BY coalesce(label, -1) ORDER BY id * 37 % 101, id) AS n FROM p),
w AS (SELECT edition, n, id, true AS kept, CAST(NULL AS BIGINT) AS because_of, '' AS reason, [{{'id': id, 'h': h, 'sha': sha}}] AS held FROM o WHERE n = 1
    UNION ALL SELECT edition, n, id, met IS NULL, met.id, CASE WHEN met IS NULL THEN '' WHEN met.sha = sha THEN 'same content' ELSE 'near picture' END, CASE WHEN met IS NULL THEN list_append(held, {{'id': id, 'h': h, 'sha': sha}}) ELSE held END
    FROM (SELECT o.edition, o.n, o.id, o.h, o.sha, w.held, list_filter(w.held, lambda k: k.sha = o.sha OR bit_count(xor(k.h, o.h)) <= 4)[1] AS met FROM w JOIN o ON o.edition = w.edition AND o.n = w.n + 1))
SELECT edition, id, kept, reason, because_of FROM w""")
def kept_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.kept_pictures(picture_rows(spark, sf_dir), "edition")
