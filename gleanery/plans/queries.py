"""The operators as queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import anchors, drafts, forum, scoring, text, times, urls
from ..operators import clustering, dedup, editing, joins, predicates, selection
from ..streaming import state
from . import analytics
from .candidates import candidate_order, collect_candidates, retain, score
from .tables import AGE, CANDIDATES, FRESH, NOW, PARTS, SIMILARITY, candidates, now, table, title_of

#: Frequent parts of the invented prose stand for the words of the trade.
HIGH, LOW = ("tion", "eau"), ("the ", "le ")
HOT = ("th", "er", "on", "ou", "re", "en")
WEIGHTS = {"src1": 9, "src2": 7, "src": 6}
BRANDS = {"acme": ("nth", "eaux"), "bolt": ("tion",)}
PLACES = {"acme": ("src0.", "src1."), "bolt": ("src2.",)}
ACTS = ("the", "la", "der", "el")
STANCES = {"prediction": ("will", "tion"), "critique": ("eau", "the")}
SHORT, LONG, WEAK, SIGNAL_PLACES = ("and", "et", "und"), ("tion",), ("th", "la"), ("src0.", "src1.")

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def any_of(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


# Candidates


@query(f"""
WITH {CANDIDATES}
SELECT id, title, source, score, published_at FROM (
    SELECT id, title, source, published_at, {FRESH} * 0.5 + CASE WHEN contains(lower(source), 'src1') THEN 9 WHEN contains(lower(source), 'src2') THEN 7 WHEN contains(lower(source), 'src') THEN 6 ELSE 5 END AS score, url
    FROM c WHERE published_at IS NOT NULL AND {AGE} <= 36 AND (source_type <> 'rss' OR {any_of('lower(title)', HIGH)} OR {any_of('lower(summary)', HIGH)} OR ({any_of('lower(title)', LOW)} AND {any_of('lower(summary)', (*HIGH, *LOW))})))
ORDER BY score DESC, published_at DESC, url DESC LIMIT 45""")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention, freshness, authority and the best 45: the flagship."""
    kept = retain(candidates(spark, sf_dir), now(), HIGH, LOW).where("drop_reason = ''")
    scored = kept.withColumn("score", times.freshness(F.col("published_at"), now()) * 0.5 + scoring.authority(F.col("source"), WEIGHTS)).withColumn("bucket", F.lit(0))
    return selection.top(scored, candidate_order(F.col("bucket")), 45).select("id", "title", "source", "score", "published_at")


RETENTION = f"""CASE WHEN published_at IS NULL THEN 'no_date' WHEN {AGE} > 36 THEN 'too_old'
    WHEN source_type = 'rss' AND NOT ({any_of('lower(title)', HIGH)} OR {any_of('lower(summary)', HIGH)} OR ({any_of('lower(title)', LOW)} AND {any_of('lower(summary)', (*HIGH, *LOW))})) THEN 'not_ai' ELSE '' END"""


@query(f"WITH {CANDIDATES} SELECT id, {RETENTION} AS drop_reason FROM c")
def retention_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retain(candidates(spark, sf_dir), now(), HIGH, LOW).select("id", "drop_reason")


@query(f"WITH {CANDIDATES} SELECT {RETENTION} AS drop_reason, count(*) AS n FROM c GROUP BY 1")
def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.reason_counts(retain(candidates(spark, sf_dir), now(), HIGH, LOW), "drop_reason")


@query(f"""
WITH {CANDIDATES}, k AS (SELECT *, regexp_replace(lower(url), '\\?.*$', '') AS url_key FROM c),
f AS (SELECT url_key, arg_min(source_type, pos) AS source_type, arg_min(id, pos) AS id, arg_min(title, pos) AS title, min(published_at) AS published_at, max(hn_score) AS hn_score, max(github_stars) AS github_stars FROM k GROUP BY url_key)
SELECT f.id, f.title, f.url_key, f.source_type, f.published_at, f.hn_score, f.github_stars, (SELECT count(*) FROM k WHERE k.url_key = f.url_key AND k.source_type <> f.source_type) AS cross_source_count FROM f""")
def merged_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.merge_by_url(candidates(spark, sf_dir))
    return rows.select("id", "title", "url_key", "source_type", "published_at", "hn_score", "github_stars", "cross_source_count")


@query(f"""
WITH {CANDIDATES}, p AS (SELECT min(id) AS id, count(*) AS n, {PARTS} FROM (SELECT * FROM c WHERE trim(title) <> '') GROUP BY title), d AS (SELECT min(id) AS id, sum(n) AS n, clean, any_value(canon) AS canon, any_value(words) AS words FROM p GROUP BY clean)
SELECT a.id AS a, b.id AS b, round({SIMILARITY}, 9) AS sim FROM d a JOIN d b ON a.id < b.id WHERE {SIMILARITY} > 0.7""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = dedup.title_classes(candidates(spark, sf_dir), F.col("title"), "id")
    return dedup.similar_titles(classes, 0.7).select("a", "b", F.round("sim", 9).alias("sim"))


@query(f"""
WITH {CANDIDATES}, d AS (SELECT id, {PARTS} FROM c)
SELECT a.id, (SELECT count(*) FROM d b WHERE b.id <> a.id AND a.clean <> '' AND b.clean <> '' AND {SIMILARITY} > 0.25) AS cross_refs FROM d a""")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cross_references(candidates(spark, sf_dir), F.col("title"), "id")


#: The views that give the candidates `c` their composite score, the last of them `z`.
SCORED = f"""d AS (SELECT *, {PARTS} FROM c), m AS (
    SELECT a.*, (SELECT count(*) FROM d b WHERE b.id <> a.id AND a.clean <> '' AND b.clean <> '' AND {SIMILARITY} > 0.25) AS refs, {any_of('lower(title)', ACTS)} AS acts,
        CASE WHEN {any_of('lower(title)', BRANDS['acme'])} THEN 'acme' WHEN {any_of('lower(title)', BRANDS['bolt'])} THEN 'bolt' ELSE '' END AS brand FROM d a),
s AS (SELECT *, {FRESH} * CASE WHEN (source_type = 'hn' AND hn_score < 10 AND hn_comments < 2) OR (source_type = 'huggingface' AND hf_likes < 20 AND hf_downloads < 1000) THEN 0.2 ELSE 0.5 END
    + CASE WHEN contains(lower(source), 'src1') THEN 9 WHEN contains(lower(source), 'src2') THEN 7 WHEN contains(lower(source), 'src') THEN 6 ELSE 5 END + refs * 3
    + 2 * least(5, {' + '.join(f"CAST(contains(lower(title), '{h}') AS INTEGER)" for h in HOT)}) + CASE WHEN length(summary) > 50 THEN 2 ELSE 0 END
    + CASE WHEN hn_score > 0 OR hn_comments > 0 THEN ln(1 + hn_score) * 1.5 + ln(1 + hn_comments) * 1.2 ELSE 0 END + CASE WHEN github_stars > 0 THEN ln(1 + github_stars) ELSE 0 END
    + CASE WHEN hf_likes > 0 THEN ln(1 + hf_likes) * 2.0 ELSE 0 END + CASE WHEN hf_downloads > 100 THEN ln(1 + hf_downloads / 100.0) * 0.5 ELSE 0 END + arxiv_signal * 0.5 AS plain FROM m),
z AS (SELECT *, CASE WHEN low THEN 'low' ELSE 'high' END AS confidence, CASE WHEN low THEN plain * 0.6 ELSE plain END AS score FROM (
    SELECT *, acts AND brand <> '' AND NOT ((brand = 'acme' AND {any_of('lower(url)', PLACES['acme'])}) OR (brand = 'bolt' AND {any_of('lower(url)', PLACES['bolt'])})) AS low FROM s))"""


@query(f"WITH {CANDIDATES}, {SCORED} SELECT id, refs AS cross_refs, confidence, round(score, 6) AS score FROM z")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score(candidates(spark, sf_dir).withColumn("x_official", F.lit(False)), now(), HOT, WEIGHTS, BRANDS, PLACES, ACTS)
    return rows.select("id", "cross_refs", "confidence", F.round("score", 6).alias("score"))


@query(f"""
WITH {CANDIDATES.replace('c AS', 'c0 AS', 1)}, c AS (SELECT * FROM c0 WHERE ({RETENTION}) = ''), {SCORED}
SELECT id, title, bucket, round(exact, 6) AS score FROM (SELECT *, score AS exact, CAST(CASE WHEN url = '' OR title = '' THEN 2 WHEN length(summary) >= 60 THEN 0 ELSE 1 END AS INTEGER) AS bucket FROM z) ORDER BY bucket, exact DESC, published_at DESC NULLS LAST, url DESC LIMIT 45""")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production query: retention, composite score, three buckets, the best 45."""
    rows = candidates(spark, sf_dir).withColumn("x_official", F.lit(False))
    out = collect_candidates(rows, now(), HIGH, LOW, F.length("summary") >= 60, hot=HOT, weights=WEIGHTS, brands=BRANDS, places=PLACES, acts=ACTS)
    return out.select("id", "title", "bucket", F.round("score", 6).alias("score"))


# Text, urls, times, scores


@query(f"""
WITH {CANDIDATES}, d AS (SELECT id, title, {PARTS} FROM c)
SELECT id, clean, canon, len(words) AS n_words, CASE WHEN length(clean) < 2 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(clean)), lambda i: substr(clean, i, 2)))) END AS n_pairs FROM d""")
def title_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = candidates(spark, sf_dir).select("id", text.title_parts(F.col("title")).alias("p"))
    return made.select("id", "p.clean", "p.canon", F.size("p.words").cast("long").alias("n_words"), F.size("p.pairs").cast("long").alias("n_pairs"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, len(list_filter(string_split_regex(x, '[。！？!?]'), lambda s: trim(regexp_replace(s, '[。！？!?]+', '')) <> '')) AS n_sentences,
    regexp_replace(lower(trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '<[^>]+>', ' ', 'g'), chr(160), ' '), '\\s+', ' ', 'g'))), '[\\s，,。.!！?？:：;；、"' || chr(39) || '“”‘’（）()【】\\[\\]]+', '', 'g') AS compared,
    len(list_filter(list_distinct(regexp_extract_all(lower(x), '([a-z]+|[0-9]+(?:\\.[0-9]+)?)', 1)), lambda w: w NOT IN ('a', 'an', 'the'))) AS n_tokens,
    'topic:' || left(CASE WHEN s = '' THEN 'unknown' ELSE s END, 80) AS topic
FROM (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(x, '^@+', '')), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM d)""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.summary_sentences(x)).cast("long").alias("n_sentences"), text.comparison_text(x).alias("compared"), F.size(text.latin_tokens(x)).cast("long").alias("n_tokens"), text.topic_key(x).alias("topic"))


@query("""
WITH p AS (SELECT page_id, trim(coalesce(url, '')) AS u FROM pages),
q AS (SELECT page_id, u, lower(regexp_extract(u, '(?i)^(https?)://([^/?#]*)([^?#]*)\\??([^#]*)', 1)) AS scheme, regexp_extract(u, '(?i)^(https?)://([^/?#]*)([^?#]*)\\??([^#]*)', 2) AS auth,
    regexp_extract(u, '(?i)^(https?)://([^/?#]*)([^?#]*)\\??([^#]*)', 3) AS path, regexp_extract(u, '(?i)^(https?)://([^/?#]*)([^?#]*)\\??([^#]*)', 4) AS query FROM p),
r AS (SELECT *, regexp_replace(regexp_replace(lower(auth), '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS host, list_filter(string_split(query, '&'), lambda x: x <> '') AS pairs FROM q),
s AS (SELECT *, list_filter(pairs, lambda x: NOT (lower(regexp_extract(x, '^([^=]*)', 1)) IN ('fbclid', 'gclid', 'ref', 'source') OR starts_with(lower(regexp_extract(x, '^([^=]*)', 1)), 'utm_'))) AS kept FROM r)
SELECT page_id, host, path, scheme || '://' || host || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS relation_url,
    CASE WHEN len(kept) > 0 THEN '' ELSE scheme || '://' || host || path END AS public_url,
    CASE WHEN len(kept) > 0 THEN 'invalid-url:sha256:' || left(sha256(u), 16) ELSE scheme || '://' || host || path END AS audit_url,
    regexp_replace(lower(u), '\\?.*$', '') AS merge_key, u LIKE '%example.com%' AS official
FROM s""")
def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.relation_url(u).alias("relation_url"), urls.public_url(u).alias("public_url"), urls.audit_url(u).alias("audit_url"), urls.merge_key(u, F.col("page_id")).alias("merge_key"), urls.is_official(u, ("example.com",)).alias("official"))


@query("""
WITH e AS (SELECT event_id, ts, (epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 3.6e9 AS age FROM events)
SELECT event_id, CASE WHEN age <= 6 THEN 100.0 WHEN age <= 12 THEN 80.0 WHEN age <= 24 THEN 60.0 WHEN age <= 36 THEN 35.0 ELSE 0.0 END AS fresh,
    CASE WHEN greatest(age, 0) <= 6 THEN 2.0 WHEN age <= 24 THEN 1.8 WHEN age <= 36 THEN 1.5 WHEN age <= 72 THEN 0.8 ELSE 0.2 END AS editorial,
    age >= -5 / 60.0 AND age <= 6 AS in_time, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS report_date, month(ts) || '月' || day(ts) || '日' AS month_day,
    CAST(((datediff('day', DATE '2026-01-01', CAST(ts AS DATE)) % 8) + 8) % 8 AS BIGINT) AS palette FROM e""")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, ts = F.lit("2024-01-20 12:00:00").cast("timestamp"), F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", times.freshness(ts, at).alias("fresh"), times.editorial_freshness(ts, at).alias("editorial"), times.fresh_snapshot(ts, at).alias("in_time"), times.report_date(ts).alias("report_date"), times.month_day(ts).alias("month_day"), times.palette(ts.cast("date")).cast("long").alias("palette"))


@query("""
WITH d AS (SELECT doc_id, coalesce(n_chars, 0) % 101 / 10.0 AS s, coalesce(n_chars, 0) % 13 / 1.0 AS e, doc_id % 3 AS t FROM documents)
SELECT doc_id, CASE WHEN s < 4 THEN 'below_4' WHEN s < 7 THEN '4_to_7' WHEN s < 8.5 THEN '7_to_8_5' ELSE '8_5_and_above' END AS bucket,
    CASE WHEN t = 0 THEN 'high' WHEN e < 6 OR doc_id % 7 = 0 THEN 'medium' ELSE 'low' END AS risk, round(CAST(s AS DOUBLE) * 0.7 + CAST(e AS DOUBLE) * 0.3, 6) AS plain FROM d""")
def score_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce("n_chars", F.lit(0))
    s, e = n % 101 / 10.0, n % 13 / 1.0
    risk = scoring.risk_level(F.col("doc_id") % 3 == 0, e, F.lit(True), F.col("doc_id") % 7 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", scoring.score_bucket(s).alias("bucket"), risk.alias("risk"), F.round(s * 0.7 + e * 0.3, 6).alias("plain"))


@query("""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS x, coalesce(source, '') AS publisher FROM documents), t AS (SELECT *, list_filter(regexp_extract_all(x, '([a-z0-9][a-z0-9.+-]*|[一-鿿]{2,})', 1), lambda w: w NOT IN ('a', 'an', 'the', 'to', 'for', 'of', 'and', 'with', 'its', 'new', 'begin', 'begins', 'makes', 'make', 'selected')) AS tokens FROM d)
SELECT doc_id, 'event-' || left(sha256(CASE WHEN len(tokens) > 0 THEN array_to_string(tokens, ' ') ELSE publisher END), 16) AS event_key, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(x, '([0-9]+(?:\\.[0-9]+)?)', 1), lambda n: 'number:' || n))), ',') AS numbers,
    array_to_string(list_sort(list_filter(['tion', 'eaux', 'the ', 'ung'], lambda k: contains(x, k))), ',') AS entities FROM t""")
def anchors_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", anchors.event_key(x, F.lit(""), F.col("source")).alias("event_key"), F.array_join(anchors.numbers(x), ",").alias("numbers"), F.array_join(anchors.entities(x, ("tion", "eaux", "the ", "ung")), ",").alias("entities"))


@query("""
WITH s0 AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s1 AS (SELECT page_id, h, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'), '(?is)<template\\b[^>]*>.*?</template\\s*>', ' ', 'g'), '(?is)<svg\\b[^>]*>.*?</svg\\s*>', ' ', 'g') AS v FROM s0)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(v, '(?s)<[^>]*>', ' ', 'g'), chr(160), ' ', 'g'), '\\s+', ' ', 'g')) AS visible, len(regexp_extract_all(h, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1)) AS n_images,
    len(regexp_extract_all(h, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)) AS n_links FROM s1""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.pages import image_urls, link_urls

    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text(h).alias("visible"), F.size(image_urls(h)).cast("long").alias("n_images"), F.size(link_urls(h)).cast("long").alias("n_links"))


# Predicates


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x, role, turn > 0 AS reply, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS context FROM conversations),
n AS (SELECT *, len(regexp_extract_all(x, '([A-Za-z0-9]+|[一-鿿])', 1)) AS words FROM t)
SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'opinion_author_not_allowed' WHEN starts_with(lower(x), 'rt @') THEN 'opinion_repost_only' WHEN reply AND NOT context THEN 'opinion_context_missing'
    WHEN trim(regexp_replace(x, 'https?://\\S+', '', 'g')) = '' THEN 'opinion_repost_only' WHEN words < 10 OR NOT (contains(lower(x), 'will') OR contains(lower(x), 'tion') OR contains(lower(x), 'eau') OR contains(lower(x), 'the')) THEN 'opinion_no_substantive_claim' ELSE '' END AS reason,
    CASE WHEN contains(lower(x), 'will') OR contains(lower(x), 'tion') THEN 'prediction' WHEN contains(lower(x), 'eau') OR contains(lower(x), 'the') THEN 'critique' ELSE '' END AS stance FROM n""")
def opinion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as posts: a later turn replies to the one before."""
    c = table(spark, sf_dir, "conversations")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("context", before.isNotNull())
    x = F.coalesce("text", F.lit(""))
    reason = predicates.opinion_reason(x, F.col("role").isin("user", "assistant"), F.lower(x).startswith("rt @"), F.col("turn") > 0, F.col("context"), F.lit(False), STANCES)
    return rows.select("conv_id", "turn", reason.alias("reason"), predicates.stance(x, STANCES).alias("stance"))


@query(f"""
WITH {CANDIDATES}, f AS (SELECT *, hn_comments % 2 AS crossed, lower(title) AS low FROM c)
SELECT id, CASE WHEN (source_type = 'hn' AND crossed = 0) THEN 1 ELSE 0 END AS forum_only,
    CASE WHEN regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])(and|et|und)($|[^\\p{{L}}\\p{{N}}_])') THEN 'strong_short' WHEN contains(low, 'tion') THEN 'strong_long' WHEN (contains(low, 'th') OR contains(low, 'la')) AND (contains(url, 'src0.') OR contains(url, 'src1.')) THEN 'weak' ELSE '' END AS sig,
    CASE WHEN source_type = 'github' THEN CAST(github_stars % 2 = 1 OR length(trim(title)) < 24 OR length(trim(summary)) < 40 AS INTEGER) WHEN source_type = 'hn' THEN CAST(crossed = 0 AS INTEGER) WHEN source_type = 'huggingface' THEN 1 ELSE 0 END AS radar,
    CASE WHEN source_type = 'arxiv' THEN 'research' WHEN source_type IN ('hn', 'github', 'huggingface') THEN 'community' ELSE 'media' END AS tier FROM f""")
def community_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code rows are releases by their stars, with notes by their length; forum rows have another source by their comments."""
    c = candidates(spark, sf_dir)
    tier = predicates.tier_of(F.lit(""), F.col("source_type"))
    cross = F.col("hn_comments") % 2
    forum = predicates.community_only(F.col("source"), F.col("source_type"), cross)
    event = F.when(F.col("github_stars") % 2 == 0, "github_release").otherwise("github_activity")
    explained = predicates.explainable_release(F.col("title"), F.col("summary"))
    radar = predicates.community_radar(F.col("source_type"), tier, cross, event, explained)
    sig = predicates.signal(F.col("title"), F.col("url"), SHORT, LONG, WEAK, SIGNAL_PLACES)
    return c.select("id", forum.cast("int").alias("forum_only"), sig.alias("sig"), radar.cast("int").alias("radar"), tier.alias("tier"))


# Joins


@query("""
WITH l AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events e WHERE ts IS NOT NULL)
SELECT user_id, event_id, event_type, value FROM l WHERE r = 1""")
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""
SELECT coalesce(d.doc_id, l.doc_id, b.doc_id) AS doc_id, d.source, l.quality, b.item FROM (SELECT doc_id, source FROM documents) d FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id
FULL JOIN (SELECT item_id * 30 AS doc_id, item_id AS item FROM benchmark) b ON coalesce(d.doc_id, l.doc_id) = b.doc_id""")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("pos"))
    a = table(spark, sf_dir, "labels").select("doc_id", "quality", F.col("quality").alias("pos"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 30).alias("doc_id"), F.col("item_id").alias("item"), F.lit(0).alias("pos"))
    return joins.records(d, a, b, ["doc_id"])


@query("""
SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unmapped' WHEN l.n > 1 THEN 'duplicate' ELSE 'matched' END AS state, coalesce(d.doc_id, l.doc_id) AS doc_id
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT page_id * 7 FROM pages) GROUP BY 1) l ON d.doc_id = l.doc_id""")
def reassociated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as what was asked; the labels, and every seventh id from the pages, as the answers."""
    answers = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") * 7).alias("doc_id")))
    return joins.reassociate(table(spark, sf_dir, "documents").select("doc_id"), answers, "doc_id")


@query("""
SELECT p.page_id, p.host, CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'com' WHEN host LIKE '%.example.net' OR host = 'example.net' THEN 'net' END AS publisher
FROM (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '(:[0-9]*)?$', ''), '^www\\.', '') AS host FROM pages) p""")
def domain_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("example.com", "com"), ("example.net", "net")], "domain string, publisher string")
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return joins.domain_join(rows, registry, "url").select("page_id", urls.bare_host(F.col("url")).alias("host"), "publisher")


@query("""
SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def unquarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, marks = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    return joins.without(joins.within(d, marks.where("quality = 1"), ["doc_id"]), marks.where("toxic = 1"), ["doc_id"])


@query("""
WITH l AS (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type, CAST(floor(value) AS BIGINT) ORDER BY event_id) AS nth FROM events WHERE user_id % 2 = 0),
r AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY ALL)
SELECT event_id, event_type, v FROM l LEFT JOIN r USING (event_type, v) WHERE nth > coalesce(n, 0)""")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.floor("value").cast("long").alias("v"))
    return joins.bag_difference(e.where("user_id % 2 = 0").drop("user_id"), e.where("user_id % 2 = 1"), ["event_type", "v"], "event_id").select("event_id", "event_type", "v")


@query("""
SELECT a.event_id AS a, b.event_id AS b, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000""")
def close_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return state.close_in_time(e, e, ["user_id"], "ts", 2.0).where("event_id < event_id_other").select(F.col("event_id").alias("a"), F.col("event_id_other").alias("b"), "user_id")


#: Bits in which the second picture of a vector differs from the first: (factor of the id, modulus).
FLIPS = ((1, 61), (7, 59), (3, 53), (1, 5), (11, 47))
PICTURES = f"""v AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CASE WHEN i = 64 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << (i - 1) END ELSE CAST(0 AS HUGEINT) END)) AS BIGINT) AS h, label FROM embeddings),
p AS (SELECT 2 * vec_id AS id, h, label FROM v UNION ALL SELECT 2 * vec_id + 1, {reduce(lambda h, f: f"xor({h}, CAST(1 AS BIGINT) << CAST(vec_id * {f[0]} % {f[1]} AS INTEGER))", FLIPS, "h")}, label FROM v)"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and h: the signs of an embedding stand for a picture's hash; a second picture of each differs in a few bits."""
    bit = lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))
    signs = F.transform("embedding", lambda x, i: F.expr("0L") + bit(x, i))
    h = F.aggregate(F.reverse(signs), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    v = table(spark, sf_dir, "embeddings").select("vec_id", h.alias("h"), "label")
    other = reduce(lambda x, f: x.bitwiseXOR(F.expr(f"shiftleft(1L, CAST(vec_id * {f[0]} % {f[1]} AS INT))")), FLIPS, F.col("h"))
    return v.select(F.inline(F.array(F.struct((2 * F.col("vec_id")).alias("id"), "h", "label"), F.struct((2 * F.col("vec_id") + 1).alias("id"), other.alias("h"), "label"))))


@query(f"""
WITH {PICTURES}, h AS (SELECT min(id) AS id, h FROM p WHERE h IS NOT NULL GROUP BY h)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 4""")
def near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_hashes(pictures(spark, sf_dir), "h", "id")


@query(f"""
WITH {PICTURES}, c AS (SELECT h, min(id) AS class_id FROM p GROUP BY h), l AS (SELECT a.id, count(*) AS links FROM p a JOIN p b ON a.id <> b.id WHERE bit_count(xor(a.h, b.h)) <= 4 GROUP BY a.id)
SELECT p.id, coalesce(c.class_id, p.id) AS class_id, coalesce(l.links, 0) AS links FROM p LEFT JOIN c ON c.h = p.h LEFT JOIN l ON l.id = p.id""")
def hash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.hash_links(pictures(spark, sf_dir), "h", "id")


# Aggregations


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as reviewed candidates."""
    name = F.when(F.col("toxic") == 1, "bad_topic").when(F.col("quality") == 1, "good_topic").when(F.col("doc_id") % 2 == 0, "duplicate").otherwise("not_interesting")
    marks = table(spark, sf_dir, "labels").select("doc_id", name.alias("label"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), (F.coalesce("n_chars", F.lit(0)) % 101 / 10.0).alias("score"))
    return d.join(marks, "doc_id", "left").withColumn("action", F.when(F.col("doc_id") % 4 == 0, "write").when(F.col("doc_id") % 4 == 1, "reserve").otherwise("reject"))


JUDGED = """j AS (SELECT d.doc_id, coalesce(d.source, '') AS source, coalesce(n_chars, 0) % 101 / 10.0 AS score, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'bad_topic' WHEN quality = 1 THEN 'good_topic' WHEN d.doc_id % 2 = 0 THEN 'duplicate' ELSE 'not_interesting' END AS label,
    CASE WHEN d.doc_id % 4 = 0 THEN 'write' WHEN d.doc_id % 4 = 1 THEN 'reserve' ELSE 'reject' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LABEL_COUNTS = ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in analytics.LABELS)


@query(f"""WITH {JUDGED} SELECT source, count(*) AS candidates, count(label) AS reviewed, {LABEL_COUNTS}, CAST(round_even(count(label) / CAST(count(*) AS DOUBLE), 3) AS DOUBLE) AS coverage, count(*) FILTER (label IN ('bad_topic', 'duplicate', 'not_interesting')) AS negative FROM j GROUP BY source""")
def feedback_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    return analytics.feedback_summary(rows.select("doc_id", "source"), rows.where("label IS NOT NULL"), ["doc_id"])


@query(f"""WITH {JUDGED}, b AS (SELECT unnest(['below_4', '4_to_7', '7_to_8_5', '8_5_and_above']) AS bucket), k AS (SELECT label, CASE WHEN score < 4 THEN 'below_4' WHEN score < 7 THEN '4_to_7' WHEN score < 8.5 THEN '7_to_8_5' ELSE '8_5_and_above' END AS bucket FROM j WHERE label IS NOT NULL)
SELECT b.bucket, {LABEL_COUNTS} FROM b LEFT JOIN k USING (bucket) GROUP BY b.bucket""")
def analyst_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.calibration(judged(spark, sf_dir).where("label IS NOT NULL"))


_RISKS = "CASE WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'low' END"


@query(f"""WITH {JUDGED}, b AS (SELECT unnest(['low', 'medium', 'high']) AS risk), k AS (SELECT label, {_RISKS} AS risk FROM j WHERE label IS NOT NULL) SELECT b.risk, {LABEL_COUNTS} FROM b LEFT JOIN k USING (risk) GROUP BY b.risk""")
def risk_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = judged(spark, sf_dir).where("label IS NOT NULL").withColumn("risk", F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low"))
    return analytics.risk_calibration(rows)


@query(f"""WITH {JUDGED} SELECT {LABEL_COUNTS}, count(label) AS reviewed, CAST(count(label) < 20 AS INTEGER) AS few FROM j""")
def feedback_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.feedback_totals(judged(spark, sf_dir))


@query(f"""WITH {JUDGED} SELECT doc_id AS id, label, 'n' || doc_id AS note FROM j WHERE label IS NOT NULL AND doc_id % 3 = 0 ORDER BY doc_id DESC LIMIT 10""")
def feedback_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = judged(spark, sf_dir).where("label IS NOT NULL").select(n.alias("id"), "label", F.when(n % 3 == 0, F.concat(F.lit("n"), n.cast("string"))).otherwise("").alias("note"), n.alias("recorded_at"))
    return analytics.noted(rows).select("id", "label", "note")


@query(f"""
WITH {JUDGED}, r AS (SELECT doc_id // 100 AS run, doc_id, action, source, score, {_RISKS} AS risk FROM j WHERE doc_id IS NOT NULL)
SELECT run, count(*) AS candidates, count(*) FILTER (action = 'write') AS write_count, count(*) FILTER (action = 'reserve') AS reserve_count, count(*) FILTER (action = 'reject') AS reject_count,
    count(*) FILTER (score < 4) AS below_4, count(*) FILTER (score >= 4 AND score < 7) AS "4_to_7", count(*) FILTER (score >= 7 AND score < 8.5) AS "7_to_8_5", count(*) FILTER (score >= 8.5) AS "8_5_and_above",
    count(*) FILTER (risk = 'low') AS risk_low, count(*) FILTER (risk = 'medium') AS risk_medium, count(*) FILTER (risk = 'high') AS risk_high,
    (SELECT string_agg(source || '=' || n, '|' ORDER BY source) FROM (SELECT q.source, count(*) AS n FROM r q WHERE q.run = r.run AND q.action = 'reject' GROUP BY 1)) AS reject_reasons FROM r GROUP BY run""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per run of a hundred ids."""
    n = F.col("doc_id")
    rows = judged(spark, sf_dir).where("doc_id IS NOT NULL").withColumn("risk", F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low"))
    reports = analytics.run_report(rows.withColumn("run", F.floor(n / 100)).withColumn("reason", F.col("source")), ["run"])
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("reject_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return reports.withColumn("reject_reasons", F.when(F.size("reject_reasons") > 0, listed))


@query(f"""WITH {JUDGED}, b AS (SELECT unnest(['write', 'reserve', 'reject']) AS action) SELECT b.action, {LABEL_COUNTS} FROM b LEFT JOIN j USING (action) GROUP BY b.action""")
def editorial_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.outcomes(judged(spark, sf_dir))


@query(f"""WITH {JUDGED} SELECT doc_id AS id, score, label FROM j WHERE score >= 8.5 AND label IN ('bad_topic', 'duplicate', 'not_interesting') ORDER BY score DESC, doc_id LIMIT 10""")
def high_score_misjudgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.misjudged(judged(spark, sf_dir).select(F.col("doc_id").alias("id"), "score", "label", F.lit(0).alias("recorded_at"))).select("id", "score", "label")


@query(f"""WITH {JUDGED} SELECT doc_id AS id, score, label FROM j WHERE score < 7 AND label = 'good_topic' ORDER BY score, doc_id LIMIT 10""")
def missed_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.missed(judged(spark, sf_dir).select(F.col("doc_id").alias("id"), "score", "label", F.lit(0).alias("recorded_at"))).select("id", "score", "label")


@query(f"""WITH {JUDGED} SELECT source AS reason, count(*) AS n FROM j WHERE action = 'reject' AND source <> '' GROUP BY 1""")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.rejection_reasons(judged(spark, sf_dir).withColumn("reason", F.col("source")))


@query("""SELECT count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT CAST(ts AS DATE)) AS days, min(ts) AS first_at, max(ts) AS last_at FROM events""")
def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return analytics.coverage(table(spark, sf_dir, "events").select(F.col("ts").alias("generated_at"), named.alias("state")))


@query("""
WITH i AS (SELECT user_id AS edition, CAST(floor(value) AS BIGINT) AS event, event_type = 'view' AS opinion, event_type || user_id % 3 AS author, value IS NOT NULL AND value > 0.5 AS valid FROM events),
g AS (SELECT edition, count(*) AS items, count(*) FILTER (opinion) AS opinions, count(*) FILTER (NOT valid) AS invalid FROM i GROUP BY 1),
a AS (SELECT edition, max(n) AS n FROM (SELECT edition, author, count(*) AS n FROM i WHERE opinion GROUP BY ALL) GROUP BY 1), e AS (SELECT edition, max(n) AS n FROM (SELECT edition, event, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1)
SELECT edition, items, opinions, array_to_string(list_filter([CASE WHEN items < 5 THEN 'insufficient_items' END, CASE WHEN items - opinions < 3 THEN 'insufficient_fact_items' END, CASE WHEN opinions > 3 THEN 'opinion_limit' END, CASE WHEN coalesce(a.n, 0) > 1 THEN 'opinion_author_limit' END, CASE WHEN invalid > 0 THEN 'invalid_final_item' END, CASE WHEN e.n > 1 THEN 'duplicate_event_remaining' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM g LEFT JOIN a USING (edition) LEFT JOIN e USING (edition)""")
def draft_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    items = e.select(F.col("user_id").alias("edition"), F.floor("value").cast("long").alias("event"), (F.col("event_type") == "view").alias("opinion"), F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("author"), F.coalesce(F.col("value") > 0.5, F.lit(False)).alias("valid"))
    return analytics.draft_decision(items)


@query("""SELECT 'k' AS key, CAST(sum(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS n FROM events WHERE props LIKE '%"k"%'""")
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = table(spark, sf_dir, "events").select(F.from_json("props", "map<string,bigint>").alias("m"))
    return analytics.merged_counters(maps, "m")


@query(f"""
WITH {CANDIDATES}, e AS (SELECT 'type' AS dimension, source_type AS value FROM c UNION ALL SELECT 'source', source FROM c UNION ALL SELECT 'entity', unnest(list_filter(['tion', 'eaux', 'ung'], lambda k: contains(lower(title), k))) FROM c)
SELECT dimension, value, count(*) AS n FROM e WHERE value <> '' GROUP BY ALL""")
def balance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return analytics.balance_counts(c, {"type": F.array("source_type"), "source": F.array(text.first_component(F.col("source"))), "entity": anchors.entities(F.col("title"), ("tion", "eaux", "ung"))})


@query("""SELECT event_type AS source, count(*) AS total, count(ts) AS dated, max(ts) AS latest, count(*) FILTER (ts >= TIMESTAMP '2024-01-28') AS last_days FROM events GROUP BY 1""")
def source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("total"), F.count("ts").alias("dated"), F.max("ts").alias("latest"), F.count_if(F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz")).alias("last_days"))


@query("""
SELECT page_id, regexp_replace(url, '#.*$', '') AS article, 'https://news.ycombinator.com/item?id=' || page_id AS comments, page_id % 3 = 0 AS ambiguous, 'note ' || page_id AS detail
FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, '', 'https://news.ycombinator.com/item?id=' || page_id, true, 'note ' || page_id FROM pages WHERE page_id % 3 = 0""")
def forum_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a post of a forum; every third one shows another address than it leads to."""
    p = table(spark, sf_dir, "pages")
    shown = F.when(F.col("page_id") % 3 == 0, "https://other.example.com/").otherwise(F.col("url"))
    post = F.concat(F.lit('<p>Article URL: <a href="'), "url", F.lit('">'), shown, F.lit('</a></p><p>note '), F.col("page_id").cast("string"), F.lit('</p><p>Comments URL: <a href="https://news.ycombinator.com/item?id='), F.col("page_id").cast("string"), F.lit('">thread</a></p><p>Points: 7</p><p># Comments: 3</p><script>x</script>'))
    return p.select("page_id", forum.envelope(post).alias("e")).select("page_id", "e.*")


@query("""
SELECT doc_id AS id, doc_id % 5 IN (0, 4) AS accepted, CASE WHEN doc_id % 5 IN (0, 4) THEN 2 END AS bindings FROM documents""")
def strict_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft per document, of which three in five break the contract: a wrong index, a field too many, a sentence without evidence."""
    d = table(spark, sf_dir, "documents")
    fault = F.col("doc_id") % 5
    quoted = lambda name: F.struct(F.lit(name).alias("target"), F.left("text", F.lit(40)).alias("source_quote"), F.lit("https://example.com/").alias("source_url"))
    safe = d.withColumn("text", F.concat(F.lit("t "), F.coalesce("text", F.lit(""))))
    base = {"index": F.when(fault == 1, 2).otherwise(1), "event_key": F.lit("k"), "chinese_title": F.left("text", F.lit(30)), "evidence_targets": F.when(fault == 3, F.array(quoted("title"))).otherwise(F.array(quoted("title"), quoted("brief_1")))}
    made = lambda brief, **more: F.to_json(F.struct(*[c.alias(n) for n, c in (base | {"brief": brief} | more).items()]))
    raw = F.when(fault == 4, made(F.array(F.lit("One sentence。")))).when(fault == 2, made(F.lit("One sentence。"), extra=F.lit(1))).otherwise(made(F.lit("One sentence。")))
    parsed = safe.select("doc_id", drafts.strict_draft(raw, F.lit(1), F.lit("k")).alias("d"))
    return parsed.select(F.col("doc_id").alias("id"), F.col("d").isNotNull().alias("accepted"), F.when(F.col("d").isNotNull(), F.size("d.bindings")).alias("bindings"))


# State and windows


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type").isin("error", "click"), "error").otherwise("success")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.col("ts").alias("at"), status.alias("status"))


ATTEMPTS = "a AS (SELECT user_id, event_id AS pos, ts AS seen, CASE WHEN event_type IN ('error', 'click') THEN 'error' ELSE 'success' END AS status FROM events)"


@query(f"""
WITH {ATTEMPTS}, r AS (SELECT *, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seen, pos) AS run FROM a)
SELECT user_id, pos, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY seen, pos) AS BIGINT) AS failures FROM r""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.failure_streaks(attempts(spark, sf_dir), ["user_id"]).select("user_id", "pos", "failures")


@query(f"""
WITH {ATTEMPTS}, g AS (SELECT user_id, max(seen) AS last_attempt, max(seen) FILTER (status = 'success') AS last_success, count(*) AS attempts FROM a GROUP BY 1),
l AS (SELECT user_id, status, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, pos DESC) AS r FROM a)
SELECT g.user_id, last_attempt, l.status, last_success, attempts, (SELECT count(*) FROM a WHERE a.user_id = g.user_id AND status = 'error' AND (g.last_success IS NULL OR a.seen > g.last_success)) AS failures FROM g JOIN l ON l.user_id = g.user_id AND l.r = 1""")
def source_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ledger(attempts(spark, sf_dir), ["user_id"])


@query("""
WITH w AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS start)
SELECT start, count(*) AS n FROM w JOIN events ON ts >= start AND ts < start + INTERVAL 2 DAY GROUP BY 1""")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH s AS (SELECT event_id, event_type AS now_state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, now_state, before IS NULL OR (before, now_state) IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view')) AS legal FROM s""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view")], "before string, now_state string").withColumn("known", F.lit(True))
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("now_state"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    return e.join(legal, ["before", "now_state"], "left").select("event_id", "before", "now_state", (F.col("before").isNull() | F.col("known").isNotNull()).alias("legal"))


# Ranking, selection, clustering


@query(f"""
WITH {CANDIDATES}, r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY hn_score DESC, github_stars DESC, id) AS rank FROM c) SELECT id, source, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def best_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pool(candidates(spark, sf_dir), ["source"], [F.desc("hn_score"), F.desc("github_stars"), F.col("id")], 5).select("id", "source", "rank")


@query(f"""
WITH {CANDIDATES}, r AS (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY hn_score DESC, github_stars DESC, id) AS rank FROM c)
SELECT source, rtrim(left(string_agg(title, '；' ORDER BY rank), 80)) AS digest FROM r WHERE rank <= 3 GROUP BY source""")
def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = selection.pool(candidates(spark, sf_dir), ["source"], [F.desc("hn_score"), F.desc("github_stars"), F.col("id")], 3)
    titles = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"])
    return best.groupBy("source").agg(titles.alias("t")).select("source", F.rtrim(F.left(F.array_join("t", "；"), F.lit(80))).alias("digest"))


def edition_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per day of age; its pool is the best 45 candidates."""
    c = candidates(spark, sf_dir)
    run = F.coalesce(F.datediff(now(), "published_at"), F.lit(-1))
    rows = c.select("id", "title", "source", run.alias("run"), F.col("source_type").alias("topic"), F.col("title").alias("event"), (F.col("source_type") == "arxiv").alias("primary"), (F.col("source_type") == "hn").alias("radar"), (F.col("hn_score") / 5.0).alias("score"), "source_type")
    return selection.pool(rows, ["run"], [F.desc("score"), F.col("id")])


@query()
def demoted_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.demote_repeats(edition_pools(spark, sf_dir), ["run"]).select("run", "id", "rank", "place")


@query()
def selected_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_edition(edition_pools(spark, sf_dir), ["run"], 10, per_topic=4).select("run", "id", "rank", "turn")


@query()
def balanced_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of source, publishers and the entities of a title in balance, feeds making up two fifths."""
    pools = edition_pools(spark, sf_dir).withColumn("entity", anchors.entities(F.col("title"), ("tion", "eaux", "ung")))
    kinds = {"topic": {"arxiv": 2, "huggingface": 2, "hn": 7}}
    return selection.balance(pools, ["run"], 15, {"source": 4, "entity": 2}, kinds, ("topic", "rss", 6), ("source",), ("topic", "hn")).select("run", "id", "rank", "turn", "relaxed")


@query()
def diversified_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = edition_pools(spark, sf_dir).withColumn("entity", F.when(F.col("source") != "", F.col("source")))
    return selection.diversify(pools, ["run"], 15).select("run", "id", "rank", "kept")


def pool_pairs(pools: DataFrame) -> DataFrame:
    """Pairs of a pool that share a word and have similar titles: ids meet first, then each title's parts are looked up."""
    met = pools.select("run", "id", F.explode(text.words(text.clean_title(F.col("title")))).alias("word"))
    ids = met.withColumnRenamed("id", "a").join(met.withColumnRenamed("id", "b"), ["run", "word"]).where("a < b").select("run", "a", "b").distinct()
    parts = pools.groupBy("run", "id").agg(F.first(text.title_parts(F.col("title"))).alias("p"))
    of = lambda side: parts.select("run", F.col("id").alias(side), F.col("p").alias(f"p{side}"))
    sim = text.title_similarity(F.col("pa"), F.col("pb"))
    judged = ids.join(of("a"), ["run", "a"]).join(of("b"), ["run", "b"]).where(sim > 0.4)
    return judged.select("run", "a", "b", F.when(sim > 0.7, "same_event").otherwise("review").alias("relation"))


@query()
def topic_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = edition_pools(spark, sf_dir)
    return clustering.leaders(pools, pool_pairs(pools), ["run"])


@query()
def clustered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = edition_pools(spark, sf_dir)
    return clustering.events(pools, pool_pairs(pools), ["run"])


@query()
def accepted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = edition_pools(spark, sf_dir)
    return clustering.accepted_duplicates(pools, pool_pairs(pools), ["run"])


def draft_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools with what their drafts are worth: short titles are built again, titles without evidence for good rejected."""
    pools = edition_pools(spark, sf_dir)
    reason = F.when(F.length("title") < 12, "source_missing_event_detail").when(F.col("title").rlike("[0-9]"), "unsupported_number").otherwise("")
    second = F.when(reason == "unsupported_number", F.lit("")).otherwise(reason)
    return pools.select(
        "run", "id", "rank", "title", (F.col("rank") + F.when(F.col("primary"), 0).otherwise(100)).alias("strength"), (F.col("topic") == "github").alias("opinion"),
        (F.col("topic") == "hn").alias("post"), F.col("source").alias("author"), F.array(editing.attempt(reason, 1), editing.attempt(second, 2)).alias("attempts"),
    )


@query()
def edited_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = draft_pools(spark, sf_dir)
    return editing.edit(pools, pool_pairs(pools), ["run"])


def _register() -> None:
    from . import checked, choices, editions, landed, publishing, signals  # noqa: F401


def queries() -> dict[str, Query]:
    _register()
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _register()
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
