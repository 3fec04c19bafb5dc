"""Queries over headlines and landed records: people, fingerprints, editorial signals, notes, pictures, and services' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editorial, fingerprints, media, people, replies
from ..operators import relation
from ..operators.lineage import settled
from ..sources import feeds, records
from .publishing import HEADLINES, _list, _pick, headlines
from .queries import query
from .tables import NOW, now, table

PHRASES = (
    "CEO Sam Altman said so", "Jane Roe, the Chief Scientist, agreed", "Elon Musk said he would", "Acme Research Group met Bob Smith", "Ada Byron works as a director",
    "Chief Scientist Ilya Sutskever left", "The Verge, where she wrote", "山姆·奥特曼 spoke",
)
TIERS = ("primary", "research", "media", "community", "")
QUALITIES = ("ready", "ready", "thin", "ready")
ACTIVITIES = ("github_release", "new_repository", "recent_push")
ORIGINS = ("og:image", "twitter:image", "jsonld", "rss:media_content", "rss:enclosure", "html:first_img", "")
HINTS = ("cover", "logo", "photo", "avatar", "hero")
SIZES = ("1200x630", "100x100", "640x360", "800x200", "big")
TASKS = ("text-generation", "image-text-to-text", "tabular", "robotics", "")
LETTERS_ABROAD = "[À-ÖØ-öø-ɏ一-鿿]"


def _q(value: str) -> str:
    return value.replace("'", "''")


def _held(x: str, names) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({x}, '{_q(n)}') THEN '{_q(n)}' END" for n in sorted(names)) + "], lambda v: v IS NOT NULL)"


def _any(x: str, names) -> str:
    return "(" + " OR ".join(f"contains({x}, '{_q(n)}')" for n in names) + ")"


_CONTEXT = (
    f"'(?i)\\b{people.TITLE}[ \\t]+' || shown || '\\b|\\b' || name || ',[^.]{{0,80}}\\b{people.TITLE}\\b|\\b' || name || '\\b[^.]{{0,80}}{people.PRONOUNS}|\\b' || name || '\\b[^.]{{0,80}}{people.ROLE}'"
)


@query(f"""
WITH {HEADLINES}, d AS (SELECT doc_id, regexp_replace({_list(PHRASES)}[doc_id % {len(PHRASES)} + 1] || chr(10) || evidence, '{LETTERS_ABROAD}', '_', 'g') AS x, {_list(PHRASES)}[doc_id % {len(PHRASES)} + 1] || chr(10) || evidence AS whole FROM h),
l AS (SELECT doc_id, unnest(string_split_regex(x, '\\r\\n|[\\n\\r\\v\\f]')) AS line FROM d), m AS (SELECT doc_id, line, unnest(regexp_extract_all(line, '{people.NAME}', 1)) AS shown FROM l),
w AS (SELECT *, string_split_regex(lower(shown), '[ \\t]+') AS words FROM m), t AS (SELECT *, list_max(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN list_contains({_list(people.TITLE_HEADS)}, words[i]) THEN i ELSE 0 END)) AS pos FROM w),
r AS (SELECT *, list_slice(words, pos + 1, len(words)) AS rest, array_to_string(list_slice(words, pos + 1, len(words)), ' ') AS name FROM t),
k AS (SELECT doc_id, name FROM r WHERE len(rest) >= 2 AND NOT list_has_any(rest, {_list(people.DESIGNATORS)}) AND NOT list_contains({_list(people.NO_PEOPLE)}, name) AND NOT list_contains({_list(sorted({*people.ORGANIZATIONS, *people.ORGANIZATIONS.values()}))}, name) AND (pos > 0 OR regexp_matches(line, {_CONTEXT}))
    UNION ALL SELECT doc_id, 'sam altman' FROM d WHERE regexp_matches(' ' || lower(whole) || ' ', '[^a-z0-9](samuel altman|sam a\\. altman)[^a-z0-9]|山姆·奥特曼'))
SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (list_contains({_list(people.KNOWN)}, name))), '|'), '') AS people, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), '|'), '') AS candidates FROM h LEFT JOIN k USING (doc_id) GROUP BY doc_id""")
def people_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headlines(spark, sf_dir).select("doc_id", people.people(F.concat(_pick(PHRASES, F.col("doc_id") % len(PHRASES)), F.lit("\n"), "evidence")).alias("p"))
    return rows.select("doc_id", F.array_join("p.people", "|").alias("people"), F.array_join("p.candidates", "|").alias("candidates"))


_ACTS = (*(w for many in fingerprints.CATEGORIES.values() for w in many), *fingerprints.OTHER_ACTIONS)
_SETS = dict(zip(fingerprints.FIELDS, (fingerprints.FIRMS, fingerprints.PEOPLE, fingerprints.PRODUCTS, _ACTS), strict=True))
_PRINTS = f"f AS (SELECT doc_id, channel, {', '.join(f'{_held("x", names)} AS {f}' for f, names in _SETS.items())} FROM (SELECT doc_id, channel, lower(title || ' ' || evidence) AS x FROM h))"


@query(f"WITH {HEADLINES}, {_PRINTS} SELECT doc_id, {', '.join(f'array_to_string({f}, {chr(39)}|{chr(39)}) AS {f}' for f in fingerprints.FIELDS)} FROM f")
def event_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headlines(spark, sf_dir).select("doc_id", fingerprints.fingerprint(F.col("title"), F.col("evidence")).alias("f"))
    return rows.select("doc_id", *[F.array_join(f"f.{f}", "|").alias(f) for f in fingerprints.FIELDS])


_SAME = " OR ".join(f"(list_has_any(a.actions, {_list(words)}) AND list_has_any(b.actions, {_list(words)}))" for words in fingerprints.CATEGORIES.values())
_KEY = "(CAST({0}.channel = 'rss' AS INTEGER), {0}.doc_id % 3, CASE WHEN {0}.doc_id % 5 = 0 THEN 1 WHEN {0}.doc_id % 5 = 1 THEN 2 ELSE 3 END, CAST({0}.doc_id % 2 = 0 AS INTEGER), CAST({0}.doc_id % 9 AS DOUBLE))"


@query(f"""
WITH {HEADLINES}, {_PRINTS}
SELECT a.doc_id AS a, b.doc_id AS b, {', '.join(f'CAST(len(list_intersect(a.{f}, b.{f})) AS INTEGER) AS shared_{f}' for f in fingerprints.FIELDS)}, ({_SAME}) AS same_category,
    CASE WHEN {_KEY.format('a')} >= {_KEY.format('b')} THEN a.doc_id ELSE b.doc_id END AS keeper FROM f a JOIN f b ON b.doc_id = a.doc_id + 1""")
def fingerprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report held against the one of the next id: what their fingerprints share, and which of the two would stay."""
    n = F.col("doc_id")
    confidence = F.when(n % 5 == 0, "low").when(n % 5 == 1, "medium").otherwise("high")
    key = fingerprints.keeper_key(F.col("channel"), n % 3, confidence, n % 2 == 0, (n % 9).cast("double"))
    # Both sides read the fingerprints, so the texts are searched once.
    rows = settled(headlines(spark, sf_dir).select("doc_id", fingerprints.fingerprint(F.col("title"), F.col("evidence")).alias("f"), key.alias("key")))
    a = rows.select(n.alias("a"), (n + 1).alias("b"), F.col("f").alias("fa"), F.col("key").alias("ka"))
    both = a.join(rows.select(n.alias("b"), F.col("f").alias("fb"), F.col("key").alias("kb")), "b")
    shared = fingerprints.overlap(F.col("fa"), F.col("fb"))
    return both.select(
        "a", "b", *[F.size(shared[f"shared_{f}"]).alias(f"shared_{f}") for f in fingerprints.FIELDS],
        fingerprints.same_category(F.col("fa.actions"), F.col("fb.actions")).alias("same_category"), F.when(F.col("ka") >= F.col("kb"), F.col("a")).otherwise(F.col("b")).alias("keeper"),
    )


def _first(x: str, names: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {_any(x, many)} THEN '{n}'" for n, many in names.items()) + " ELSE '' END"


_SIGNALS = f"""
s0 AS (SELECT *, lower(title || ' ' || title || ' ' || evidence || ' ' || evidence) AS x, doc_id % 80 AS hours, CASE WHEN doc_id % 13 = 0 THEN '' ELSE url END AS link, {_list(TIERS)}[doc_id % 5 + 1] AS tier, {_list(ACTIVITIES)}[doc_id % 3 + 1] AS activity FROM h),
s1 AS (SELECT *, {_first('x', editorial.WHO)} AS who, {_first('x', editorial.WHAT)} AS what, regexp_replace(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    regexp_replace(regexp_replace(lower(trim(string_split(title, ':')[1])), '[^a-z0-9._/-]+', '-', 'g'), '^-+|-+$', '', 'g') AS repo, trim(title) <> '' AND trim(evidence) <> '' AND link <> '' AND doc_id % 17 <> 0 AS complete FROM s0),
s2 AS (SELECT *, CASE WHEN slug = '' THEN 'unknown' ELSE left(slug, 80) END AS topic, CASE WHEN channel = 'github' THEN CASE activity WHEN 'github_release' THEN 'github_release' WHEN 'new_repository' THEN 'github_new_repository' ELSE 'github_activity' END WHEN what <> '' THEN what ELSE 'news' END AS event_type,
    CASE WHEN doc_id % 17 = 0 THEN 0.0 WHEN hours <= 6 THEN 2.0 WHEN hours <= 24 THEN 1.8 WHEN hours <= 36 THEN 1.5 WHEN hours <= 72 THEN 0.8 ELSE 0.2 END AS fresh FROM s1),
s3 AS (SELECT *, CASE WHEN channel = 'github' THEN CASE event_type WHEN 'github_release' THEN 'github-release:' WHEN 'github_new_repository' THEN 'github-new:' ELSE 'github-activity:' END || CASE WHEN repo = '' THEN 'unknown' ELSE repo END
        WHEN who <> '' AND what <> '' THEN 'event:' || who || ':' || what WHEN what <> '' THEN 'event:' || what || ':' || topic ELSE 'topic:' || topic END AS event_key,
    CAST(round_even(least(CASE WHEN complete THEN 3.0 ELSE 0.8 END + fresh + CASE tier WHEN 'primary' THEN 2.5 WHEN 'research' THEN 2.2 WHEN 'media' THEN 1.8 WHEN '' THEN 1.8 ELSE 1.0 END + CASE WHEN event_type IN ('news', 'lawsuit', 'funding', 'waic', 'conference') THEN 2.0 ELSE 1.2 END,
        CASE event_type WHEN 'github_activity' THEN 7.4 WHEN 'github_new_repository' THEN 8.4 ELSE 10.0 END), 1) AS DOUBLE) AS score FROM s2)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with their event, evidence and score; ids say what else a candidate would have."""
    n, title = F.col("doc_id"), F.col("title")
    rows = headlines(spark, sf_dir).withColumn("at", F.when(n % 17 != 0, now() - F.make_dt_interval(hours=(n % 80).cast("int")))).withColumn("link", F.when(n % 13 == 0, "").otherwise(F.col("url")))
    text = editorial.source_text(title, title, F.col("evidence"), F.col("evidence"))
    event = editorial.event_identity(text, F.col("channel"), editorial.topic_of(F.lit(""), title, title), title, _pick(ACTIVITIES, n % 3), F.lit(""))
    told = rows.withColumn("event", event).withColumn("complete", editorial.evidence_complete(title, F.col("evidence"), F.col("link"), F.col("at"))).withColumn("tier", _pick(TIERS, n % 5))
    return told.withColumn("signals", editorial.signals(F.col("event.type"), F.col("complete"), F.col("tier"), F.col("at"), now()))


@query(f"""
WITH {HEADLINES}, {_SIGNALS}
SELECT doc_id, event_type, event_key, complete, score, array_to_string(list_filter([CASE WHEN NOT complete THEN 'incomplete_source_evidence' END, CASE WHEN fresh < 1.5 THEN 'stale_or_missing_timestamp' END,
    CASE event_type WHEN 'github_activity' THEN 'github_activity_not_release' WHEN 'github_new_repository' THEN 'github_new_repository' WHEN 'github_release' THEN 'github_release_evidence' END], lambda v: v IS NOT NULL), '|') AS reasons FROM s3""")
def editorial_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("doc_id", F.col("event.type").alias("event_type"), F.col("event.key").alias("event_key"), "complete", "signals.score", F.array_join("signals.reasons", "|").alias("reasons"))


@query(f"""
WITH {HEADLINES}, {_SIGNALS}, a AS (SELECT doc_id, doc_id % 4 AS crossed, {_list(QUALITIES)}[doc_id % 4 + 1] AS quality, doc_id % 19 = 0 AS risky, doc_id % 23 = 0 AS unsure, CAST(round_even(greatest(0.0, least(score, 10.0)), 1) AS DOUBLE) AS importance,
    greatest(0.0, least(CASE WHEN complete THEN 8.0 ELSE 4.0 END + CASE WHEN tier IN ('primary', 'research') THEN 0.5 ELSE 0.0 END + least((doc_id % 4) * 0.5, 1.0), 10.0)) AS raw FROM s3),
b AS (SELECT *, CAST(CASE WHEN quality = 'ready' THEN round_even(raw, 1) ELSE least(round_even(raw, 1), 2.0) END AS DOUBLE) AS evidence FROM a),
b1 AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(importance * CAST(0.7 AS DOUBLE) + evidence * CAST(0.3 AS DOUBLE), CAST(10 AS DOUBLE))) AS v FROM b), b2 AS (SELECT *, v * 8 + v * 2 AS s, (v * 8 + v * 2) - v * 8 AS back FROM b1),
b3 AS (SELECT *, (v * 8 - (s - back)) + (v * 2 - back) AS lost, floor(s) AS whole FROM b2),
c AS (SELECT *, (whole + CASE WHEN s - whole > 0.5 OR (s - whole = 0.5 AND (lost > 0 OR (lost = 0 AND whole % 2 <> 0))) THEN 1 ELSE 0 END) / CAST(10 AS DOUBLE) AS impact, CASE WHEN quality <> 'ready' OR risky THEN 'high' WHEN evidence < 6 OR unsure THEN 'medium' ELSE 'low' END AS risk FROM b3)
SELECT doc_id, importance, evidence, impact, risk, CASE WHEN importance >= 8 THEN '{editorial.IMPORTANCE[0]}' WHEN importance >= 5 THEN '{editorial.IMPORTANCE[1]}' ELSE '{editorial.IMPORTANCE[2]}' END AS importance_reason,
    CASE WHEN quality <> 'ready' THEN '{editorial.QUALITY}' || quality || ': {editorial.UNAVAILABLE}' WHEN evidence >= 8 THEN '{editorial.VERIFIABLE[0]}' || crossed || '{editorial.VERIFIABLE[1]}' ELSE '{editorial.UNVERIFIABLE}' END AS verifiability_reason,
    CASE WHEN risk = 'high' THEN '{editorial.IMPACT[0]}' WHEN impact >= 8 THEN '{editorial.IMPACT[1]}' ELSE '{editorial.IMPACT[2]}' END AS impact_analysis FROM c""")
def analyst_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    made = editorial.analysis(F.col("signals.score"), F.col("complete"), F.col("tier"), n % 4, _pick(QUALITIES, n % 4), F.lit(""), n % 19 == 0, n % 23 == 0)
    return _signals(spark, sf_dir).select("doc_id", made.alias("a")).select("doc_id", "a.*")


_POINTS = f"""50 + CASE WHEN {_any('u', media.BAD_HINTS)} THEN -45 ELSE 0 END + CASE WHEN regexp_matches(string_split(u, '?')[1], '{media.ENDINGS}') THEN 10 ELSE 0 END + CASE WHEN contains(origin, 'og') OR contains(origin, 'twitter') THEN 18 ELSE 0 END
    + CASE WHEN contains(origin, 'jsonld') THEN 15 ELSE 0 END + CASE WHEN starts_with(origin, 'rss:media') OR origin = 'rss:enclosure' THEN 16 ELSE 0 END + CASE WHEN origin IN ('html:first_img', 'html:srcset') THEN 8 ELSE 0 END
    + CASE WHEN contains(u, '?') AND (contains(u, 'width=') OR contains(u, 'w=') OR contains(u, 'height=') OR contains(u, 'h=')) THEN 4 ELSE 0 END"""


@query(f"""
WITH u AS (SELECT doc_id, 'https://cdn.example.com/' || {_list(HINTS)}[doc_id % 5 + 1] || '-' || {_list(SIZES)}[doc_id // 5 % 5 + 1] || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.gif' END || CASE WHEN doc_id % 3 = 0 THEN '?w=10' ELSE '' END AS u, {_list(ORIGINS)}[doc_id % 7 + 1] AS origin FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT *, {_POINTS} AS points, regexp_extract(u, '(\\d{{2,4}})x(\\d{{2,4}})', ['w', 'h']) AS s FROM u),
q AS (SELECT *, TRY_CAST(s.w AS INTEGER) AS w, TRY_CAST(s.h AS INTEGER) AS hh FROM p)
SELECT doc_id, CAST(greatest(0, least(100, points + CASE WHEN w IS NULL THEN 0 ELSE CASE WHEN w < 300 OR hh < 160 THEN -35 WHEN w >= 600 AND hh >= 300 THEN 12 ELSE 0 END + CASE WHEN w / CAST(hh AS DOUBLE) BETWEEN 1.2 AND 2.4 THEN 8 ELSE 0 END END)) AS INTEGER) AS score FROM q""")
def picture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    url = F.concat(F.lit("https://cdn.example.com/"), _pick(HINTS, n % 5), F.lit("-"), _pick(SIZES, F.floor(n / 5) % 5), F.when(n % 2 == 0, ".jpg").otherwise(".gif"), F.when(n % 3 == 0, "?w=10").otherwise(""))
    return table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", media.image_score(url, _pick(ORIGINS, n % 7)).alias("score"))


def _anchors(x: str) -> str:
    bare = f"list_transform(regexp_extract_all({x}, '{media.TOKEN}', 1), lambda t: trim(t, '.-'))"
    return f"""list_distinct(list_transform(regexp_extract_all({x}, '(?:^|[^a-z0-9])((?:gpt|claude|gemini|llama|qwen|deepseek|model)[- ]?[a-z]*\\d[a-z0-9_.+-]*)', 1), lambda m: 'model:' || regexp_replace(m, '\\s+', '-', 'g'))
        || list_transform(list_filter({bare}, lambda t: t <> '' AND NOT list_contains({_list((*media.GENERIC, *media.FIRMS))}, t)), lambda t: 'token:' || t))"""


@query(f"""
WITH {HEADLINES}, p AS (SELECT a.doc_id, list_sort(list_intersect({_anchors('lower(a.title)')}, {_anchors('lower(b.evidence)')})) AS shared FROM h a JOIN h b ON b.doc_id = a.doc_id + 8),
k AS (SELECT doc_id, list_filter(shared, lambda v: starts_with(v, 'model:')) AS models, list_filter(shared, lambda v: starts_with(v, 'token:')) AS tokens FROM p)
SELECT doc_id, len(models) > 0 OR len(tokens) >= 2 AS accepted, CASE WHEN len(models) > 0 THEN 'shared_model_anchor' WHEN len(tokens) >= 2 THEN 'shared_event_anchors' ELSE 'missing_semantic_anchor' END AS reason,
    array_to_string(CASE WHEN len(models) > 0 THEN models ELSE tokens END, '|') AS anchors FROM k""")
def picture_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title against the whole evidence of the report eight ids on, as if that stood under a picture."""
    h = headlines(spark, sf_dir)
    both = h.select("doc_id", "title").join(h.select((F.col("doc_id") - 8).alias("doc_id"), F.col("evidence").alias("said")), "doc_id")
    return both.select("doc_id", media.picture_relevance(F.col("title"), F.col("said")).alias("r")).select("doc_id", "r.accepted", "r.reason", F.array_join("r.anchors", "|").alias("anchors"))


RELATED_HOURS = 6.0


def related_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines as eight reports an hour: posts of a hundred ids make a thread. Beyond 2^31 hours, the most that an interval counts, the hours begin anew."""
    n = F.col("doc_id")
    hours = (F.floor(n / 8) % 2**31).cast("int")
    said = F.concat(_pick(PHRASES, n % len(PHRASES)), F.lit("\n"), "evidence")
    return headlines(spark, sf_dir).select(
        n.alias("id"), "title", said.alias("evidence"), F.when(n % 3 == 0, F.concat("url", F.lit("#"), n.cast("string"))).otherwise(F.concat(F.lit("https://x.com/u/status/"), n.cast("string"))).alias("url"),
        F.when(F.col("channel") == "x", F.floor(n / 100).cast("string")).alias("thread_id"), n.cast("string").alias("item_id"), (now() - F.make_dt_interval(hours=hours)).alias("published_at"),
    )


@query()
def related_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation.related_counts(relation.documents(related_sources(spark, sf_dir)), RELATED_HOURS)


# Records of services. The driver's tables stand for what was landed.


def landed_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as repositories with a release and a README each."""
    n = F.col("p_partkey")
    time = lambda days: F.date_format(now() - F.make_dt_interval(days=days.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    release = F.struct(
        F.concat(F.lit("v1."), (n % 9).cast("string")).alias("tag_name"), F.concat(F.lit("https://github.com/r/"), n.cast("string")).alias("html_url"),
        F.concat(F.lit("Adds  support for "), "p_name", F.lit(" and\nfixes the "), "p_type").alias("body"), time(n % 15).alias("published_at"), (n % 11 == 0).alias("draft"), (n % 13 == 0).alias("prerelease"),
    )
    readme = F.concat(F.lit("<!-- c -->\n# "), "p_name", F.lit("\n![](x.png)\n\n- A [tool](https://a.b/c) for "), "p_type", F.lit("\n> quoted ![i](j.png) text\n"))
    return table(spark, sf_dir, "part").select(
        n.alias("id"), F.concat("p_brand", F.when(n % 10 == 0, "/awesome-").otherwise("/tool-"), n.cast("string")).alias("full_name"), F.when(n % 4 != 0, F.col("p_name")).alias("description"), F.lit("https://github.com/x").alias("html_url"),
        time(n % 30).alias("created_at"), F.when(n % 5 != 0, time(n % 12)).alias("pushed_at"), (n % 40).alias("stargazers_count"), F.col("p_size").cast("long").alias("forks_count"), F.array("p_brand").alias("topics"), F.struct(F.col("p_brand").alias("login")).alias("owner"),
        release.alias("release"), F.when(n % 7 != 0, readme).alias("readme"),
    )


_TIME = "strftime(TIMESTAMP '{0}' - to_days(CAST({1} AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ')"
_REPOS = f"""r AS (SELECT p_partkey AS n, p_brand || CASE WHEN p_partkey % 10 = 0 THEN '/awesome-' ELSE '/tool-' END || p_partkey AS full_name, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE '' END AS about, p_name, p_type, p_brand, p_partkey % 40 AS stars, p_size AS forks,
    TIMESTAMP '{NOW}' - to_days(CAST(p_partkey % 30 AS INTEGER)) AS made, CASE WHEN p_partkey % 5 <> 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(p_partkey % 12 AS INTEGER)) END AS pushed, TIMESTAMP '{NOW}' - to_days(CAST(p_partkey % 15 AS INTEGER)) AS released FROM part),
g AS (SELECT *, coalesce(pushed >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND pushed > made, false) AS active FROM r WHERE stars >= 5 AND NOT {_any('lower(full_name)', records.LISTS)} AND NOT {_any('lower(about)', records.LISTS)})"""


@query(f"""
WITH {_REPOS}
SELECT 'github-' || n AS id, left(full_name || CASE WHEN trim(about) <> '' THEN ': ' || trim(about) ELSE '' END, 200) AS title, CASE WHEN active THEN pushed ELSE made END AS published_at, CASE WHEN active THEN 'recent_push' ELSE 'new_repository' END AS activity,
    left(trim('GitHub ' || CASE WHEN active THEN '近期推送活跃' ELSE '近期开源' END || '项目，当前 ' || stars || ' stars、' || forks || ' forks。' || trim(about)), 300) AS summary, p_brand AS author, CAST(round_even(ln(1 + stars) * 3 + ln(1 + forks) * 1.5 + CASE WHEN active THEN 8.0 ELSE 5.0 END, 1) AS DOUBLE) AS hotness FROM g""")
def repository_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.repositories(landed_repositories(spark, sf_dir), now() - F.expr("INTERVAL 7 DAYS")).select("id", "title", "published_at", "activity", "summary", "author", "hotness")


@query(f"""
WITH {_REPOS}, s AS (SELECT *, CASE WHEN n % 7 <> 0 THEN trim(p_name) || ' A tool for ' || trim(p_type) || ' quoted  text' ELSE trim(about) END AS told, 'Adds support for ' || p_name || ' and fixes the ' || p_type AS notes FROM g),
t AS (SELECT *, trim(left(trim(regexp_replace(told, '\\s+', ' ', 'g')), 600)) AS what, trim(left(trim(regexp_replace(notes, '\\s+', ' ', 'g')), 1400)) AS new FROM s)
SELECT 'github-release-' || n || '-v1.' || n % 9 AS id, full_name || ' releases v1.' || n % 9 AS title, released AS published_at, left('GitHub Release v1.' || n % 9 || '. Project: ' || what || '. Release notes: ' || new, 2000) AS summary, CAST(round_even(ln(1 + stars) * 3 + ln(1 + forks) * 1.5 + 12.0, 1) AS DOUBLE) AS hotness
FROM t WHERE n % 11 <> 0 AND n % 13 <> 0 AND released >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND length(what) >= 24 AND length(new) >= 40""")
def release_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.releases(landed_repositories(spark, sf_dir), now() - F.expr("INTERVAL 7 DAYS")).select("id", "title", "published_at", "summary", "hotness")


@query(f"""
WITH m AS (SELECT c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/' || c_mktsegment END AS id, CASE {' '.join(f"WHEN c_custkey % 5 = {i} THEN '{records.TASK_NAMES.get(t, t)}'" for i, t in enumerate(TASKS))} END AS named, c_custkey % 3 = 1 AS tagged, c_custkey % 30 AS likes, c_custkey * 37 % 9000 AS loads, c_custkey, c_mktsegment, c_name FROM customer),
k AS (SELECT *, CASE WHEN list_contains({_list(records.TASKS)}, named) THEN named WHEN tagged THEN 'robotics' ELSE '' END AS task FROM m),
c AS (SELECT *, CASE task {' '.join(f"WHEN '{t}' THEN '{n}'" for t, n in records.CATEGORIES.items())} ELSE task END AS category FROM k WHERE task <> '' AND (likes >= 10 OR (likes >= 3 AND loads >= 5000)))
SELECT 'hf-' || id AS id, CASE WHEN c_custkey % 4 = 0 THEN 'Card ' || c_mktsegment || ' (' || id || ')' ELSE id END AS title, left('Hugging Face 模型，类型：' || category || '；点赞 ' || likes || '，累计下载 ' || loads || '。' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, 300) AS summary,
    CASE WHEN contains(id, '/') THEN c_name ELSE '' END AS author, CASE WHEN c_custkey % 6 <> 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(c_custkey % 20 AS INTEGER)) END AS published_at, CAST(round_even(ln(1 + likes) * 3 + ln(1 + loads) * 0.5, 1) AS DOUBLE) AS hotness, likes < 10 AS by_downloads FROM c""")
def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as landed models."""
    n = F.col("c_custkey")
    time = F.date_format(now() - F.make_dt_interval(days=(n % 20).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    landed = table(spark, sf_dir, "customer").select(
        F.concat("c_name", F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("/"), "c_mktsegment"))).alias("id"), F.lit("").alias("modelId"), _pick(TASKS, n % 5).alias("pipeline_tag"), F.when(n % 3 == 1, F.array(F.lit("tag"), F.lit("robotics"))).alias("tags"),
        (n % 30).alias("likes"), (n * 37 % 9000).alias("downloads"), F.when(n % 2 == 0, F.col("c_mktsegment")).alias("description"), F.lit(None).cast("string").alias("author"), F.when(n % 6 != 0, time).otherwise("yesterday").alias("lastModified"),
        F.struct(F.when(n % 4 == 0, F.concat(F.lit("Card "), "c_mktsegment")).alias("model_name"), F.lit("").alias("description")).alias("cardData"),
    )
    return records.models(landed).select("id", "title", "summary", "author", "published_at", "hotness", "by_downloads")


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""
WITH p AS (SELECT doc_id, coalesce(source, '') || ' &amp; ' || coalesce(lang, '') AS title, coalesce(text, '') AS summary, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Ann' ELSE 'Ann et al.' END AS who FROM documents WHERE doc_id IS NOT NULL)
SELECT CASE WHEN doc_id % 5 = 0 THEN 'arxiv-' ELSE 'arxiv-2401.' || doc_id END AS id, left({_STRIP.format("replace(title, '&amp;', '&')")} || ' [' || who || ']', 200) AS title, CASE WHEN doc_id % 5 = 0 THEN 'urn:' || doc_id ELSE 'https://arxiv.org/abs/2401.' || doc_id END AS url,
    left({_STRIP.format("replace(replace(replace(replace(summary, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")}, 300) AS summary, who AS author, CASE WHEN doc_id % 2 = 0 THEN 'cs.CL|paper|research' ELSE 'paper|research' END AS tags, {_any("lower(title || ' ' || summary)", records.PAPER_WORDS)} AS core FROM p""")
def paper_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as landed papers; whether a paper is at the core of the field is told by its whole text."""
    n = F.col("doc_id")
    authors = F.when(n % 3 == 0, F.array().cast("array<struct<name:string>>")).when(n % 3 == 1, F.array(F.struct(F.lit("Ann").alias("name")))).otherwise(F.array(F.struct(F.lit("Ann").alias("name")), F.struct(F.lit("Bob").alias("name"))))
    landed = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(
        F.when(n % 5 == 0, F.concat(F.lit("urn:"), n.cast("string"))).otherwise(F.concat(F.lit("http://arxiv.org/abs/2401."), n.cast("string"))).alias("id"), F.concat(F.coalesce("source", F.lit("")), F.lit(" &amp; "), F.coalesce("lang", F.lit(""))).alias("title"),
        F.coalesce("text", F.lit("")).alias("summary"), authors.alias("authors"), now().alias("published"), F.when(n % 2 == 0, "cs.CL").otherwise("").alias("primary_category"),
    )
    return records.papers(landed).select("id", "title", "url", "summary", "author", F.array_join("tags", "|").alias("tags"), "core")


@query(f"""
WITH p AS (SELECT conv_id, turn, conv_id * 1000 + turn AS number, {_STRIP.format("coalesce(text, '')")} AS text, role FROM conversations)
SELECT 'x-' || number AS id, left(role || ': ' || left(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')), 180), 200) AS title, 'https://x.com/' || role || '/status/' || number AS url, left(text, 900) AS summary
FROM p WHERE text <> '' AND turn % 5 <> 3 AND conv_id % 7 <> 0 AND conv_id % 11 <> 0""")
def post_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as landed posts; some lack a tier, some have another's address, some only repeat."""
    number = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    whose = F.when(F.col("conv_id") % 7 == 0, "other").otherwise(F.col("role"))
    landed = table(spark, sf_dir, "conversations").select(
        number.alias("tweet_id"), "text", F.concat(F.lit("https://x.com/"), whose, F.lit("/status/"), number).alias("url"), F.col("role").alias("source_name"), F.concat(F.lit("@"), "role").alias("source_handle"), F.col("role").alias("author"),
        F.when(F.col("conv_id") % 11 != 0, "media").alias("source_tier"), now().alias("created_at"), (F.col("turn") % 5 == 3).alias("is_repost"),
    )
    return records.posts(landed).select("id", "title", "url", "summary")


@query("""
WITH e AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') || '<IMG alt="x" src="' || coalesce(url, '') || '/i.png"><img src="data:x">' AS h FROM pages),
c AS (SELECT page_id, unnest([{'place': 0, 'url': u || '/a.png', 'source': 'rss:media_content'}, {'place': 2, 'url': u || '/l.png', 'source': 'rss:link'}, {'place': 3, 'url': u || '/e.bin', 'source': 'rss:link'}, {'place': 4, 'url': u || '/q?a=1&b=2', 'source': 'rss:enclosure'}]
    || list_transform(regexp_extract_all(h, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), lambda x, i: {'place': 10 + i, 'url': trim(replace(x, '&amp;', '&')), 'source': 'rss:html_img'}), recursive := true) FROM e),
f AS (SELECT page_id, url, min(place) AS place, arg_min(source, place) AS source FROM c WHERE url <> '' AND NOT starts_with(url, 'data:') GROUP BY page_id, url)
SELECT page_id, string_agg(source || ' ' || url, '|' ORDER BY place) AS images FROM f GROUP BY page_id""")
def feed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as entries of feeds: media, links of several kinds, enclosures and the whole markup."""
    none = F.lit(None).cast("string")
    linked = lambda url=none, href=none, kind=none, rel=none: F.struct(url.alias("url"), href.alias("href"), kind.alias("type"), rel.alias("rel"))
    at = lambda end: F.concat(F.coalesce("url", F.lit("")), F.lit(end))
    markup = F.concat(F.coalesce("html", F.lit("")), F.lit('<IMG alt="x" src="'), at("/i.png"), F.lit('"><img src="data:x">'))
    links = F.array(linked(href=at("/l.png"), kind=F.lit("image/png")), linked(href=at("/n.html"), kind=F.lit("text/html"), rel=F.lit("alternate")), linked(url=at("/e.bin"), rel=F.lit("ENCLOSURE")))
    enclosures = F.array(linked(href=at("/l.png"), kind=F.lit("image/png")), linked(url=at("/q?a=1&amp;amp;b=2 "), kind=F.lit("IMAGE/JPEG")), linked(url=at("/s.mp3"), kind=F.lit("audio/mpeg")))
    images = feeds.entry_images(F.array(linked(url=at("/a.png"))), F.array(linked(href=at("/a.png")), linked(url=F.lit("data:x"))), links, enclosures, F.array(markup))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(images, lambda x: F.concat(x["source"], F.lit(" "), x["url"])), "|").alias("images"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 6 AS way, trim(coalesce(text, '')) AS t, coalesce(source, '-') AS s FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN way IN (0, 1, 2) THEN 2 WHEN way = 3 THEN 1 END AS items, CASE WHEN way < 4 THEN doc_id END AS number, CASE WHEN way < 4 AND t <> '' THEN t || s END AS brief, way IN (0, 1, 2, 4) AS holds_object FROM d""")
def repaired_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as replies about them: bare, fenced, amid prose, a list alone, an object too deep for the lenient reading, and none."""
    n, words = F.col("doc_id"), F.trim(F.coalesce("text", F.lit("")))
    item = lambda number: F.to_json(F.struct(number.alias("index"), F.array(words, F.coalesce("source", F.lit("-"))).alias("brief")))
    flat = F.to_json(F.struct(n.alias("index"), F.lit(" x ").alias("brief")))
    listed = F.concat(F.lit('{"items": ['), item(F.concat(F.lit(" "), n.cast("string"))), F.lit(", "), flat, F.lit("]}"))
    ways = [
        F.concat(F.lit(" \n"), listed), F.concat(F.lit("Here it is:\n```json\n"), listed, F.lit("\n```\nand so on {")), F.concat(F.lit("Sure. "), listed, F.lit(" Anything else?")),
        F.concat(F.lit("["), item(n), F.lit("]")), F.concat(F.lit('{ no: {"a": {"b": {"c": "'), n.cast("string"), F.lit('"}}} tail')), F.concat(F.lit("Sorry, "), n.cast("string"), F.lit(" cannot be told.")),
    ]
    reply = F.element_at(F.array(*ways), (n % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", replies.extracted(reply).alias("value"), replies.first_object(reply).alias("object"))
    read = rows.select("doc_id", "object", replies.items(F.col("value")).alias("items"))
    first = F.get("items", F.lit(0))
    return read.select("doc_id", F.nullif(F.size("items"), F.lit(-1)).alias("items"), replies.index_of(first).alias("number"), replies.brief_of(first).alias("brief"), F.col("object").isNotNull().alias("holds_object"))
