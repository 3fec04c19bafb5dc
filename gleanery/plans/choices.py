"""Queries of what became of candidates: choices, audits, and a second selection beside the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, summaries, verdicts
from ..functions.text import summary_sentences
from ..operators import choices, clustering, editing, selection
from .publishing import OBJECTS, _list, _pick
from .queries import draft_pools, edition_pools, pool_pairs, query
from .tables import CANDIDATES, candidates, now, table

#: Rows of a run of two selections, and the length of each.
RUN, TARGET = 100, 10
RISKS = ("low", "medium", "high", "low", "medium")


def choice_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of runs and their analyses, which every seventh lacks."""
    c = candidates(spark, sf_dir).where("id IS NOT NULL")
    n = F.col("id")
    rows = c.select(
        F.floor(n / RUN).alias("run"), "id", "pos", "title", "source", "source_type", (n % 4 == 0).alias("primary"), (n % 9 == 0).alias("radar"), F.when(n % 3 == 0, F.concat(F.lit("Topic "), (n % 7).cast("string"))).alias("topic_key"),
        F.when(n % 5 == 0, F.concat(F.lit("event:"), (n % 25).cast("string"))).alias("event_key"), (F.col("hn_score") / 5.0).alias("editorial_score"), F.col("github_stars").cast("double").alias("score"),
        F.when(n % 6 == 5, "partial").otherwise("ready").alias("content_quality"), F.when(n % 12 == 5, "cut off").otherwise("").alias("quality_reason"),
    )
    analyses = c.where(n % 7 != 6).select(F.floor(n / RUN).alias("run"), "id", _pick(RISKS, n % len(RISKS)).alias("risk_level"), F.concat(F.lit("because of "), n.cast("string")).alias("importance_reason"))
    return rows, analyses


@query()
def editorial_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, analyses = choice_inputs(spark, sf_dir)
    return choices.editorial_choice(rows, analyses, "run", TARGET, per_topic=3)


@query()
def candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of the edition loop with the one state in which it ended."""
    all_rows = candidates(spark, sf_dir).where("id IS NOT NULL").select(F.coalesce(F.datediff(now(), "published_at"), F.lit(-1)).alias("run"), "id")
    pools = edition_pools(spark, sf_dir).where("id IS NOT NULL")
    pairs = pool_pairs(pools)
    clustered = clustering.events(pools, pairs, ["run"])
    events = clustered.where("state = 'event'").select("run", "id")
    drafts = draft_pools(spark, sf_dir).join(events, ["run", "id"], "left_semi")
    kept = pairs.join(events.select("run", F.col("id").alias("a")), ["run", "a"], "left_semi").join(events.select("run", F.col("id").alias("b")), ["run", "b"], "left_semi")
    edited = editing.edit(drafts, kept, ["run"])
    return choices.audit("run", all_rows, pools.select("run", "id"), clustered, edited)


@query("""
WITH d AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), '.', '！'), '[。！？!?]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
e AS (SELECT id, s, list_filter(s, lambda x, i: i % 2 = 1) AS f FROM d),
r AS (SELECT id, list_filter(s, lambda x, i: len(list_filter(s[1:i], lambda y: y = x)) > len(list_filter(f, lambda y: y = x))) AS r FROM e)
SELECT id, len(r) AS removed, array_to_string(r, '|') AS sentences FROM r""")
def removed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that a shorter text lacks: here every text against itself without each second sentence."""
    d = candidates(spark, sf_dir).select("id", summary_sentences(F.translate("summary", ".", "！")).alias("s"))
    told = choices.removed_sentences(F.col("s"), F.filter("s", lambda _, i: i % 2 == 0))
    return d.select("id", told.alias("r")).select("id", F.size("r").cast("long").alias("removed"), F.array_join("r", "|").alias("sentences"))


def _cleaned(x: str, most: int) -> str:
    """`evidence.readable` in SQL, for texts without markup."""
    out = f"coalesce({x}, '')"
    for shape, kept in evidence.MARKDOWN:
        out = "regexp_replace({0}, '{1}', '{2}', 'g')".format(out, shape.replace("(?dm)", "(?m)").replace("'", "''"), kept.replace("$1", chr(92) + "1"))
    return f"trim(left(trim({out}), {most}))"


_PLAIN = "CASE WHEN contains(coalesce(text, ''), '<') OR contains(coalesce(text, ''), '&') THEN '' ELSE coalesce(text, '') END"


@query(f"""
WITH d AS (SELECT doc_id AS id, doc_id % 6 AS k, {_PLAIN} AS x FROM documents), p AS (SELECT *, {_cleaned('x', evidence.PURPOSE)} AS purpose, CASE WHEN id % 4 = 0 THEN 'See CHANGELOG.md' ELSE {_cleaned('x', evidence.CHANGES)} END AS notes, {_cleaned('x', evidence.SUMMARY)} AS own, {_cleaned('left(x, 30)', evidence.SUMMARY)} AS little FROM d)
SELECT id, CASE WHEN k IN (0, 1) THEN CASE WHEN purpose = '' OR length(CASE WHEN id % 4 = 0 THEN '' ELSE notes END) < {evidence.LEAST} THEN 'missing' ELSE 'ready' END WHEN k = 2 THEN 'metadata_only'
        WHEN k IN (3, 4) THEN CASE WHEN length(little) >= {evidence.LEAST} OR (k = 4 AND length(own) >= {evidence.LEAST}) THEN 'ready' WHEN little = '' THEN 'missing' ELSE 'too_short' END ELSE 'ready' END AS quality,
    CASE WHEN k IN (0, 1) THEN CASE WHEN purpose = '' THEN '' WHEN id % 4 = 0 OR length(notes) < {evidence.LEAST} THEN '{evidence.PURPOSE_LABEL}' || purpose ELSE '{evidence.PURPOSE_LABEL}' || purpose || chr(10) || CASE WHEN k = 0 THEN '{evidence.TAGGED.format('v' + "1")}' ELSE '{evidence.UNTAGGED}' END || notes END WHEN k = 2 THEN ''
        WHEN k IN (3, 4) THEN CASE WHEN length(little) >= {evidence.LEAST} THEN little WHEN k = 4 AND length(own) >= {evidence.LEAST} THEN own ELSE little END ELSE own END AS summary,
    CASE WHEN k = 2 THEN 'https://a.example/x' WHEN k = 3 THEN 'https://news.ycombinator.com/item?id=2' ELSE 'https://b.example/y' END AS url FROM p""")
def shadow_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without markup as releases, a forum's entries and posts, and other sources: what there is to write from."""
    c = candidates(spark, sf_dir)
    n, k = F.col("id"), F.col("id") % 6
    x = F.when(F.col("summary").contains("<") | F.col("summary").contains("&"), "").otherwise(F.col("summary"))
    said = F.when(k == 2, "\nArticle URL: https://a.example/x\nComments URL: https://news.ycombinator.com/item?id=1\n").when(k.isin(3, 4), F.left(x, F.lit(30))).otherwise(x)
    kind = F.when(k < 2, "github").when(k == 2, "rss").when(k < 5, "hn").otherwise("rss")
    url = F.when(k == 3, "https://news.ycombinator.com/item?id=2").otherwise("https://b.example/y")
    made = evidence.normalized_evidence(F.col("title"), url, said, F.when(k == 2, "Hacker News").otherwise("s"), kind, x, F.when(n % 4 == 0, "See CHANGELOG.md").otherwise(x), F.when(k == 0, "v1"), x)
    return c.select("id", made.alias("e")).select("id", "e.quality", "e.summary", "e.url")


def queued_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).where("id IS NOT NULL")
    n = F.col("id")
    return c.select(
        F.floor(n / RUN).alias("run"), F.concat(F.lit("event-"), n.cast("string")).alias("event_key"), _pick(("github", "rss", "x"), n % 3).alias("channel"), _pick((*selection.AUTHORITY, "unknown"), n % 5).alias("authority"),
        F.floor(F.col("hn_score") / 10).alias("score"), "published_at", F.concat(F.lit("p"), (n % 6).cast("string")).alias("publisher_id"), F.when(n % 4 != 0, F.array(F.lit("score"), F.concat(F.lit("topic: T"), (n % 8).cast("string")))).otherwise(F.array(F.lit("score"))).alias("reasons"),
    )


@query()
def selector_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run in the order in which the selector tries them."""
    return selection.selector_queue(queued_events(spark, sf_dir), ["run"]).select("run", "event_key", "rank", "topic", "primary", "place")


#: Titles that a generator might have made: of what the headline names, and of more.
ADDED = ("", " GPT-5.2", " Claude 9", " Aurora", " deepseek-r1.", " Novak")
_HEAD = f"{_list(OBJECTS)}[doc_id % {len(OBJECTS)} + 1]"
_NAMED = "list_sort(list_distinct(list_transform(regexp_extract_all({0}, '" + summaries.PRODUCTS.replace("'", "''") + "', 1), lambda x: lower(x))))"


@query(f"""
WITH d AS (SELECT doc_id, {_HEAD} AS head, {_list(ADDED)}[doc_id % {len(ADDED)} + 1] AS added, coalesce(text, '') AS body, coalesce(source, '') AS source FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE head || added END AS shown, {_NAMED.format("head || added")} AS named, {_NAMED.format("head || ' ' || body || '  ' || source")} AS known FROM d),
f AS (SELECT doc_id, CASE WHEN shown = '' THEN [] ELSE list_filter(named, lambda x: NOT list_contains(known, x)) END AS suspicious FROM s)
SELECT doc_id AS id, len(suspicious) = 0 AS valid, coalesce(array_to_string(suspicious, '|'), '') AS suspicious, CASE WHEN len(suspicious) = 0 THEN 'keep' ELSE 'fallback' END AS action FROM f""")
def summary_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown titles that name products of which the whole source says nothing."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    n = F.col("doc_id")
    head = _pick(OBJECTS, n % len(OBJECTS))
    shown = F.when(n % 5 == 0, "").otherwise(F.concat(head, _pick(ADDED, n % len(ADDED))))
    told = summaries.fact_check(shown, head, F.col("text"), F.lit(""), F.col("source"))
    return d.select(n.alias("id"), told.alias("f")).select("id", "f.valid", F.array_join("f.suspicious", "|").alias("suspicious"), "f.action")


def two_selections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = candidates(spark, sf_dir).where("id IS NOT NULL").withColumn("run", F.floor(F.col("id") / RUN))
    first = selection.pool(c, ["run"], [F.desc("hn_score"), F.col("id")], TARGET).select("run", "id", "rank")
    second = selection.pool(c, ["run"], [F.desc("github_stars"), F.col("id")], TARGET + 2).select("run", "id", "rank", (F.col("id") % 11 != 0).alias("ready"))
    failures = c.where(F.col("run") % 5 == 4).select("run", F.lit("ValueError").alias("error"))
    return first, second, failures


_TWO = f"""{CANDIDATES}, r AS (SELECT id // {RUN} AS run, id, row_number() OVER (PARTITION BY id // {RUN} ORDER BY hn_score DESC, id) AS f, row_number() OVER (PARTITION BY id // {RUN} ORDER BY github_stars DESC, id) AS s FROM c WHERE id IS NOT NULL),
a AS (SELECT run, id, CAST(f AS INTEGER) AS rank FROM r WHERE f <= {TARGET}), b AS (SELECT run, id, CAST(row_number() OVER (PARTITION BY run ORDER BY s) AS INTEGER) AS rank FROM r WHERE s <= {TARGET + 2} AND id % 11 <> 0),
m AS (SELECT coalesce(a.run, b.run) AS run, coalesce(a.id, b.id) AS id, a.rank AS rank_first, b.rank AS rank_second, a.rank - b.rank AS displacement, CASE WHEN b.id IS NULL THEN 'dropped' WHEN a.id IS NULL THEN 'added' ELSE 'both' END AS side FROM a FULL JOIN b ON a.run = b.run AND a.id = b.id)"""


@query(f"WITH {_TWO} SELECT * FROM m")
def rank_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second, _ = two_selections(spark, sf_dir)
    ready = selection.pool(second.where("ready").withColumnRenamed("rank", "_rank"), ["run"], [F.col("_rank")], TARGET + 2)
    return choices.displacements(first, ready, "run")


@query(f"""
WITH {_TWO}, t AS (SELECT run, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank_first) FILTER (rank_first IS NOT NULL) AS selected, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank_second) FILTER (rank_second IS NOT NULL) AS recommended,
    string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank_first) FILTER (side = 'dropped') AS dropped, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank_second) FILTER (side = 'added') AS added,
    count(*) FILTER (rank_first <= {TARGET} AND rank_second <= {TARGET}) / {TARGET}.0 AS overlap, avg(abs(displacement)) AS footrule, count(rank_second) AS ready FROM m GROUP BY run),
s AS (SELECT *, CASE WHEN run % 5 = 4 THEN 'agent_error:ValueError' WHEN ready < {TARGET} THEN 'insufficient_ready_write_candidates' ELSE '' END AS fallback_reason FROM t)
SELECT run, CASE WHEN fallback_reason = '' THEN 'diagnostic_only' ELSE 'fallback' END AS status, fallback_reason, selected, CASE WHEN fallback_reason = '' THEN coalesce(recommended, '') ELSE '' END AS recommended, CASE WHEN fallback_reason = '' THEN coalesce(dropped, '') ELSE '' END AS dropped,
    CASE WHEN fallback_reason = '' THEN coalesce(added, '') ELSE '' END AS added, CASE WHEN fallback_reason = '' THEN CAST(round(overlap, 6) AS DOUBLE) END AS overlap, CASE WHEN fallback_reason = '' THEN round(footrule, 6) END AS footrule FROM s""")
def shadow_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = choices.shadow_comparison(*two_selections(spark, sf_dir)[:2], "run", TARGET, two_selections(spark, sf_dir)[2])
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("selected", "recommended", "dropped", "added")]
    return told.select("run", "status", "fallback_reason", *joined, F.round("overlap", 6).alias("overlap"), F.round("footrule", 6).alias("footrule"))


#: Replies about a document's first and second half, by its id; {0} is its first long word, {1} a word that it has not.
REPLIES = (
    '{{"relationship":"same_event","shared_subjects":["{0}"],"shared_action":"launch"}}', '{{"relationship":"same_event","shared_subjects":["{0}"],"shared_action":"hire"}}', '{{"relationship":"distinct","shared_subjects":[],"shared_action":""}}',
    '{{"relationship":"uncertain","shared_subjects":["{1}"],"shared_action":""}}', '{{"relationship":"same_event","shared_subjects":["team"],"shared_action":"launch"}}', '{{"relationship":"same","shared_subjects":[],"shared_action":""}}',
    '{{"relationship":"distinct","shared_subjects":["{0}"]}}', '{{"relationship":"distinct","shared_subjects":"{0}","shared_action":""}}', '{{"relationship":"distinct","shared_subjects":[],"shared_action":null}}', '["{0}"]', '{{"relationship":', '{{"relationship":"same_event","shared_subjects":[],"shared_action":"launch"}}',
)
_WORD = "regexp_extract(lower(coalesce(text, '')), '[a-z]{8,}', 0)"


@query(f"""
WITH d AS (SELECT doc_id, doc_id % {len(REPLIES)} AS k, {_WORD} AS w, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS x FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT *, w <> '' AND contains(' ' || x || ' ', ' ' || w || ' ') AS stands FROM d)
SELECT doc_id, CASE k WHEN 0 THEN CASE WHEN w = '' THEN 'subjects_no_texts' WHEN NOT stands THEN 'subject_not_anchored' ELSE '' END WHEN 1 THEN CASE WHEN w = '' THEN 'subjects_no_texts' WHEN NOT stands THEN 'subject_not_anchored' ELSE 'action_not_shared' END WHEN 2 THEN '' WHEN 3 THEN 'subject_not_anchored'
    WHEN 4 THEN 'no_strong_subject' WHEN 5 THEN 'unknown_relationship' WHEN 6 THEN 'wrong_fields' WHEN 7 THEN 'subjects_no_texts' WHEN 8 THEN 'action_no_text' WHEN 9 THEN 'no_object' WHEN 10 THEN 'no_object' ELSE 'same_event_without_subject_or_action' END AS fault FROM s""")
def checked_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about two copies of a document, with the first fault of each."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")
    d = d.select("doc_id", plain.alias("x"), F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "[a-z]{8,}", 0).alias("w"))
    word = F.col("w")
    made = [F.concat(*[F.lit(part) if i == 0 else F.concat(word, F.lit(part)) for i, part in enumerate(r.replace("{1}", "zzqx").replace("{{", "{").replace("}}", "}").split("{0}"))]) for r in REPLIES]
    reply = F.element_at(F.array(*made), (F.col("doc_id") % len(REPLIES) + 1).cast("int"))
    acts = F.array(F.lit("launch"))
    return d.select("doc_id", reply.alias("reply"), "x", "w").select("doc_id", verdicts.fault(F.col("reply"), F.col("x"), F.col("x"), F.array("w"), acts, acts).alias("fault"))
