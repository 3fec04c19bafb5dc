"""Queries over headlines: what a source claims, whether it may be published, and what is shown of it.

`headlines` makes documents into reports: the title names one of a few subjects, one of the marks of events and one of a
few objects, and the evidence is the whole text with a sentence that says the same, or something else.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anchors, publishability
from ..functions.text import PLAIN, WIDE, bounded_shape, text_tokens
from .queries import query
from .tables import table

SUBJECTS = ("OpenAI", "Google DeepMind", "谷歌", "the team", "Mistral AI", "Acme Labs", "NVIDIA and Meta", "")
OBJECTS = ("GPT-5.2 mini", "Claude 4.5 Sonnet", "12% faster inference", "a model", "$30 million in 2025", "新模型", "open weights for Llama-3 pro within 3 months", "")
MARKS = tuple(m for many in anchors.EVENT_ACTIONS.values() for m in many)
CHANNELS = ("rss", "github", "x", "hn")
PUBLISHERS = ("OpenAI", "Acme Press", "谷歌")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    eighth = F.floor(n / 8)
    said = lambda at: F.concat_ws(" ", _pick(SUBJECTS, at % len(SUBJECTS)), _pick(MARKS, n * 7 % len(MARKS)), _pick(OBJECTS, eighth % len(OBJECTS)))
    title = said(n)
    evidence = F.when(n % 3 == 0, F.concat(title, F.lit(". "), text)).when(n % 3 == 1, F.concat(said(n + 1), F.lit("! "), text)).otherwise(F.concat(text, F.lit("; "), title))
    return d.select(
        "doc_id", title.alias("title"), F.concat(evidence, F.when(n % 22 == 0, " Points: 12").otherwise("")).alias("evidence"), _pick(CHANNELS, n % 4).alias("channel"),
        F.when(n % 11 == 0, "hacker_news").otherwise("").alias("found_at"), _pick(PUBLISHERS, n % 3).alias("publisher"), (n % 2 == 0).alias("official"),
        F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example.com/a//"), (n % 50).cast("string"), F.lit("/?p=1")).alias("url"),
    )


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _said(at: str) -> str:
    return f"array_to_string([{_list(SUBJECTS)}[{at} % {len(SUBJECTS)} + 1], {_list(MARKS)}[doc_id * 7 % {len(MARKS)} + 1], {_list(OBJECTS)}[doc_id // 8 % {len(OBJECTS)} + 1]], ' ')"


#: The view `h` of `headlines` in SQL.
HEADLINES = f"""h AS (
    SELECT doc_id, {_said('doc_id')} AS title,
        CASE doc_id % 3 WHEN 0 THEN {_said('doc_id')} || '. ' || coalesce(text, '') WHEN 1 THEN {_said('(doc_id + 1)')} || '! ' || coalesce(text, '') ELSE coalesce(text, '') || '; ' || {_said('doc_id')} END
            || CASE WHEN doc_id % 22 = 0 THEN ' Points: 12' ELSE '' END AS evidence,
        {_list(CHANNELS)}[doc_id % 4 + 1] AS channel, CASE WHEN doc_id % 11 = 0 THEN 'hacker_news' ELSE '' END AS found_at, {_list(PUBLISHERS)}[doc_id % 3 + 1] AS publisher, doc_id % 2 = 0 AS official,
        'https://' || coalesce(source, 'none') || '.example.com/a//' || (doc_id % 50) || '/?p=1' AS url
    FROM documents WHERE doc_id IS NOT NULL)"""


def _normal(x: str) -> str:
    return f"trim(regexp_replace(replace(translate({x}, '{WIDE.replace(chr(39), chr(39) * 2)}', '{PLAIN.replace(chr(39), chr(39) * 2)}'), chr(160), ' '), '\\s+', ' ', 'g'))"


def _is_latin(mark: str) -> bool:
    return not re.search("[一-鿿]", mark)


def _quoted(mark: str) -> str:
    return re.escape(mark).replace("\\ ", " ").replace("\\-", "-").replace("'", "''")


def _stands(x: str, marks) -> str:
    """Whether one of the marks stands in lower-case x as a whole, without looking behind."""
    latin, other = [_quoted(m) for m in marks if _is_latin(m)], [m for m in marks if not _is_latin(m)]
    shapes = ([f"[^a-z0-9](?:{'|'.join(latin)})[^a-z0-9]"] if latin else []) + other
    return f"regexp_matches(' ' || {x} || ' ', '{'|'.join(shapes)}')"


def _named(x: str, spellings: dict[str, str], prefix: str) -> str:
    names: dict[str, list[str]] = {}
    for spelling, name in spellings.items():
        names.setdefault(name, []).append(spelling)
    return "list_filter([" + ", ".join(f"CASE WHEN {_stands(f'lower({x})', many)} THEN '{prefix}{name}' END" for name, many in sorted(names.items())) + "], lambda v: v IS NOT NULL)"


def _models(x: str) -> str:
    found = f"regexp_extract_all({x}, '(?i)(?:^|[^a-z0-9])((?:chatgpt\\b|(?:gpt|claude|gemini|llama|qwen|deepseek|model|mistral)[- ]?[a-z]*\\d[a-z0-9_.+-]*)(?:\\s+(?:flash|mini|pro|ultra|ultrafast)\\b)?)', 1)"
    return f"list_transform({found}, lambda v: 'model:' || regexp_replace(regexp_replace(lower(v), '[.,;:!?，。；：！？]+$', ''), '\\s+', '-', 'g'))"


def _subject_sql(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({x}, ' ,，:：-—'), '^(?:在|于|截至)\\s*', ''), '(?i)\\b(?:has|have|had|is|are|was|were|will)\\s*$', '')"
    return f"list_transform([{bare}], lambda b: CASE WHEN b = '' OR lower(b) IN ({_list(publishability.GENERIC_SUBJECTS)[1:-1]}) OR regexp_full_match(b, '\\d+(?:[.,]\\d+)?') THEN [] ELSE ['literal-subject:' || lower(b)] END)[1]"


def _subjects_sql(x: str, models: bool = True) -> str:
    named = _named(x, anchors.CLAIM_ORGANIZATIONS, "org:") + (f" || {_models(x)}" if models else "")
    return f"CASE WHEN len({named}) > 0 THEN list_distinct({named}) ELSE {_subject_sql(x)} END"


def _details_sql(x: str) -> str:
    numbers = f"list_transform(regexp_extract_all({x}, '(?i)((?:\\$\\s*)?\\d+(?:[.,]\\d+)?(?:\\s*(?:%|gw|mw|亿美元|万元))?)', 1), lambda v: 'number:' || replace(lower(v), ',', ''))"
    bare = f"regexp_replace(regexp_replace(lower({x}), '{'|'.join(_quoted(m) for m in MARKS)}', ' ', 'g'), '[^a-z0-9一-鿿.+-]+', ' ', 'g')"
    words = f"list_transform(string_split_regex({bare}, '\\s+'), lambda w: trim(w, '{publishability._ENDS}'))"
    literal = f"list_transform(list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains({_list(publishability.GENERIC_DETAILS)}, w)), lambda w: 'literal:' || w)"
    return f"list_distinct({_named(x, anchors.CLAIM_ORGANIZATIONS, 'org:')} || {_models(x)} || {numbers} || {literal})"


_LATIN = "|".join(_quoted(m) for m in MARKS if _is_latin(m))
_OTHER = "|".join(m for m in MARKS if not _is_latin(m))
_KIND = "CASE mark " + " ".join(f"WHEN '{m}' THEN '{kind}'" for kind, many in anchors.EVENT_ACTIONS.items() for m in many) + " END"


def _frames(source: str) -> str:
    """The view `f`: doc_id, part, action, subjects, details of each s of `source`; no row without a mark."""
    return f"""
n AS (SELECT doc_id, part, {_normal('s')} AS x FROM {source}),
m AS (SELECT *, regexp_extract(' ' || lower(x) || ' ', '(?s)^(.*?)(?:([^a-z0-9])({_LATIN})[^a-z0-9]|({_OTHER})).*$', ['b', 'c', 'k', 'o']) AS g FROM n),
p AS (SELECT doc_id, part, x, g.k || g.o AS mark, length(g.b) + length(g.c) - 1 AS before FROM m WHERE g.k || g.o <> ''),
q AS (SELECT doc_id, part, {_KIND} AS action, left(x, before) AS subject, substr(x, before + length(mark) + 1) AS rest FROM p),
f AS (SELECT doc_id, part, action, {_subjects_sql('subject')} AS subjects, {_details_sql('rest')} AS details FROM q)"""


@query(f"WITH {HEADLINES}, u AS (SELECT doc_id, 0 AS part, title AS s FROM h), {_frames('u')} SELECT h.doc_id, coalesce(action, '') AS action, array_to_string(list_sort(subjects), '|') AS subjects, array_to_string(list_sort(details), '|') AS details FROM h LEFT JOIN f USING (doc_id)")
def claim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.col("frame")
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    rows = headlines(spark, sf_dir).select("doc_id", publishability.claim_frame(F.col("title")).alias("frame"))
    return rows.select("doc_id", F.coalesce(frame["action"], F.lit("")).alias("action"), joined(frame["subjects"]).alias("subjects"), joined(frame["details"]).alias("details"))


_ACTIVITY = "regexp_matches(lower(evidence), 'star|commit|recent push|近期活跃') AND NOT regexp_matches(lower(evidence), 'release|readme|announcement|发布说明')"


@query(f"""
WITH {HEADLINES}, u AS (SELECT doc_id, 0 AS part, title AS s FROM h), {_frames('u')}
SELECT h.doc_id, CASE WHEN channel = 'github' AND {_ACTIVITY} THEN 'github_activity_only' WHEN found_at = 'hacker_news' AND regexp_matches(evidence, '(?i)\\bPoints:\\s*\\d+|#\\s*Comments:\\s*\\d+|\\bComments:\\s*\\d+') THEN 'metadata_only_evidence'
    WHEN action IS NULL OR regexp_matches(title, '(?i)\\bhow\\b.*\\bworks?\\b|\\bguide\\b|\\btutorial\\b|\\bmentions?\\b|工作原理|使用指南|教程|提及|战略$|趋势$') THEN 'non_news_content'
    WHEN len(subjects) = 0 THEN 'source_missing_subject' WHEN len(details) = 0 THEN 'source_missing_event_detail' ELSE '' END AS reason FROM h LEFT JOIN f USING (doc_id)""")
def source_publishability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headlines(spark, sf_dir)
    return rows.select("doc_id", publishability.source_reason(F.col("title"), F.col("evidence"), F.col("channel"), F.col("found_at")).alias("reason"))


_ASSERTED = "CASE t.action " + " ".join(f"WHEN '{kind}' THEN {_stands('ev', many)}" for kind, many in anchors.EVENT_ACTIONS.items()) + " END"
DISPLAY = f"""
WITH {HEADLINES}, u AS (
    SELECT doc_id, 0 AS part, title AS s FROM h
    UNION ALL SELECT doc_id, 1 AS part, unnest(list_filter(list_transform(string_split_regex(regexp_replace(evidence, '([a-zA-Z0-9])\\.\\s+', '\\1。', 'g'), '[。！？!?;；\\n]+'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM h),
{_frames('u')}, t AS (SELECT * FROM f WHERE part = 0),
o AS (SELECT doc_id, {_normal('lower(evidence)')} AS ev, CASE WHEN official THEN {_subjects_sql('publisher', False)} ELSE [] END AS own FROM h),
s AS (SELECT t.doc_id, bool_or(t.action = e.action AND len(t.subjects) > 0 AND list_has_all(e.subjects || own, t.subjects) AND len(t.details) > 0 AND list_has_all(e.details, t.details)) AS held
    FROM t JOIN f e ON e.doc_id = t.doc_id AND e.part = 1 JOIN o ON o.doc_id = t.doc_id GROUP BY 1)
SELECT h.doc_id, CASE WHEN t.action IS NULL THEN 'title_missing_event_action' WHEN len(t.subjects) = 0 THEN 'title_missing_subject' WHEN len(t.details) = 0 THEN 'title_missing_event_detail' WHEN held THEN ''
    WHEN regexp_matches(ev, '\\b(?:not|never|without|would not)\\b|未|没有|并未|不会') OR NOT {_ASSERTED} THEN 'title_action_not_source_bound' ELSE 'title_claim_not_source_bound' END AS reason
FROM h JOIN o USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)"""


@query(DISPLAY)
def display_publishability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title held against the sentences of its whole evidence."""
    rows = headlines(spark, sf_dir)
    own = publishability.publisher_subjects(F.col("publisher"), F.col("official"), F.lit("registry"))
    return rows.select("doc_id", publishability.display_reason(F.col("title"), F.col("evidence"), own).alias("reason"))


def _kinds_held(x: str, kinds: dict[str, tuple[str, ...]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains({x}, {chr(39)}{m}{chr(39)})' for m in many)} THEN '{kind}' END" for kind, many in sorted(kinds.items())) + "], lambda v: v IS NOT NULL), '|')"


def _kinds_standing(x: str, kinds: dict[str, tuple[str, ...]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_stands(x, many)} THEN '{kind}' END" for kind, many in sorted(kinds.items())) + "], lambda v: v IS NOT NULL), '|')"


_SUFFIX = "|".join(sorted(anchors.VARIANTS, key=lambda v: (-len(v), v)))
_MODEL = f"(?i)\\b((?:{'|'.join(anchors.FAMILIES)})[- ]?[a-z]*\\d[a-z0-9_.+-]*)(?:\\s*(?:\\(\\s*)?({_SUFFIX})\\b(?:\\s*\\))?)?"
_QUALIFIED = " || ".join(f"list_transform(regexp_extract_all(ev, '{shape.replace(chr(39), chr(39) * 2)}', 1), lambda v: '{kind}:' || v)" for kind, shape in anchors.QUALIFIERS.items())


@query(f"""
WITH {HEADLINES}, w AS (SELECT *, {_normal('lower(title)')} AS ti, replace({_normal("lower(title || chr(10) || evidence)")}, 'ß', 'ss') AS ev FROM h),
z AS (SELECT *, list_zip(regexp_extract_all(ev, '{_MODEL}', 1), regexp_extract_all(ev, '{_MODEL}', 2)) AS found,
    list_filter(regexp_extract_all(lower(title), '([a-z0-9][a-z0-9.+-]*|[一-鿿]{{2,}})', 1), lambda t: NOT list_contains({_list(anchors.KEY_STOPWORDS)}, t)) AS signed FROM w)
SELECT doc_id, {_kinds_held('ev', anchors.ACTIONS)} AS actions, CASE WHEN regexp_matches(ti, '\\b(?:not|never|without|would not)\\b|未|没有|并未|不会') THEN '' ELSE {_kinds_standing('ti', anchors.EVENT_ACTIONS)} END AS asserted,
    array_to_string(list_sort({_named('ev', anchors.ORGANIZATIONS, '')}), '|') AS organizations,
    array_to_string(list_sort(list_distinct(list_transform(found, lambda p: regexp_replace(p[1], '[\\s-]+', '-', 'g') || CASE WHEN coalesce(p[2], '') <> '' THEN '-' || regexp_replace(p[2], '\\s+', '-', 'g') ELSE '' END))), '|') AS models,
    array_to_string(list_sort(list_distinct({_QUALIFIED})), '|') AS qualifiers,
    'event-' || left(sha256(CASE WHEN len(signed) > 0 THEN array_to_string(signed, ' ') ELSE regexp_replace(regexp_replace(regexp_replace(url, '\\?.*$', ''), '([^:])/+', '\\1/', 'g'), '/$', '') END), 16) AS event_key,
    CAST(len(list_distinct(list_filter(regexp_extract_all(ev, '([a-z0-9][a-z0-9.+-]*|[一-鿿]{{2,}})', 1), lambda t: NOT list_contains({_list(anchors.TEXT_STOPWORDS)}, t)))) AS BIGINT) AS n_tokens FROM z""")
def report_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the relation of two reports goes by, over whole evidence."""
    whole, title = F.concat_ws("\n", "title", "evidence"), F.col("title")
    joined = lambda c: F.array_join(c, "|")
    return headlines(spark, sf_dir).select(
        "doc_id", joined(anchors.actions(whole)).alias("actions"), joined(anchors.asserted_actions(title)).alias("asserted"), joined(anchors.organizations(whole)).alias("organizations"),
        joined(anchors.models(whole)).alias("models"), joined(anchors.qualifiers(whole)).alias("qualifiers"), anchors.event_key(title, F.col("url"), F.col("publisher")).alias("event_key"),
        F.size(text_tokens(whole, anchors.TEXT_STOPWORDS)).cast("long").alias("n_tokens"),
    )


_TRANSLATED = "CASE mark " + " ".join(f"WHEN '{m}' THEN '{verb}'" for verb, many in publishability.TRANSLATIONS.items() for m in many) + " END"
_SURFACE = "|".join(_quoted(a) for a in sorted(anchors.CLAIM_ORGANIZATIONS, key=lambda a: (-len(a), a)))
_ANY_SURFACE = f"(?i)(?:^|[^a-z0-9])((?:{_SURFACE})\\b|(?:chatgpt\\b|(?:gpt|claude|gemini|llama|qwen|deepseek|model|mistral)[- ]?[a-z]*\\d[a-z0-9_.+-]*)(?:\\s+(?:flash|mini|pro|ultra|ultrafast))?)"


@query(f"""
WITH {HEADLINES}, m AS (SELECT doc_id, {_normal('title')} AS x, regexp_extract(' ' || lower({_normal('title')}) || ' ', '(?s)^(.*?[^a-z0-9])({'|'.join(m for many in publishability.TRANSLATIONS.values() for m in many)})[^a-z0-9].*$', ['b', 'k']) AS g FROM h),
p AS (SELECT doc_id, x, g.k AS mark, left(x, length(g.b) - 1) AS before, substr(x, length(g.b) + length(g.k)) AS rest FROM m),
s AS (SELECT *, coalesce(nullif(regexp_extract(before, '{_ANY_SURFACE}', 1), ''), CASE WHEN len({_subject_sql('before')}) > 0 THEN regexp_replace(trim(before, ' ,，:：-—'), '(?i)\\b(?:has|have|had|is|are|was|were|will)\\s*$', '') END) AS subject FROM p),
a AS (SELECT *, list_filter(regexp_extract_all(rest, '{_ANY_SURFACE}', 1), lambda v: lower(v) <> lower(subject)) AS named,
    list_filter(regexp_extract_all(rest, '(?i)(?:^|[^a-z0-9])([a-z][a-z0-9.+-]*)', 1), lambda v: length(v) >= 3 AND NOT list_contains({_list(publishability.DETAIL_STOPWORDS)}, lower(v))) AS words FROM s)
SELECT doc_id, CASE WHEN mark <> '' AND NOT regexp_matches(x, '[一-鿿]') THEN subject || ' ' || {_TRANSLATED} || ' ' || coalesce(named[1], words[1]) END AS title FROM a""")
def anchored_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headlines(spark, sf_dir).select("doc_id", publishability.anchored_title(F.col("title")).alias("title"))
