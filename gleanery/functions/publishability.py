"""Whether a source tells of an event, and whether what is shown of it is one claim of one sentence of the source.

A claim is a frame: the first mark of an event splits a sentence into who acts and what is said of it. Frames of several
sentences never add up.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .anchors import CLAIM_ORGANIZATIONS, EVENT_ACTIONS, asserted_actions, canonical_names
from .text import IDEOGRAPH, bounded_shape, contains_any, folded, known, lookup, normalized, once, one_of, quoted, sentences, unescape

#: Subjects and details that say nothing.
GENERIC_SUBJECTS = (
    "a company", "an ai company", "company", "the company", "this company", "team", "the team", "organization", "某公司", "一家公司", "多家公司",
    "该公司", "这家公司", "公司", "某机构", "该机构", "机构", "某团队", "该团队", "这个团队", "团队", "实验室", "我们", "我", "其", "它",
)
GENERIC_DETAILS = (
    "ai", "model", "models", "product", "products", "strategy", "update", "模型", "产品", "战略", "计划", "进展", "动态", "消息", "更新", "研究",
    "能力", "功能", "新模型", "新产品", "全新模型", "全新产品",
)
#: Titles that are no news, evidence that is only a forum's figures, and words of code activity and of publications.
NON_NEWS = r"(?i)\bhow\b.*\bworks?\b|\bguide\b|\btutorial\b|\bmentions?\b|工作原理|使用指南|教程|提及|战略$|趋势$"
METADATA = r"(?i)\bPoints:\s*\d+|#\s*Comments:\s*\d+|\bComments:\s*\d+"
ACTIVITY_WORDS = ("star", "commit", "recent push", "近期活跃")
PUBLICATION_WORDS = ("release", "readme", "announcement", "发布说明")
#: Models that a claim may name, and numbers with their unit.
CLAIM_MODEL = r"(?iU)((?<![a-z0-9])(?:chatgpt(?![a-z0-9])|(?:gpt|claude|gemini|llama|qwen|deepseek|model|mistral)[- ]?[a-z]*\d[\w.+-]*)(?:\s+(?:flash|mini|pro|ultra|ultrafast))?)"
CLAIM_NUMBER = r"(?i)((?:\$\s*)?\d+(?:[.,]\d+)?(?:\s*(?:%|gw|mw|亿美元|万元))?)"
#: How a mark of an English title is put into a minimal Chinese one, and words that are no detail there.
TRANSLATIONS = {
    "发布": ("release", "released", "releases", "launch", "launched", "launches"), "更新": ("update", "updated", "updates"), "升级": ("upgrade", "upgraded", "upgrades"),
    "暂停": ("pause", "paused", "pauses"), "追踪": ("track", "tracks"), "减少": ("reduce", "reduced", "reduces"), "提升": ("improve", "improved"), "超过": ("exceed", "exceeded"),
    "增长": ("jump", "jumps"), "解散": ("disband", "disbanded", "disbands"), "融资": ("raise", "raises", "raised"), "收购": ("acquire", "acquired", "acquires"),
    "任命": ("appoint", "appointed", "appoints"), "加入": ("join", "joins", "joined"), "入职": ("hire", "hired"),
}
DETAIL_STOPWORDS = (
    "a", "an", "and", "at", "before", "by", "can", "for", "from", "in", "it", "its", "may", "model", "models", "more", "new", "of", "on", "our", "over",
    "product", "products", "service", "services", "that", "the", "their", "this", "to", "with", "will", "your",
)
_ENDS = ".,;:!?，。；：！？"
FRAME = "struct<action:string,subjects:array<string>,details:array<string>>"


def marks_shape(marks: list[str]) -> str:
    """The pattern of the leftmost of many marks; one in ideographs and one of letters never begin at one place."""
    latin = [bounded_shape(m).removeprefix("(?<![a-z0-9])").removesuffix("(?![a-z0-9])") for m in marks if not _ideographs(m)]
    other = [m for m in marks if _ideographs(m)]
    parts = ([f"(?<![a-z0-9])(?:{'|'.join(latin)})(?![a-z0-9])"] if latin else []) + other
    return "(" + "|".join(parts) + ")"


def _ideographs(mark: str) -> bool:
    return any("一" <= c <= "鿿" for c in mark)


def _clean(text: Column) -> Column:
    return normalized(unescape(text))


def _prefixed(prefix: str):
    return lambda v: F.concat(F.lit(prefix), v)


def organization_anchors(text: Column) -> Column:
    return F.transform(canonical_names(text, CLAIM_ORGANIZATIONS, short=True), _prefixed("org:"))


def model_anchors(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(CLAIM_MODEL), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.concat(F.lit("model:"), F.regexp_replace(F.rtrim(F.lower(m), F.lit(_ENDS)), r"\s+", "-"))))


def numeric_anchors(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(CLAIM_NUMBER), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("number:"), F.replace(F.lower(n), F.lit(","), F.lit("")))))


def _subject(text: Column) -> Column:
    """A subject as it is written, or an empty string if it is generic or a number."""
    bare = F.btrim(normalized(text), F.lit(" ,，:：-—"))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^(?:在|于|截至)\s*", ""), r"(?i)\b(?:has|have|had|is|are|was|were|will)\s*$", "")
    return once(bare, lambda x: F.when((x == "") | one_of(F.lower(x), GENERIC_SUBJECTS) | x.rlike(r"^\d+(?:[.,]\d+)?$"), "").otherwise(x))


def detail_anchors(text: Column, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Organisations, models, numbers, and all other words but generic ones and marks of events."""
    marks = [m for many in (kinds or EVENT_ACTIONS).values() for m in many]
    bare = F.regexp_replace(folded(text), "|".join(map(quoted, marks)), " ")
    words = F.transform(F.split(F.regexp_replace(bare, "[^a-z0-9一-鿿.+-]+", " "), r"\s+"), lambda w: F.btrim(w, F.lit(_ENDS)))
    literal = F.transform(F.filter(words, lambda w: (F.length(w) >= 2) & ~one_of(w, GENERIC_DETAILS)), _prefixed("literal:"))
    return F.array_distinct(F.concat(organization_anchors(text), model_anchors(text), numeric_anchors(text), literal))


def claim_frame(text: Column, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct<action, subjects, details> of a sentence; null without a mark."""
    kinds = kinds or EVENT_ACTIONS
    marks = [m for many in kinds.values() for m in many]
    shape = marks_shape(marks)
    kind_of: dict[str, str] = {}
    for kind, many in kinds.items():
        for m in many:
            kind_of.setdefault(m, kind)
    table = lookup(kind_of)

    def split(x):
        low = F.lower(x)
        mark = F.regexp_extract(low, shape, 1)
        at = F.regexp_instr(low, F.lit(shape))
        parts = F.struct(mark.alias("mark"), F.substring(x, F.lit(1), at - 1).alias("before"), F.substring(x, at + F.length(mark), F.length(x)).alias("after"))
        return once(parts, frame)

    def frame(p):
        named = F.array_distinct(F.concat(organization_anchors(p["before"]), model_anchors(p["before"])))
        literal = _subject(p["before"])
        subjects = F.when(F.size(named) > 0, named).when(literal != "", F.array(F.concat(F.lit("literal-subject:"), F.lower(literal)))).otherwise(F.array().cast("array<string>"))
        made = F.struct(F.element_at(table, p["mark"]).alias("action"), subjects.alias("subjects"), detail_anchors(p["after"], kinds).alias("details"))
        return F.when(p["mark"] != "", made)

    return once(_clean(text), split)


def publisher_subjects(name: Column, official: Column, identity: Column) -> Column:
    """Who may be meant without being named: the publisher, if it speaks for itself and that is known from somewhere."""
    literal = _subject(name)
    named = organization_anchors(name)
    own = F.when(F.size(named) > 0, named).when(literal != "", F.array(F.concat(F.lit("literal-subject:"), F.lower(literal)))).otherwise(F.array().cast("array<string>"))
    return F.when(official & (known(identity) != ""), own).otherwise(F.array().cast("array<string>"))


def frame_supported(shown: Column, source: Column, publisher: Column) -> Column:
    """Whether a frame has the action of another, and nothing that the other lacks; a publisher may be an unnamed subject."""
    within = lambda a, b: (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)
    return (shown["action"] == source["action"]) & within(shown["subjects"], F.concat(source["subjects"], publisher)) & within(shown["details"], source["details"])


def claim_supported(claim: Column, quote: Column, publisher: Column | None = None, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether one sentence of the quote says what the claim says; a claim without an event is never supported."""
    own = F.array().cast("array<string>") if publisher is None else publisher
    of_kind = F.from_json(F.lit(json.dumps({k: list(many) for k, many in (kinds or EVENT_ACTIONS).items()}, ensure_ascii=False)), "map<string,array<string>>")

    def plausible(c):
        """Sentences that hold a mark of the claim's own action and all its literal details: only their frames are made."""
        words = F.transform(F.filter(c["details"], lambda d: d.startswith("literal:")), lambda d: F.substring(d, F.lit(len("literal:") + 1), F.length(d)))
        wanted = F.struct(words.alias("words"), F.element_at(of_kind, c["action"]).alias("marks"))
        # Plain letters on single blanks need no cleaning.
        bare = lambda s: F.when(s.rlike("[^ -%'-~À-Þà-ÿ]|  "), folded(_clean(s))).otherwise(F.lower(s))
        holds = lambda w: lambda s: once(bare(s), lambda x: F.forall(w["words"], lambda d: x.contains(d)) & F.exists(w["marks"], lambda m: x.contains(m)))
        return once(wanted, lambda w: F.filter(sentences(quote), holds(w)))

    def supported(c):
        fits = lambda s: once(claim_frame(s, kinds), lambda q: F.coalesce(frame_supported(c, q, own), F.lit(False)))
        return F.when(c.isNotNull(), F.exists(plausible(c), fits)).otherwise(F.lit(False))

    return once(claim_frame(claim, kinds), supported)


def activity_only(evidence: Column) -> Column:
    """Evidence that tells of code activity and of no publication."""
    return once(F.lower(known(evidence)), lambda e: contains_any(e, ACTIVITY_WORDS) & ~contains_any(e, PUBLICATION_WORDS))


def source_reason(title: Column, evidence: Column, channel: Column, found_at: Column, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The reason against a source as news, or an empty string."""
    clean_title, clean_evidence = _clean(title), _clean(evidence)

    def judged(frame):
        return (
            F.when((channel == "github") & activity_only(clean_evidence), "github_activity_only")
            .when((known(found_at) == "hacker_news") & clean_evidence.rlike(METADATA), "metadata_only_evidence")
            .when(clean_title.rlike(NON_NEWS) | frame.isNull(), "non_news_content")
            .when(F.size(frame["subjects"]) == 0, "source_missing_subject")
            .when(F.size(frame["details"]) == 0, "source_missing_event_detail")
            .otherwise("")
        )

    return once(claim_frame(title, kinds), judged)


def display_reason(title: Column, evidence: Column, publisher: Column, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The reason against a title that is shown for a source, or an empty string."""

    def judged(frame):
        return (
            F.when(frame.isNull(), "title_missing_event_action")
            .when(F.size(frame["subjects"]) == 0, "title_missing_subject")
            .when(F.size(frame["details"]) == 0, "title_missing_event_detail")
            .when(claim_supported(_clean(title), evidence, publisher, kinds), "")
            .when(~F.array_contains(asserted_actions(evidence, kinds), frame["action"]), "title_action_not_source_bound")
            .otherwise("title_claim_not_source_bound")
        )

    return once(claim_frame(title, kinds), judged)


def anchored_title(title: Column) -> Column:
    """A minimal Chinese title of who, what and of what, made of an English title's own anchors alone; null where one of them lacks."""
    verb_of = {m: verb for verb, many in TRANSLATIONS.items() for m in many}
    shape = marks_shape(list(verb_of))
    verbs = lookup(verb_of)
    names = "|".join(bounded_shape(a).replace("[a-z0-9]", "[a-zA-Z0-9]") if not _ideographs(a) else f"(?<![a-zA-Z0-9]){a}(?![a-zA-Z0-9])" for a in sorted(CLAIM_ORGANIZATIONS, key=lambda a: (-len(a), a)))
    surface = rf"(?i)({names}|{CLAIM_MODEL.removeprefix('(?iU)')})"
    word = r"(?i)((?<![a-z0-9])[a-z][a-z0-9.+-]*(?![a-z0-9]))"

    def split(x):
        low = F.lower(x)
        mark, at = F.regexp_extract(low, shape, 1), F.regexp_instr(low, F.lit(shape))
        return once(F.struct(mark.alias("mark"), F.substring(x, F.lit(1), at - 1).alias("before"), F.substring(x, at + F.length(mark), F.length(x)).alias("after")), made)

    def made(p):
        first = F.regexp_extract(p["before"], surface, 1)
        subject = F.when(first != "", first).otherwise(_subject(p["before"]))
        anchors = F.filter(F.regexp_extract_all(p["after"], F.lit(surface), F.lit(1)), lambda a: F.lower(a) != F.lower(subject))
        words = F.filter(F.regexp_extract_all(p["after"], F.lit(word), F.lit(1)), lambda w: (F.length(w) >= 3) & ~one_of(F.lower(w), DETAIL_STOPWORDS))
        detail = F.coalesce(F.get(anchors, F.lit(0)), F.get(words, F.lit(0)))
        return F.when((p["mark"] != "") & (subject != "") & detail.isNotNull(), F.concat_ws(" ", subject, F.element_at(verbs, p["mark"]), detail))

    return once(_clean(title), lambda x: F.when(~x.rlike(IDEOGRAPH), split(x)))
