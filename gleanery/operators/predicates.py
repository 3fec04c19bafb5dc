"""Predicates that explain themselves: each gives the first reason that holds, or an empty string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, known
from ..functions.times import age_hours

#: Words of posts that advertise, and of posts that take a stand, by kind and in order.
PROMOTION = ("招聘", "课程", "报名", "折扣", "优惠", "join us", "hiring", "register", "workshop", "webinar", "congratulations", "congrats", "祝贺")
COURSE = r"(?i)\b(?:(?:our|this|new|ai)\s+course|course\s+(?:registration|enrollment))\b"
REPOST = r"(?i)^\s*(?:rt\s+@|转发\s*[:：])"
STANCES = {
    "prediction": ("will", "likely", "expect", "predict", "将会", "可能", "预计"),
    "critique": ("wrong", "fail", "problem", "overrated", "质疑", "错误", "问题", "局限"),
    "comparison": ("better", "worse", "than", "versus", "更好", "不如", "相比"),
    "opinion": ("i think", "i believe", "in my view", "认为", "我觉得", "我相信", "观点"),
}
#: Names whose versions are compared, and words of finance and of amounts.
MODEL_NAME = r"\b(gpt[-\s]?\d[\w.]*|claude\s?\w+|gemini\s?\w+|llama\s?\w+|grok\s?\w+)\b"
COMPARISON = r"\b(vs\.?|versus|compare|comparison|test|challenge|benchmark)\b"
FINANCE = r"\b(arr|revenue|valuation|funding|financing|market cap)\b|融资|收入|营收|估值|市值"
LARGE_AMOUNT = r"\b\d+(?:\.\d+)?\s?(?:billion|million)\b|亿美元|亿元|千万|百万|\d+\s?倍"
#: Words that mark low-value repositories.
LEAST_STARS = 5


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else an empty string. A rule that is null does not hold."""
    out = F.lit("")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """How often each reason was given, accepted rows as an empty string."""
    return rows.groupBy(reason).agg(F.count("*").alias("n"))


def reason_list_counts(rows: DataFrame, reasons: str) -> DataFrame:
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def relevant(title: Column, summary: Column, high: tuple[str, ...], low: tuple[str, ...]) -> Column:
    """A strong word in the title or the summary, or a weak one in the title and any in the summary. Words are substrings."""
    t, s = F.lower(known(title)), F.lower(known(summary))
    return contains_any(t, high) | contains_any(s, high) | (contains_any(t, low) & contains_any(s, (*high, *low)))


def retention_reason(ts: Column, now: Column, hours: float, needs_topic: Column, on_topic: Column) -> Column:
    """no_date, too_old, not_ai in this order; a row exactly `hours` old stays."""
    return first_reason([("no_date", ts.isNull()), ("too_old", age_hours(ts, now) > hours), ("not_ai", needs_topic & ~on_topic)])


def signal(title: Column, url: Column, short: tuple[str, ...], long: tuple[str, ...], weak: tuple[str, ...], places: tuple[str, ...]) -> Column:
    """strong_short for whole short words, strong_long for long substrings, weak for weak ones on a known place, else empty."""
    low = F.lower(known(title))
    words = low.rlike(r"\b(" + "|".join(short) + r")\b")
    return F.when(words, "strong_short").when(contains_any(low, long), "strong_long").when(contains_any(low, weak) & contains_any(F.lower(known(url)), places), "weak").otherwise("")


def community_only(source: Column, kind: Column, cross_sources: Column) -> Column:
    """Posts that only the one forum carries: each part of the source label names it."""
    low = F.lower(known(source))
    parts = F.filter(F.transform(F.split(low, r"\s+(?:\+|\|)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    all_forum = F.forall(F.when(F.size(parts) > 0, parts).otherwise(F.array(low)), lambda p: p.contains("hacker news") | p.isin("hn", "hnrss"))
    return ((kind == "hn") & (cross_sources == 0)) | (low.contains("hacker news") & all_forum)


def publish_risk(title: Column, kind: Column, cross_sources: Column, forum_only: Column, official: Column) -> Column:
    """struct<category, penalty> of the risk of publishing a candidate as it is; an empty category and 0 without one."""
    low = F.lower(known(title))
    compared = forum_only & ~official & low.rlike(MODEL_NAME) & (low.rlike(COMPARISON) | title.contains("$") | low.contains("music video"))
    claimed = (kind == "rss") & (cross_sources == 0) & low.rlike(FINANCE) & low.rlike(LARGE_AMOUNT)
    category = F.when(compared, "community_model_comparison").when(claimed, "single_source_financial_claim").otherwise("")
    penalty = F.when(compared, 18.0).when(claimed, 12.0).otherwise(0.0)
    return F.struct(category.alias("category"), penalty.alias("penalty"))


def brand_claim(title: Column, url: Column, brands: dict[str, tuple[str, ...]], places: dict[str, tuple[str, ...]], acts: tuple[str, ...], vouched: Column, cross_sources: Column) -> Column:
    """struct<brand, confidence>: a brand and an act in the title make a claim; it is high on the brand's own place or
    vouched for, medium with another source, else low. Without a claim the brand is empty and the confidence high."""
    low = F.lower(known(title))
    brand, own = F.lit(""), F.lit(False)
    for name, aliases in reversed(list(brands.items())):
        hit = contains_any(low, aliases)
        own = F.when(hit, contains_any(F.lower(known(url)), places.get(name, ()))).otherwise(own)
        brand = F.when(hit, name).otherwise(brand)
    claim = (brand != "") & contains_any(low, acts)
    confidence = F.when(~claim | own | vouched, "high").when(cross_sources > 0, "medium").otherwise("low")
    return F.struct(F.when(claim, brand).otherwise("").alias("brand"), confidence.alias("confidence"))


def post_rejection(text: Column, repost: Column) -> Column:
    low = F.lower(known(text))
    return first_reason([("x_repost", repost | text.rlike(REPOST)), ("x_promotional_content", contains_any(low, PROMOTION) | text.rlike(COURSE))])


def stance(text: Column, stances: dict[str, tuple[str, ...]] | None = None) -> Column:
    out, low = F.lit(""), F.lower(known(text))
    for name, marks in reversed(list((stances or STANCES).items())):
        out = F.when(contains_any(low, marks), name).otherwise(out)
    return out


def opinion_reason(text: Column, allowed: Column, repost: Column, reply: Column, context: Column, quotes: Column, stances: dict[str, tuple[str, ...]] | None = None, least_words: int = 10, least_quoting: int = 8) -> Column:
    """The first reason against a post as an opinion, or an empty string."""
    low = F.lower(known(text))
    count = F.size(F.regexp_extract_all(known(text), F.lit("([A-Za-z0-9]+|[一-鿿])"), F.lit(1)))
    link_only = F.trim(F.regexp_replace(known(text), r"https?://\S+", "")) == ""
    return first_reason([
        ("opinion_author_not_allowed", ~allowed),
        ("opinion_repost_only", repost),
        ("opinion_context_missing", reply & ~context),
        ("opinion_promotional_content", contains_any(low, PROMOTION) | known(text).rlike(COURSE)),
        ("opinion_repost_only", link_only | (quotes & (count < least_quoting))),
        ("opinion_no_substantive_claim", (count < least_words) | (stance(text, stances) == "")),
    ])


def explainable_release(description: Column, notes: Column) -> Column:
    return (F.length(F.trim(known(description))) >= 24) & (F.length(F.trim(known(notes))) >= 40)


def community_radar(kind: Column, tier: Column, cross_sources: Column, event: Column, explained: Column) -> Column:
    """Rows that only show what a community looks at, which are never selected: code activity but for explained releases,
    posts of the forum without another source, and else what its tier says."""
    return F.when(F.lower(kind) == "github", (event != "github_release") | ~explained).when(F.lower(kind) == "hn", cross_sources == 0).otherwise(tier == "community")


def model_quality(likes: Column, downloads: Column) -> Column:
    return (likes >= 10) | ((likes >= 3) & (downloads >= 5000))


def low_value_repository(stars: Column, name: Column, description: Column, marks: tuple[str, ...]) -> Column:
    text = F.lower(F.concat_ws(" ", known(name), known(description)))
    return (stars < LEAST_STARS) | contains_any(text, marks)


def tier_of(tier: Column, kind: Column) -> Column:
    """The given tier, else research for papers, community for forums and code, media for the rest."""
    given = F.when(F.trim(known(tier)) != "", tier)
    return F.coalesce(given, F.when(kind == "arxiv", "research").when(kind.isin("hn", "github", "huggingface"), "community").otherwise("media"))


def event_type(text: Column, kind: Column, activity: Column) -> Column:
    """Kind of event by words, code activity first."""
    low = F.lower(known(text))
    return (
        F.when((kind == "github") & (activity != ""), F.concat(F.lit("github_"), activity))
        .when(contains_any(low, ("waic", "世界人工智能大会")), "waic")
        .when(contains_any(low, ("lawsuit", "sues", "sued", "起诉", "诉讼")), "lawsuit")
        .when(contains_any(low, ("funding", "融资", "估值")), "funding")
        .when(contains_any(low, ("conference", "大会", "峰会")), "conference")
        .otherwise("news")
    )
