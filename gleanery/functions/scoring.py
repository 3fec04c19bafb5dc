"""Scores over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: The weight of a source by the first name that its label holds; 5 where none does.
SOURCE_AUTHORITY = {
    "openai": 10, "anthropic": 10, "google deepmind": 10, "deepmind": 10, "meta ai": 9, "microsoft": 9, "nvidia": 9,
    "techcrunch": 9, "the verge": 9, "mit technology review": 9, "wired": 8, "arstechnica": 8, "venturebeat": 8,
    "hacker news": 6, "hn": 6, "机器之心": 9, "量子位": 9, "36氪": 8, "虎嗅": 8, "钛媒体": 8, "品玩": 7,
}
#: Words in a title that tell of weight.
HOT_WORDS = (
    "breakthrough", "launch", "release", "announce", "unveil", "revolutionary", "new model", "funding", "raise", "billion",
    "acquisition", "partnership", "research", "paper", "benchmark", "open source", "open-source", "state of the art", "sota",
    "update", "major", "first", "biggest", "发布", "推出", "突破", "融资", "收购", "开源", "重磅", "首次", "重大", "最新",
    "万亿", "亿", "千万",
)
TIER_SCORE = {"primary": 2.5, "research": 2.2, "media": 1.8, "community": 1.0}
SCORE_BUCKETS = ("below_4", "4_to_7", "7_to_8_5", "8_5_and_above")


def tenths(value: Column) -> Column:
    """A double to one decimal by its exact value: 4.65, which is stored a little above that, becomes 4.7; true halves go to even.

    Ten times the value is the sum of eight times and twice it, both exact, so what that sum loses is known.
    """

    def rounded(s):
        whole, rest = F.floor(s["sum"]), s["sum"] - F.floor(s["sum"])
        back = s["sum"] - s["eight"]
        lost = (s["eight"] - (s["sum"] - back)) + (s["two"] - back)
        up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 != 0))))
        return (whole + up.cast("int")) / 10.0

    x = value.cast("double")
    return once(F.struct((x * 8 + x * 2).alias("sum"), (x * 8).alias("eight"), (x * 2).alias("two")), rounded)


def clamp(value: Column) -> Column:
    """Between 0 and 10, one decimal."""
    return tenths(F.greatest(F.lit(0.0), F.least(value, F.lit(10.0))))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / whole, 3))


def score_bucket(score: Column) -> Column:
    return F.when(score < 4, SCORE_BUCKETS[0]).when(score < 7, SCORE_BUCKETS[1]).when(score < 8.5, SCORE_BUCKETS[2]).otherwise(SCORE_BUCKETS[3])


def authority(source: Column, weights: dict[str, int] | None = None, other: int = 5) -> Column:
    out = F.lit(other)
    for name, weight in reversed(list((weights or SOURCE_AUTHORITY).items())):
        out = F.when(F.lower(source).contains(name), weight).otherwise(out)
    return out


def hotness(title: Column, words: tuple[str, ...] = HOT_WORDS, most: int = 5) -> Column:
    """How many of the words the title holds, at most `most`."""
    return F.least(F.lit(most), sum((F.lower(title).contains(w).cast("int") for w in words), F.lit(0)))


def community(m: dict[str, Column]) -> Column:
    """Logarithmic weight of points, comments, stars, likes and downloads, and 5 for each other source."""
    talk = F.when((m["hn_score"] > 0) | (m["hn_comments"] > 0), F.log1p(m["hn_score"]) * 1.5 + F.log1p(m["hn_comments"]) * 1.2).otherwise(0.0)
    stars = F.when(m["github_stars"] > 0, F.log1p(m["github_stars"])).otherwise(0.0)
    likes = F.when(m["hf_likes"] > 0, F.log1p(m["hf_likes"]) * 2.0).otherwise(0.0)
    loads = F.when(m["hf_downloads"] > 100, F.log1p(m["hf_downloads"] / 100) * 0.5).otherwise(0.0)
    return talk + stars + likes + loads + m["cross_source_count"] * 5


def freshness_weight(kind: Column, official: Column, m: dict[str, Column]) -> Column:
    """A half; a fifth for posts and models that nobody noticed."""
    quiet_post = (kind == "hn") & (m["cross_source_count"] == 0) & ~official & (m["hn_score"] < 10) & (m["hn_comments"] < 2)
    quiet_model = (kind == "huggingface") & (m["cross_source_count"] == 0) & (m["hf_likes"] < 20) & (m["hf_downloads"] < 1000)
    return F.when(quiet_post | quiet_model, 0.2).otherwise(0.5)


def composite(fresh: Column, weight: Column, authority_: Column, cross_refs: Column, hot: Column, summary: Column, community_: Column, paper: Column, doubtful_claim: Column, risk_penalty: Column | None = None) -> Column:
    """The composite score of a candidate; a doubtful brand claim costs 40 of 100, a publish risk up to the whole score."""
    plain = fresh * weight + authority_ + cross_refs * 3 + hot * 2 + F.when(F.length(summary) > 50, 2).otherwise(0) + community_ + F.when(paper > 0, paper * 0.5).otherwise(0.0)
    held = F.when(doubtful_claim, plain - plain * 0.4).otherwise(plain)
    return held if risk_penalty is None else held - F.least(risk_penalty, F.greatest(held, F.lit(0.0)))


def editorial_score(evidence: Column, fresh: Column, tier: Column, event_type: Column) -> Column:
    """Evidence, freshness, tier and event, capped for activity that is no release."""
    of_tier = F.lit(1.0)
    for name, value in TIER_SCORE.items():
        of_tier = F.when(tier == name, value).otherwise(of_tier)
    event = F.when(event_type.isin("news", "lawsuit", "funding", "waic", "conference"), 2.0).otherwise(1.2)
    total = F.when(evidence, 3.0).otherwise(0.8) + fresh + of_tier + event
    return tenths(F.least(total, score_cap(event_type)))


def score_cap(event_type: Column) -> Column:
    return F.when(event_type == "github_activity", 7.4).when(event_type == "github_new_repository", 8.4).otherwise(10.0)


def reviewed_score(own: Column, review: Column, event_type: Column) -> Column:
    """70 parts of the own score and 30 of a review, capped."""
    return tenths(F.least(own * 0.7 + review * 0.3, score_cap(event_type)))


def evidence_score(ready: Column, judged: Column, tier: Column, cross_sources: Column) -> Column:
    base = F.when(judged, 8.0).otherwise(4.0) + F.when(tier.isin("primary", "research"), 0.5).otherwise(0.0) + F.least(cross_sources * 0.5, F.lit(1.0))
    return F.when(ready, clamp(base)).otherwise(F.least(clamp(base), F.lit(2.0)))


def impact_score(importance: Column, evidence: Column) -> Column:
    return clamp(importance * 0.7 + evidence * 0.3)


def risk_level(risky: Column, evidence: Column, ready: Column, unsure: Column) -> Column:
    """high without a ready content or with a publish risk; medium with little evidence or low confidence."""
    return F.when(risky | ~ready, "high").when((evidence < 6) | unsure, "medium").otherwise("low")


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hexadecimal digits; 64 if either is no such hash."""
    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = lambda c: F.conv(c, 16, -10).cast("long")
    return F.coalesce(F.when(good, F.bit_count(bits(a).bitwiseXOR(bits(b)))), F.lit(64))
