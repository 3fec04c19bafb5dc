"""Editorial signals of a candidate: the event that it stands for, its evidence, its score, and notes on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import clamp, editorial_score, evidence_score, impact_score, risk_level
from .text import first_named, known, once
from .times import editorial_freshness
from .urls import is_http

#: Spellings of who and what an event's key is made of, in order.
WHO = {
    "tencent": ("腾讯", "tencent"), "openai": ("openai",), "google": ("google", "deepmind", "谷歌"), "microsoft": ("microsoft", "微软"), "apple": ("apple", "苹果"),
    "meta": ("meta",), "anthropic": ("anthropic",), "nvidia": ("nvidia", "英伟达"),
}
WHAT = {"waic": ("waic", "世界人工智能大会"), "lawsuit": ("lawsuit", "sues", "sued", "起诉", "诉讼"), "funding": ("funding", "融资", "估值"), "conference": ("conference", "大会", "峰会")}
CODE = {"github_release": "github-release:", "github_new_repository": "github-new:", "github_activity": "github-activity:"}
#: Notes on scores, from the best on, and on risk.
IMPORTANCE = ("既有编辑信号显示该事件具备高日报价值。", "既有编辑信号显示该事件值得作为备选关注。", "既有编辑信号不足以支持优先报道。")
VERIFIABLE, UNVERIFIABLE = ("来源证据完整，且有 ", " 个跨源佐证信号。"), "来源证据或跨源佐证不足，应保持保守表述。"
QUALITY, UNAVAILABLE = "证据状态 ", "source content is unavailable"
IMPACT = ("该事件可能有读者价值，但证据或发布风险较高，需谨慎处理。", "高影响：适合优先面向关注 AI 产业与产品变化的读者报道。", "中低影响：适合作为补充线索，不应压过证据更强的事件。")


def source_text(source_title: Column, title: Column, source_summary: Column, summary: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[known(c) for c in (source_title, title, source_summary, summary)]))


def topic_of(topic: Column, source_title: Column, title: Column) -> Column:
    """`topic:` and the first 80 characters of the slug of a given topic, else of the title."""
    given = F.coalesce(*[F.when(known(c) != "", c) for c in (topic, source_title, title)], F.lit(""))
    made = F.regexp_replace(F.regexp_replace(F.lower(given), "[^a-z0-9一-鿿]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("topic:"), F.when(made == "", "unknown").otherwise(F.left(made, F.lit(80))))


def event_identity(text: Column, kind: Column, topic: Column, title: Column, activity: Column, release_url: Column) -> Column:
    """struct<type, key>: code activity by repository, else who and what the text names, else the topic. text: `source_text`; title: as the source gave it; topic: `topic_of`."""
    repository = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.substring_index(known(title), ":", 1))), r"[^a-z0-9._/-]+", "-"), "^-+|-+$", "")
    code = F.when((known(activity) == "github_release") | (known(release_url) != ""), "github_release").when(known(activity) == "new_repository", "github_new_repository").otherwise("github_activity")
    prefix = F.element_at(F.create_map(*[F.lit(v) for pair in CODE.items() for v in pair]), code)

    def named(n):
        key = F.when((n["who"] != "") & (n["what"] != ""), F.concat(F.lit("event:"), n["who"], F.lit(":"), n["what"])).when(n["what"] != "", F.concat(F.lit("event:"), n["what"], F.lit(":"), F.substring(topic, F.lit(7), F.length(topic)))).otherwise(topic)
        return F.struct(F.when(n["what"] != "", n["what"]).otherwise("news").alias("type"), key.alias("key"))

    of_code = F.struct(code.alias("type"), F.concat(prefix, F.when(repository == "", "unknown").otherwise(repository)).alias("key"))
    return F.when(kind == "github", of_code).otherwise(once(F.struct(first_named(text, WHO).alias("who"), first_named(text, WHAT).alias("what")), named))


def evidence_complete(title: Column, source_summary: Column, url: Column, published_at: Column) -> Column:
    return (F.trim(known(title)) != "") & (F.trim(known(source_summary)) != "") & is_http(url) & published_at.isNotNull()


def signals(kind_of_event: Column, complete: Column, tier: Column, published_at: Column, now: Column) -> Column:
    """struct<score, reasons> of a candidate's editorial worth."""
    fresh = F.when(published_at.isNull(), 0.0).otherwise(editorial_freshness(published_at, now))
    reasons = [
        F.when(~complete, "incomplete_source_evidence"), F.when(fresh < 1.5, "stale_or_missing_timestamp"), F.when(kind_of_event == "github_activity", "github_activity_not_release"),
        F.when(kind_of_event == "github_new_repository", "github_new_repository"), F.when(kind_of_event == "github_release", "github_release_evidence"),
    ]
    return F.struct(editorial_score(complete, fresh, F.when(known(tier) == "", "media").otherwise(tier), kind_of_event).alias("score"), F.array_compact(F.array(*reasons)).alias("reasons"))


def analysis(score: Column, complete: Column, tier: Column, cross_sources: Column, quality: Column, quality_reason: Column, risky: Column, unsure: Column) -> Column:
    """struct of the scores of a candidate, its risk, and a note on each."""
    ready = quality == "ready"
    made = F.struct(clamp(score).alias("importance"), evidence_score(ready, complete, tier, cross_sources).alias("evidence"))

    def noted(s):
        risk, impact = risk_level(risky, s["evidence"], ready, unsure), impact_score(s["importance"], s["evidence"])
        importance = F.when(s["importance"] >= 8, IMPORTANCE[0]).when(s["importance"] >= 5, IMPORTANCE[1]).otherwise(IMPORTANCE[2])
        said = F.when(known(quality_reason) != "", quality_reason).otherwise(UNAVAILABLE)
        verifiable = F.when(~ready, F.concat(F.lit(QUALITY), quality, F.lit(": "), said)).when(s["evidence"] >= 8, F.concat(F.lit(VERIFIABLE[0]), cross_sources.cast("long").cast("string"), F.lit(VERIFIABLE[1]))).otherwise(UNVERIFIABLE)
        told = F.when(risk == "high", IMPACT[0]).when(impact >= 8, IMPACT[1]).otherwise(IMPACT[2])
        return F.struct(s["importance"].alias("importance"), s["evidence"].alias("evidence"), impact.alias("impact"), risk.alias("risk"), importance.alias("importance_reason"), verifiable.alias("verifiability_reason"), told.alias("impact_analysis"))

    return once(made, noted)
