"""What becomes of each candidate: choices with their briefs and reasons, one final state each, and two rankings side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import keep_last
from .predicates import first_reason
from .selection import POOL, pool, select_edition

#: What a candidate's brief says, by kind of source, and why a candidate was not written.
BRIEFS = {
    "arxiv": ("关注 AI 技术进展的读者", "说明论文提出的问题、方法边界与潜在应用，不夸大研究结论。", "研究解读型，突出已知问题与方法，不写成产品发布。"),
    "tools": ("关注 AI 工具和开源生态的读者", "先解释项目用途，再说明可确认的版本或社区信号。", "工具价值型，避免将社区活跃表述为公司官宣。"),
    "other": ("关注 AI 产业与产品变化的读者", "先交代可确认的事实，再解释对读者的实际影响或不确定性。", "事实型标题，突出事件主体和已确认动作，避免夸张措辞。"),
}
TOOLS = ("github", "huggingface")
UNREADY, HIGH_RISK, RESERVED, NOT_CHOSEN = "证据不足 ({0}): {1}", "分析阶段标记为高风险，不能进入自动写作。", "符合候选条件，但未进入当期正选。", "未通过当前编辑配额与选题规则。"
UNANALYSED, UNAVAILABLE = "缺少分析结果。", "source content is unavailable"


def brief(kind: Column) -> Column:
    """struct<audience, angle, title_direction> for a kind of source."""
    made = {k: F.struct(*[F.lit(v).alias(n) for v, n in zip(texts, ("audience", "angle", "title_direction"), strict=True)]) for k, texts in BRIEFS.items()}
    return F.when(kind == "arxiv", made["arxiv"]).when(kind.isin(*TOOLS), made["tools"]).otherwise(made["other"])


def topic_of(key: Column, title: Column) -> Column:
    """The topic a row names, or its title, in lower case."""
    named = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    return F.when(named != "", named).otherwise(F.lower(F.trim(F.coalesce(title, F.lit("")))))


def editorial_choice(candidates: DataFrame, analyses: DataFrame, scope: str, target: int = 10, size: int = POOL, **caps) -> DataFrame:
    """scope, id, action (write, reserve or reject), rank (of written ones), reason and brief of every candidate.

    candidates: scope, id, pos, title, source, source_type, primary, radar, topic_key, event_key, editorial_score, score,
    content_quality, quality_reason; analyses: scope, id, risk_level, importance_reason. A candidate without an
    analysis is of high risk, and those have no part in the selection, which is made of the best `size` others of a scope by
    editorial score, score and place. Whatever was selected, a candidate whose content is not ready is rejected; the
    rest of the selection's pool is the reserve.
    """
    told = candidates.join(analyses.select(scope, "id", "risk_level", "importance_reason"), [scope, "id"], "left").withColumns({"risk_level": F.coalesce("risk_level", F.lit("high")), "importance_reason": F.coalesce("importance_reason", F.lit(UNANALYSED))})
    topic = topic_of(F.col("topic_key"), F.col("title"))
    event = F.lower(F.trim(F.coalesce("event_key", F.lit(""))))
    eligible = told.where("risk_level != 'high'").select(
        scope, "id", "pos", "primary", "radar", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source"), topic.alias("topic"), F.when(event != "", event).otherwise(topic).alias("event"),
        F.coalesce("editorial_score", F.lit(0.0)).alias("score"), F.coalesce("score", F.lit(0.0)).alias("_own"),
    )
    pools = pool(eligible, [scope], [F.desc("score"), F.desc("_own"), F.col("pos")], size).drop("_own", "pos")
    chosen = select_edition(pools, [scope], target, **caps).select(scope, "id", "turn")
    rows = told.join(chosen, [scope, "id"], "left")
    ready, high = F.coalesce(F.col("content_quality") == "ready", F.lit(False)), F.col("risk_level") == "high"
    action = F.when(~ready | high, "reject").when(F.col("turn") > 0, "write").when(F.col("turn") == 0, "reserve").otherwise("reject")
    unready = F.format_string(UNREADY.replace("{0}", "%s").replace("{1}", "%s"), F.coalesce("content_quality", F.lit("")), F.coalesce(F.nullif("quality_reason", F.lit("")), F.lit(UNAVAILABLE)))
    reason = F.when(~ready, unready).when(high, HIGH_RISK).when(F.col("turn") > 0, F.col("importance_reason")).when(F.col("turn") == 0, RESERVED).otherwise(NOT_CHOSEN)
    return rows.select(scope, "id", action.alias("action"), F.when(action == "write", F.col("turn")).alias("rank"), reason.alias("reason"), brief(F.col("source_type")).alias("brief"))


#: Stages of the log, in the order in which a candidate meets them.
STAGES = ("collected", "pool", "clustering", "edition")
UNRESOLVED = "semantic_duplicate_unresolved"


def entry(rows: DataFrame, scope: str, stage: str, state: Column, reason: Column, duplicate_of: Column) -> DataFrame:
    """Lines of the log: what a stage says of each of its rows."""
    return rows.select(scope, "id", F.lit(STAGES.index(stage)).alias("seq"), F.lit(stage).alias("stage"), state.alias("state"), reason.alias("reason"), duplicate_of.alias("duplicate_of"))


def audit(scope: str, collected: DataFrame, pools: DataFrame, clustered: DataFrame, edited: DataFrame) -> DataFrame:
    """scope, id, final_state, stage, reason, duplicate_of, relationship and trail of every collected candidate, exactly one row each.

    collected: scope, id; pools: the rows of the pool; clustered: id, event, state (see clustering.events); edited: id,
    state, reason, because_of (see editing.edit). The last stage that a candidate met gave it its state; candidates
    beyond the pool, and events that the edition did not come to, are `not_selected`. The log is folded on the map side.
    """
    none = F.lit(None).cast(collected.schema["id"].dataType)
    event = F.col("state")
    log = [
        entry(collected, scope, "collected", F.lit("not_selected"), F.lit("beyond_pool"), none),
        entry(pools, scope, "pool", F.lit("not_selected"), F.lit("target_reached"), none),
        entry(clustered, scope, "clustering", F.when(event == "merged", "clustered_duplicate").when(event == "quarantined", "quarantined").otherwise("not_selected"), F.when(event == "merged", "same_event").when(event == "quarantined", UNRESOLVED).otherwise("target_reached"), F.when(event == "merged", F.col("event"))),
        entry(edited, scope, "edition", F.col("state"), F.col("reason"), F.col("because_of")),
    ]
    lines = reduce(DataFrame.unionByName, log)
    trail = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "stage", "state").alias("said")))), lambda x: x["said"])
    folded = lines.groupBy(scope, "id").agg(F.max_by(F.struct("stage", "state", "reason", "duplicate_of"), "seq").alias("last"), trail.alias("trail"), F.count_if(F.col("seq") == 0).alias("_times"))
    once = F.assert_true(F.col("_times") == 1, "each candidate is collected once, and none is audited that was not")
    related = F.when(F.col("last.duplicate_of").isNotNull(), F.when(F.col("last.reason") == UNRESOLVED, "uncertain").otherwise("same_event")).otherwise("")
    return folded.withColumn("_once", once).where(F.col("_once").isNull()).select(scope, "id", F.col("last.state").alias("final_state"), "last.stage", "last.reason", "last.duplicate_of", related.alias("relationship"), "trail")


def removed_sentences(original: Column, final: Column) -> Column:
    """Sentences of the original (arrays) that the final text no longer has; of repeated ones so many as are missing, the last ones."""
    times = lambda sentences, s: F.size(F.filter(sentences, lambda x: x == s))
    return F.filter(original, lambda s, i: times(F.slice(original, F.lit(1), i + 1), s) > times(final, s))


def displacements(first: DataFrame, second: DataFrame, scope: str) -> DataFrame:
    """scope, id, rank_first, rank_second, displacement (positive: further ahead in the second) and side (both, dropped, added)."""
    both = first.select(scope, "id", F.col("rank").alias("rank_first")).join(second.select(scope, "id", F.col("rank").alias("rank_second")), [scope, "id"], "full_outer")
    side = F.when(F.col("rank_second").isNull(), "dropped").when(F.col("rank_first").isNull(), "added").otherwise("both")
    return both.select(scope, "id", "rank_first", "rank_second", (F.col("rank_first") - F.col("rank_second")).alias("displacement"), side.alias("side"))


def shadow_comparison(first: DataFrame, second: DataFrame, scope: str, target: int, failures: DataFrame | None = None) -> DataFrame:
    """A row per scope of first: how a second selection would change it, which stays as it is.

    first: scope, id, rank; second: scope, id, rank, ready; failures: scope, error. Rows of second that are not ready
    count for nothing. Where the second failed, or has fewer than `target` ready rows, status is `fallback` with its
    reason, and nothing is recommended. Else `diagnostic_only`, with recommended ids, dropped and added ones, each in
    the order of its own list, overlap (the share of the first `target` ranks that both lists name) and footrule (the
    mean displacement of rows in both, null without any).
    """
    ready = second.where("ready").withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy("rank", "id")))
    moved = displacements(first, ready, scope)
    listed = lambda by, kept: F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct(F.col(by).alias("r"), "id")))), lambda x: x["id"])
    side, within = F.col("side"), (F.col("rank_first") <= target) & (F.col("rank_second") <= target)
    told = moved.groupBy(scope).agg(
        listed("rank_first", F.col("rank_first").isNotNull()).alias("selected"), listed("rank_second", F.col("rank_second").isNotNull()).alias("recommended"), listed("rank_first", side == "dropped").alias("dropped"), listed("rank_second", side == "added").alias("added"),
        (F.count_if(within) / F.lit(float(target))).alias("overlap"), F.avg(F.abs("displacement")).alias("footrule"), F.count("rank_second").alias("_ready"),
    )
    failed = failures.select(scope, "error").distinct().groupBy(scope).agg(F.min("error").alias("_error")) if failures is not None else None
    rows = told.join(first.select(scope).distinct(), scope, "left_semi")
    rows = rows.join(failed, scope, "left") if failed is not None else rows.withColumn("_error", F.lit(None).cast("string"))
    reason = first_reason([("error", F.col("_error").isNotNull()), ("insufficient_ready_write_candidates", F.col("_ready") < target)])
    fallback = reason != ""
    empty = F.array().cast(told.schema["selected"].dataType)
    return rows.select(
        scope, F.when(fallback, "fallback").otherwise("diagnostic_only").alias("status"), F.when(reason == "error", F.concat(F.lit("agent_error:"), "_error")).otherwise(reason).alias("fallback_reason"), "selected",
        *[F.when(fallback, empty).otherwise(F.col(c)).alias(c) for c in ("recommended", "dropped", "added")], *[F.when(~fallback, F.col(c)).alias(c) for c in ("overlap", "footrule")],
    )
