"""Analytics over runs and feedback: counts, zero-filled histograms, priority samples, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import SCORE_BUCKETS, ratio, score_bucket

LABELS = ("good_topic", "bad_topic", "duplicate", "not_interesting")
NEGATIVE = LABELS[1:]
ACTIONS = ("write", "reserve", "reject")
RISKS = ("low", "medium", "high")


def zero_filled(rows: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """Rows per value of a fixed domain, 0 where there are none; other values are not counted."""
    domain = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return domain.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def label_counts(label: Column) -> list[Column]:
    return [F.count_if(F.coalesce(label == name, F.lit(False))).alias(name) for name in LABELS]


def by_label(rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    """One row per value of key with the count of each label."""
    return rows.groupBy(key).agg(*label_counts(F.col(label)))


def filled_by_label(rows: DataFrame, key: str, values: tuple[str, ...], label: str = "label") -> DataFrame:
    domain = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    counts = by_label(rows, key, label)
    return domain.join(counts, key, "left").select(key, *[F.coalesce(name, F.lit(0)).alias(name) for name in LABELS])


def coverage(runs: DataFrame) -> DataFrame:
    """Runs, runs by state, days, first and last time."""
    day = F.to_date("generated_at")
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_distinct(day).alias("days"), F.min("generated_at").alias("first_at"), F.max("generated_at").alias("last_at"))


def feedback_summary(records: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """Per source: candidates, reviewed ones, their share, and the counts by label. records: keys, source; feedback: keys, label (one row per key)."""
    both = records.join(feedback.select(*keys, "label"), keys, "left")
    counted = both.groupBy("source").agg(F.count("*").alias("candidates"), F.count("label").alias("reviewed"), *label_counts(F.col("label")))
    return counted.select("*", ratio(F.col("reviewed"), F.col("candidates")).alias("coverage"), sum((F.col(n) for n in NEGATIVE), F.lit(0)).alias("negative"))


def calibration(judged: DataFrame) -> DataFrame:
    """Counts by label for each score bucket, empty ones too. judged: score, label."""
    return filled_by_label(judged.withColumn("bucket", score_bucket(F.col("score"))), "bucket", SCORE_BUCKETS)


def risk_calibration(judged: DataFrame) -> DataFrame:
    """Counts by label for each level of risk, empty ones too; other levels are not counted. judged: risk, label."""
    return filled_by_label(judged, "risk", RISKS)


def feedback_totals(judged: DataFrame, least: int = 20) -> DataFrame:
    """One row: the counts by label, the reviewed rows, and whether they are too few to tell."""
    return judged.agg(*label_counts(F.col("label")), F.count("label").alias("reviewed")).withColumn("few", (F.col("reviewed") < least).cast("int"))


def noted(judged: DataFrame, size: int = 10) -> DataFrame:
    """The report of reviewed rows that carry a note: the latest first."""
    return judged.where(F.coalesce("note", F.lit("")) != "").orderBy(F.desc("recorded_at"), F.desc("id")).limit(size)


def run_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run: candidates, decisions by action, levels of score and of risk, and how often each reason rejected.

    rows: keys, action, score, risk, reason. Reasons are counted first, so a run's map has one entry per reason.
    """
    bucket = score_bucket(F.col("score"))
    counted = rows.groupBy(*keys).agg(
        F.count("*").alias("candidates"), *[F.count_if(F.coalesce(F.col("action") == a, F.lit(False))).alias(f"{a}_count") for a in ACTIONS],
        *[F.count_if(bucket == b).alias(b) for b in SCORE_BUCKETS], *[F.count_if(F.coalesce(F.col("risk") == r, F.lit(False))).alias(f"risk_{r}") for r in RISKS],
    )
    reasons = rows.where(F.col("action") == "reject").groupBy(*keys, "reason").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("reject_reasons"))
    return counted.join(reasons, keys, "left").withColumn("reject_reasons", F.coalesce("reject_reasons", F.create_map().cast("map<string,bigint>")))


def misjudged(judged: DataFrame, high: float = 8.5, size: int = 10) -> DataFrame:
    """The report of rows of a high score with a negative label: highest score first, then the earliest."""
    return judged.where((F.col("score") >= high) & F.col("label").isin(*NEGATIVE)).orderBy(F.desc("score"), "recorded_at", "id").limit(size)


def missed(judged: DataFrame, low: float = 7.0, size: int = 10) -> DataFrame:
    return judged.where((F.col("score") < low) & (F.col("label") == LABELS[0])).orderBy("score", "recorded_at", "id").limit(size)


def outcomes(decided: DataFrame) -> DataFrame:
    """Counts by label for each action. decided: action, label."""
    return filled_by_label(decided, "action", ACTIONS)


def rejection_reasons(decided: DataFrame) -> DataFrame:
    return decided.where((F.col("action") == "reject") & (F.col("reason") != "")).groupBy("reason").agg(F.count("*").alias("n"))


def draft_decision(items: DataFrame, least_items: int = 5, least_facts: int = 3, most_opinions: int = 3, per_author: int = 1) -> DataFrame:
    """One row per edition: counts and the reasons against it in a fixed order. items: edition, event, opinion, author, valid.

    Authors and events are counted per edition first, so that a large edition is folded before it is gathered.
    """
    authors = items.where("opinion").groupBy("edition", "author").agg(F.count("*").alias("n")).groupBy("edition").agg(F.max("n").alias("of_author"))
    repeats = items.groupBy("edition", "event").agg(F.count("*").alias("n")).groupBy("edition").agg(F.max("n").alias("of_event"))
    whole = items.groupBy("edition").agg(F.count("*").alias("items"), F.count_if("opinion").alias("opinions"), F.count_if(~F.col("valid")).alias("invalid"))
    all_ = whole.join(authors, "edition", "left").join(repeats, "edition", "left")
    rules = [
        ("insufficient_items", F.col("items") < least_items), ("insufficient_fact_items", F.col("items") - F.col("opinions") < least_facts),
        ("opinion_limit", F.col("opinions") > most_opinions), ("opinion_author_limit", F.coalesce("of_author", F.lit(0)) > per_author),
        ("invalid_final_item", F.col("invalid") > 0), ("duplicate_event_remaining", F.col("of_event") > 1),
    ]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(holds, name) for name, holds in rules])), ",")
    return all_.select("edition", "items", "opinions", reasons.alias("reasons"))


def merged_counters(rows: DataFrame, counters: str) -> DataFrame:
    """Sum by key over maps of counters."""
    return rows.select(F.explode(counters).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def balance_counts(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """How often each value of each dimension occurs, in one pass: dimension, value, n. A dimension is an array of strings; empty strings do not count."""

    def named(dimension: str):
        return lambda value: F.named_struct(F.lit("dimension"), F.lit(dimension), F.lit("value"), value)

    each = F.flatten(F.array(*[F.transform(c, named(n)) for n, c in dimensions.items()]))
    return rows.select(F.explode(each).alias("d")).select("d.dimension", "d.value").where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("dimension", "value").agg(F.count("*").alias("n"))


#: What a small sample is warned of, and from how many days and labels on it is not small.
NO_RUNS, NO_FEEDBACK, FEW_DAYS, FEW_LABELS = "没有可用的影子运行历史", "没有人工反馈", "覆盖天数少于 3 天", "人工反馈少于 20 条"
LEAST_DAYS, LEAST_LABELS = 3, 20


def sample_warnings(runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """pos and warning of what a history is too small for. runs: generated_at; feedback: a row per reviewed candidate."""
    counted = runs.agg(F.count("*").alias("runs"), F.count_distinct(F.to_date("generated_at")).alias("days")).join(feedback.agg(F.count("*").alias("labels")))
    rules = [(NO_RUNS, F.col("runs") == 0), (NO_FEEDBACK, F.col("labels") == 0), (FEW_DAYS, F.col("days") < LEAST_DAYS), (FEW_LABELS, F.col("labels") < LEAST_LABELS)]
    return counted.select(F.posexplode(F.array_compact(F.array(*[F.when(holds, F.lit(text)) for text, holds in rules]))).alias("pos", "warning"))
