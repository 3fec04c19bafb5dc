"""Snapshots of several versions read to one frame, and production snapshots with their times restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import aware
from ..operators.payloads import _field, _opens, text_at
from ..operators.predicates import first_reason

LATEST = 2
#: Fixed values of published items.
ORIGINS, VALIDATIONS, MODES = ("llm", "source"), ("rules_and_llm", "rules_only"), ("title_only", "expanded")
#: What an item of either version becomes.
ITEM = "struct<pos: int, event_key: string, title: string, brief: string, url: string, source: string, source_type: string, published_at: string, content_type: string, brief_mode: string, legacy: boolean>"
COUNTERS = ("fetched_total", "source_merge_removed", "filtered_total", "topic_cluster_removed", "final_editorial_dedup_removed", "returned_candidate_count")


def files(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each file: a snapshot is one small document."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def _list_at(root: Column, path: str) -> Column:
    """The variants of an array at a path; null where there is no array."""
    return F.when(_opens(_field(root, path), "["), F.try_variant_get(root, path, "array<variant>"))


def _all_objects(values: Column) -> Column:
    return F.forall(values, lambda x: _opens(x, "{"))


def _item_v2(x: Column, pos: Column) -> Column:
    brief = F.try_variant_get(x, "$.brief", "string")
    mode = F.when(text_at(x, "$.brief_mode") != "", text_at(x, "$.brief_mode")).when(F.trim(brief) == "", "title_only").otherwise("expanded")
    kind = F.when(text_at(x, "$.content_type") == "", "fact_event").otherwise(text_at(x, "$.content_type"))
    get = lambda p: F.try_variant_get(x, p, "string")
    return F.struct(pos.alias("pos"), get("$.event_key").alias("event_key"), get("$.chinese_title").alias("title"), brief.alias("brief"), get("$.canonical_source.url").alias("url"), get("$.canonical_source.publisher_name").alias("source"), get("$.canonical_source.channel").alias("source_type"), get("$.published_at").alias("published_at"), kind.alias("content_type"), mode.alias("brief_mode"), F.lit(False).alias("legacy"))


def _item_v1(x: Column, pos: Column) -> Column:
    """An older item as the newer ones are; what it does not say is null."""
    get = lambda p: F.nullif(text_at(x, p), F.lit(""))
    brief = F.coalesce(get("$.brief"), get("$.summary"), F.lit(""))
    mode = F.when(brief == "", "title_only").otherwise("expanded")
    return F.struct(pos.alias("pos"), get("$.event_key").alias("event_key"), F.coalesce(get("$.chinese_title"), get("$.title")).alias("title"), brief.alias("brief"), F.coalesce(get("$.source_url"), get("$.url")).alias("url"), get("$.source").alias("source"), get("$.source_type").alias("source_type"), get("$.published_at").alias("published_at"), F.lit("fact_event").alias("content_type"), mode.alias("brief_mode"), F.lit(True).alias("legacy"))


def _bad_item(x: Column) -> Column:
    """Whether an item of the present version misses a field or contradicts itself."""
    needed = [F.try_variant_get(x, p, "string") for p in ("$.event_key", "$.chinese_title", "$.brief", "$.published_at", "$.content_origin", "$.validation_mode")]
    item = _item_v2(x, F.lit(0))
    brief, author = F.trim(item["brief"]), text_at(x, "$.opinion_author")
    wrong = F.lit(False)
    for c in needed:
        wrong = wrong | c.isNull()
    wrong = wrong | ~text_at(x, "$.content_origin").isin(*ORIGINS) | ~text_at(x, "$.validation_mode").isin(*VALIDATIONS)
    wrong = wrong | ~_opens(_field(x, "$.canonical_source"), "{") | aware(item["published_at"]).isNull() | ~item["content_type"].isin("fact_event", "attributed_opinion")
    wrong = wrong | ((item["content_type"] == "attributed_opinion") & (author == "")) | ~item["brief_mode"].isin(*MODES)
    return F.coalesce(wrong | ((item["brief_mode"] == "title_only") != (brief == "")), F.lit(True))


def latest(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows without the text, with version, items (ITEM, of either version), decision, execution, diagnostics (JSON text) and problem.

    Version 1, or none, is the older shape, whose `news` become items; version 2 is the present one. A snapshot that
    cannot be read, is of another version or contradicts itself has a problem, named first, and no items.
    """
    root = F.col("_root")
    made = rows.withColumn("_root", F.try_parse_json(text))
    said = F.to_json(_field(root, "$.schema_version"))
    version = F.when(said.isNull() | said.isin("null", "1"), 1).when(said == "2", LATEST)
    v2, v1 = F.coalesce(version == LATEST, F.lit(False)), F.coalesce(version == 1, F.lit(False))
    items, news = _list_at(root, "$.brief_items"), F.when(F.to_json(_field(root, "$.news")).isNull(), F.array().cast("array<variant>")).otherwise(_list_at(root, "$.news"))
    decision, execution, told = (F.to_json(_field(root, f"$.{c}")) for c in ("draft_decision", "draft_execution", "diagnostics"))
    undecided = decision.isNull() | (decision == "null")
    excused = (F.size(items) == 0) & (text_at(root, "$.draft_execution.status") == "failed") & (text_at(root, "$.draft_execution.reason") == "invalid_configuration")
    rules = [
        ("cannot read latest snapshot", root.isNull()), ("latest snapshot root must be an object", ~_opens(root, "{")), ("unsupported latest schema version", version.isNull()),
        ("v1 news must be a list of objects", v1 & ~F.coalesce(_all_objects(news), F.lit(False))), ("v2 brief_items must be a list", v2 & items.isNull()),
        ("v2 diagnostics must be an object", v2 & told.isNotNull() & ~told.startswith("{")),
        ("invalid v2 latest snapshot", v2 & (~F.coalesce(execution.startswith("{"), F.lit(False)) | ~_all_objects(items) | F.exists(items, _bad_item) | (undecided & ~excused) | (~undecided & ~F.coalesce(decision.startswith("{"), F.lit(False))))),
    ]
    judged = made.withColumn("problem", first_reason(rules))
    good = F.col("problem") == ""
    shown = F.when(v2, F.transform(items, lambda x, i: _item_v2(x, i).cast(ITEM))).otherwise(F.transform(news, lambda x, i: _item_v1(x, i).cast(ITEM)))
    out = judged.select("*", F.when(good, version).alias("version"), F.when(good, shown).alias("items"), F.when(good & v2 & ~undecided, decision).alias("decision"), F.when(good & v2, execution).alias("execution"), F.when(good, F.when(v2, F.coalesce(told, F.lit("{}"))).otherwise("{}")).alias("diagnostics"))
    return out.drop("_root", text)


def latest_v2(items: DataFrame, scope: str, decision: Column, execution: Column, diagnostics: Column) -> DataFrame:
    """scope and text: the present version of each edition's snapshot. items: scope, pos and `item` (a struct of the published fields)."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json("item", {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"])
    whole = items.groupBy(scope).agg(held.alias("_items"))
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = F.concat(F.lit("{"), F.concat_ws(",", part("schema_version", F.lit(str(LATEST))), part("brief_items", F.concat(F.lit("["), F.array_join("_items", ","), F.lit("]"))), part("draft_decision", F.coalesce(decision, F.lit("null"))), part("draft_execution", execution), part("diagnostics", diagnostics)), F.lit("}"))
    return whole.select(scope, text.alias("text"))


PRODUCTION = "production-snapshot-v1"


def production(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows without the text, with report_date, generated_at, items (array<struct<pos, published_at, source_published_at, json>>), the counters and problem.

    Times of items are restored; one that is no time with an offset is a problem of the snapshot, as is another schema,
    a date of another form, a time of making that is not UTC, or items that are no objects. Where no counters are
    written, the returned ones are the items.
    """
    root = F.col("_root")
    made = rows.withColumn("_root", F.try_parse_json(text))
    items = _list_at(root, "$.items")
    day, at = text_at(root, "$.report_date"), text_at(root, "$.generated_at")
    zero = at.rlike(r"(Z|[+-]00:00)$")
    fields = ("published_at", "source_published_at")
    bad_time = lambda x, f: F.coalesce(F.to_json(_field(x, f"$.{f}")) != "null", F.lit(False)) & aware(text_at(x, f"$.{f}")).isNull()
    counts = F.to_json(_field(root, "$.collection_diagnostics"))
    rules = [
        ("cannot read production snapshot", root.isNull()), ("production snapshot root must be an object", ~_opens(root, "{")), ("unsupported production snapshot schema", text_at(root, "$.schema_version") != PRODUCTION),
        ("report_date must use YYYY-MM-DD", ~day.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")), ("generated_at must use UTC", aware(at).isNull() | ~zero),
        ("items must be a list", items.isNull()), ("items must contain only objects", ~_all_objects(items)), ("item times must be ISO with an offset", F.exists(items, lambda x: bad_time(x, fields[0]) | bad_time(x, fields[1]))),
        ("collection_diagnostics must be an object", counts.isNotNull() & (counts != "null") & ~counts.startswith("{")),
    ]
    judged = made.withColumn("problem", first_reason(rules))
    good = F.col("problem") == ""
    shown = F.transform(items, lambda x, i: F.struct(i.alias("pos"), *[aware(text_at(x, f"$.{f}")).alias(f) for f in fields], F.to_json(x).alias("json")))
    number = lambda c: F.try_variant_get(root, f"$.collection_diagnostics.{c}", "long")
    fallback = {c: F.lit(0) for c in COUNTERS} | {"returned_candidate_count": F.size(items)}
    return judged.select("*", F.when(good, day).alias("report_date"), F.when(good, aware(at)).alias("generated_at"), F.when(good, shown).alias("items"), *[F.when(good, F.coalesce(number(c), fallback[c])).cast("long").alias(c) for c in COUNTERS]).drop("_root", text)
