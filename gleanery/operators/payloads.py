"""Nested JSON of unknown depth: all objects of a payload in depth-first order, and the posts among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import keep_first
from .lineage import settled


def _opens(value: Column, mark: str) -> Column:
    return F.coalesce(F.to_json(value).startswith(mark), F.lit(False))


def walk(rows: DataFrame, id_column: str, payload: str) -> DataFrame:
    """id, path, pointer, raw and value of every object in the payloads, the payload itself included. `path` (array<int>) sorts them in depth-first order, members in the order of the text; `pointer` names the place; raw is the object's text and value its variant.

    A level of nesting is one step, in which the containers of the level before are taken apart, so payloads of any
    number are walked at once. Null payloads, and such as are no JSON (an object that repeats a key is none), give no row.
    """
    none = F.array().cast("array<int>")
    root = rows.select(F.col(id_column), F.col(payload).alias("raw"), F.try_parse_json(payload).alias("value"), none.alias("path"), F.lit("").alias("pointer"))
    level = settled(root.where(_opens(F.col("value"), "{") | _opens(F.col("value"), "[")))
    found = None
    while not level.isEmpty():
        here = level.where(_opens(F.col("value"), "{"))
        found = here if found is None else found.unionByName(here)
        # Variants sort their keys, so place and text come from the JSON text.
        parts = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("_pos", "_key", "_value"))
        parts = parts.where(_opens(F.col("_value"), "{") | _opens(F.col("_value"), "["))
        place = F.when(F.col("_key").isNull(), F.col("_pos")).otherwise(F.array_position(F.json_object_keys("raw"), F.col("_key")).cast("int") - 1)
        text = F.when(F.col("_key").isNull(), F.get(F.from_json("raw", "array<string>"), F.col("_pos"))).otherwise(F.from_json("raw", "map<string,string>")[F.col("_key")])
        name = F.concat("pointer", F.lit("/"), F.coalesce("_key", F.col("_pos").cast("string")))
        level = settled(parts.select(id_column, text.alias("raw"), F.col("_value").alias("value"), F.concat("path", F.array(place)).alias("path"), name.alias("pointer")))
    columns = [id_column, "path", "pointer", "raw", "value"]
    return (root.limit(0) if found is None else found).select(columns)


def _field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def text_at(value: Column, path: str) -> Column:
    """The trimmed string at a path of a variant; empty where there is none or it is no string."""
    found = _field(value, path)
    return F.coalesce(F.when(_opens(found, '"'), F.regexp_replace(F.try_variant_get(value, path, "string"), r"^\s+|\s+$", "")), F.lit(""))


def public_id(text: Column) -> Column:
    return F.when(text.rlike(r"\A[0-9]{1,32}\z"), text).otherwise("")


def count_at(value: Column, path: str) -> Column:
    """The number at a path as a whole one, 0 at least; strings of digits count, truth values and all else are 0."""
    text = F.to_json(_field(value, path))
    digits = F.regexp_extract(text, r'^"?\s*([+-]?[0-9]{1,18})\s*"?$', 1)
    number = F.when(digits != "", digits.cast("long")).when(~text.startswith('"'), F.try_variant_get(value, path, "double").cast("long"))
    truth = text.isin("true", "false")
    return F.greatest(F.coalesce(F.when(~truth, number), F.lit(0)), F.lit(0)).cast("long")


COUNTS = {"like_count": "favorite_count", "repost_count": "retweet_count", "reply_count": "reply_count", "quote_count": "quote_count"}
AUTHOR = "$.core.user_results.result.legacy.screen_name"


def posts(objects: DataFrame, id_column: str) -> DataFrame:
    """id, nth and the fields of the posts among the objects of `walk`: those with a `legacy` object, a numeric id and a text. Of posts with one id the first in depth-first order stays; nth is its place among them."""
    v = F.col("value")
    own = F.to_json(_field(v, "$.rest_id"))
    blank = own.isNull() | own.isin("null", '""', "0", "0.0", "false", "[]", "{}")
    post = public_id(F.when(blank, text_at(v, "$.legacy.id_str")).otherwise(text_at(v, "$.rest_id")))
    thread = public_id(text_at(v, "$.legacy.conversation_id_str"))
    rows = objects.where(_opens(_field(v, "$.legacy"), "{")).select(
        id_column, "path", post.alias("post_id"), text_at(v, "$.legacy.full_text").alias("text"), text_at(v, AUTHOR).alias("author"), text_at(v, "$.legacy.created_at").alias("created_at"), thread.alias("thread"),
        public_id(text_at(v, "$.legacy.in_reply_to_status_id_str")).alias("reply_to_id"), public_id(text_at(v, "$.legacy.quoted_status_id_str")).alias("quoted_id"),
        *[count_at(v, f"$.legacy.{field}").alias(name) for name, field in COUNTS.items()],
    )
    first = keep_first(rows.where((F.col("post_id") != "") & (F.col("text") != "")), [id_column, "post_id"], [F.col("path")])
    return first.withColumn("thread_id", F.when(F.col("thread") == "", F.col("post_id")).otherwise(F.col("thread"))).drop("thread")
