"""Drafts as a generator returns them: one JSON object per item, taken only if it keeps the contract to the letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, summary_sentences

#: The exact type of a draft, with its summary as a text or as a list of sentences.
_BINDING = "ARRAY<OBJECT<source_quote: STRING, source_url: STRING, target: STRING>>"
TYPES = tuple(f"OBJECT<brief: {brief}, chinese_title: STRING, event_key: STRING, evidence_targets: {_BINDING}, index: BIGINT>" for brief in ("STRING", "ARRAY<STRING>"))
MOST_SENTENCES = 2


def strict_draft(raw: Column, index: Column, key: Column) -> Column:
    """struct<title, brief, mode, bindings: array<struct<claim, quote, url>>> of a draft in JSON, or null if it breaks the contract.

    It must have just the known fields, each of its type, the expected index and key, a title, at most two sentences, and
    evidence for the title and for each sentence (targets title, brief_1, brief_2) and for nothing else, without a blank.
    """
    at = lambda v, path, kind: F.try_variant_get(v, path, kind)
    blank = lambda s: F.coalesce(F.trim(s), F.lit("")) == ""

    def read(v):
        listed = at(v, "$.brief", "array<string>")
        several = F.when(F.size(listed).between(1, MOST_SENTENCES) & ~F.exists(listed, blank), F.array_join(F.transform(listed, lambda p: F.trim(p)), ""))
        text = F.schema_of_variant(v) == TYPES[0]
        fields = F.struct(
            F.trim(at(v, "$.chinese_title", "string")).alias("title"), F.when(text, F.trim(at(v, "$.brief", "string"))).otherwise(several).alias("brief"),
            at(v, "$.evidence_targets", "array<struct<target string, source_quote string, source_url string>>").alias("given"),
        )
        fits = F.schema_of_variant(v).isin(*TYPES) & (at(v, "$.index", "bigint") == index) & (at(v, "$.event_key", "string") == key)
        return F.when(fits, once(fields, bind))

    def bind(d):
        claims = F.concat(F.array(d["title"]), summary_sentences(d["brief"]))
        names = F.transform(claims, lambda _, i: F.when(i == 0, "title").otherwise(F.concat(F.lit("brief_"), i.cast("string"))))
        targets = F.transform(d["given"], lambda b: F.trim(b["target"]))
        whole = ~F.exists(d["given"], lambda b: blank(b["target"]) | blank(b["source_quote"]) | blank(b["source_url"]))
        exact = (F.size(F.array_except(targets, names)) == 0) & (F.size(F.array_except(names, targets)) == 0)
        good = ~blank(d["title"]) & d["brief"].isNotNull() & (F.size(claims) <= 1 + MOST_SENTENCES) & whole & exact
        claim = lambda b: F.get(claims, (F.array_position(names, F.trim(b["target"])) - 1).cast("int"))
        bindings = F.transform(d["given"], lambda b: F.struct(claim(b).alias("claim"), F.trim(b["source_quote"]).alias("quote"), F.trim(b["source_url"]).alias("url")))
        return F.when(good, F.struct(d["title"].alias("title"), d["brief"].alias("brief"), F.when(d["brief"] == "", "title_only").otherwise("expanded").alias("mode"), bindings.alias("bindings")))

    return once(F.try_parse_json(raw), read)
