"""Replies that say how two reports relate, held against a declared schema and both texts: one expression, and the first fault's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.predicates import first_reason
from .text import IDEOGRAPH, folded, known, once

#: The fields of a reply, the relations it may name, and subjects that are too broad or too general to make one event of two reports.
FIELDS = ("relationship", "shared_subjects", "shared_action")
RELATIONS = ("same_event", "distinct", "uncertain")
BROAD = ("anthropic", "deepseek", "google", "google deepmind", "meta", "microsoft", "mistral ai", "nvidia", "openai", "qwen")
GENERAL = ("ai", "company", "companies", "executive", "executives", "leader", "leaders", "organization", "organizations", "team", "teams")
#: Faults in the order in which they are looked for.
FAULTS = (
    "no_object", "wrong_fields", "unknown_relationship", "subjects_no_texts", "action_no_text", "same_event_without_subject_or_action", "no_strong_subject", "subject_not_anchored", "action_not_shared",
)


def compared(value: Column) -> Column:
    """Letters and digits in one case, anything else as single blanks."""
    return F.trim(F.regexp_replace(folded(value), "[^a-z0-9一-鿿]+", " "))


def anchored(value: Column, text: Column) -> Column:
    """Whether a compared value stands in a compared text: as whole words, or anywhere if it has ideographs."""
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    # Around a value of letters and digits neither may stand; ideographs may.
    words = F.regexp_replace(text, "[一-鿿]", " ")
    return (value != "") & F.when(value.rlike(IDEOGRAPH), text.contains(value)).otherwise(padded(words).contains(padded(value)))


def fault(reply: Column, left: Column, right: Column, strong: Column, left_actions: Column, right_actions: Column) -> Column:
    """The first fault of a reply (JSON text), or an empty string.

    left and right are the texts of the two reports; strong holds the subjects that both name, actions what each tells of.
    A reply has just the three FIELDS. Its subjects are texts, each of which stands in both reports; an action must be
    told by both; one event needs an action and a subject that is strong, and neither broad nor general.
    """

    def judged(r):
        v = F.try_parse_json(r)
        kind = lambda path: F.substring(F.to_json(F.try_variant_get(v, path, "variant")), 1, 1)
        is_text = lambda x: F.coalesce(F.to_json(x).startswith('"'), F.lit(False))
        items = F.try_variant_get(v, "$.shared_subjects", "array<variant>")
        texts = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
        fields = F.array_sort(F.json_object_keys(r))
        parts = F.struct(
            F.coalesce(F.to_json(v).startswith("{"), F.lit(False)).alias("object"), F.coalesce(fields == F.array(*map(F.lit, sorted(FIELDS))), F.lit(False)).alias("fields"),
            F.when(kind("$.relationship") == '"', F.try_variant_get(v, "$.relationship", "string")).alias("relation"),
            F.coalesce((kind("$.shared_subjects") == "[") & F.forall(items, is_text) & F.forall(texts, lambda t: F.trim(t) != ""), F.lit(False)).alias("listed"),
            F.coalesce(F.transform(texts, compared), F.array().cast("array<string>")).alias("subjects"), F.when(kind("$.shared_action") == '"', F.try_variant_get(v, "$.shared_action", "string")).alias("action"),
            compared(left).alias("left"), compared(right).alias("right"), F.transform(strong, compared).alias("strong"),
        )
        return once(parts, named)

    def named(p):
        one = p["relation"] == "same_event"
        action = compared(p["action"])
        blank = F.trim(known(p["action"])) == ""
        strong_one = F.exists(p["subjects"], lambda s: F.array_contains(p["strong"], s) & ~s.isin(*BROAD, *GENERAL))
        both = F.forall(p["subjects"], lambda s: anchored(s, p["left"]) & anchored(s, p["right"]))
        shared = F.array_contains(left_actions, action) & F.array_contains(right_actions, action)
        holds = (
            ~p["object"], ~p["fields"], p["relation"].isNull() | ~p["relation"].isin(*RELATIONS), ~p["listed"], p["action"].isNull(), one & ((F.size(p["subjects"]) == 0) | blank), one & ~strong_one, ~both, ~blank & ~shared,
        )
        return first_reason(list(zip(FAULTS, holds, strict=True)))

    return once(known(reply), judged)
