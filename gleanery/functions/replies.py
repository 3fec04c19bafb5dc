"""What a reply that should be JSON holds, however it is wrapped: the value itself, one in a fence, or one amid prose.

Values are JSON text; a reply that holds none gives null. Repeated keys of an object, NaN and infinities are no JSON here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import known, once

#: A fenced block, and a brace block whose inner blocks are flat.
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
BLOCK = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
END = "end of the reply"


def bare(value: Column) -> Column:
    return F.regexp_replace(known(value), r"(?U)^\s+|\s+$", "")


def whole(text: Column) -> Column:
    """The text as one JSON value and nothing after it: parsing alone stops at the value's end, so a mark must still follow."""
    framed = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(f',"{END}":true}}')))
    return once(framed, lambda v: F.when(F.try_variant_get(v, f"$['{END}']", "boolean"), F.to_json(F.try_variant_get(v, "$.value", "variant"))))


def extracted(text: Column) -> Column:
    """The reply's value: the whole reply, else its first fenced block, else its first brace block."""

    def parts(reply):
        group = lambda pattern, n: F.nullif(F.regexp_extract(reply, pattern, n), F.lit(""))
        return F.coalesce(whole(reply), whole(group(FENCE, 1)), whole(group(BLOCK, 0)))

    return once(bare(text), parts)


def first_object(text: Column) -> Column:
    """The reply's object: the whole reply, which must then be one, else the first that starts at some brace and can be read to its end."""

    def at_next_brace(state, _):
        rest = F.substr(state["rest"], F.locate("{", state["rest"]) + 1)
        later = once(rest, lambda r: F.struct(F.to_json(F.try_parse_json(F.concat(F.lit("{"), r))).alias("found"), r.alias("rest")))
        return F.when(state["found"].isNotNull(), state).otherwise(later)

    def read(reply):
        braces = F.length(reply) - F.length(F.replace(reply, F.lit("{"), F.lit("")))
        steps = F.when(braces > 0, F.sequence(F.lit(1), braces)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(None).cast("string").alias("found"), reply.alias("rest"))
        return once(whole(reply), lambda value: F.when(value.isNull(), F.aggregate(steps, start, at_next_brace)["found"]).when(value.startswith("{"), value))

    return once(bare(text), read)


def items(value: Column) -> Column:
    """The values of a reply's list, each as JSON text: the list itself, or that at `items` of an object."""
    v = F.try_parse_json(value)
    listed = F.when(value.startswith("{"), F.try_variant_get(v, "$.items", "array<variant>")).otherwise(F.try_variant_get(v, "$", "array<variant>"))
    return F.transform(listed, lambda x: F.to_json(x))


def index_of(item: Column, path: str = "$.index") -> Column:
    """A whole number, or a text of digits alone; null for any other value."""

    def read(v):
        kind, text = F.schema_of_variant(v), bare(F.try_variant_get(v, "$", "string"))
        return F.when(kind.rlike(r"^(BIGINT|BOOLEAN|DECIMAL\(\d+,0\))$"), F.try_variant_get(v, "$", "bigint")).when((kind == "STRING") & text.rlike(r"^\d+$"), text.try_cast("bigint"))

    return once(F.try_variant_get(F.try_parse_json(item), path, "variant"), read)


def brief_of(item: Column, path: str = "$.brief") -> Column:
    """A text without white space around it, or one or two texts that are not blank, joined; null for any other value."""

    def read(v):
        kind, parts = F.schema_of_variant(v), F.transform(F.try_variant_get(v, "$", "array<string>"), bare)
        good = F.size(parts).between(1, 2) & F.forall(parts, lambda p: p != "")
        return F.when(kind == "STRING", bare(F.try_variant_get(v, "$", "string"))).when((kind == "ARRAY<STRING>") & good, F.array_join(parts, ""))

    return once(F.try_variant_get(F.try_parse_json(item), path, "variant"), read)
