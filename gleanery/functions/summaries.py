"""Generated titles and summaries held against the source: products that it does not name, activity told as a launch, and the packet of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, known, once, unescape

#: Products and versions that a title may not add, and the texts that come with activity and evidence.
PRODUCTS = (
    r"(?i)\b(GPT[-\s]?\d[\d.]*|Claude\s?\d[\d.]*|Gemini\s?\d[\d.]*|Llama\s?\d[\d.]*|"
    r"Grok[-\s]?\d[\d.]*|Mistral[-\s]?\d[\d.]*|Qwen[-\s]?\d[\d.]*|"
    r"DeepSeek[-\s]?[A-Za-z0-9.]*|Phi[-\s]?\d[\d.]*|Stable\s?Diffusion\s?\d[\d.]*|"
    r"DALL[-\s]?E\s?\d[\d.]*|Midjourney\s?\d[\d.]*|Sora[-\s]?\d[\d.]*|"
    r"Terra|Luna|Atlas|Helios|Nova|Orion|Falcon|Titan|Aurora)\b"
)
ACTIVITY = {"recent_push": "GitHub 项目近期活跃：", "new_repository": "GitHub 新开源项目："}
UNNAMED, NOT_GIVEN, NO_VERSION, SUMMARY = "开源项目", "（未提供）", "（版本未提供）", 200


def display(value: Column) -> Column:
    """Text as it is shown: character references resolved up to three times, white space collapsed."""
    return collapse(reduce(lambda x, _: unescape(x), range(3), known(value)))


def either(first: Column, second: Column) -> Column:
    return F.when(known(first) != "", first).otherwise(known(second))


def products(text: Column) -> Column:
    """Distinct products and versions that a text names, in lower case, sorted. Letters and digits are ASCII here, as bounds of words too."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(known(text), F.lit(PRODUCTS), F.lit(1)), F.lower)))


def fact_check(shown: Column, title: Column, summary: Column, url: Column, source: Column) -> Column:
    """struct<valid, suspicious, action>: products that a shown title names and none of the source's fields does. An empty title is kept."""
    original = F.concat_ws(" ", known(title), known(summary), known(url), known(source))
    added = F.when(known(shown) == "", F.array().cast("array<string>")).otherwise(F.array_except(products(shown), products(original)))
    return once(added, lambda x: F.struct((F.size(x) == 0).alias("valid"), x.alias("suspicious"), F.when(F.size(x) == 0, "keep").otherwise("fallback").alias("action")))


def guarded(shown: Column, summary: Column, title: Column, source_summary: Column, kind: Column, activity: Column) -> Column:
    """struct<title, summary>: what is shown, but of a repository's push or first appearance only that, with its own summary if it has one."""
    plain = (kind == "github") & known(activity).isin(*ACTIVITY)
    name = F.trim(F.substring_index(display(title), ":", 1))
    prefix = F.when(activity == "recent_push", ACTIVITY["recent_push"]).otherwise(ACTIVITY["new_repository"])
    own = F.left(display(source_summary), F.lit(SUMMARY))
    said = F.concat(prefix, F.when(name == "", UNNAMED).otherwise(name))
    return F.struct(F.when(F.coalesce(plain, F.lit(False)), said).otherwise(shown).alias("title"), F.when(F.coalesce(plain, F.lit(False)) & (own != ""), own).otherwise(summary).alias("summary"))


def packet(index: Column, title: Column, source: Column, kind: Column, summary: Column, description: Column, notes: Column, tag: Column) -> Column:
    """The lines of evidence that a summary may use."""
    c = {n: display(x) for n, x in {"title": title, "source": source, "kind": kind, "summary": summary, "about": description, "notes": notes, "tag": tag}.items()}
    line = lambda label, text, when=None: F.when(text != "" if when is None else when, F.concat(F.lit(label), text))
    release = c["kind"] == "github"
    lines = [
        F.concat(index.cast("string"), F.lit(". 原始标题: "), c["title"]), line("来源: ", c["source"]), line("来源类型: ", c["kind"]), F.concat(F.lit("原始摘要: "), F.when(c["summary"] == "", NOT_GIVEN).otherwise(c["summary"])),
        line("GitHub 项目用途: ", c["about"], release & (c["about"] != "")),
        F.when(release & (c["notes"] != ""), F.concat(F.lit("GitHub 本次 Release "), F.when(c["tag"] == "", NO_VERSION).otherwise(c["tag"]), F.lit(": "), c["notes"])),
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")
