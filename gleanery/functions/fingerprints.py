"""Light fingerprints of events: firms, people, products and actions that a title and summary name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, known, once, substrings_held

#: Names that a fingerprint looks for.
FIRMS = ("openai", "anthropic", "google deepmind", "deepmind", "microsoft", "meta", "xai", "nvidia", "apple", "tesla", "amazon", "intel", "amd", "ibm")
PEOPLE = (
    "sam altman", "greg brockman", "ilya sutskever", "mira murati", "fidji simo", "kevin weil", "dario amodei", "daniela amodei", "demis hassabis", "sundar pichai",
    "satya nadella", "mark zuckerberg", "elon musk", "jensen huang", "lisa su", "tim cook", "jeff bezos", "andy jassy", "arthur mensch", "aravind srinivas",
    "emmett shear", "jakub pachocki", "john schulman", "jan leike", "noam shazeer", "aidan gomez", "clem delangue", "yann lecun", "geoffrey hinton", "andrew ng",
    "fei-fei li", "andrej karpathy", "李开复", "王小川", "周鸿祎", "张一鸣", "hinton", "lecun", "bengio", "karpathy",
)
PRODUCTS = ("gpt", "claude", "gemini", "llama", "grok", "mistral", "mixtral", "deepseek", "qwen", "phi", "muse", "dall-e", "sora", "midjourney", "copilot", "chatgpt", "diffusion", "whisper")
#: Words of actions, by category; the last two kinds of words belong to none.
CATEGORIES = {
    "departure": ("离职", "卸任", "辞职", "下台", "跳槽", "resign", "step down", "leave", "depart", "quit"),
    "joining": ("加入", "任命", "上任", "join", "appoint", "hire", "promote"),
    "release": ("发布", "推出", "开源", "launch", "release", "open-source"),
    "funding": ("融资", "投资", "估值", "上市", "acquire", "raise", "partner"),
    "legal": ("起诉", "诉讼", "索赔", "sue", "sues", "sued", "lawsuit", "litigation", "legal action"),
}
OTHER_ACTIONS = ("收购", "合作", "调整", "restructure")
FIELDS = ("companies", "people", "products", "actions")


def fingerprint(title: Column, summary: Column) -> Column:
    """struct<companies, people, products, actions>, each sorted; names and words are substrings in lower case."""
    acts = (*(w for many in CATEGORIES.values() for w in many), *OTHER_ACTIONS)
    names = dict(zip(FIELDS, (FIRMS, PEOPLE, PRODUCTS, acts), strict=True))
    return once(F.lower(F.concat_ws(" ", known(title), known(summary))), lambda x: F.struct(*[substrings_held(x, many).alias(f) for f, many in names.items()]))


def overlap(a: Column, b: Column) -> Column:
    return F.struct(*[F.array_sort(F.array_intersect(a[f], b[f])).alias(f"shared_{f}") for f in FIELDS])


def same_category(a: Column, b: Column) -> Column:
    """Whether two lists of actions have words of one category."""
    found = F.lit(False)
    for words in CATEGORIES.values():
        held = lambda x, words=words: F.exists(x, lambda w: w.isin(*words))
        found = found | (held(a) & held(b))
    return found


def keeper_key(kind: Column, cross_sources: Column, confidence: Column, pictured: Column, score: Column) -> Column:
    """What decides which of two repeats stays, the greater one: feeds, other sources, confidence, a picture, the score."""
    sure = F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1).otherwise(0)
    return F.struct((kind == "rss").cast("int").alias("feed"), F.coalesce(cross_sources, F.lit(0)).alias("cross"), sure.alias("sure"), pictured.cast("int").alias("pictured"), F.coalesce(score, F.lit(0.0)).alias("score"))
