"""What a text names: entities, models, numbers, qualifiers, actions, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bounded_shape, contains_any, folded, jaccard, known, normalized, once, one_of, substrings_held, unescape

#: Names of firms and products that count as entities.
ENTITIES = (
    "openai", "anthropic", "claude", "gpt", "chatgpt", "dall-e", "google", "deepmind", "gemini", "bard", "meta", "llama",
    "microsoft", "copilot", "nvidia", "intel", "amd", "apple", "siri", "amazon", "alexa", "tesla", "elon musk", "stability ai",
    "stable diffusion", "midjourney", "runway", "hugging face", "huggingface", "mistral", "mixtral", "perplexity", "replicate",
    "langchain", "llamaindex", "cursor", "windsurf", "rowboat", "factiq", "backlog", "cowork", "fable", "grok", "xai", "sora",
    "kling", "nexa", "qualcomm", "kimi", "minimax", "qwen", "jiuqian", "jiqizhixin", "qbitai", "36kr", "muse", "instagram",
)
#: What marks a kind of event in a text, as a substring; two reports of one event share a kind.
ACTIONS = {
    "release": ("release", "released", "releases", "launch", "launched", "launches", "roll out", "rollout", "available", "receiving access", "发布", "推出", "上线"),
    "funding": ("funding", "funded", "raises", "raised", "融资", "投资", "估值"),
    "acquisition": ("acquire", "acquired", "acquisition", "merger", "收购", "合并"),
    "partnership": ("partner", "partnership", "collaborat", "合作"),
    "open_source": ("open source", "open-source", "opensource", "开源"),
    "research": ("paper", "study", "research", "论文", "研究"),
    "departure": ("departing", "departure", "leaving", "leaves", "left", "steps down", "stepping down", "resigns", "resigned", "takes off", "headed out the door", "离职", "辞职", "离开", "卸任"),
    "appointment": ("appointed", "appointment", "named", "promoted", "任命", "晋升"),
    "joining": ("joins", "joined", "joining", "hired", "入职", "加入"),
    "layoff": ("layoff", "layoffs", "laid off", "cuts jobs", "裁员"),
    "office": ("office", "campus", "headquarters", "办公室", "总部"),
}
#: What marks a kind of event that a text asserts, as whole words, in the order in which they are tried.
EVENT_ACTIONS = {
    "release": ("发布", "推出", "介绍", "上线", "公开", "开放使用", "release", "released", "releases", "launch", "launched", "launches", "available", "receiving access", "introduce", "introduced", "introduces", "introducing", "roll out", "rollout"),
    "update": ("更新", "升级", "新增", "下线", "update", "updated", "updates", "upgrade", "upgraded", "upgrades", "add", "added", "adds", "deprecate", "deprecated", "暂停", "追踪", "跟踪", "pause", "paused", "pauses", "tracks"),
    "result": ("达到", "提升", "降低", "减少", "超过", "增长", "achieve", "achieved", "improve", "improved", "reduce", "reduced", "reduces", "exceed", "exceeded", "jump", "jumps"),
    "research": ("研究发现", "论文提出", "实验显示", "发表论文", "发表", "study finds", "paper proposes", "publishes a paper", "published a paper", "publishes", "published"),
    "funding": ("完成融资", "获得融资", "获得投资", "融资完成", "raise", "raises", "raised", "funded"),
    "acquisition": ("收购", "完成合并", "acquire", "acquired", "acquires", "merges with"),
    "partnership": ("达成合作", "宣布合作", "签署合作", "partners with", "partnered with", "collaborates with", "collaborated with"),
    "appointment": ("任命", "晋升", "appoint", "appointed", "appoints", "promoted"),
    "departure": ("宣布离职", "宣布辞职", "announces departure", "announced departure", "departs", "departed", "离职", "辞职", "离开", "卸任", "leaving", "leaves", "left", "takes off", "headed out the door", "steps down", "resigns", "resigned"),
    "organizational_change": ("解散", "disband", "disbanded", "disbands"),
    "joining": ("入职", "加入", "joins", "joined", "hired"),
    "layoff": ("裁员", "layoffs", "laid off", "cuts jobs"),
    "policy": ("颁布禁令", "出台禁令", "发布禁令", "监管裁决", "bans", "banned", "prohibits", "regulated", "issues a ban"),
    "infrastructure": ("建设", "部署", "扩建", "扩大", "builds", "built", "deploys", "deployed", "expands"),
    "security": ("披露漏洞", "发现漏洞", "修复漏洞", "discloses", "disclosed", "discovers", "discovered", "fixes", "fixed"),
    "open_source": ("开源", "open source", "open-source", "open-sources"),
}
#: Words of which any means that nothing is asserted.
NEGATION = r"\b(?:not|never|without|would not)\b|未|没有|并未|不会"
#: Spellings of organisations, for the relation of reports and for the claims of a text.
ORGANIZATIONS = {
    "openai": "openai", "anthropic": "anthropic", "google deepmind": "google deepmind", "deepmind": "google deepmind", "google": "google", "meta": "meta",
    "microsoft": "microsoft", "microsoft research": "microsoft", "nvidia": "nvidia", "hugging face": "hugging face", "mistral ai": "mistral ai", "mistral": "mistral ai",
    "deepseek": "deepseek", "qwen": "qwen", "微软": "microsoft", "谷歌": "google", "谷歌深度思维": "google deepmind", "英伟达": "nvidia", "元宇宙公司": "meta", "阿里通义": "qwen", "通义千问": "qwen",
}
CLAIM_ORGANIZATIONS = {
    "openai": "openai", "anthropic": "anthropic", "google": "google", "google deepmind": "google deepmind", "deepmind": "google deepmind", "mistral": "mistral ai", "mistral ai": "mistral ai",
    "microsoft": "microsoft", "meta": "meta", "nvidia": "nvidia", "xai": "xai", "x.ai": "xai", "cohere": "cohere", "cerebras": "cerebras", "谷歌": "google", "微软": "microsoft", "英伟达": "nvidia",
}
#: Families of models with a version, and the variants that may follow.
FAMILIES = ("gpt", "claude", "gemini", "llama", "qwen", "deepseek", "model")
VARIANTS = ("deep think", "enterprise", "flash", "haiku", "maverick", "max", "mini", "nano", "opus", "pro", "scout", "sonnet", "thinking", "turbo", "ultra")
#: Amounts, shares, years and durations, in lower case.
QUALIFIERS = {
    "amount": r"((?:\$|usd\s*)\d+(?:[.,]\d+)?(?:\s*(?:million|billion|m|b))?)",
    "percent": r"(\d+(?:[.,]\d+)?%)",
    "year": r"\b((?:19|20)\d{2})\b",
    "duration": r"\b(\d+(?:[.,]\d+)?\s*(?:years?|months?|days?|hours?))\b",
}
#: What a text holds if it holds a qualifier of the kind, which is found out faster.
_QUALIFIED = {"amount": ("$", "usd"), "percent": ("%",), "year": ("19", "20"), "duration": ("year", "month", "day", "hour")}
#: Words without weight in an event's key, and in the tokens of a report.
KEY_STOPWORDS = ("a", "an", "the", "to", "for", "of", "and", "with", "its", "new", "begin", "begins", "makes", "make", "selected")
TEXT_STOPWORDS = ("a", "an", "and", "for", "from", "in", "is", "new", "of", "on", "the", "to", "with")


def entities(text: Column, names: tuple[str, ...] = ENTITIES) -> Column:
    return substrings_held(F.lower(known(text)), names)


def actions(text: Column, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Kinds of event of which a mark is a substring, sorted."""
    return once(folded(text), lambda x: actions_in(x, kinds))


def actions_in(low: Column, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """`actions` of a folded text."""
    return F.array_compact(F.array(*[F.when(contains_any(low, marks), F.lit(kind)) for kind, marks in sorted((kinds or ACTIONS).items())]))


def asserted_actions(text: Column, kinds: dict[str, tuple[str, ...]] | None = None, negation: str = NEGATION) -> Column:
    """Kinds of event of which a whole mark stands in the text, sorted; none if it negates anything."""
    # Most marks do not even stand as substrings, which is found out faster than that they stand as words.
    found = lambda x: [F.when(contains_any(x, marks) & x.rlike("|".join(map(bounded_shape, marks))), F.lit(kind)) for kind, marks in sorted((kinds or EVENT_ACTIONS).items())]
    return once(folded(unescape(text)), lambda x: F.when(x.rlike(negation), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found(x)))))


def canonical_names(text: Column, spellings: dict[str, str], short: bool = False) -> Column:
    """The canonical names of which a spelling stands in the text as whole words, sorted. `short` texts are not searched for substrings first."""
    return once(folded(text), lambda x: canonical_names_in(x, spellings, short))


def canonical_names_in(low: Column, spellings: dict[str, str], short: bool = False) -> Column:
    """`canonical_names` of a folded text."""
    by_name: dict[str, list[str]] = {}
    for spelling, name in spellings.items():
        by_name.setdefault(name, []).append(spelling)
    # Most names do not even stand as substrings, which is found out faster than that they stand as words.
    stands = lambda x, many: (F.lit(True) if short else contains_any(x, many)) & x.rlike("|".join(map(bounded_shape, many)))
    return F.array_compact(F.array(*[F.when(stands(low, many), F.lit(name)) for name, many in sorted(by_name.items())]))


def organizations(text: Column, spellings: dict[str, str] | None = None) -> Column:
    return canonical_names(text, spellings or ORGANIZATIONS)


def organizations_in(low: Column) -> Column:
    """`organizations` of a folded text."""
    return canonical_names_in(low, ORGANIZATIONS)


def models(text: Column, families: tuple[str, ...] = FAMILIES, variants: tuple[str, ...] = VARIANTS) -> Column:
    """Names of models with a version, and the variant that follows: gpt-4o-mini, claude-4.5-sonnet. Sorted."""
    return once(normalized(text), lambda plain: models_in(plain, F.lower(plain), families, variants))


def models_in(plain: Column, low: Column, families: tuple[str, ...] = FAMILIES, variants: tuple[str, ...] = VARIANTS) -> Column:
    """`models` of a normalized text that is also there in lower case, or folded."""
    suffix = "|".join(sorted(variants, key=lambda v: (-len(v), v)))
    shape = rf"(?iU)\b((?:{'|'.join(families)})[- ]?[a-z]*\d[\w.+-]*)(?:\s*(?:\(\s*)?({suffix})\b(?:\s*\))?)?"
    hyphened = F.regexp_replace(plain, "[\u2010-\u2015\u2212]", "-")
    part = lambda x, n: F.regexp_extract_all(x, F.lit(shape), F.lit(n))
    dashed = lambda v, of: F.regexp_replace(F.lower(v), of, "-")
    named = lambda base, more: F.when(F.coalesce(more, F.lit("")) != "", F.concat(dashed(base, r"[\s-]+"), F.lit("-"), dashed(more, r"\s+"))).otherwise(dashed(base, r"[\s-]+"))
    # A version needs a digit and a family, which most texts are soon found to lack.
    found = lambda x: F.array_sort(F.array_distinct(F.zip_with(part(x, 1), part(x, 2), named)))
    none = F.array().cast("array<string>")
    return F.when(plain.rlike(r"(?U)\d") & contains_any(low, (*families, "ſ")), once(hyphened, found)).otherwise(none)


def people(text: Column, names: tuple[str, ...]) -> Column:
    return substrings_held(F.lower(known(text)), tuple(n.lower() for n in names))


def numbers(text: Column) -> Column:
    """`number:` and each distinct number, sorted."""
    found = F.regexp_extract_all(known(text), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("number:"), n))))


def _marked(kind: str):
    return lambda value: F.concat(F.lit(f"{kind}:"), value)


def qualifiers(text: Column) -> Column:
    """kind:value of years, shares, amounts with their scale, and durations, sorted."""
    return once(folded(text), qualifiers_in)


def qualifiers_in(low: Column) -> Column:
    """`qualifiers` of a folded text."""
    none = F.array().cast("array<string>")
    found = lambda x: [F.when(contains_any(x, _QUALIFIED[kind]), F.transform(F.regexp_extract_all(x, F.lit(shape), F.lit(1)), _marked(kind))).otherwise(none) for kind, shape in QUALIFIERS.items()]
    return F.when(low.rlike("[0-9]"), F.array_sort(F.array_distinct(F.concat(*found(low))))).otherwise(none)


def tokens(text: Column, stop: tuple[str, ...] = KEY_STOPWORDS) -> Column:
    """Words and numbers with inner marks, and runs of ideographs, in order, without the commonest words."""
    found = F.regexp_extract_all(F.lower(known(text)), F.lit("([a-z0-9][a-z0-9.+-]*|[一-鿿]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~one_of(t, stop))


def event_key(title: Column, url: Column, publisher: Column) -> Column:
    """`event-` and 16 digits of the digest of the title's tokens; without any, of the address, else of the publisher."""
    from .urls import event_url

    signed = F.array_join(tokens(title), " ")
    address = event_url(url)
    return F.concat(F.lit("event-"), F.left(F.sha2(F.when(signed != "", signed).when(address != "", address).otherwise(known(publisher)), 256), F.lit(16)))


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard share of two arrays of distinct tokens."""
    return jaccard(a, b)


def conflicting(a: Column, b: Column) -> Column:
    """Whether two lists of kind:value share a kind of which they share no value."""
    kind = lambda x: F.regexp_extract(x, "^([^:]*)", 1)
    shared = F.array_intersect(F.transform(a, kind), F.transform(b, kind))
    return F.exists(shared, lambda k: F.size(F.array_intersect(F.filter(a, lambda x: kind(x) == k), F.filter(b, lambda x: kind(x) == k))) == 0)
