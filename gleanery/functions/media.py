"""Pictures by their address and by what is said of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, known, once, one_of, unescape

#: Parts of addresses of pictures that show nothing, and endings of pictures.
BAD_HINTS = ("favicon", "icon-", "apple-touch-icon", "logo", "avatar", "profile", "sprite", "placeholder", "transparent", "tracking", "pixel", "badge", "default", "blank", "spacer", "loading", "spinner", "gravatar")
ENDINGS = r"\.(jpg|jpeg|png|webp|avif)$"
#: Words without weight around pictures, names of firms, and models.
GENERIC = (
    "ai", "model", "models", "product", "products", "research", "strategy", "team", "image", "photo", "corporate", "company", "launch", "launches", "release", "releases",
    "new", "the", "and", "for", "with", "from", "模型", "产品", "研究", "战略", "团队", "公司", "图片", "照片", "发布", "推出", "上线", "公开", "新闻", "快讯",
)
FIRMS = ("openai", "anthropic", "google", "deepmind", "mistral", "meta", "microsoft", "nvidia", "xai", "cohere", "cerebras", "谷歌", "微软", "英伟达")
MODEL = r"(?iU)((?<![a-z0-9])(?:gpt|claude|gemini|llama|qwen|deepseek|model)[- ]?[a-z]*\d[\w.+-]*)"
TOKEN = r"([a-z][a-z0-9.+-]{2,}|[一-鿿]{2,})"


def image_score(url: Column, origin: Column) -> Column:
    """0 to 100, from what a picture's address holds and from where on a page it was found."""
    low, origin = F.lower(known(url)), known(origin)
    sizes = F.slice(F.zip_with(*[F.regexp_extract_all(low, F.lit(r"(\d{2,4})x(\d{2,4})"), F.lit(n)) for n in (1, 2)], lambda w, h: F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))), 1, 2)

    def of_size(s):
        ratio = s["w"] / F.greatest(s["h"], F.lit(1))
        return F.when((s["w"] < 300) | (s["h"] < 160), -35).when((s["w"] >= 600) & (s["h"] >= 300), 12).otherwise(0) + F.when((ratio >= 1.2) & (ratio <= 2.4), 8).otherwise(0)

    points = [
        (contains_any(low, BAD_HINTS), -45), (F.substring_index(low, "?", 1).rlike(ENDINGS), 10), (origin.contains("og") | origin.contains("twitter"), 18), (origin.contains("jsonld"), 15),
        (origin.startswith("rss:media") | (origin == "rss:enclosure"), 16), (origin.isin("html:first_img", "html:srcset"), 8), (low.contains("?") & contains_any(low, ("width=", "w=", "height=", "h=")), 4),
    ]
    total = sum((F.when(holds, value).otherwise(0) for holds, value in points), F.lit(50))
    return F.greatest(F.lit(0), F.least(F.lit(100), total + F.aggregate(sizes, F.lit(0), lambda a, s: a + of_size(s))))


def picture_anchors(text: Column) -> Column:
    """`model:` and `token:` of what a text names, without firms and generic words, sorted."""

    def found(x):
        models = F.transform(F.regexp_extract_all(x, F.lit(MODEL), F.lit(1)), lambda m: F.concat(F.lit("model:"), F.regexp_replace(m, r"\s+", "-")))
        bare = F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(1)), lambda t: F.btrim(t, F.lit(".-")))
        kept = F.filter(bare, lambda t: (t != "") & ~one_of(t, (*GENERIC, *FIRMS)))
        return F.array_sort(F.array_distinct(F.concat(models, F.transform(kept, lambda t: F.concat(F.lit("token:"), t)))))

    return once(F.lower(unescape(text)), found)


def picture_relevance(event: Column, picture: Column) -> Column:
    """struct<accepted, reason, anchors>: a shared model, or two shared words, tie a picture to an event. Both are texts."""

    def judged(shared):
        models = F.filter(shared, lambda a: a.startswith("model:"))
        tokens = F.filter(shared, lambda a: a.startswith("token:"))
        reason = F.when(F.size(models) > 0, "shared_model_anchor").when(F.size(tokens) >= 2, "shared_event_anchors").otherwise("missing_semantic_anchor")
        return F.struct((reason != "missing_semantic_anchor").alias("accepted"), reason.alias("reason"), F.when(F.size(models) > 0, models).otherwise(tokens).alias("anchors"))

    return once(F.array_sort(F.array_intersect(picture_anchors(event), picture_anchors(picture))), judged)
