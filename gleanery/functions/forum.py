"""Posts of a forum's feed: an HTML envelope that names an article and its comments, around what the post itself says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import known, once, unescape, visible_text, without_hidden
from .urls import public_url, publisher_name, request_url

#: How the envelope names its links and its counters.
LABELLED = r"(?is)\b(article|comments) url:\s*(?:<(?!a\b)[^>]*>\s*)*<a\b([^>]*)>(.*?)</a\s*>"
PLAIN = r"(?i)\b(article|comments) url:\s*(https?://[^\s<>]+)"
LABELS = r"(?i)\b(?:article|comments) url:\s*(?:https?://\S+)?"
COUNTERS = r"(?i)(?:points:\s*[0-9]+|#?\s*comments:\s*[0-9]+)"
FORUM = "Hacker News"


def _links(markup: Column, label: str) -> Column:
    """array<struct<href, shown>> of the links that `label` names, as links or as plain text."""
    part = lambda shape, group: F.regexp_extract_all(markup, F.lit(shape), F.lit(group))

    def shown(inner):
        text = visible_text(inner)
        found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>]+)"), F.lit(1))
        return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(text)

    href = lambda tag: unescape(F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'>\s]*)""", 1))
    pairs = F.zip_with(part(LABELLED, 2), part(LABELLED, 3), lambda tag, inner: F.struct(href(tag).alias("href"), shown(inner).alias("shown")))
    linked = F.zip_with(part(LABELLED, 1), pairs, lambda name, p: F.when(F.lower(name) == label, p))
    plain = F.zip_with(part(PLAIN, 1), part(PLAIN, 2), lambda name, u: F.when(F.lower(name) == label, F.struct(u.alias("href"), u.alias("shown"))))
    return F.array_compact(F.concat(linked, plain))


def _chosen(links: Column) -> Column:
    """struct<url, ambiguous>: the one safe address of the links; ambiguous if they name several, or a link shows another than it leads to."""

    def choose(safe):
        differ = F.exists(safe, lambda p: (p["href"] != "") & (p["shown"] != "") & (p["href"] != p["shown"]))
        urls = F.array_distinct(F.filter(F.transform(safe, lambda p: F.when(p["href"] != "", p["href"]).otherwise(p["shown"])), lambda u: u != ""))
        sure = ~differ & (F.size(urls) == 1)
        return F.struct(F.when(sure, F.get(urls, F.lit(0))).otherwise("").alias("url"), (differ | (F.size(urls) > 1)).alias("ambiguous"))

    return once(F.transform(links, lambda p: F.struct(request_url(p["href"]).alias("href"), request_url(p["shown"]).alias("shown"))), choose)


def envelope(summary: Column) -> Column:
    """struct<article, comments, ambiguous, detail>: the addresses that the envelope names, and the text without them, their labels and the counters."""

    def read(markup):
        both = F.concat(_links(markup, "article"), _links(markup, "comments"))
        raw = F.flatten(F.transform(both, lambda p: F.filter(F.array(p["href"], p["shown"]), lambda u: u != "")))
        bare = F.regexp_replace(F.regexp_replace(visible_text(markup), LABELS, ""), COUNTERS, "")
        detail = F.aggregate(raw, bare, lambda text, u: F.replace(text, u, F.lit("")))
        article = _chosen(_links(markup, "article"))
        return F.struct(article["url"].alias("article"), _chosen(_links(markup, "comments"))["url"].alias("comments"), article["ambiguous"].alias("ambiguous"), visible_text(detail).alias("detail"))

    return once(without_hidden(unescape(summary)), read)


def normalized_source(title: Column, url: Column, summary: Column, excerpt: Column, body: Column, source: Column, kind: Column) -> Column:
    """struct<title, evidence, request_url, url, publisher, via, quality> of a candidate.

    A forum's post stands for the article that it names unless that is ambiguous. Evidence is the title and each
    different detail, a line each; quality is ready with a detail and title_only without.
    """
    clean = lambda c: visible_text(unescape(known(c)))
    name, sort = clean(source), F.lower(F.trim(F.when(F.trim(known(kind)) == "", "rss").otherwise(kind)))
    forum = sort.isin("hn", "hacker_news") | F.lower(name).contains("hacker news")

    def build(e):
        head = clean(title)
        asked = F.when(forum & ~e["ambiguous"] & (e["article"] != ""), e["article"]).otherwise(request_url(url))
        details = F.array_distinct(F.filter(F.array(F.when(forum, e["detail"]).otherwise(clean(summary)), clean(excerpt), clean(body)), lambda d: d != ""))
        lines = F.filter(F.concat(F.array(head), details), lambda d: d != "")
        lines = F.when(forum, lines).otherwise(F.array_distinct(lines))
        ready = F.when(forum, F.size(details) > 0).otherwise(F.size(lines) > 1)
        shown = public_url(asked)
        publisher = F.when(shown != "", publisher_name(shown)).when(forum, FORUM).otherwise(name)
        return F.struct(
            head.alias("title"), F.array_join(lines, "\n").alias("evidence"), asked.alias("request_url"), shown.alias("url"), publisher.alias("publisher"),
            F.when(forum, "hacker_news").otherwise(sort).alias("via"), F.when(ready, "ready").otherwise("title_only").alias("quality"),
        )

    return once(envelope(summary), build)
