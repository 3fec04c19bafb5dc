"""What a candidate's source says, in readable text, and whether that is enough to write from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import known, once, unescape, without_hidden
from .urls import host, safe_http_url

#: Least and greatest lengths of what is read, and the texts that come with a verdict.
LEAST, PURPOSE, CHANGES, SUMMARY, TITLE, TAG = 40, 420, 640, 900, 240, 80
POINTERS = ("see changelog", "changelog.md", "full changelog", "compare changes")
POINTER_LENGTH = 120
FORUM_HOSTS = ("news.ycombinator.com", "ycombinator.com")
REASONS = {
    "other": "该来源沿用既有影子证据，不适用 GitHub/HN 专项校验。",
    "no_purpose": "GitHub 项目用途缺少可读的源证据。",
    "no_changes": "GitHub Release 未提供可验证的实际变更说明。",
    "release": "GitHub 项目用途与版本变更均有可读证据。",
    "metadata": "HN RSS 仅提供文章链接、评论链接和积分，未提供新闻正文。",
    "post": "HN 帖子提供了可读的正文说明。",
    "article": "HN 外链文章提供了可读的正文证据。",
    "nothing": "HN 帖子未提供足够正文，外链文章也无法取得可读证据。",
}
PURPOSE_LABEL, TAGGED, UNTAGGED = "项目用途：", "版本 {0} 变更：", "本次版本变更："
#: A line of a feed's envelope, and the marks of Markdown with what stays of them.
ARTICLE_LINE, COMMENTS_LINE = r"(?im)^\s*article url:\s*(https?://\S+)\s*$", r"(?im)^\s*comments url:\s*(https?://\S+)\s*$"
MARKDOWN = (
    (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"<https?://[^>]+>", " "), (r"https?://\S+", " "),
    (r"(?dm)^\s{0,3}#{1,6}\s*", ""), (r"(?dm)^\s*[-*+]\s+", ""), (r"\s+", " "),
)
_TAGS = r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>"
_PRIVATE = r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.(?:1[89]|51\.100)\.|^203\.0\.113\.|^(?:24[0-9]|25[0-5])\."
_PRIVATE_6 = r"(?i)^\[(?:::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|2001:db8:.*)\]$"


def readable(value: Column, most: int) -> Column:
    """Text without markup, Markdown's marks and addresses, white space collapsed, at most so long."""
    out = F.regexp_replace(without_hidden(unescape(known(value))), _TAGS, " ")
    for shape, kept in MARKDOWN:
        out = F.regexp_replace(out, shape, kept)
    return F.trim(F.left(F.trim(out), F.lit(most)))


def open_url(url: Column) -> Column:
    """The url, or an empty string unless it is http or https with a host that is no private or local address."""
    name = host(url)
    literal = name.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & name.rlike(_PRIVATE)
    return F.when(literal | name.rlike(_PRIVATE_6), "").otherwise(safe_http_url(url))


def external_article(url: Column) -> Column:
    return (known(url) != "") & (host(url) != "") & ~host(url).isin(*FORUM_HOSTS)


def changelog_pointer(text: Column) -> Column:
    """Notes that only say where the changes are told, or nothing."""
    low = F.lower(known(text))
    points = F.lit(False)
    for mark in POINTERS:
        points = points | low.contains(mark)
    return (known(text) == "") | (points & (F.length(text) < POINTER_LENGTH))


def envelope_only(source: Column, summary: Column) -> Column:
    """A forum feed's entry of links and counters."""
    s = known(summary)
    return F.lower(known(source)).contains("hacker news") & s.rlike(ARTICLE_LINE) & s.rlike(COMMENTS_LINE)


def evidence_text(title: Column, summary: Column, excerpt: Column) -> Column:
    """What there is to check a generated text against, a line each."""
    parts = F.array(*[F.trim(known(c)) for c in (title, summary, excerpt)])
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def normalized_evidence(title: Column, url: Column, summary: Column, source: Column, kind: Column, description: Column, notes: Column, tag: Column, article: Column) -> Column:
    """struct<title, summary, url, quality, reason, details> of a candidate, for review beside what is published.

    Releases need what the project is for and what changed; a forum feed's envelope is metadata of the article that it
    names; a forum's post needs a text of its own or the landed text of the article it links to (`article`; of hosts
    other than the forum's). Other sources are taken as they are. quality is ready, missing, too_short or metadata_only.
    """
    head, link, sort = readable(title, TITLE), open_url(url), F.lower(readable(kind, 40))
    none = F.from_json(F.lit("{}"), "map<string,string>")

    def made(text, quality, why, details=None, at=None):
        return F.struct(head.alias("title"), text.alias("summary"), (link if at is None else at).alias("url"), F.lit(quality).alias("quality") if isinstance(quality, str) else quality.alias("quality"), F.lit(REASONS[why]).alias("reason"), (none if details is None else details).alias("details"))

    def told(name, value):
        return F.create_map(F.lit(name), value)

    def release(p):
        changes = F.when(changelog_pointer(p["notes"]), "").otherwise(p["notes"])
        details = F.create_map(F.lit("project_purpose"), p["purpose"], F.lit("release_changes"), changes, F.lit("release_tag"), p["tag"])
        purpose = F.concat(F.lit(PURPOSE_LABEL), p["purpose"])
        before, after = TAGGED.split("{0}")
        label = F.when(p["tag"] != "", F.concat(F.lit(before), p["tag"], F.lit(after))).otherwise(UNTAGGED)
        return (
            F.when(p["purpose"] == "", made(F.lit(""), "missing", "no_purpose", details)).when(F.length(changes) < LEAST, made(purpose, "missing", "no_changes", details))
            .otherwise(made(F.concat(purpose, F.lit("\n"), label, changes), "ready", "release", details))
        )

    def post(p):
        return (
            F.when(F.length(p["own"]) >= LEAST, made(p["own"], "ready", "post", told("evidence_origin", F.lit("hn_text"))))
            .when(F.length(p["article"]) >= LEAST, made(p["article"], "ready", "article", told("evidence_origin", F.lit("external_article"))))
            .otherwise(made(p["own"], F.when(p["own"] == "", "missing").otherwise("too_short"), "nothing"))
        )

    named = open_url(F.regexp_extract(known(summary), ARTICLE_LINE, 1))
    target = F.when(named != "", named).otherwise(link)
    repository = F.struct(readable(description, PURPOSE).alias("purpose"), readable(notes, CHANGES).alias("notes"), readable(tag, TAG).alias("tag"))
    forum = F.struct(readable(summary, SUMMARY).alias("own"), F.when(external_article(link), readable(article, SUMMARY)).otherwise("").alias("article"))
    return (
        F.when(sort == "github", once(repository, release))
        .when(envelope_only(readable(source, 120), summary), made(F.lit(""), "metadata_only", "metadata", told("article_url", target), target))
        .when(sort == "hn", once(forum, post))
        .otherwise(made(readable(summary, SUMMARY), "ready", "other"))
    )
