"""Url functions over columns: parts, normal forms, public forms, publishers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, known

#: Query keys that only track, and the keys that a host's public address needs.
TRACKING_KEYS = ("fbclid", "gclid", "ref", "source")
NEEDED_KEYS = {"news.ycombinator.com": ("id", r"^[0-9]{1,20}$", "/item")}
#: Addresses of organisations that speak for themselves.
OFFICIAL_PLACES = (
    "openai.com", "anthropic.com", "deepmind.google", "ai.meta.com", "research.google", "microsoft.com/en-us/research",
    "nvidia.com/en-us/research", "nvidia.com/blog", "stability.ai", "midjourney.com", "runwayml.com", "huggingface.co/blog",
    "huggingface.co/papers", "arxiv.org", "paperswithcode.com", "replicate.com/blog", "together.ai/blog", "fireworks.ai/blog",
    "perplexity.ai/blog", "mistral.ai", "x.ai", "langchain.com/blog", "llamaindex.ai/blog",
)
_SHAPE = r"(?i)^(https?)://([^/?#]*)([^?#]*)\??([^#]*)"


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(known(url), r"^\s+|\s+$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_trimmed(url), _SHAPE, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(_trimmed(url), _SHAPE, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(_trimmed(url), _SHAPE, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(_trimmed(url), _SHAPE, 4)


def host(url: Column) -> Column:
    """Lower case, without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]*)$", 1)


def is_http(url: Column) -> Column:
    return (scheme(url) != "") & (authority(url) != "")


def safe_http_url(url: Column) -> Column:
    """The url, or an empty string unless it is http or https with a host."""
    return F.when(is_http(url), _trimmed(url)).otherwise("")


def merge_key(url: Column, other: Column) -> Column:
    """Lower case up to the question mark; an empty url gives `other`."""
    key = F.regexp_replace(F.lower(_trimmed(url)), r"(?s)\?.*$", "")
    return F.when(key == "", other.cast("string")).otherwise(key)


def _plain_path(url: Column) -> Column:
    short = F.regexp_replace(F.regexp_replace(path(url), r"/+", "/"), r"/$", "")
    return short


def event_url(url: Column) -> Column:
    """Scheme, host, port and path, without query and fragment."""
    return F.when(is_http(url), F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), _plain_path(url))).otherwise("")


def relation_url(url: Column) -> Column:
    """As `event_url`, without the port."""
    return F.when(is_http(url), F.concat(scheme(url), F.lit("://"), host(url), _plain_path(url))).otherwise("")


def status_id(url: Column) -> Column:
    """The id of a post on one of the two hosts of that service, or an empty string."""
    found = F.regexp_extract(path(url), r"^/[^/]+/status/([0-9]+)", 1)
    return F.when(bare_host(url).isin("x.com", "twitter.com"), found).otherwise("")


def is_address_literal(name: Column) -> Column:
    """An IPv6 address, or one to four decimal, octal or hexadecimal numbers."""
    return name.contains("[") | name.rlike(r"(?i)^(?:0x[0-9a-f]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|[0-9]+)){0,3}$")


def request_url(url: Column) -> Column:
    """Scheme, host, path and query of a url that is safe to ask for, or an empty string.

    Safe is http or https on its own port, without user, on a named host that is not this machine.
    """
    text, s, p = _trimmed(url), scheme(url), port(url)
    own = (p == "") | ((s == "http") & (p == "80")) | ((s == "https") & (p == "443"))
    good = (s != "") & (host(url) != "") & ~authority(url).contains("@") & own & (host(url) != "localhost") & ~is_address_literal(host(url)) & ~text.rlike(r"[\x00-\x20\x7f]")
    mark = F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url)))
    return F.when(good, F.concat(s, F.lit("://"), host(url), path(url), mark)).otherwise("")


def _needed_pair(key: str, shape: str):
    return lambda x: (F.lower(F.regexp_extract(x, "^([^=]*)", 1)) == key) & F.regexp_extract(x, "=(.*)$", 1).rlike(shape)


def public_url(url: Column) -> Column:
    """A safe url without keys that track; any other key makes the url private and the result empty, but for the keys that its host needs."""
    safe = request_url(url)
    pairs = F.filter(F.split(query(url), "&"), lambda x: x != "")
    key = lambda x: F.lower(F.regexp_extract(x, "^([^=]*)", 1))
    tracks = lambda x: key(x).isin(*TRACKING_KEYS) | key(x).startswith("utm_")
    needed, bad = F.lit(False), F.lit(False)
    kept = F.filter(pairs, lambda x: ~tracks(x))
    for name, (own, shape, place) in NEEDED_KEYS.items():
        mine = host(url) == name
        needed = needed | mine
        fits = F.forall(kept, _needed_pair(own, shape))
        bad = bad | (mine & ~(fits & ((path(url) == place) | (F.size(kept) == 0))))
    private = (safe == "") | F.when(needed, bad).otherwise(F.size(kept) > 0)
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(private, "").otherwise(F.concat(scheme(url), F.lit("://"), host(url), path(url), tail))


def audit_url(url: Column) -> Column:
    """A public url without its query, or a digest of what was given."""
    safe = public_url(url)
    digest = F.concat(F.lit("invalid-url:sha256:"), F.left(F.sha2(known(url), 256), F.lit(16)))
    return F.when(safe == "", digest).otherwise(F.regexp_replace(safe, r"\?.*$", ""))


def is_official(url: Column, places: tuple[str, ...] = OFFICIAL_PLACES) -> Column:
    return contains_any(F.lower(known(url)), places)


def publisher_name(url: Column) -> Column:
    """The label before the public suffix, with spaces for hyphens and capitals; two-part suffixes such as co.uk are known."""
    labels = F.split(bare_host(url), r"\.")
    n = F.size(labels)
    double = (n >= 3) & F.element_at(labels, -2).isin("co", "com", "org", "net", "ac", "gov") & (F.length(F.element_at(labels, -1)) == 2)
    label = F.when(double, F.get(labels, n - 3)).when(n >= 2, F.get(labels, n - 2)).otherwise(F.get(labels, F.lit(0)))
    return F.initcap(F.regexp_replace(F.coalesce(label, F.lit("")), "-", " "))


def host_suffixes(url: Column) -> Column:
    """The host and each of its parent domains, the longest first: an equi-join key in place of a suffix test per pair."""
    labels = F.split(bare_host(url), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
