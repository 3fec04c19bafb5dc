"""What a page holds besides its text: pictures and links, in order of first occurrence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import known


def image_urls(html: Column) -> Column:
    """Addresses of all pictures, repeats included, in order."""
    return F.regexp_extract_all(known(html), F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1))


def link_urls(html: Column) -> Column:
    return F.regexp_extract_all(known(html), F.lit(r"""(?i)<a[^>]+href=["']([^"']+)["']"""), F.lit(1))


def image_candidates(html: Column) -> Column:
    """array<struct<url, source>>: the pictures that a page names in its head, then those of its body; each address once, no inline data."""
    named = F.regexp_extract_all(known(html), F.lit(r"""(?i)<meta[^>]+(?:property|name)=["'](?:og:image|twitter:image)["'][^>]+content=["']([^"']+)["']"""), F.lit(1))
    real = lambda a: F.filter(F.array_distinct(a), lambda u: ~F.lower(u).startswith("data:"))
    head = real(named)
    body = F.array_except(real(image_urls(html)), head)
    return F.concat(F.transform(head, lambda u: F.struct(u.alias("url"), F.lit("meta").alias("source"))), F.transform(body, lambda u: F.struct(u.alias("url"), F.lit("img").alias("source"))))
