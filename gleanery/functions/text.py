"""Text functions over columns. A missing text is the empty string."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ideographs that count as such, and punctuation without weight in titles.
IDEOGRAPH = "[一-鿿]"
TITLE_PUNCTUATION = "[，,。.!！?？:：;；|｜、\"'“”‘’（）()【】\\[\\]\\-—_]"
TITLE_PREFIX = r"^(独家|首发|快讯|重磅)\s*[|｜:：]\s*"


def known(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def once(value: Column, then) -> Column:
    """then(value), with the value worked out once: as a variable, and not again wherever `then` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def collapse(value: Column) -> Column:
    """White space runs become one space, none stays at the ends."""
    # Single blanks stay as they are, which spares a replacement at each word.
    return F.trim(F.regexp_replace(F.replace(known(value), F.lit(" "), F.lit(" ")), r"\s{2,}|[\t\n\x0B\f\r]", " "))


#: Full-width forms and the plain characters that they stand for.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def normalized(value: Column) -> Column:
    """Compatible forms in one spelling (full-width characters become plain), white space collapsed."""
    # Most texts have no such character, which is found out faster than each of theirs is looked up.
    return collapse(once(known(value), lambda x: F.when(x.rlike("[\uFF01-\uFF5E\u3000]"), F.translate(x, WIDE, PLAIN)).otherwise(x)))


def folded(value: Column) -> Column:
    """`normalized`, without case."""
    return folded_plain(normalized(value))


def folded_plain(plain: Column) -> Column:
    """`folded` of a normalized text."""
    return F.replace(F.lower(plain), F.lit("ß"), F.lit("ss"))


def unescape(value: Column) -> Column:
    """Text with the commonest character references resolved, once."""
    out = known(value)
    for reference, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(character))
    return out


def strip_tags(value: Column) -> Column:
    return collapse(F.regexp_replace(known(value), r"<[^>]+>", ""))


def without_hidden(html: Column) -> Column:
    """Markup without scripts, styles, templates and drawings."""
    out = known(html)
    for tag in ("script", "style", "noscript", "template", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return out


def visible_text(html: Column) -> Column:
    """Text outside of what is hidden; a tag counts as a space."""
    return collapse(F.regexp_replace(without_hidden(html), r"(?s)<[^>]*>", " "))


def clean_title(value: Column) -> Column:
    return F.lower(F.regexp_replace(known(value), r"^\s+|\s+$", ""))


def canonical_title(value: Column) -> Column:
    """A title without editorial prefix, white space and punctuation."""
    bare = F.regexp_replace(F.lower(collapse(value)), TITLE_PREFIX, "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", ""), TITLE_PUNCTUATION, "")


def words(value: Column) -> Column:
    """Distinct words between white space, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(known(value), r"\s+"), lambda w: w != ""))


def grams(value: Column, size: int) -> Column:
    """Distinct runs of `size` neighbouring characters, in time linear in the text: a place in a string is found by walking to it, one in an array is not."""

    def cut(characters):
        starts = F.when(F.size(characters) >= size, F.sequence(F.lit(0), F.size(characters) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(characters, i + k) for k in range(size)]))

    return F.array_distinct(once(F.split(known(value), ""), cut))


def bigrams(value: Column) -> Column:
    return grams(value, 2)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct values; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def title_parts(title: Column) -> Column:
    """What `title_similarity` needs of a title, made once per row and not once per pair."""
    def parts(clean):
        named = {"clean": clean, "canon": canonical_title(clean), "cjk": clean.rlike(IDEOGRAPH), "words": words(clean), "pairs": bigrams(clean)}
        return F.named_struct(*[x for name, value in named.items() for x in (F.lit(name), value)])

    return once(clean_title(title), parts)


def _contained(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))


def title_similarity(a: Column, b: Column) -> Column:
    """Of two `title_parts`: 1 if equal or equal in canonical form, the ratio of lengths if one holds the other, else the
    Jaccard share of character pairs where either has ideographs and of words where neither has. A title may come without its pairs."""
    within = b["clean"].contains(a["clean"]) | a["clean"].contains(b["clean"])
    canonical = (F.length(a["canon"]) > 0) & (F.length(b["canon"]) > 0)
    canon_within = canonical & (b["canon"].contains(a["canon"]) | a["canon"].contains(b["canon"]))
    return (
        F.when((F.length(a["clean"]) == 0) | (F.length(b["clean"]) == 0), 0.0)
        .when(a["clean"] == b["clean"], 1.0)
        .when(canonical & (a["canon"] == b["canon"]), 1.0)
        .when(within, _contained(a["clean"], b["clean"]))
        .when(canon_within, _contained(a["canon"], b["canon"]))
        .when(a["cjk"] | b["cjk"], jaccard(*[F.coalesce(x["pairs"], bigrams(x["clean"])) for x in (a, b)]))
        .otherwise(jaccard(a["words"], b["words"]))
    )


def summary_sentences(value: Column) -> Column:
    """Sentences of a summary without their final marks."""
    parts = F.split(known(value), r"(?<=[。！？!?])\s*")
    return F.filter(F.transform(parts, lambda s: F.rtrim(F.regexp_replace(s, r"^\s+|\s+$", ""), F.lit("。！？!? "))), lambda s: s != "")


def sentences(value: Column) -> Column:
    """Sentences ended by a mark, or by a full stop between a letter or digit and white space; lines end them too."""
    parts = F.split(known(value), r"[。！？!?；;\n]+|(?<=[a-zA-Z0-9])\.\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: s != "")


#: Characters without weight where claims are compared.
COMPARED_MARKS = "[\\s，,。.!！?？:：;；、\"'“”‘’（）()【】\\[\\]]+"


def plain_text(value: Column) -> Column:
    """Text with references resolved, a tag as a space, and white space collapsed."""
    return collapse(F.regexp_replace(unescape(value), r"<[^>]+>", " "))


def comparison_text(value: Column) -> Column:
    """Text for comparing claims: plain, lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(plain_text(value)), COMPARED_MARKS, "")


def latin_tokens(value: Column, stop: tuple[str, ...] = ("a", "an", "the")) -> Column:
    """Distinct words and numbers without articles."""
    found = F.regexp_extract_all(F.lower(known(value)), F.lit(r"([a-z]+|[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)))


def slug(value: Column, other: str = "unknown") -> Column:
    made = F.trim(F.regexp_replace(F.lower(F.regexp_replace(known(value), "^@+", "")), "[^a-z0-9一-鿿]+", "-"), F.lit("-"))
    return once(made, lambda x: F.when(x == "", other).otherwise(x))


def topic_key(value: Column) -> Column:
    """`topic:` and at most 80 characters of the slug."""
    # What holds one letter, digit or ideograph more than that decides; the rest of a long text is not looked at.
    start = F.regexp_extract(F.lower(known(value)), "^(?:[^a-z0-9一-鿿]*+[a-z0-9一-鿿]){0,81}+", 0)
    return F.concat(F.lit("topic:"), F.left(slug(start), F.lit(80)))


def first_component(value: Column) -> Column:
    """The first publisher named in a source label."""
    parts = F.filter(F.split(F.lower(collapse(value)), r"\s*[+|/,，]\s*"), lambda p: F.trim(p) != "")
    return F.coalesce(F.trim(F.get(parts, F.lit(0))), F.lit(""))


def quoted(phrase: str) -> str:
    """A phrase as a pattern that means itself."""
    return re.escape(phrase).replace("\\ ", " ")


def contains_any(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """Whether any of the needles is a substring: fast on long texts."""
    found = F.lit(False)
    for needle in [n for n in needles if not any(m in n for m in needles if m != n)]:  # what holds another needle adds nothing
        found = found | text.contains(needle)
    return found


def holds_any(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """As `contains_any`, as one pattern: a small expression, for short texts and many needles."""
    return text.rlike("|".join(map(quoted, needles)))


def one_of(text: Column, values: list[str] | tuple[str, ...]) -> Column:
    """Whether a text is one of the values."""
    return text.rlike("^(?:" + "|".join(map(quoted, values)) + r")\z")


def lookup(table: dict[str, str]) -> Column:
    """A map of fixed values; one literal after constant folding."""
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,string>")


def substrings_held(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """The needles that are substrings, sorted."""
    return F.array_compact(F.array(*[F.when(text.contains(n), F.lit(n)) for n in sorted(needles)]))


def bounded_shape(phrase: str) -> str:
    """The pattern of a phrase between characters that are neither letters nor digits; ideographs need no bounds."""
    plain = quoted(phrase)
    return plain if re.search(IDEOGRAPH, phrase) else f"(?<![a-z0-9]){plain}(?![a-z0-9])"


def bounded(text: Column, phrase: str) -> Column:
    """Whether a phrase stands between characters that are neither letters nor digits."""
    return text.rlike(bounded_shape(phrase))


def first_named(text: Column, names: dict[str, tuple[str, ...]], other: str = "") -> Column:
    """The first name, in the given order, of which an alias is a substring."""
    out = F.lit(other)
    for name, aliases in reversed(list(names.items())):
        out = F.when(contains_any(text, aliases), name).otherwise(out)
    return out


def text_tokens(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct words and numbers with inner marks and runs of ideographs, without the commonest words."""
    found = F.regexp_extract_all(folded(text), F.lit("([a-z0-9][a-z0-9.+-]*|[一-鿿]{2,})"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda t: ~t.isin(*stop))
