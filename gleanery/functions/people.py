"""People that a text names, by what stands around the name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .anchors import ORGANIZATIONS
from .text import bounded_shape, folded, known, once, one_of

#: Known people, other spellings, and names that are none.
KNOWN = (
    "alexandr wang", "alice johnson", "andrej karpathy", "andrew ng", "aravind srinivas", "arthur mensch", "bob smith", "brad lightcap", "bret taylor",
    "clement delangue", "daniela amodei", "dario amodei", "demis hassabis", "elon musk", "emad mostaque", "fidji simo", "geoffrey hinton", "greg brockman",
    "ian goodfellow", "ilya sutskever", "jeff dean", "jensen huang", "kevin weil", "lisa su", "mark zuckerberg", "mira murati", "mustafa suleyman",
    "noam shazeer", "sam altman", "sarah friar", "satya nadella", "sundar pichai", "thomas wolf", "yann lecun", "yoshua bengio",
)
SPELLINGS = {"samuel altman": "sam altman", "sam a. altman": "sam altman", "山姆·奥特曼": "sam altman"}
NO_PEOPLE = ("another openai", "openai coo", "openai ceo", "the rundown", "techcrunch ai", "the verge")
#: What ends a job title, what stands for one, and what marks an organisation.
TITLE_HEADS = ("chair", "chairman", "chairwoman", "counsel", "director", "engineer", "executive", "founder", "member", "officer", "partner", "president", "researcher", "scientist")
TITLE_LETTERS = ("ceo", "cfo", "cio", "cmo", "coo", "cpo", "cto", "svp", "vp")
DESIGNATORS = ("company", "corporation", "foundation", "group", "institute", "lab", "labs", "research", "systems", "team", "technologies", "technology", "university")

#: The patterns of names, titles, pronouns and roles.
NAME = r"\b([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)+)\b"
#: What `NAME` finds, without going a step deeper into the stack for each word: texts repeat a capitalised word a thousand times and more.
_NAME = r"\b([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+\b)++)"
TITLE = rf"(?:{'|'.join(TITLE_LETTERS)}|(?:[A-Z][a-z]+[ \t]+){{0,4}}(?:{'|'.join(TITLE_HEADS)}))"
PRONOUNS = r"\b(?:he|her|hers|him|his|she)\b"
ROLE = rf"\bas\s+(?:an?|the)\s+(?:{'|'.join(TITLE_HEADS)})\b"


def context_shape(name: Column, shown: Column) -> Column:
    """A pattern of a title before a name, or a title, a pronoun or a role after it in the same sentence."""
    parts = [F.lit(rf"(?i)\b{TITLE}[ \t]+"), shown, F.lit(r"\b|\b"), name, F.lit(rf",[^.]{{0,80}}\b{TITLE}\b|\b"), name, F.lit(rf"\b[^.]{{0,80}}{PRONOUNS}|\b"), name, F.lit(rf"\b[^.]{{0,80}}{ROLE}")]
    return F.concat(*parts)


def people(text: Column) -> Column:
    """struct<people, candidates>, both sorted: whom the text names as a person, and those of them that are known.

    A context never goes beyond a full stop, so only the parts of a line between full stops that hold the name are searched.
    """
    return people_in(text, folded(text))


def people_in(text: Column, low: Column) -> Column:
    """`people` of a text that is also there folded."""
    organizations = sorted({*ORGANIZATIONS, *ORGANIZATIONS.values()})

    def named(line):
        parts = F.transform(F.split(line, r"\."), lambda part: F.struct(part.alias("text"), F.lower(part).alias("low")))
        return F.when(line.rlike(_NAME), once(parts, lambda within: in_line(line, within))).otherwise(F.array().cast("array<string>"))

    def in_line(line, within):
        def read(shown):
            words = F.split(F.lower(shown), r"[ \t]+")
            places = F.transform(words, lambda w, i: F.when(one_of(w, TITLE_HEADS), i + 1).otherwise(0))
            return once(F.struct(F.array_max(places).alias("at"), words.alias("words")), lambda p: kept(shown, p))

        def kept(shown, p):
            rest = F.slice(p["words"], p["at"] + 1, F.size(p["words"]))
            name = F.array_join(rest, " ")
            fits = (F.size(rest) >= 2) & ~F.exists(rest, lambda w: one_of(w, DESIGNATORS)) & ~one_of(name, (*NO_PEOPLE, *organizations))
            said = lambda part: part["low"].contains(name) & F.regexp_like(part["text"], context_shape(name, shown))
            return F.when(fits & ((p["at"] > 0) | F.exists(within, said)), name)

        return F.transform(F.regexp_extract_all(line, F.lit(_NAME), F.lit(1)), read)

    spaced = once(known(text), lambda x: F.when(x.contains("　"), F.translate(x, "　", " ")).otherwise(x))
    lines = F.split(spaced, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    found = F.array_compact(F.flatten(F.transform(lines, named)))
    spelled = once(low, lambda x: F.array_compact(F.array(*[F.when(x.contains(s) & x.rlike(bounded_shape(s)), F.lit(p)) for s, p in SPELLINGS.items()])))

    def both(f):
        return F.struct(
            F.array_sort(F.array_distinct(F.concat(f["spelled"], F.filter(f["found"], lambda n: one_of(n, KNOWN))))).alias("people"),
            F.array_sort(F.array_distinct(F.concat(f["spelled"], f["found"]))).alias("candidates"),
        )

    return once(F.struct(found.alias("found"), spelled.alias("spelled")), both)


def shared(a: Column, text_a: Column, b: Column, text_b: Column) -> Column:
    """The names of two lists that both have, or that one has and the other's text holds as a phrase."""
    stands = lambda text, name: F.regexp_like(text, F.concat(F.lit(r"(?<![a-z0-9])"), F.regexp_replace(name, r"([.])", r"\\$1"), F.lit(r"(?![a-z0-9])")))
    within = lambda names, text: once(folded(text), lambda x: F.filter(names, lambda n: stands(x, n)))
    return F.array_sort(F.array_distinct(F.concat(F.array_intersect(a, b), within(a, text_b), within(b, text_a))))


def mentioned(text: Column) -> Column:
    """The known people whose name stands in a text as a phrase, whatever its case, sorted."""
    return once(folded(text), mentioned_in)


def mentioned_in(low: Column) -> Column:
    """`mentioned` of a folded text."""
    return F.array_compact(F.array(*[F.when(low.contains(name) & low.rlike(bounded_shape(name)), F.lit(name)) for name in sorted(KNOWN)]))
