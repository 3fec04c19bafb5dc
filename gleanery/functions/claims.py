"""Whether what is shown of an item is held by its evidence: actions, protected words, relatedness, untranslated prose.

Word lists are parameters: `groups` maps a kind of action to its marks, in the order in which they are tried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import IDEOGRAPH, collapse, comparison_text, holds_any, grams, known, once, one_of, quoted

_WORD = r"([A-Za-z][A-Za-z0-9.+-]*)"
_NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
#: Names that a text may not show unless its evidence does.
PROTECTED = ("openai", "anthropic", "claude", "gemini", "llama", "qwen", "deepseek", "mistral", "api", "github")


def _all(value: Column, shape: str) -> Column:
    return F.regexp_extract_all(known(value), F.lit(shape), F.lit(1))


def _bare(tokens: Column) -> Column:
    """Lower case, without marks at the end, each once."""
    bare = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, r"[.,;:!?)\]}\"'’”]+$", "")))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def unsupported_action(shown: Column, evidence: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Whether a kind of action is shown of which the evidence has no mark."""
    s, e = F.lower(known(shown)), F.lower(known(evidence))
    found = F.lit(False)
    for marks in groups.values():
        found = found | (holds_any(s, marks) & ~holds_any(e, marks))
    return found


def action_matches(claim: Column, quote: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Whether the quote has a mark of the first kind of action that the claim has; true without one."""
    c, q = F.lower(known(claim)), F.lower(known(quote))
    out = F.lit(True)
    for marks in reversed(list(groups.values())):
        out = F.when(holds_any(c, marks), holds_any(q, marks)).otherwise(out)
    return out


def unsupported_tokens(shown: Column, evidence: Column, names: tuple[str, ...] = PROTECTED) -> Column:
    """Whether a number, or a word with a digit, all in capitals, or among `names`, is shown and not part of the evidence."""
    weighty = F.filter(_all(shown, _WORD), lambda t: t.rlike("[0-9]") | (t == F.upper(t)) | F.lower(t).isin(*names))
    tokens = F.concat(_all(shown, _NUMBER), weighty)
    return once(F.lower(collapse(evidence)), lambda e: F.exists(tokens, lambda t: ~e.contains(F.lower(t))))


def meaningful_tokens(value: Column) -> Column:
    found = F.concat(_all(value, _WORD), _all(F.regexp_replace(known(value), _WORD, " "), _NUMBER))
    return F.array_except(_bare(found), F.array(F.lit("the"), F.lit("a"), F.lit("an")))


def ideograph_pairs(value: Column) -> Column:
    return grams(F.regexp_replace(known(value), "[^一-鿿]", ""), 2)


def related(claim: Column, quote: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Whether a quote can be meant by a claim: one holds the other; or they share a word and the quote has all that are
    protected (words with a digit; all, if the claim has a capital); or, for a claim in ideographs on a quote without any, the
    kinds of action match; or they share two pairs of ideographs."""
    c, q = comparison_text(claim), comparison_text(quote)

    def judge(t):
        shared = F.size(F.array_intersect(t["claim"], t["quote"])) > 0
        guarded = F.when(known(claim).rlike("[A-Z]"), t["claim"]).otherwise(F.filter(t["claim"], lambda w: w.rlike("[0-9]")))
        across = known(claim).rlike(IDEOGRAPH) & ~known(quote).rlike(IDEOGRAPH)
        pairs = F.size(F.array_intersect(ideograph_pairs(claim), ideograph_pairs(quote))) >= 2
        return (
            F.when(q.contains(c) | c.contains(q), True)
            .when(shared, F.size(F.array_except(guarded, t["quote"])) == 0)
            .when(across, action_matches(claim, quote, groups))
            .otherwise(pairs)
        )

    return once(F.struct(meaningful_tokens(claim).alias("claim"), meaningful_tokens(quote).alias("quote")), judge)


def anchors_held(claim: Column, quote: Column, stop: tuple[str, ...] = (), marks: tuple[str, ...] = ()) -> Column:
    """Whether rules alone can vouch for a claim in another language: it has names, all of them in the quote, and no
    ideographs but those of the known marks."""
    names = lambda v: F.filter(_bare(_all(v, r"(?<![A-Za-z0-9])" + _WORD)), lambda t: ~one_of(t, stop) if stop else F.lit(True))
    rest = F.regexp_replace(known(claim), "[^一-鿿]", "")
    if marks:
        rest = F.regexp_replace(rest, "|".join(map(quoted, marks)), "")
    return once(names(claim), lambda n: (F.size(n) > 0) & (F.size(F.array_except(n, names(quote))) == 0) & (rest == ""))


def untranslated_prose(title: Column, words: tuple[str, ...]) -> Column:
    """Whether one of `words` stands in lower case outside addresses, repository names and quoted names."""
    rest = F.regexp_replace(known(title), r"(?i)https?://\S+", " ")
    rest = F.regexp_replace(rest, r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", " ")
    rest = F.regexp_replace(rest, r'[`"][A-Za-z][^`"]*[`"]', " ")
    return F.exists(_all(rest, r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z-]*)(?![A-Za-z0-9])"), lambda w: one_of(w, words))
