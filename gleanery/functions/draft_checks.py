"""The chain of checks that a draft passes before it is shown, and the draft that a source gives by itself.

A source is a struct: title, evidence, url, channel, found_at, published_at, official, publisher, identity, opinion
(boolean), author, allowed, original, whole. A draft is a struct: title, brief, origin (llm or source), bindings
(array<struct<claim, quote, url>>), opinion, author.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import claims
from .anchors import EVENT_ACTIONS, asserted_actions
from .publishability import activity_only, anchored_title, claim_supported, display_reason, publisher_subjects, source_reason
from .text import IDEOGRAPH, collapse, comparison_text, holds_any, known, once, one_of, plain_text, summary_sentences, unescape
from .times import age_hours
from .urls import is_http

#: Phrases of commentary, words of attribution, and English words that a Chinese title keeps only untranslated.
COMMENTARY = ("值得关注的是", "这意味着", "这标志着", "将产生深远影响", "建议读者", "我们建议")
ATTRIBUTION = ("称", "分享", "表示", "帖子", "发文", "透露", "据", "研究者", "开发者", "媒体")
UNTRANSLATED = (
    "a", "acquire", "acquires", "an", "and", "announces", "are", "as", "at", "be", "been", "being", "benchmarks", "by", "can", "capitalizes", "classes", "could", "denies", "did", "do", "does",
    "fastest", "for", "from", "frustration", "has", "have", "if", "in", "into", "is", "it", "its", "may", "more", "new", "not", "of", "on", "open", "optimization", "or", "out", "output", "over",
    "parameters", "problem", "report", "rival", "setting", "solver", "source", "startup", "style", "than", "that", "the", "their", "this", "to", "tried", "up", "was", "were", "will", "with",
)
#: Words that are no name across languages, and ideographs that rules may leave unproved.
ANCHOR_STOPWORDS = (
    "acquire", "acquisition", "agentic", "and", "company", "for", "from", "funding", "in", "initiative", "introduce", "introducing", "lab", "launch", "merge", "model", "models", "new", "of", "on",
    "open", "out", "platform", "product", "products", "raise", "release", "roll", "service", "services", "source", "system", "systems", "technology", "the", "to", "tool", "tools", "valuation",
    "vendor", "with", "work", "workflow", "workflows",
)
FILLERS = (
    "公司", "厂商", "平台", "实验室", "团队", "机构", "模型", "产品", "工具", "系统", "服务", "项目", "版本", "该", "其", "一个", "一款", "于", "年", "并", "与", "和", "的", "了", "已", "已经",
    "将", "在", "为", "向", "由", "新", "正式",
)
#: Reasons that a second draft cannot mend.
PERMANENT = ("github_activity_only", "missing_evidence", "missing_source_url", "stale_item")
MOST_SENTENCES = 2
NUMBER, WORD = r"(\d+(?:[.,]\d+)?)", r"([A-Za-z][A-Za-z0-9.+-]*)"


def _marks() -> tuple[str, ...]:
    return tuple(m for many in EVENT_ACTIONS.values() for m in many)


def _proved() -> tuple[str, ...]:
    ideographs = [m for m in _marks() if "一" <= m[0] <= "鿿"]
    return tuple(sorted({*ideographs, *ATTRIBUTION, *FILLERS}, key=lambda m: (-len(m), m)))


def _quote(value: Column) -> Column:
    return collapse(unescape(value))


def covers(shown: Column, claim: Column) -> Column:
    return once(F.struct(comparison_text(shown).alias("a"), comparison_text(claim).alias("b")), lambda t: (t["a"] != "") & (t["a"] == t["b"]))


def shown_claims(draft: Column) -> Column:
    return F.concat(F.array(F.trim(draft["title"])), summary_sentences(F.trim(known(draft["brief"]))))


def source_contract(source: Column, now: Column, hours: float = 36.0) -> Column:
    age = age_hours(source["published_at"], now)
    return (
        F.when((F.trim(known(source["title"])) == "") | (F.trim(known(source["evidence"])) == ""), "missing_evidence")
        .when(~is_http(source["url"]), "missing_source_url")
        .when(source["published_at"].isNull() | (age < -5 / 60) | (age > hours), "stale_item")
        .otherwise("")
    )


def opinion_contract(draft: Column, source: Column) -> Column:
    author = F.lower(F.trim(known(source["author"])))
    return (
        F.when(~(draft["opinion"] & source["allowed"] & source["original"] & source["whole"]), "opinion_author_not_allowed")
        .when((author == "") | ~F.lower(draft["title"]).contains(author) | (F.lower(F.trim(known(draft["author"]))) != author), "opinion_attribution_missing")
        .otherwise("")
    )


def _across(claim: Column, quotes: Column) -> Column:
    """Whether a claim in ideographs can be meant by quotes without any: all names are held, and a number, a word or an action is shared."""
    names = lambda v: F.filter(claims._bare(claims._all(v, r"(?<![A-Za-z0-9])" + WORD)), lambda t: ~one_of(t, ANCHOR_STOPWORDS))
    numbers = F.arrays_overlap(claims._all(claim, NUMBER), claims._all(quotes, NUMBER))
    words = F.arrays_overlap(F.transform(claims._all(claim, WORD), lambda t: F.lower(t)), claims.meaningful_tokens(quotes))
    acts = claims.action_matches(claim, quotes, EVENT_ACTIONS) & holds_any(F.lower(claim), _marks())
    return (F.size(F.array_except(names(claim), names(quotes))) == 0) & (numbers | words | acts)


def claim_reason(claim: Column, quotes: Column, is_title: Column, source_title: Column, own: Column) -> Column:
    """The reason against one shown claim on its quotes, or an empty string."""
    across = claim.rlike(IDEOGRAPH) & ~quotes.rlike(IDEOGRAPH)
    related = F.when(across, _across(claim, quotes)).otherwise(claims.related(claim, quotes, EVENT_ACTIONS))
    return (
        F.when(claims.unsupported_action(claim, quotes, EVENT_ACTIONS), "action_not_supported")
        .when(is_title & (F.size(asserted_actions(claim)) > 0) & ~claim_supported(claim, source_title, own), "claim_quote_mismatch")
        .when(~related, "claim_quote_mismatch")
        .otherwise("")
    )


def display_contract(draft: Column, source: Column) -> Column:
    """The first reason against what a draft shows of its source, or an empty string."""
    title, bindings = draft["title"], draft["bindings"]
    sentences = summary_sentences(known(draft["brief"]))
    display = F.trim(F.concat(title, F.lit("\n"), known(draft["brief"])))
    own = publisher_subjects(source["publisher"], source["official"], source["identity"])

    def judged(p):
        shown, quoted = p["shown"], _quote(source["evidence"])
        covered = F.forall(shown, lambda c: F.exists(bindings, lambda b: covers(c, b["claim"])))
        expected = F.forall(bindings, lambda b: F.exists(shown, lambda c: covers(c, b["claim"])))
        faults = F.transform(bindings, lambda b: F.when(b["url"] != source["url"], "source_url_mismatch").when((_quote(b["quote"]) == "") | ~quoted.contains(_quote(b["quote"])), "quote_not_found").otherwise(""))
        fault = F.coalesce(F.get(F.filter(faults, lambda f: f != ""), F.lit(0)), F.lit(""))
        quotes = lambda c: F.array_join(F.transform(F.filter(bindings, lambda b: covers(c, b["claim"])), lambda b: _quote(b["quote"])), " ")
        each = F.transform(shown, lambda c: claim_reason(c, quotes(c), c == title, source["title"], own))
        editorial = F.when(source["opinion"], "").otherwise(display_reason(title, source["evidence"], own))
        found = F.struct(covered.alias("covered"), expected.alias("expected"), fault.alias("fault"), editorial.alias("editorial"), F.coalesce(F.get(F.filter(each, lambda r: r != ""), F.lit(0)), F.lit("")).alias("claim"))
        return once(found, chain)

    def chain(f):
        evidence = plain_text(source["evidence"])
        return (
            F.when((F.trim(title) == "") | ~title.rlike(IDEOGRAPH) | (F.size(sentences) > MOST_SENTENCES) | F.exists(sentences, lambda s: ~s.rlike(IDEOGRAPH)) | (F.size(bindings) == 0), "invalid_builder_response")
            .when((draft["origin"] == "llm") & claims.untranslated_prose(title, UNTRANSLATED), "translation_failed")
            .when(holds_any(display, COMMENTARY), "unsupported_commentary")
            .when((source["channel"] == "github") & activity_only(source["evidence"]), "github_activity_only")
            .when((source["channel"] == "x") & ~source["official"] & holds_any(F.lower(display), _marks()) & ~holds_any(display, ATTRIBUTION), "community_claim_overstated")
            .when(~f["covered"], "missing_target_binding")
            .when(~f["expected"], "unexpected_target_binding")
            .when(f["fault"] != "", f["fault"])
            .when(f["editorial"] != "", f["editorial"])
            .when(claims.unsupported_tokens(display, evidence), "protected_token_missing")
            .when(claims.unsupported_action(display, evidence, EVENT_ACTIONS), "action_not_supported")
            .otherwise(f["claim"])
        )

    return once(F.struct(shown_claims(draft).alias("shown")), judged)


def without_restatements(draft: Column, source_title: Column) -> Column:
    """struct<brief, mode, removed> without the sentences that say what the title says, or that only the source's title holds."""
    held, title = _quote(source_title), F.trim(draft["title"])
    mine = lambda s: F.filter(draft["bindings"], lambda b: covers(s, b["claim"]))
    again = lambda s: (comparison_text(s) == comparison_text(title)) | ((F.size(mine(s)) > 0) & F.forall(mine(s), lambda b: held.contains(_quote(b["quote"]))))

    def made(s):
        kept = F.filter(s, lambda x: ~again(x))
        removed = F.size(s) - F.size(kept)
        brief = F.when(removed == 0, known(draft["brief"])).when(F.size(kept) > 0, F.concat(F.array_join(kept, "。"), F.lit("。"))).otherwise("")
        return F.struct(brief.alias("brief"), F.when(F.size(kept) > 0, "expanded").otherwise("title_only").alias("mode"), removed.alias("removed"))

    return once(summary_sentences(known(draft["brief"])), made)


def rules_vouch(draft: Column) -> Column:
    """Whether rules alone can vouch for each shown claim in another language than its quotes."""

    def held(c):
        quotes = F.array_join(F.transform(F.filter(draft["bindings"], lambda b: covers(c, b["claim"])), lambda b: _quote(b["quote"])), " ")
        return ~(c.rlike(IDEOGRAPH) & ~quotes.rlike(IDEOGRAPH)) | claims.anchors_held(c, quotes, ANCHOR_STOPWORDS, _proved())

    return F.forall(shown_claims(draft), held)


def issue_action(reason: Column, attempt: Column) -> Column:
    """rebuild on the first attempt, unless another draft cannot mend the reason; else reject."""
    return F.when((attempt == 1) & ~reason.isin(*PERMANENT), "rebuild").otherwise("reject")


def validated(draft: Column, source: Column, attempt: Column, now: Column, hours: float = 36.0) -> Column:
    """struct<action, reason, brief, mode> of a draft under the rules alone: accept, rebuild or reject."""
    none = F.lit("")

    def told(p):
        shown = F.when((p["contract"] == "") & (p["editorial"] == ""), display_contract(draft, source)).otherwise(none)
        return once(F.struct(p["contract"].alias("contract"), p["editorial"].alias("editorial"), shown.alias("shown")), decided)

    def decided(p):
        return once(without_restatements(draft, source["title"]), lambda short: once(final_reason(p, short), lambda reason: verdict(p, short, reason)))

    def final_reason(p, short):
        final = F.struct(draft["title"].alias("title"), short["brief"].alias("brief"), draft["bindings"].alias("bindings"))
        before = F.coalesce(*[F.when(p[step] != "", p[step]) for step in ("contract", "editorial", "shown")])
        return F.when(before.isNotNull(), before).when(~once(final, rules_vouch), "claim_quote_mismatch").otherwise("")

    def verdict(p, short, reason):
        fixed = (p["contract"] != "") | ((p["editorial"] != "") & ~source["opinion"])
        action = F.when(reason == "", "accept").when(fixed, "reject").otherwise(issue_action(reason, attempt))
        return F.struct(action.alias("action"), reason.alias("reason"), F.when(reason == "", short["brief"]).otherwise("").alias("brief"), F.when(reason == "", short["mode"]).otherwise("").alias("mode"))

    editorial = F.when(source["opinion"], opinion_contract(draft, source)).otherwise(source_reason(source["title"], source["evidence"], source["channel"], source["found_at"]))
    return once(F.struct(source_contract(source, now, hours).alias("contract"), editorial.alias("editorial")), told)


def source_draft(source: Column) -> Column:
    """The draft that a source gives without a generator: a Chinese title with at most two sentences of its evidence, or a minimal title made of an English one's anchors; null without either."""
    title = F.trim(known(source["title"]))
    chinese = title.rlike(IDEOGRAPH)

    def made(t):
        body = F.trim(known(source["evidence"]))
        at = F.when(t != "", F.position(t, body)).otherwise(0)
        rest = F.when(at > 0, F.btrim(F.concat(F.substring(body, F.lit(1), at - 1), F.substring(body, at + F.length(t), F.length(body))), F.lit(" \n。；;：:"))).otherwise(body)
        sentences = F.slice(F.filter(summary_sentences(rest), lambda s: s.rlike(IDEOGRAPH)), 1, MOST_SENTENCES)
        brief = F.when(chinese & (F.size(sentences) > 0), F.concat(F.array_join(sentences, "。"), F.lit("。"))).otherwise("")
        claimed = F.when(chinese, F.array_distinct(F.concat(F.array(t), summary_sentences(brief)))).otherwise(F.array(t))
        bound = F.transform(claimed, lambda c: F.struct(c.alias("claim"), F.when(chinese, c).otherwise(source["title"]).alias("quote"), source["url"].alias("url")))
        return F.when(known(t) != "", F.struct(t.alias("title"), brief.alias("brief"), F.lit("source").alias("origin"), bound.alias("bindings"), source["opinion"].alias("opinion"), source["author"].alias("author")))

    return once(F.when(chinese, title).otherwise(anchored_title(source["title"])), made)
