"""Every query against its SQL in DuckDB, and the queries without SQL against brute force over plain lists."""

import glob
import math
import os
import re
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.functions import anchors, claims, draft_checks, drafts, forum, publishability, replies, text
from gleanery.operators import clustering, dedup, editing, relation, selection
from gleanery.plans import queries as Q
from gleanery.plans import signals
from gleanery.sources import feeds

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return round(float(value), 9) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = Q.queries()[name](spark, SMALL)
    mine = Counter(tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect())
    made = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == sorted(found.columns)
    assert mine == Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in made.fetchall())


def pools_of(spark, rows):
    return spark.createDataFrame(rows, "run int, id long, rank int, source string, topic string, event string, primary boolean, radar boolean, score double")


def test_demoted_repeats(spark):
    rows = [(1, 1, 1, "a", "t", "e1", False, False, 9.0), (1, 2, 2, "a", "t", "e2", False, False, 8.0), (1, 3, 3, "a", "u", "e3", False, False, 7.0), (1, 4, 4, "b", "u", "e4", True, False, 6.0)]
    found = {r["id"]: r["place"] for r in selection.demote_repeats(pools_of(spark, rows), ["run"], 1, 2, 1).collect()}
    assert found == {4: 1, 1: 2, 2: 3, 3: 4}


def test_selected_edition(spark):
    rows = [(1, i, i, f"s{i % 2}", f"t{i % 3}", f"e{i}", i == 6, i == 1, 9.0 - i) for i in range(1, 8)]
    found = {r["id"]: r["turn"] for r in selection.select_edition(pools_of(spark, rows), ["run"], 4, per_source=2, per_topic=2, least_primary=1).collect()}
    assert found == {6: 1, 2: 2, 3: 3, 5: 4, 1: 0, 4: 0, 7: 0}


def test_leaders_and_events(spark):
    pools = spark.createDataFrame([(1, i, i, float(10 - i)) for i in range(1, 7)], "run int, id long, rank int, score double")
    pairs = spark.createDataFrame([(1, 1, 2, "same_event"), (1, 2, 3, "same_event"), (1, 4, 5, "same_event"), (1, 3, 6, "review"), (1, 4, 6, "same_event")], "run int, a long, b long, relation string")
    led = {r["id"]: r["leader"] for r in clustering.leaders(pools, pairs, ["run"]).collect()}
    assert led == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 3}
    found = {r["id"]: (r["event"], r["state"]) for r in clustering.events(pools, pairs, ["run"]).collect()}
    assert found == {1: (1, "event"), 2: (1, "merged"), 3: (1, "merged"), 4: (None, "quarantined"), 5: (None, "quarantined"), 6: (None, "quarantined")}
    kept = {r["id"]: r["accepted"] for r in clustering.accepted_duplicates(pools, pairs, ["run"]).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}


GOOD, AGAIN, BAD = {"action": "accept", "reason": ""}, {"action": "rebuild", "reason": "weak"}, {"action": "reject", "reason": "bad"}


def edited(spark, rows, pairs=(), **limits):
    """rows: opinion, post, author, attempts; the rank is the place, and the strength too unless a fifth value gives it."""
    made = [(1, i, i, r[4] if len(r) > 4 else i, *r[:4]) for i, r in enumerate(rows, 1)]
    pools = spark.createDataFrame(made, "run int, id long, rank int, strength int, opinion boolean, post boolean, author string, attempts array<struct<action string, reason string>>")
    links = spark.createDataFrame([(1, *p) for p in pairs], "run int, a long, b long, relation string")
    return {r["id"]: (r["state"], r["reason"], r["because_of"]) for r in editing.edit(pools, links, ["run"], editing.Limits(**limits)).collect()}


DONE = ("accepted", "", None)


def test_edit_retries_once(spark):
    rows = [(False, False, "", [AGAIN, GOOD]), (False, False, "", [AGAIN, AGAIN]), (False, False, "", [BAD]), (False, False, "", None), (False, False, "", [AGAIN])]
    assert edited(spark, rows) == {1: DONE, 2: ("rejected", "weak", None), 3: ("rejected", "bad", None), 4: ("rejected", editing.INVALID, None), 5: ("rejected", editing.INVALID, None)}


def test_edit_keeps_quotas(spark):
    opinion, post, fact = (True, False, "Ann", [GOOD]), (False, True, "", [GOOD]), (False, False, "", [GOOD])
    assert edited(spark, [opinion, opinion, (True, False, "", [GOOD]), fact], batch=1) == {1: DONE, 2: ("rejected", "opinion_author_limit", None), 3: ("rejected", "selection_rejected", None), 4: DONE}
    assert edited(spark, [post, post, fact], posts=1, wanted_posts=1) == {1: DONE, 2: ("rejected", "x_limit", None), 3: DONE}
    assert edited(spark, [post, fact], posts=0) == {1: ("rejected", "x_limit", None), 2: DONE}
    # A fact comes before an opinion of a better rank as long as facts are owed.
    assert edited(spark, [opinion, fact, fact], items=2, facts=2) == {1: ("not_selected", "target_reached", None), 2: DONE, 3: DONE}


def test_edit_removes_reports_of_one_event(spark):
    fact = lambda strength: (False, False, "", [GOOD], strength)
    assert edited(spark, [fact(2), fact(1), fact(3)], [(1, 2, "same_event"), (2, 3, "review")]) == {1: ("rejected", "semantic_duplicate", 2), 2: DONE, 3: ("rejected", "semantic_duplicate_unresolved", 2)}
    # When all places are taken, only a stronger report of an accepted event still gets in.
    assert edited(spark, [fact(5), fact(4), fact(1)], [(1, 3, "same_event")], items=1) == {1: ("rejected", "semantic_duplicate", 3), 2: ("not_selected", "target_reached", None), 3: DONE}
    # A post that waits takes the place of one that is gone.
    posts = [(False, True, "", [GOOD], s) for s in (3, 9)] + [fact(1)]
    assert edited(spark, posts, [(1, 3, "same_event")], posts=1) == {1: ("rejected", "semantic_duplicate", 3), 2: DONE, 3: DONE}


def test_edited_edition_keeps_its_promises(spark):
    pools = Q.draft_pools(spark, SMALL)
    rows = {(r["run"], r["id"]): r for r in pools.collect()}
    found = Q.edited_edition(spark, SMALL).collect()
    assert {(r["run"], r["id"]) for r in found} == set(rows) and len(found) == len(rows)
    kept = [rows[r["run"], r["id"]] for r in found if r["state"] == "accepted"]
    limits = editing.Limits()
    for run in {r["run"] for r in found}:
        mine = [r for r in kept if r["run"] == run]
        authors = [r["author"] for r in mine if r["opinion"]]
        assert len(mine) <= limits.items and sum(r["post"] for r in mine) <= limits.posts and len(authors) == len(set(authors)) <= limits.opinions
    accepted = {(r["run"], r["id"]) for r in kept}
    pairs = Q.pool_pairs(pools).collect()
    assert not [p for p in pairs if (p["run"], p["a"]) in accepted and (p["run"], p["b"]) in accepted]
    assert accepted


def test_related_pairs_equal_all_pairs(spark):
    docs = relation.documents(signals.related_sources(spark, SMALL))
    docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    side = lambda p: docs.select(*[F.col(x).alias(f"{p}_{x}") for x in docs.columns])
    of = lambda p: {f: F.col(f"{p}_{f}") for f in relation.FEATURES}
    every = side("a").join(side("b"), F.col("a_id") < F.col("b_id")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), relation.relationship(of("a"), of("b"), 12.0).alias("relation")).where("relation != 'distinct'")
    found = relation.related_pairs(docs, 12.0)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in every.collect()}
    assert found.count() > 10


@pytest.mark.parametrize("a, b, expected", [
    ("", "x", 0.0), ("Same Title", "same title", 1.0), ("独家：新模型发布", "新模型发布", 1.0), ("alpha beta", "alpha beta gamma", 10 / 16), ("a b c d", "c d e f", 2 / 6), ("新模型", "新方法", 0.0), ("新模型甲", "新模型乙", 2 / 4),
])
def test_title_similarity(spark, a, b, expected):
    one = spark.range(1).select(text.title_similarity(text.title_parts(F.lit(a)), text.title_parts(F.lit(b))).alias("s")).first()["s"]
    assert one == pytest.approx(expected)


@pytest.mark.parametrize("summary, article, ambiguous, detail", [
    ('<p>Article URL: <a href="https://a.example.com/x">https://a.example.com/x</a></p><p>Points: 3</p>', "https://a.example.com/x", False, ""),
    ("Article URL: https://a.example.com/x\nComments URL: https://news.ycombinator.com/item?id=1\nSome words", "https://a.example.com/x", False, "Some words"),
    ('&lt;p&gt;Article URL: &lt;a href="https:&#x2F;&#x2F;a.example.com&#x2F;x"&gt;here&lt;/a&gt;&lt;/p&gt; words', "https://a.example.com/x", False, "words"),
    ('Article URL: <a href="https://a.example.com/x">https://b.example.com/</a>', "", True, ""),
    ('Article URL: <a href="https://10.0.0.1/x">k</a> words', "", False, "words"),
    ("Article URL: https://a.example.com/x Article URL: https://b.example.com/y", "", True, ""),
    ("<script>Article URL: https://a.example.com/</script>plain", "", False, "plain"),
    (None, "", False, ""),
])
def test_forum_envelope(spark, summary, article, ambiguous, detail):
    one = spark.createDataFrame([(summary,)], "s string").select(forum.envelope(F.col("s")).alias("e")).first()["e"]
    assert (one["article"], one["ambiguous"], one["detail"]) == (article, ambiguous, detail)


def test_normalized_source(spark):
    rows = [("T", "https://a.example.com/p?utm_source=f", "<b>more</b>", None, "more", "A", "rss"), ("T", "https://news.ycombinator.com/item?id=1", "Article URL: https://some-lab.org/x", None, None, "HN", "hn"), ("T", None, "T", None, None, "A", "rss"), (None,) * 7]
    names = "title string, url string, summary string, excerpt string, body string, source string, kind string"
    found = [r["n"].asDict() for r in spark.createDataFrame(rows, names).select(forum.normalized_source(*map(F.col, ("title", "url", "summary", "excerpt", "body", "source", "kind"))).alias("n")).collect()]
    assert [(n["evidence"], n["url"], n["publisher"], n["via"], n["quality"]) for n in found] == [
        ("T\nmore", "https://a.example.com/p", "Example", "rss", "ready"), ("T", "https://some-lab.org/x", "Some Lab", "hacker_news", "title_only"), ("T", "", "A", "rss", "title_only"), ("", "", "", "rss", "title_only"),
    ]


def test_strict_draft_contract(spark):
    import json

    quote = lambda target: {"target": target, "source_quote": "q", "source_url": "u"}
    good = {"index": 1, "event_key": "k", "chinese_title": " T ", "brief": ["One。", "Two。"], "evidence_targets": [quote("title"), quote("brief_1"), quote("brief_2")]}
    broken = [{"index": "1"}, {"index": 2}, {"index": True}, {"event_key": "x"}, {"chinese_title": " "}, {"brief": ["One。", "Two。", "Three。"]}, {"brief": []}, {"brief": "One。Two。Three。"}, {"brief": None}, {"more": 1}, {"evidence_targets": []}, {"evidence_targets": [quote("title")]}, {"evidence_targets": [*good["evidence_targets"], quote("brief_3")]}, {"evidence_targets": [quote("title"), quote("brief_1"), {**quote("brief_2"), "source_quote": " "}]}, {"evidence_targets": [quote("title"), quote("brief_1"), {"target": "brief_2", "source_quote": "q"}]}]
    raws = [json.dumps(good), json.dumps(good | {"brief": "", "evidence_targets": [quote("title")]})] + [json.dumps(good | b) for b in broken] + ["[1]", "{", "", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    found = [r["d"] for r in rows.select("i", drafts.strict_draft(F.col("raw"), F.lit(1), F.lit("k")).alias("d")).orderBy("i").collect()]
    assert (found[0]["title"], found[0]["brief"], [b["claim"] for b in found[0]["bindings"]]) == ("T", "One。Two。", ["T", "One", "Two"])
    assert found[1]["mode"] == "title_only" and found[2:] == [None] * (len(raws) - 2)


GROUPS = {"release": ("发布", "release"), "funding": ("融资", "raise")}


def test_claims(spark):
    lit = F.lit
    cases = [
        (claims.unsupported_action(lit("A 发布 B"), lit("a releases b"), GROUPS), False), (claims.unsupported_action(lit("A 融资"), lit("a releases b"), GROUPS), True),
        (claims.action_matches(lit("发布"), lit("released"), GROUPS), True), (claims.action_matches(lit("融资"), lit("released"), GROUPS), False), (claims.action_matches(lit("x"), lit("y"), GROUPS), True),
        (claims.unsupported_tokens(lit("OpenAI 5.5"), lit("openai had 5.5"), ()), False), (claims.unsupported_tokens(lit("grew 12"), lit("grew")), True), (claims.unsupported_tokens(lit("the API"), lit("the door")), True), (claims.unsupported_tokens(lit(None).cast("string"), lit("x")), False),
        (claims.related(lit("Acme X2 out"), lit("Acme put X2 out today"), GROUPS), True), (claims.related(lit("Acme X3 out"), lit("Acme put X2 out today"), GROUPS), False),
        (claims.related(lit("新模型发布"), lit("something was released"), GROUPS), True), (claims.related(lit("新模型来了"), lit("旧的新模型走"), GROUPS), True), (claims.related(lit("甲乙丙"), lit("丁戊"), GROUPS), False),
        (claims.anchors_held(lit("Acme发布X2"), lit("Acme ships X2"), (), ("发布",)), True), (claims.anchors_held(lit("Acme发布好X2"), lit("Acme ships X2"), (), ("发布",)), False), (claims.anchors_held(lit("发布"), lit("x"), (), ("发布",)), False),
        (claims.untranslated_prose(lit("新 model with 力"), ("with",)), True), (claims.untranslated_prose(lit("新 a/with `run with` With"), ("with",)), False),
    ]
    row = spark.range(1).select(*[c.alias(str(i)) for i, (c, _) in enumerate(cases)]).first()
    assert [row[str(i)] for i in range(len(cases))] == [expected for _, expected in cases]


def test_balance(spark):
    """Publishers capped at two, entities at one, papers at one; a feed is promoted; then soft caps give way, at last all but the firm one."""
    rows = [(1, i, i, s, k, e) for i, (s, k, e) in enumerate([("a", "hn", ["x"]), ("a", "hn", []), ("a", "rss", []), ("b", "arxiv", ["x", "y"]), ("b", "arxiv", []), ("c", "arxiv", []), ("d", "hn", None), ("a", "hn", ["y"]), ("e", "rss", ["x"])], 1)]
    pools = spark.createDataFrame(rows, "run int, id long, rank int, source string, topic string, entity array<string>")

    def balanced(target):
        made = selection.balance(pools, ["run"], target, {"source": 2, "entity": 1}, {"topic": {"arxiv": 1, "hn": 3}}, ("topic", "rss", 1), ("source",), ("topic", "hn"))
        return {r["id"]: (r["turn"], r["relaxed"]) for r in made.collect()}

    assert balanced(3) == {1: (1, ""), 2: (2, ""), 5: (3, ""), 7: (4, ""), 3: (0, ""), 4: (0, ""), 6: (0, ""), 8: (0, ""), 9: (0, "")}
    assert balanced(5) | {3: (5, "soft")} == balanced(5)
    assert balanced(9) == {1: (1, ""), 2: (2, ""), 5: (3, ""), 7: (4, ""), 3: (5, "soft"), 4: (6, "all"), 6: (7, "all"), 9: (8, "all"), 8: (0, "")}


def test_diversify(spark):
    rows = [(1, 1, 1, "a"), (1, 2, 2, "a"), (1, 3, 3, "a"), (1, 4, 4, "b"), (1, 5, 5, "a"), (1, 6, 6, "c"), (1, 7, 7, None)]
    pools = spark.createDataFrame(rows, "run int, id long, rank int, entity string")
    kept = {r["id"] for r in selection.diversify(pools, ["run"], 5).collect() if r["kept"]}
    assert kept == {1, 2, 6, 4, 7}


def claims_of(spark, rows):
    """(claim, quote): whether the quote supports the claim."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, claim string, quote string")
    return [r["s"] for r in frame.select("i", publishability.claim_supported(F.col("claim"), F.col("quote")).alias("s")).orderBy("i").collect()]


def test_claims_are_one_frame_of_one_sentence(spark):
    assert claims_of(spark, [
        ("OpenAI 发布 GPT-5", "OpenAI released GPT-5."), ("OpenAI 发布 GPT-5", "Anthropic released GPT-5."), ("OpenAI 发布 GPT-5", "OpenAI released. Anthropic says GPT-5."),
        ("", "OpenAI released GPT-5."), ("GPT-5 is here", "GPT-5 is here"), ("发布 GPT-5", "OpenAI 发布 GPT-5"), ("谷歌收购 Mistral AI", "Google acquires Mistral"), ("OpenAI 更新 GPT-5", "OpenAI released GPT-5."),
    ]) == [True, False, False, False, False, False, True, False]


def test_features_of_reports(spark):
    frame = spark.createDataFrame([("GPT-4o-mini beats Claude 4.5 Sonnet and Model\u20112 (pro) for $30 million, up 3.5% in 2 years since 2024",)], "x string")
    r = frame.select(anchors.models(F.col("x")).alias("m"), anchors.qualifiers(F.col("x")).alias("q"), anchors.conflicting(anchors.qualifiers(F.col("x")), F.array(F.lit("amount:$30 billion"))).alias("c")).first()
    assert r["m"] == ["claude-4.5-sonnet", "gpt-4o-mini", "model-2-pro"]
    assert r["q"] == ["amount:$30 million", "duration:2 years", "percent:3.5%", "year:2024"] and r["c"]


SOURCE = "title string, evidence string, url string, channel string, found_at string, published_at timestamp, official boolean, publisher string, identity string, opinion boolean, author string, allowed boolean, original boolean, whole boolean"
DRAFT = "title string, brief string, origin string, bindings array<struct<claim string, quote string, url string>>, opinion boolean, author string"


def checked(spark, attempt=1, **more):
    """The verdict on a good draft in which the fields named in `more` differ."""
    from datetime import datetime

    text = "OpenAI 发布 GPT-5 模型。新模型支持 API 调用。"
    source = {"title": "OpenAI 发布 GPT-5 模型", "evidence": text, "url": "https://a.example/1", "channel": "rss", "found_at": "", "published_at": datetime(2024, 1, 30, 20), "official": False, "publisher": "P", "identity": "", "opinion": False, "author": "", "allowed": False, "original": False, "whole": False}
    bind = lambda claim, quote, url="https://a.example/1": (claim, quote, url)
    draft = {"title": "OpenAI 发布 GPT-5 模型", "brief": "新模型支持 API 调用。", "origin": "llm", "bindings": [bind("OpenAI 发布 GPT-5 模型", "OpenAI 发布 GPT-5 模型"), bind("新模型支持 API 调用", "新模型支持 API 调用")], "opinion": False, "author": ""}
    source |= {k: v for k, v in more.items() if k in source and k not in ("title",)}
    draft |= {k.removeprefix("draft_"): v for k, v in more.items() if k.startswith("draft_")}
    if "title" in more:
        source["title"] = more["title"]
    frame = spark.createDataFrame([(tuple(source.values()), tuple(draft.values()))], f"s struct<{SOURCE.replace(' ', ':').replace(',:', ',')}>, d struct<{DRAFT.split(', bindings')[0].replace(' ', ':').replace(',:', ',')},bindings:array<struct<claim:string,quote:string,url:string>>,opinion:boolean,author:string>")
    return tuple(frame.select(draft_checks.validated(F.col("d"), F.col("s"), F.lit(attempt), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("v")).first()["v"])


def test_checks_of_a_draft(spark):
    good = ("accept", "", "新模型支持 API 调用。", "expanded")
    assert checked(spark) == good
    assert checked(spark, url="") == ("reject", "missing_source_url", "", "")
    assert checked(spark, published_at=None)[:2] == ("reject", "stale_item")
    assert checked(spark, title="使用指南")[:2] == ("reject", "non_news_content")
    assert checked(spark, draft_brief="这意味着新模型支持 API 调用。")[:2] == ("rebuild", "unsupported_commentary")
    assert checked(spark, attempt=2, draft_brief="这意味着新模型支持 API 调用。")[:2] == ("reject", "unsupported_commentary")
    assert checked(spark, draft_title="OpenAI will 发布 GPT-5")[:2] == ("rebuild", "translation_failed")
    assert checked(spark, draft_brief="")[:2] == ("rebuild", "unexpected_target_binding")
    assert checked(spark, draft_brief="新模型支持 API 调用。它很快。")[:2] == ("rebuild", "missing_target_binding")
    only = [("OpenAI 发布 GPT-5 模型", "OpenAI 发布 GPT-5 模型", "https://b.example/")]
    assert checked(spark, draft_brief="", draft_bindings=only)[:2] == ("rebuild", "source_url_mismatch")
    assert checked(spark, draft_brief="", draft_bindings=[(*only[0][:1], "OpenAI 推出", "https://a.example/1")])[:2] == ("rebuild", "quote_not_found")
    # A sentence that only the source's title holds goes, and the draft is its title alone.
    again = [("OpenAI 发布 GPT-5 模型", "OpenAI 发布 GPT-5 模型", "https://a.example/1"), ("GPT-5 模型", "GPT-5 模型", "https://a.example/1")]
    assert checked(spark, draft_brief="GPT-5 模型。", draft_bindings=again) == ("accept", "", "", "title_only")
    assert checked(spark, opinion=True)[:2] == ("rebuild", "opinion_author_not_allowed")


def test_people_need_context(spark):
    from gleanery.functions.people import people, shared

    texts = ["CEO Sam Altman spoke", "Sam Altman spoke", "Jane Roe, the Chief Scientist, left", "Jane Roe said she left", "Acme Research Group hired a director", "Ann Lee works as an engineer", "the rundown", "Samuel Altman"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", people(F.col("x")).alias("p")).orderBy("i").collect()
    assert [(r["p"]["people"], r["p"]["candidates"]) for r in rows] == [(["sam altman"], ["sam altman"]), ([], []), ([], ["jane roe"]), ([], ["jane roe"]), ([], []), ([], ["ann lee"]), ([], []), (["sam altman"], ["sam altman"])]
    none = F.array().cast("array<string>")
    both = spark.range(1).select(shared(F.array(F.lit("jane roe")), F.lit("CEO Jane Roe"), none, F.lit("JANE ROE left")).alias("s")).first()
    assert both["s"] == ["jane roe"]


def test_relation_of_reports(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    rows = [(1, "OpenAI releases GPT-5", "text", "https://a/1"), (2, "OpenAI launches GPT-5", "other", "https://a/2"), (3, "OpenAI releases GPT-4", "x", "https://a/3"), (4, "OpenAI raises $30 million", "x", "https://a/4"), (5, "OpenAI raises $30 billion", "x", "https://a/5"), (6, "OpenAI raises money", "x", "https://a/6"), (7, "nothing", "y", "https://a/1/")]
    frame = spark.createDataFrame([(*r, None, str(r[0]), at) for r in rows], "id long, title string, evidence string, url string, thread_id string, item_id string, published_at timestamp")
    docs = relation.documents(frame)
    assert {(r["a"], r["b"], r["relation"]) for r in relation.related_pairs(docs).collect()} == {(1, 2, "same_event"), (1, 7, "same_event"), (4, 6, "review"), (5, 6, "review")}
    assert {r["id"]: (r["same_events"], r["reviews"]) for r in relation.related_counts(docs).collect()} == {1: (2, 0), 2: (1, 0), 3: (0, 0), 4: (0, 1), 5: (0, 1), 6: (0, 2), 7: (1, 0)}


def test_tenths_round_as_python_does(spark):
    from gleanery.functions.scoring import tenths

    values = [4.65, 4.15, 0.25, 0.75, 9.95, 4.5 * 0.7 + 5.0 * 0.3, 7.5 * 0.7 + 9.0 * 0.3, 0.0, 10.0, *(i * 0.7 / 10 + j * 0.3 / 10 for i in range(0, 101, 3) for j in range(0, 101, 7))]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    assert all(r["t"] == round(r["x"], 1) for r in frame.select("x", tenths(F.col("x")).alias("t")).collect())


TITLES = ("a", "ab", "abc", "x a", "a b c d", "b c d e", "c d e f g", "a-b c", "ab c", "ABC", "新", "新模", "新模型", "新模型甲 ab", "ab 新方法", "新方法", "方法新", "one two three four", "two three four five", "one two three four five six seven", "twothree", "three fourty", "the whole title is held", "whole title is held", "whole title", "", "   ", "!?", "alpha!", "al pha", "al-pha beta")


@pytest.mark.parametrize("threshold, inclusive", [(0.25, False), (0.25, True), (0.5, True), (0.7, False)])
def test_similar_titles_equal_all_pairs(spark, monkeypatch, threshold, inclusive):
    monkeypatch.setattr(dedup, "BLOCK", 3)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)] + [(90, "A B C D"), (91, None)], "id long, title string")
    classes = dedup.title_classes(rows, F.col("title"), "id")
    sim = text.title_similarity(F.col("p"), F.col("q"))
    every = classes.select(F.col("class").alias("a"), F.col("parts").alias("p")).join(classes.select(F.col("class").alias("b"), F.col("parts").alias("q")), F.col("a") < F.col("b")).select("a", "b", sim.alias("sim"))
    expected = {(r.a, r.b, round(r.sim, 9)) for r in every.where(F.col("sim") >= threshold if inclusive else F.col("sim") > threshold).collect()}
    found = [(r.a, r.b, round(r.sim, 9)) for r in dedup.similar_titles(classes, threshold, inclusive).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and expected


@pytest.mark.parametrize("threshold, block", [(0.25, 7), (0.25, 65536), (0.5, 7)])
def test_cross_references_count_without_pairs(spark, monkeypatch, threshold, block):
    """No pair of titles by their words alone is made, and the counts are those of all pairs."""
    monkeypatch.setattr(dedup, "COUNTED_BLOCK", block)
    monkeypatch.setattr(dedup, "similar_titles", lambda *a, **k: pytest.fail("pairs are made"))
    monkeypatch.setattr(dedup, "_prefix_keys", lambda flat, values, *how, plain=dedup._prefix_keys: plain(flat, values, *how) if values == "pairs" else pytest.fail("pairs are made"))
    rng = np.random.default_rng(3)
    drawn = [" ".join(rng.choice(["al", "bet", "gam", "delta", "eps", "ze", "e", "theta!"], int(k))) for k in rng.integers(1, 9, 60)]
    runs = ["nd " * 40 + "x", "nd nd", "the nd x", "x nd", "y " + "abcdefgh" * 9 + " z", "abcdefgh" * 4, "cdefghab" * 3, "abc-defgh" * 5, "efghabcd" * 8, "--- ---", "---"]
    titles = [*TITLES, *drawn, *runs, "A B C D", None]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    parts = rows.select("id", text.title_parts(F.col("title")).alias("p"))
    pairs = parts.join(parts.withColumnsRenamed({"id": "o", "p": "q"}), F.col("id") != F.col("o")).where(text.title_similarity(F.col("p"), F.col("q")) > threshold)
    expected = Counter(r.id for r in pairs.select("id").collect())
    assert {r.id: r.cross_refs for r in dedup.cross_references(rows, F.col("title"), "id", threshold).collect()} == {i: expected[i] for i in range(len(titles))}


@pytest.mark.parametrize("small", [1024, 40])
def test_small_scopes_are_paired_without_keys(spark, monkeypatch, small):
    by_keys = []
    monkeypatch.setattr(dedup, "SMALL_SCOPE", small)
    monkeypatch.setattr(dedup, "_similar_by_keys", lambda classes, *how, plain=dedup._similar_by_keys: by_keys.append(sorted({r.mark for r in classes.collect()})) or plain(classes, *how))
    rows = spark.createDataFrame([(s * 1000 + i, s, t) for s in (1, 2) for i, t in enumerate(TITLES)] + [(3000 + i, 1, f"one two three {i}") for i in range(15)], "id long, s long, title string")
    classes = dedup.title_classes(rows, F.col("title"), "id", scope="s")
    every = classes.select("mark", F.col("class").alias("a"), F.col("parts").alias("p")).join(classes.select("mark", F.col("class").alias("b"), F.col("parts").alias("q")), "mark").where("a < b")
    expected = {(r.a, r.b, round(r.sim, 9)) for r in every.select("a", "b", text.title_similarity(F.col("p"), F.col("q")).alias("sim")).where("sim > 0.25").collect()}
    found = [(r.a, r.b, round(r.sim, 9)) for r in dedup.similar_titles(classes, 0.25).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and expected
    assert by_keys == ([] if small == 1024 else [["1\x1f"]])


def test_hash_links_count_near_rows(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 3)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 6)] + [0, -1]
    near = [b ^ sum({1 << int(p) for p in rng.integers(0, 63, k)}) for b in base for k in (1, 2, 3, 4, 5) for _ in range(4)]
    hashes = [*base, *near, base[0], base[0], None, None]
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    apart = lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count()
    expected = {i: (i, i, 0) if h is None else (i, hashes.index(h), sum(g is not None and j != i and apart(g, h) <= 4 for j, g in enumerate(hashes))) for i, h in enumerate(hashes)}
    found = dedup.hash_links(rows, "h", "id").collect()
    assert {r.id: tuple(r) for r in found} == expected and len(found) == len(hashes)
    assert dedup.hash_links(rows.where("id < 0"), "h", "id").count() == 0


@pytest.mark.parametrize("reply, value, first", [
    (' {"a":1} ', '{"a":1}', '{"a":1}'), ('Sure:\n```json\n[{"index":1}]\n```', '[{"index":1}]', '{"index":1}'), ('x {"a":{"b":1}} y {"c":2}', '{"a":{"b":1}}', '{"a":{"b":1}}'),
    ('{bad} {"a":1} t', None, '{"a":1}'), ('{"a":1} {"b":2}', '{"a":1}', '{"a":1}'), ('[{"a":1}]', '[{"a":1}]', None), ("1],[2", None, None), ("12 apples", None, None), ("", None, None), (None, None, None),
    ('{"a":{"b":{"c":1}}} z', '{"b":{"c":1}}', '{"a":{"b":{"c":1}}}'), ('```\n{bad}\n``` {"k":"v"}', None, '{"k":"v"}'), ("{" * 50, None, None), ('"text"', '"text"', None),
])
def test_replies(spark, reply, value, first):
    row = spark.createDataFrame([(reply,)], "s string").select(replies.extracted(F.col("s")).alias("v"), replies.first_object(F.col("s")).alias("o")).first()
    assert (row.v, row.o) == (value, first)


def test_items_of_a_reply(spark):
    value = '{"items":[{"index":" 2 ","brief":["a "," b"]},{"index":3,"brief":" x "},{"index":3.5,"brief":["a",""]},{"index":"-1","brief":["a",null]},{"brief":["a","b","c"]},7]}'
    rows = spark.createDataFrame([(value,)], "s string").select(F.posexplode(replies.items(F.col("s"))).alias("at", "i"))
    found = rows.orderBy("at").select(replies.index_of(F.col("i")), replies.brief_of(F.col("i"))).collect()
    assert [tuple(r) for r in found] == [(2, "ab"), (3, "x"), (None, None), (None, None), (None, None), (None, None)]
    assert spark.range(1).select(replies.items(F.lit('{"other":1}'))).first()[0] is None


def test_images_of_an_entry(spark):
    kind = "m {0}, t {0}, l {0}, e {0}, h array<string>".format(feeds.LINKED)
    link = lambda url=None, href=None, type=None, rel=None: (url, href, type, rel)
    rows = [
        ([link("m", "no"), link("")], [link(None, "t"), link("m")], [link("a.html", rel="alternate"), link("i", type="Image/png"), link("h", rel="Thumbnail"), None], [link("u", "e", "image/gif"), link("s", None, "audio/x")],
         ["<p><img class='x' src='w'><IMG src=\"data:1\"></p>", None, '<img src="a&amp;amp;b"> <img src="t">']),
        (None, None, None, None, None),
    ]
    found = spark.createDataFrame(rows, kind).select(feeds.entry_images(*map(F.col, "mtleh")).alias("x")).collect()
    assert [tuple(p) for p in found[0].x] == [("m", "rss:media_content"), ("t", "rss:media_thumbnail"), ("i", "rss:link"), ("h", "rss:link"), ("e", "rss:enclosure"), ("w", "rss:html_img"), ("a&b", "rss:html_img")]
    assert found[1].x == []


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_topic_key_of_long_texts(spark):
    texts = ["@@a b", "x" * 200, "-" * 500 + "A b", "a!" * 300, "新 " * 90, "a" * 80 + "!" * 9, "a" * 79 + " - b", "a" * 80 + " b", "!?", "", None, "a" * 79 + "!!\nb c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, s string").repartition(2)
    found = frame.select("id", text.topic_key(F.col("s")).alias("k"), text.slug(F.col("s")).alias("w"))
    assert all(r.k == "topic:" + r.w[:80] for r in found.collect())
    assert _plan(frame.select(text.topic_key(F.col("s")).alias("k"))).count("[^a-z0-9一-鿿]+,") == 1


def test_white_space_and_tokens(spark):
    values = ["a b", "a  b", " a\tb\n", "a b", "a    b", "\n\na\r\n b \x0b\x0c", "Ａ　ｂ！", "", None, "the a the b a b c"]
    frame = spark.createDataFrame([(v,) for v in values], "s string").repartition(2)
    for r in frame.select("s", text.collapse(F.col("s")).alias("c"), text.normalized(F.col("s")).alias("n"), text.text_tokens(F.col("s"), ("a", "the")).alias("t")).collect():
        plain = lambda s: re.sub("[ \t\n\x0b\f\r]+", " ", s.replace(" ", " ")).strip(" ")
        assert r.c == plain(r.s or "") and r.n == plain((r.s or "").translate(str.maketrans(text.WIDE, text.PLAIN)))
        assert r.t == list(dict.fromkeys(w for w in re.findall("[a-z0-9][a-z0-9.+-]*", r.n.lower()) if w not in ("a", "the")))
    assert "\\z" not in _plan(frame.select(text.text_tokens(F.col("s"), ("a", "the"))))


def test_fingerprint_pairs_search_texts_once(spark):
    assert "documents" not in _plan(signals.fingerprint_pairs(spark, "/root/testdata/sf0.001")) and "Relation" not in _plan(signals.fingerprint_pairs(spark, "/root/testdata/sf0.001"))


def test_reports_of_one_address_are_counted_not_paired(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(relation, "_related", lambda docs, pairs, hours, plain=relation._related: tried.append(pairs.count()) or plain(docs, pairs, hours))
    kind = "id long, title string, evidence string, url string, thread_id string, item_id string, published_at timestamp"
    at = datetime(2024, 1, 1)
    hot = relation.documents(spark.createDataFrame([(i, f"t {i}", "x", "https://a/1", None, str(i), at + timedelta(days=i)) for i in range(120)], kind))
    assert {tuple(r)[1:] for r in relation.related_counts(hot).collect()} == {(119, 0)} and tried == [0]
    urls = ("https://x.com/u/status/7", "https://x.com/w/status/7", "https://x.com/u/status/7#a", "https://a/1", "https://a/1", "", None, "https://a/2")
    said = ("OpenAI releases GPT-5", "OpenAI launches GPT-5", "OpenAI raises money", "nothing")
    docs = relation.documents(spark.createDataFrame([(i, said[i % 4], "text", urls[i % 8], None, str(i), at + timedelta(hours=i * 5)) for i in range(24)], kind))
    pairs = relation.related_pairs(docs).collect()
    expected = {i: tuple(sum(i in (p.a, p.b) and p.relation == r for p in pairs) for r in ("same_event", "review")) for i in range(24)}
    assert {r.id: (r.same_events, r.reviews) for r in relation.related_counts(docs).collect()} == expected


def test_short_titles_meet_only_what_holds_them(spark):
    """titles of less than 16 characters are paired with no title that does not hold them."""
    rng = np.random.default_rng(7)
    drawn = ["".join(rng.choice(list("abn -"), int(k))) for k in rng.integers(1, 30, 400)]
    rows = spark.createDataFrame(list(enumerate([*TITLES, *drawn])), "id long, title string")
    classes = dedup.title_classes(rows, F.col("title"), "id")
    parts = {r["class"]: r.parts for r in classes.collect()}
    for threshold in (0.25, 0.7):
        holds = lambda a, b: any(x and y and (x in y or y in x) and min(len(x), len(y)) >= threshold * max(len(x), len(y)) for x, y in ((a.clean, b.clean), (a.canon, b.canon)))  # noqa: B023, E731
        found = {(r.a, r.b) for r in dedup._held_pairs(dedup._flat(classes), threshold).collect()}
        every = {(a, b) for a in parts for b in parts if a < b and holds(parts[a], parts[b])}
        assert every <= found and every
        assert all(holds(parts[a], parts[b]) for a, b in found if min(len(parts[a].clean), len(parts[b].clean)) < 16)


def test_doubtful_titles_are_told_where_words_are_counted(spark):
    """one holds the other, but is so short that their similarity is below what their words tell; no pair leaves the count."""
    rows = spark.createDataFrame([(1, "x"), (2, "x " + "y" * 40), (3, "x " + "y" * 40 + " z"), (4, "b x"), (5, "x")], "id long, title string")
    classes = dedup.title_classes(rows, F.col("title"), "id")
    counted = dedup._counted(classes, 0.25)
    assert counted.columns == ["class", "m"] and Counter({r["class"]: r.m for r in counted.groupBy("class").agg(F.sum("m").alias("m")).collect()}) == {1: 1, 2: 2, 3: 1, 4: 3}


def test_long_titles_share_more_words_than_a_byte_counts(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BITS", 64)
    rows = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i * 100, i * 100 + n))) for i, n in enumerate((900, 500, 300, 254, 255, 256))], "id long, title string")
    words = {r.id: set(r.title.split()) for r in rows.collect()}
    expected = {i: sum(len(v & w) / len(v | w) > 0.25 for j, w in words.items() if j != i) for i, v in words.items()}
    title = rows.withColumn("title", F.concat_ws(" ", F.reverse(F.split("title", " "))))
    assert {r.id: r.cross_refs for r in dedup.cross_references(title, F.col("title"), "id").collect()} == expected and any(expected.values())


def test_scores_move_no_summaries(spark):
    """F2: the join of scores and references moves no text of which only the length counts."""
    from gleanery.plans import queries as plans

    assert "AS summary#" not in _plan(plans.composite_scores(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("threshold, inclusive", [(0.4, False), (0.5, True)])
def test_scopes_meet_without_a_join(spark, monkeypatch, threshold, inclusive):
    """the titles of a scope are held against each other in one task, not as rows of a join."""
    monkeypatch.setattr(dedup, "SHARED_COLUMNS", 5)
    rng = np.random.default_rng(11)
    drawn = [" ".join(rng.choice(["al", "bet", "gam", "新模型", "e", "模!"], int(k))) for k in rng.integers(1, 7, 60)]
    rows = spark.createDataFrame([(s * 1000 + i, s, t) for s in (1, 2) for i, t in enumerate([*TITLES, *drawn])] + [(5000, 3, "alone"), (5001, 4, "a b"), (5002, 4, "a b c")], "id long, s long, title string")
    classes = dedup.title_classes(rows, F.col("title"), "id", scope="s")
    every = classes.select("mark", F.col("class").alias("a"), F.col("parts").alias("p")).join(classes.select("mark", F.col("class").alias("b"), F.col("parts").alias("q")), "mark").where("a < b")
    sim = text.title_similarity(F.col("p"), F.col("q"))
    expected = {tuple(r) for r in every.select("a", "b", sim.alias("sim")).where(F.col("sim") >= threshold if inclusive else F.col("sim") > threshold).collect()}
    pairs = dedup.similar_titles(classes, threshold, inclusive)
    found = [(r.a, r.b, r.sim) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == expected and expected
    assert "Join" not in _plan(pairs)


def test_long_runs_of_capitalised_words_are_one_name(spark):
    """a run of a few thousand capitalised words ended the executor."""
    from gleanery.functions import people

    kind = "id long, title string, evidence string, url string, thread_id string, item_id string, published_at timestamp"
    run = "De " * 20_000
    rows = [(1, "CEO Sam Altman releases GPT-5", f"x\nCEO {run}said"), (2, "Sam Altman launched GPT-5", run), (3, run, "nothing"), (4, "Samuel  Altman，ＣＥＯ", "ＧＰＴ-5 left　Straße")]
    docs = relation.documents(spark.createDataFrame([(*r, f"https://a/{r[0]}", None, str(r[0]), datetime(2024, 1, 1)) for r in rows], kind))
    found = {r.id: r for r in docs.collect()}
    assert found[1].people == ["sam altman"] and found[1].candidates == ["de " * 19_999 + "de", "sam altman"] and found[2].mentioned == ["sam altman"] and found[2].people == [] and found[3].candidates == []
    assert found[4].people == ["sam altman"] and found[4].models == ["gpt-5"] and found[4].actions == ["departure"]
    assert {r.id: (r.same_events, r.reviews) for r in relation.related_counts(docs).collect()} == {1: (1, 0), 2: (1, 0), 3: (0, 0), 4: (0, 0)}
    rng = np.random.default_rng(3)
    words = ["Ab", "Cde", "f", "GH", "Ij2", "Klé", "_Mn", "Éo", " ", "\t", ".", ",", "-", "Pq ", "Rs\t "]
    lines = ["".join(w + (" " if i else "") for w, i in zip(rng.choice(words, k), rng.integers(0, 4, k), strict=True)) for k in rng.integers(1, 14, 3000)]
    each = spark.createDataFrame([(x,) for x in lines], "x string").select("x", *[F.regexp_extract_all("x", F.lit(p), F.lit(1)).alias(n) for n, p in (("old", people.NAME), ("new", people._NAME))]).collect()
    assert [r for r in each if r.old != r.new] == [] and sum(len(r.new) for r in each) > 500


def test_features_of_reports_are_those_of_their_texts(spark):
    from gleanery.functions import people

    rows = signals.related_sources(spark, SMALL).withColumn("title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("CEO Sam Altman　said, Ann Lee works as a director. "), "title")).otherwise(F.col("title")))
    whole = F.concat_ws("\n", "title", "evidence")
    made = {"actions": anchors.actions(whole), "mentioned": people.mentioned(whole), "models": anchors.models(whole), "organizations": anchors.organizations(whole), "qualifiers": anchors.qualifiers(whole), "_p": people.people(whole)}
    expected = {r.id: r for r in rows.select("id", *[c.alias(f) for f, c in made.items()]).collect()}
    found = relation.documents(rows).collect()
    assert len(found) == len(expected) and any("ann lee" in r.candidates for r in found)
    for r in found:
        e = expected[r.id]
        assert (r.people, r.candidates) == (e._p.people, e._p.candidates) and all(r[f] == e[f] for f in made if f != "_p")
    marks = [(kind, m) for kind, many in anchors.ACTIONS.items() for m in many]
    assert all(r.kind in r.found for r in spark.createDataFrame(marks, "kind string, m string").select("kind", anchors.actions(F.concat(F.lit("A "), F.upper("m"))).alias("found")).collect())


def test_related_events_takes_ids_of_any_size(spark, tmp_path):
    """hours counted from ids of more than 17,179,869,183 did not fit."""
    from gleanery.plans.publishing import MARKS

    shifted = lambda by, name: spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 48").withColumn("doc_id", F.col("doc_id") + by).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    shifted(0, "low")
    # A multiple of all that titles, addresses and times take ids by, so that the answers are those of the low ids.
    by = 8 * 2**31 * 3 * 25 * 11 * len(MARKS)
    shifted(by, "high")
    low, high = [{r.id - start: (r.same_events, r.reviews) for r in signals.related_events(spark, f"{tmp_path}/{name}").collect()} for name, start in (("low", 0), ("high", by))]
    assert len(low) == 48 and low == high and any(any(x) for x in low.values())
