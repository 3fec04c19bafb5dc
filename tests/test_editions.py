"""Repeats, topics and whole editions against plain walks."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanery.functions import fingerprints as P
from gleanery.operators import dedup, repeats, topics
from gleanery.plans import editions
from gleanery.plans.candidates import collect_news, retain, score
from gleanery.plans.tables import now

SMALL = "/root/testdata/sf0.001"


def canonical(title):
    return re.sub(r"[，,。.!！?？:：;；|｜、\"'“”‘’（）()【】\[\]\-—_]", "", re.sub(r"\s+", "", re.sub(r"\s+", " ", title).strip().lower()))


def similar(x, y):
    a, b = (x or "").strip().lower(), (y or "").strip().lower()
    if not a or not b:
        return 0.0
    ca, cb = canonical(a), canonical(b)
    if a == b or (ca and ca == cb):
        return 1.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    if ca and cb and (ca in cb or cb in ca):
        return min(len(ca), len(cb)) / max(len(ca), len(cb))
    if re.search("[一-鿿]", a + b):
        parts = [{t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b)]
    else:
        parts = [set(t.split()) for t in (a, b)]
    return len(parts[0] & parts[1]) / len(parts[0] | parts[1]) if parts[0] and parts[1] else 0.0


def rule(x, y):
    """x, y: dicts with title and the four lists of a fingerprint."""
    shares = lambda f: set(x[f]) & set(y[f])
    sim = similar(x["title"], y["title"])
    if sim >= 0.58:
        return "title_similarity"
    if shares("people") and shares("companies") and any(set(x["actions"]) & set(w) and set(y["actions"]) & set(w) for w in P.CATEGORIES.values()):
        return "same_person_company_event"
    suit = set(P.CATEGORIES["legal"])
    if len(shares("companies")) >= 2 and suit & set(x["actions"]) and suit & set(y["actions"]):
        return "same_companies_legal_event"
    if (shares("companies") or shares("products")) and (shares("people") or shares("actions")) and sim >= 0.35:
        return "event_fingerprint_overlap"
    return None


def walk_dedup(rows):
    """id -> (slot, kept, reason, stayed, merged) of rows in their order."""
    keepers, came, slot_of, why, stayed = [], [], {}, {}, {}
    for r in rows:
        for i, k in enumerate(keepers):
            found = rule(r, k)
            if found:
                came[i].append((r["id"], found))
                if r["keeper"] > k["keeper"]:
                    keepers[i] = r
                slot_of[r["id"]], why[r["id"]], stayed[r["id"]] = i, found, keepers[i]["id"]
                break
        else:
            slot_of[r["id"]] = len(keepers)
            keepers.append(r)
            came.append([])
    kept = {k["id"]: i for i, k in enumerate(keepers)}
    return {r["id"]: (slot_of[r["id"]] + 1, r["id"] in kept, why.get(r["id"], ""), stayed.get(r["id"]), came[kept[r["id"]]] if r["id"] in kept else []) for r in rows}


WORDS = ["openai", "launches", "model", "new", "chips", "sues", "agents", "谷歌发布", "plan", "x"]


def random_reports(seed, n):
    rng = random.Random(seed)
    pick = lambda many, most: sorted(rng.sample(many, rng.randint(0, most)))
    return [{
        "run": i % 3, "id": i, "rank": rng.randint(1, 9), "title": " ".join(rng.choices(WORDS, k=rng.randint(0, 5))),
        "companies": pick(["meta", "nvidia", "openai"], 2), "people": pick(["sam altman", "lisa su"], 1), "products": pick(["gpt", "grok"], 1),
        "actions": pick(["sued", "lawsuit", "launch", "release", "hire", "join", "收购"], 2), "keeper": (rng.randint(0, 1), rng.randint(0, 2), rng.randint(1, 3), rng.randint(0, 1), float(rng.randint(0, 3))),
    } for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_final_dedup_equals_a_walk(spark, seed):
    rows = random_reports(seed, 135)
    schema = "run int, id int, rank int, title string, print struct<companies: array<string>, people: array<string>, products: array<string>, actions: array<string>>, keeper struct<feed: int, cross: int, sure: int, pictured: int, score: double>"
    frame = spark.createDataFrame([(r["run"], r["id"], r["rank"], r["title"], tuple(r[f] for f in P.FIELDS), r["keeper"]) for r in rows], schema)
    pairs = repeats.event_pairs(frame, "run")
    found = {r["id"]: (r["slot"], r["kept"], r["reason"], r["stayed"], [(m["id"], m["reason"]) for m in r["merged"]]) for r in repeats.final_dedup(frame, pairs, "run").collect()}
    want = {}
    for run in range(3):
        want |= walk_dedup(sorted((r for r in rows if r["run"] == run), key=lambda r: (r["rank"], r["id"])))
    assert found == want
    assert {w[2] for w in want.values()} >= {"title_similarity", "same_person_company_event", "event_fingerprint_overlap", ""}


def test_all_rules_of_events():
    row = lambda title, companies=(), people=(), products=(), actions=(): {"title": title, "companies": companies, "people": people, "products": products, "actions": actions}
    assert rule(row("a b c"), row("a b c d")) == "title_similarity"
    assert rule(row("a", ["meta"], ["x"], [], ["hire"]), row("b", ["meta"], ["x"], [], ["join"])) == "same_person_company_event"
    assert rule(row("a", ["meta", "xai"], [], [], ["sued"]), row("b", ["xai", "meta"], [], [], ["诉讼"])) == "same_companies_legal_event"
    assert rule(row("p q r s"), row("p q t u")) is None and rule(row("p q r", [], [], ["gpt"], ["收购"]), row("p q t", [], [], ["gpt"], ["收购"])) == "event_fingerprint_overlap"


def test_final_dedup_query_equals_a_walk(spark):
    rows = [r.asDict(True) for r in editions.report_pools(spark, SMALL).collect()]
    for r in rows:
        r |= r["print"] | {"keeper": tuple(r["keeper"].values())}
    want = {}
    for run in {r["run"] for r in rows}:
        want |= walk_dedup(sorted((r for r in rows if r["run"] == run), key=lambda r: (r["rank"], r["id"])))
    found = {r["id"]: (r["slot"], r["kept"], r["reason"], r["stayed"], [(m["id"], m["reason"]) for m in r["merged"]]) for r in editions.final_dedup(spark, SMALL).collect()}
    assert found == want


@pytest.mark.parametrize("seed", [3, 4])
def test_stayers_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)} | {(i, i + 1) for i in range(60, 75)}
    found = {r["id"]: (r["stays"], r["because_of"]) for r in repeats.stayers(spark.createDataFrame(sorted(edges), "better int, worse int")).collect()}
    stays, want = [], {}
    for i in sorted({x for e in edges for x in e}):
        first = next((s for s in stays if (s, i) in edges), None)
        want[i] = (first is None, first)
        if first is None:
            stays.append(i)
    assert found == want
    assert repeats.stayers(spark.createDataFrame([], "better int, worse int")).collect() == []


def test_pictures_of_missing_hashes_and_contents(spark):
    rows = [("e", 1, 1, "A", 5), ("e", 2, 2, "A", None), ("e", 3, 3, None, 5), ("e", 4, 4, "B", 5 ^ 15), ("e", 5, 5, None, None), ("e", 6, 6, None, None), ("f", 7, 1, "A", 5), ("e", 8, 0, "C", 5 ^ 0xFF), ("e", 9, 9, "C", None), ("e", 10, 9, "D", -1)]
    found = {r["id"]: (r["kept"], r["reason"], r["because_of"]) for r in repeats.kept_pictures(spark.createDataFrame(rows, "edition string, id int, rank int, sha string, h long"), "edition").collect()}
    assert found == {
        1: (True, "", None), 2: (False, "same content", 1), 3: (False, "near picture", 1), 4: (False, "near picture", 8), 5: (True, "", None), 6: (True, "", None),
        7: (True, "", None), 8: (True, "", None), 9: (False, "same content", 8), 10: (True, "", None),
    }


def walk_topics(rows, names):
    """rows in order; leaders with what they took in."""
    named = lambda r: {n for n in names if n in (r["title"] or "").lower()}
    out = []
    for r in rows:
        r = dict(r)
        for k in out:
            if named(r) & named(k) and similar(r["title"], k["title"]) > 0.4:
                k["source"] = (k["source"] or "") + " | " + (r["source"] or "")
                for m in dedup.METRICS:
                    k[m] = max(k[m], r[m])
                k["cross_source_count"] += 1
                k["absorbed"] += 1
                break
        else:
            out.append(r | {"absorbed": 0})
    return out


def test_topics_equal_a_walk(spark):
    rng = random.Random(9)
    rows = [{"run": i % 2, "id": i, "title": " ".join(rng.choices(["OpenAI", "ships", "Acme", "chips", "new", "plan"], k=rng.randint(1, 4))), "source": rng.choice([None, "a", "b"]), **{m: rng.randint(0, 9) for m in dedup.METRICS}} for i in range(90)]
    rows += [r | {"id": 100 + i} for i, r in enumerate(rows[:9])]
    frame = spark.createDataFrame(rows, "run int, id int, title string, source string, " + ", ".join(f"{m} int" for m in dedup.METRICS))
    led = topics.topic_clusters(frame, "run", F.struct((-F.col("hn_score")).alias("s"), "id"), ("openai", "acme"))
    found = {r["id"]: (r["source"], *[r[m] for m in dedup.METRICS], r["absorbed"]) for r in led.collect()}
    want = [k for run in (0, 1) for k in walk_topics(sorted((r for r in rows if r["run"] == run), key=lambda r: (-r["hn_score"], r["id"])), ("openai", "acme"))]
    assert found == {k["id"]: (k["source"] or "", *[k[m] for m in dedup.METRICS], k["absorbed"]) for k in want}


def walk_balance(rows, target):
    kinds, firms, places, risks = Counter(), Counter(), Counter(), Counter()
    caps = {"arxiv": 2, "huggingface": 2, "hn": max(target // 2, 4), "x": 3}
    risk_caps = {"single_source_financial_claim": max(1, int(target * 0.2)), "community_model_comparison": max(1, int(target * 0.1))}
    most = max(2, int(target * 0.3))
    firms_of = lambda r: [n for n in editions.TOPICS if n in r["title"].lower()]
    bucket = lambda r: next((p.strip() for p in re.split(r"\s*(?:\+|\||/|,|，)\s*", r["source"].lower()) if p.strip()), "")

    def fits(r, soft=True):
        if kinds[r["source_type"]] >= caps.get(r["source_type"], 10**9) or any(firms[f] >= 2 for f in firms_of(r)):
            return False
        return not soft or not ((bucket(r) and places[bucket(r)] >= most) or risks[r["risk"]] >= risk_caps.get(r["risk"], 10**9))

    def take(r):
        chosen.append(r)
        kinds[r["source_type"]] += 1
        firms.update(firms_of(r))
        places[bucket(r)] += 1
        risks[r["risk"]] += 1

    chosen, left = [], []
    for r in rows:
        take(r) if fits(r) else left.append(r)
    for r in left[:]:
        if r["source_type"] == "rss" and kinds["rss"] < max(int(target * 0.4), 3) and fits(r):
            take(r)
            left.remove(r)
    for soft in (True, False):
        for r in left[:]:
            if len(chosen) < target and fits(r, soft):
                take(r)
                left.remove(r)
    for r in left:
        if len(chosen) < target and not (r["source_type"] == "x" and kinds["x"] >= 3):
            take(r)
    return chosen


@pytest.mark.parametrize("target", [12, 20])
def test_collected_news_equals_a_walk(spark, target):
    rows = editions.news_rows(spark, SMALL).withColumn("run", F.col("id") % 3)
    prints = P.fingerprint(F.col("title"), F.col("summary"))
    news, counts = collect_news(rows, now(), *editions.ON_TOPIC, "run", editions.TOPICS, prints, target=target, **editions.HOW)
    merged = dedup.merge_by_url(rows, scope=("run",))
    kept = retain(merged, now(), *editions.ON_TOPIC).where("drop_reason = ''")
    scored = [r.asDict(True) for r in score(kept, now(), with_risk=True, scope="run", **editions.HOW).withColumn("print", prints).collect()]
    got = defaultdict(list)
    for r in sorted(news.collect(), key=lambda r: (r["run"], r["place"])):
        got[r["run"]].append((r["id"], r["source"], r["from_reserve"], r["merged_count"]))
    totals = {r["run"]: r for r in counts.collect()}
    for run in range(3):
        mine = [r for r in scored if r["run"] == run]
        when = lambda r: r["published_at"].timestamp() if r["published_at"] else -1e18
        mine.sort(key=lambda r: (-r["score"], -when(r), r["pos"], r["id"]))
        led = walk_topics(mine, editions.TOPICS)
        chosen = walk_balance(led, target)
        sure = {"high": 3, "medium": 2, "low": 1}
        first = [r | r["print"] | {"keeper": (int(r["source_type"] == "rss"), r["cross_source_count"], sure[r["confidence"]], 0, r["score"])} for r in chosen[:target]]
        told = walk_dedup(first)
        slots = sorted((t[0], i) for i, t in told.items() if t[1])
        by_id = {r["id"]: r for r in chosen}
        final = [(i, by_id[i]["source"], False, len(told[i][4])) for _, i in slots]
        taken = {by_id[i]["url"] for i, *_ in final}
        for r in chosen[target:]:
            if len(final) < target and r["url"] not in taken:
                final.append((r["id"], r["source"], True, 0))
                taken.add(r["url"])
        assert got[run] == final
        assert totals[run]["filtered_total"] == len(mine) and totals[run]["topic_cluster_removed"] == len(mine) - len(led)
        assert totals[run]["final_editorial_dedup_removed"] == sum(1 for t in told.values() if t[2]) and totals[run]["returned_candidate_count"] == len(final)
