"""Generated texts against their source, and warnings of small samples."""

from datetime import datetime

from pyspark.sql import functions as F

from gleanery.functions import summaries
from gleanery.plans import analytics


def row(spark, column, **given):
    names = list(given)
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first()["v"]


def test_fact_check(spark):
    check = lambda shown, **s: tuple(row(spark, summaries.fact_check(*[F.col(c) for c in ("shown", "title", "summary", "url", "source")]), shown=shown, **({"title": None, "summary": None, "url": None, "source": None} | s)))
    assert check("发布 GPT-5 与 Aurora", title="gpt-5 is out") == (False, ["aurora"], "fallback")
    assert check("GPT 5", title="GPT-5") == (False, ["gpt 5"], "fallback")
    assert check("Claude 4.5", url="https://a.example/Claude 4.5") == (True, [], "keep")
    assert check("", title="") == (True, [], "keep") and check("Novak wins") == (True, [], "keep")


def test_activity_is_no_launch(spark):
    names = ("shown", "summary", "title", "own", "kind", "activity")
    guard = lambda *v: tuple(row(spark, summaries.guarded(*[F.col(c) for c in names]), **dict(zip(names, v, strict=True))))
    assert guard("大发布", "s", "a/b: tool", "own &amp;amp; text", "github", "recent_push") == ("GitHub 项目近期活跃：a/b", "own & text")
    assert guard("大发布", "s", ": x", None, "github", "new_repository") == ("GitHub 新开源项目：开源项目", "s")
    assert guard("t", "s", "x", "y", "github", "github_release") == guard("t", "s", "x", "y", "rss", "recent_push") == guard("t", "s", "x", "y", None, None) == ("t", "s")


def test_packet(spark):
    names = ("title", "source", "kind", "summary", "about", "notes", "tag")
    made = lambda *v: row(spark, summaries.packet(F.lit(2), *[F.col(c) for c in names]), **dict(zip(names, v, strict=True)))
    assert made("T", "S", "github", None, "about", "notes", None) == "2. 原始标题: T\n来源: S\n来源类型: github\n原始摘要: （未提供）\nGitHub 项目用途: about\nGitHub 本次 Release （版本未提供）: notes"
    assert made("T", None, "rss", "x", "about", "notes", "v1") == "2. 原始标题: T\n来源类型: rss\n原始摘要: x"


def test_sample_warnings(spark):
    runs = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 1, 2)], "generated_at timestamp")
    feedback = spark.range(25)
    found = lambda r, f: [x["warning"] for x in analytics.sample_warnings(r, f).orderBy("pos").collect()]
    assert found(runs, feedback) == [analytics.FEW_DAYS]
    assert found(runs.limit(0), feedback.limit(0)) == [analytics.NO_RUNS, analytics.NO_FEEDBACK, analytics.FEW_DAYS, analytics.FEW_LABELS]
    assert found(runs.union(spark.createDataFrame([(datetime(2024, 1, 3),)], "generated_at timestamp")), feedback) == []
