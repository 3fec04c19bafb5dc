"""Operator 5, URL filters, in DataFrame functions alone.

Rules of host and path prefix decide what they fit, the longest first. The rest is judged by a path-template tree. A
template is a host and the segments of a path; a segment that looks variable by itself (a number, a date, a long
hexadecimal or mixed identifier) is a wildcard from the start. Going down the tree, the children of a node are merged
into one wildcard if there are many and they are alike: more than `branches` of them, or fewer rows per child than
`least_rows`, and no child whose labelled share, smoothed, differs from the node's by more than `apart` with its
sampling error. The tree is walked as deep as paths of one template differ.

The rows that rules decide are the labels. The share of a template is that of blocked rows among its labelled ones,
smoothed by `prior` rows of its parent's share; an only child has its parent's rows and so its share. A template is
rejected if that share exceeds `purity` and its labelled rows outweigh the `prior` ones; its unlabelled rows, however
many, weigh nothing. A template with fewer labels, or none, of its own is allowed, also below a rejected parent, unless
it was merged with its siblings, whose labels it then shares.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is allowed; ties between rules
cannot occur, as rules are distinct and of the fitting ones the longest wins; equal urls get equal verdicts; an empty
table gives no rows. A step of the walk is a few jobs; segments that all urls of a template share cost none, so urls of
any length are a few steps, and only urls that are prefixes of each other, one by one, cost as many as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, new_path, remove, written

WILD = "*"


def host_of(url: Column) -> Column:
    found = ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    return found


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule is `host/prefix`; rules are few and fixed by the caller."""
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=len):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def _variable(segment: Column) -> Column:
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{2,5}$", "")
    return stem.rlike(r"^[0-9]+([-_.][0-9]+)*$") | stem.rlike(r"^[0-9a-fA-F-]{8,}$") | (stem.rlike(r"[0-9]") & (F.length(stem) >= 12))


def shape_of(path: Column) -> Column:
    """The path without its first slash, variable segments as wildcards."""
    parts = F.split(F.regexp_replace(path, r"(?s)^/", ""), "/")
    return F.array_join(F.transform(parts, lambda part: F.when(_variable(part), F.lit(WILD)).otherwise(part)), "/")


def templates(labelled: DataFrame, prior: float = 4.0, branches: int = 20, least_rows: int = 5, apart: float = 0.2) -> DataFrame:
    """From host, shape and blocked (1, 0 or null: unlabelled) to a row per distinct host, shape: t (its template), labels (the template's labelled rows) and share.

    Each step first passes over the segments that all shapes of a template share, however many, then divides it by the
    next one: an aggregation by (host, template so far), which combines on the map side, and joins of distinct branches,
    never of rows. A shape leaves the walk when no other of its template differs from it further down. So there are as
    many steps as a shape has forks, not segments. The tables of the walk are one folder, removed at the end.
    """
    spark = labelled.sparkSession
    base = new_path(spark, "url-tree")
    stats = labelled.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("blocked").alias("known"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    smoothed = lambda bad, known, to, by: (F.col(bad) + by * to) / (F.col(known) + by)
    stats, stats_path = written(stats, "url-shapes")
    hosts = stats.groupBy("host").agg(F.sum("known").alias("labels"), F.sum("bad").alias("b"), (F.count("*") > 1).alias("open"))
    tree = stats.join(hosts.select("host", "labels", smoothed("b", "labels", F.lit(0.5), prior).alias("share"), "open"), "host").withColumns({"t": F.lit(""), "depth": F.lit(0)})
    step, schema, kind_path = 0, tree.schema, base
    while True:
        tree.write.parquet(f"{base}/step={step}")
        if step:
            remove(spark, kind_path)
        tree = spark.read.schema(schema).parquet(f"{base}/step={step}")
        walked = tree.where("open").withColumn("segments", F.split("shape", "/"))
        if walked.isEmpty():
            break
        # The least and the greatest of a template's remaining segments share what all of them share.
        ends = walked.groupBy("host", "t").agg(*[f(F.slice("segments", F.col("depth") + 1, F.greatest(F.lit(0), F.size("segments") - F.col("depth")))).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))])
        apart_at = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
        common = F.when(apart_at > 0, apart_at - 1).otherwise(F.size("lo")).cast("int")
        walked = walked.join(ends.select("host", "t", common.alias("common")), ["host", "t"]).withColumn("next", F.col("depth") + F.col("common"))
        walked = walked.withColumn("s", F.coalesce(F.get("segments", F.col("next")), F.lit("")))
        walked = walked.withColumn("passed", F.array_join(F.transform(F.slice("segments", F.col("depth") + 1, F.col("common")), lambda x: F.concat(F.lit("/"), x)), ""))
        child = walked.groupBy("host", "t", "share", "s", "next", "passed").agg(F.sum("n").alias("cn"), F.sum("known").alias("ck"), F.sum("bad").alias("cb"), F.count("*").alias("shapes"), F.max(F.size("segments")).alias("deepest"))
        node = child.groupBy("host", "t").agg(F.count("*").alias("children"), F.sum("cn").alias("rows"))
        error = 2 * F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("ck") + 1))
        alike = F.abs(smoothed("cb", "ck", F.col("share"), 2) - F.col("share")) <= apart + error
        many = (F.col("children") > branches) | (F.col("rows") < least_rows * F.col("children"))
        merged = many & (F.col("children") > 1) & alike
        below = F.concat("t", "passed", F.lit("/"), F.when(merged, F.lit(WILD)).otherwise(F.col("s")))
        kind, kind_path = written(child.join(node, ["host", "t"]).withColumn("below", below), "url-branches")
        group = kind.groupBy("host", "t", "below").agg(
            F.sum("ck").alias("labels"), F.sum("cb").alias("b"), F.first("share").alias("above"), (F.count("*") == F.first("children")).alias("only"),
            ((F.sum("shapes") > 1) & (F.max("deepest") > F.max("next") + 1)).alias("open"),
        )
        share = F.when(F.col("only"), F.col("above")).otherwise(smoothed("b", "labels", F.col("above"), prior))
        told = kind.select("host", "t", "s", "below").join(group.select("host", "t", "below", "labels", share.alias("share"), "open"), ["host", "t", "below"])
        rows = walked.select("host", "t", "s", "shape", "n", "known", "bad", "next").join(told, ["host", "t", "s"])
        tree = rows.select("host", "shape", "n", "known", "bad", "labels", "share", "open", F.col("below").alias("t"), (F.col("next") + 1).alias("depth"))
        step += 1
    done = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base).where(~F.col("open"))
    result, _ = written(done.select("host", "shape", "t", "labels", "share"), "url-templates")
    for path in (base, stats_path):
        remove(spark, path)
    return result


def judge(pages: DataFrame, rules: dict[str, str], purity: float = 0.8, prior: float = 4.0, id_column: str = "page_id", url_column: str = "url", **how) -> DataFrame:
    """A row per row of pages: id, host, path, rule, verdict."""
    url = F.col(url_column)
    rows = pages.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    shaped = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape_of(F.col("path")).alias("shape"))
    tree = templates(shaped.select("host", "shape", (F.col("ruled") == "block").cast("int").alias("blocked")), prior, **how)
    bad = tree.where((F.col("share") > purity) & (F.col("labels") > prior)).select("host", "shape", F.lit("block").alias("template"))
    # Only urls that no rule decides ask the tree; rejected templates alone are on the other side.
    asks = shaped.where(F.col("rule").isNull() & (F.col("host") != ""))
    done = shaped.where(F.col("rule").isNotNull() | (F.col("host") == ""))
    told = asks.join(bad, ["host", "shape"], "left").select("id", "host", "path", "rule", F.coalesce("template", F.lit("allow")).alias("verdict"))
    both = done.select("id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict")).unionByName(told)
    return both.withColumnsRenamed({"id": id_column})
