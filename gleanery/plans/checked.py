"""Queries over drafts that sources give by themselves: the drafts, and what the chain of checks says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draft_checks
from ..operators.lineage import settled
from .publishing import headlines
from .queries import query
from .tables import now


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines as sources: doc_id and `source`; every fifth one is an opinion of its publisher."""
    n = F.col("doc_id")
    opinion = n % 5 == 0
    fields = {
        "title": F.col("title"), "evidence": F.col("evidence"), "url": F.when(n % 31 == 0, "").otherwise(F.col("url")), "channel": F.col("channel"), "found_at": F.col("found_at"),
        "published_at": F.when(n % 29 != 0, now() - F.make_dt_interval(hours=(n % 40).cast("int"))), "official": F.col("official"), "publisher": F.col("publisher"), "identity": F.lit("registry"),
        "opinion": opinion, "author": F.when(opinion, F.col("publisher")).otherwise(""), "allowed": n % 10 == 0, "original": F.lit(True), "whole": F.lit(True),
    }
    return headlines(spark, sf_dir).select("doc_id", F.struct(*[c.alias(name) for name, c in fields.items()]).alias("source"))


@query()
def source_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = sourced(spark, sf_dir).select("doc_id", draft_checks.source_draft(F.col("source")).alias("d"))
    return drafts.where("d IS NOT NULL").select("doc_id", "d.title", "d.brief", F.size("d.bindings").alias("bindings"))


@query()
def checked_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's own draft through all checks, on its first or second attempt."""
    drafts = settled(sourced(spark, sf_dir).withColumn("d", draft_checks.source_draft(F.col("source")))).where("d IS NOT NULL")
    told = draft_checks.validated(F.col("d"), F.col("source"), F.col("doc_id") % 2 + 1, now())
    return settled(drafts.select("doc_id", told.alias("v"))).select("doc_id", "v.*")
