"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
dedup stages number their rows and decide by that number: of each group exactly one row stays, also where ids are null
or repeated. A null id counts as less than any other; of rows with one id any may be the one that stays. Columns of the
user's own, whatever their names, come out of each stage as they went in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import exact_dedup, language_id, packing, simhash
from gleanery.llm.common import number_or_least, read_table, release, written
from gleanery.llm.queries import PACK_END, WINDOW, WORD_VOCABULARY

#: A document whose best language has a smaller share of the evidence than this speaks none of the learned ones.
LEAST_LANGUAGE_SCORE = 0.35


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many further underscores as no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language; documents without a letter, or of none of the languages, go."""
    model = language_id.fit(docs)
    names = (unused(docs, "_lang_pred"), unused(docs, "_score"))
    lang, score = (F.col(n) for n in names)
    judged = language_id.predict(docs, model, names, keep_text=True)
    return judged.where((lang != language_id.UNKNOWN) & (score >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def _one_of_each(docs: DataFrame, name: str, groups_of, group: str, best) -> DataFrame:
    """Of the rows that `groups_of` puts in one group, the one that is `best` by (id, row number)."""
    row = unused(docs, "_row")
    rows, _ = written(docs.withColumn(row, F.monotonically_increasing_id()), name)
    release(docs.sparkSession)
    ids = rows.select(F.col(row).alias("_row"), number_or_least(F.col("doc_id")).alias("_id"))
    told = groups_of(rows.select(F.col(row).alias("_row"), "text"), "_row").select("_row", group).join(ids, "_row")
    kept = told.groupBy(group).agg(best(F.struct("_id", "_row")).alias("best")).select(F.col("best._row").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return _one_of_each(docs, "exact-rows", exact_dedup.deduplicate, "keep_id", F.max)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return _one_of_each(docs, "near-rows", simhash.near_duplicates, "component_id", F.min)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs, public_tokenizers.path(WORD_VOCABULARY), PACK_END, WINDOW)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("simhash_dedup", drop_near_copies), ("packing", pack_windows)]

#: Language ID and packing cannot be written in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = written(docs, f"pipeline-{name}")
            release(spark)
    return docs
