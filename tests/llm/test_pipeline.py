"""The corpus pipeline against the same stages written out over plain lists."""

import public_tokenizers
from pyspark.sql import functions as F

from test_operators import SMALL, brute_print, components, reference_ids


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "12 34", None, "s", 5), (10_003, "", "en", "s", 0)], docs.schema)
    all_docs = docs.unionByName(odd)
    all_docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_text = {}
    for i, text in rows.items():
        by_text[text] = max(i, by_text.get(text, -1))
    kept = {i: rows[i] for i in by_text.values()}
    prints = {i: brute_print(t) for i, t in kept.items()}
    groups = components(sorted(kept), [(a, b) for a in kept for b in kept if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    left = {i for i, root in groups.items() if i == root}
    found = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in found} == left
    for r in found:
        assert r["n"] == r["all"] == len(reference_ids(rows[r["doc_id"]])) + 1


def test_stages_keep_columns_and_clean_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert first.columns == docs.columns and first.count() == docs.count()
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = sorted({r["text"]: r for r in docs.collect() if r["text"]}.values(), key=lambda r: r["doc_id"])[:14]
    at = docs.columns.index("doc_id")
    named = lambda r, i: (*r[:at], i, *r[at + 1 :])
    rows = [named(r, None) for r in first[:4]] + [named(r, 7) for r in first[4:8]] + [tuple(r) for r in first[8:]]
    rows += rows[:2] * 3 + rows[4:6] * 3 + rows[8:10] * 3
    texts = [r["text"] for r in first]
    prints = [brute_print(x) for x in texts]
    groups = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    frame = spark.createDataFrame(rows, docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact_dedup"](spark, frame, SMALL)
    assert sorted(r["text"] for r in exact.collect()) == sorted(texts)
    near = stages["simhash_dedup"](spark, exact, SMALL)
    left = [r["text"] for r in near.collect()]
    assert sorted(groups[texts.index(x)] for x in left) == sorted(set(groups.values()))
    packed = stages["packing"](spark, near, SMALL).collect()
    assert sum(r["length"] for r in packed) == sum(len(reference_ids(x)) + 1 for x in left)


def test_stages_leave_columns_of_the_user_alone(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    own = ["score", "lang_pred", "_row", "_id", "_text", "row", "keep_id", "component_id", "kept"]
    clashing = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in own])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, SMALL)
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in own)
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, SMALL).count() > 0
