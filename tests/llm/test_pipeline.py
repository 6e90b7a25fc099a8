from pyspark.sql import functions as F

from test_shingle_sets import components_by_hand, set_by_hand

import corpus_pipeline
from flowlens.llm import language, mixing, secrets
from flowlens.session import materialize


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "secret_scan", "source_mix", "best_fit_packing"]
    step = corpus_pipeline.STAGES
    known = step[0][1](spark, docs, folder).cache()
    assert known.columns == docs.columns and known.count() >= 0.99 * len(before)
    kept = step[1][1](spark, known, folder).cache()
    groups = len(set(components_by_hand([set_by_hand(r["text"]) for r in known.collect()])))
    assert kept.columns == docs.columns and kept.count() == groups
    clean = step[2][1](spark, kept, folder).cache()
    assert clean.columns == docs.columns and clean.count() == groups
    assert all(not secrets.base_spans(r["text"]) and len(r["text"]) == r["n_chars"] for r in clean.collect())
    mixed = step[3][1](spark, clean, folder).cache()
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(clean).collect() if r["taken"]}
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    assert mixed.columns == docs.columns and got == want
    packed = step[4][1](spark, mixed, folder)
    words = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("size").alias("n")).collect()}
    assert words == want
    assert packed.groupBy("bin_id").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_run_equals_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = materialize(stage(spark, df, folder), name)

    def pieces(rows):
        return sorted((r["doc_id"], r["source"], r["piece"], r["size"], r["text"]) for r in rows.collect())

    packed = corpus_pipeline.run(spark, folder)
    assert pieces(packed) == pieces(df) and packed.columns == df.columns
    assert len({r["bin_id"] for r in packed.collect()}) < 0.7 * df.count()


def test_stages_with_odd_rows(spark, docs_of, folder):
    rows = [(i, f"the house of number {i} and " + " ".join(f"word{j * i}" for j in range(40)), "a") for i in range(30)]
    df = docs_of(rows + [(100, None), (101, ""), (None, rows[3][1], None), (102, "12 34")]).withColumn("extra", F.lit(1))
    clash = ["size", "Taken", "secrets", "lang_pred", "score", "_row_key", "_msource", "fingerprint", "target"]
    df = df.withColumn("lang", F.lit("en")).withColumns({c: F.lit(f"own {c}") for c in clash})
    assert language.train(df).languages == ["en"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", *clash]
    assert all(r[c] == f"own {c}" for r in df.collect() for c in clash) and df.count()
    assert {r["doc_id"] for r in df.collect()} <= set(range(30))
    empty = docs_of(rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
