import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm import quality_rules as qr
from flowlens.llm import queries
from flowlens.llm.common import fold_of


def counts_by_hand(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab# \n\té ", max_size=50))
def test_counts(text):
    assert qr.statistics(text)[0] == counts_by_hand(text)


def test_trees_learn_and_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(800) > 0.6).astype(float)
    trees = qr.fit_trees(x, y, [1, 0, -1])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    grid = np.linspace(0, 1, 50)
    for row in rng.random((20, 3)):
        for j, sign in ((0, 1), (2, -1)):
            line = np.tile(row, (50, 1))
            line[:, j] = grid
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()


def test_flat_arrays_score_like_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.random((300, 4)), rng.integers(0, 2, 300).astype(float)
    t = qr.fit_trees(x, y, [0, 0, 0, 0], n_trees=7)
    for row, p in zip(x[:40], t.score(x[:40])):
        total = t.base
        for k in range(7):
            node = 0
            while t.left[k, node] != node:
                node = t.left[k, node] if row[t.feature[k, node]] <= t.threshold[k, node] else t.right[k, node]
            total += t.value[k, node]
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-9


def test_edge_rows(spark, docs_of):
    trees = qr.fit_trees(np.zeros((0, len(qr.FEATURES))), np.zeros(0), [0] * len(qr.FEATURES))
    df = docs_of([(1, None), (2, ""), (3, "same " * 100_000), (4, " ".join(f"w{i}" for i in range(60)))] * 2).withColumn("Kept", F.lit("x"))
    rows = qr.quality_rules(df, trees).orderBy("doc_id").collect()
    assert [r["base_failed"] for r in rows[::2]] == [True, True, True, False]
    assert [r["kept"] for r in rows[1::2]] == [False, False, False, True]
    assert qr.quality_rules(df.limit(0), trees).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, quality int")
    assert qr.train(df, labels).score(np.zeros((1, len(qr.FEATURES))))[0] == 0.5


def test_query_counts_and_held_out_accuracy(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_rules"](spark, folder).collect()}
    assert rows.keys() == texts.keys()
    for i, t in list(texts.items())[:200]:
        n = counts_by_hand(t[:4000])
        if len(t) <= 4000:
            r = rows[i]
            assert [r[c] for c in qr.COUNTS] == n
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(labels[i], rows[i]["rule_score"] >= 0.5) for i in labels if i in rows and fold_of(i, 3) == 1]
    assert np.mean([bool(a) == b for a, b in held]) > 0.93
