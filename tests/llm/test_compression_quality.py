import random

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import compression_quality as cq
from flowlens.llm import queries
from flowlens.llm.common import fold_of


def corpus(n, seed=1):
    r = random.Random(seed)
    good, bad = "the river runs past old stone houses".split(), "BUY!! NOW$$ CLICK## WIN%% FREE&&".split()
    return [(" ".join(r.choice(w) for _ in range(60)), y) for _ in range(n) for y, w in ((1, good), (0, bad))]


def test_scores_separate_labels():
    model = cq.fit(corpus(150))
    fresh = corpus(40, seed=2)
    scores = model.score([t for t, _ in fresh])
    assert all((s >= 0.5) == bool(y) for s, (_, y) in zip(scores, fresh))


def test_pieces_cover_long_texts():
    model = cq.fit(corpus(60))
    text = corpus(1)[0][0] + "\n"
    long = text * (3 * cq.PIECE // len(text))
    raw = long.encode()
    good, bad = model._tools()
    sizes = [sum(len(c.compress(raw[i:i + cq.PIECE])) for i in range(0, len(raw), cq.PIECE)) for c in (good, bad)]
    assert model.features(long) == [(sizes[1] - sizes[0]) / max(sizes), min(sizes) / len(raw), 1.0]


def test_edge_texts_and_labels():
    model = cq.fit(corpus(60))
    scores = model.score([None, "", "x", "é" * 10])
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    assert cq.fit([]).score(["a", None]) == [0.5, 0.5] == cq.fit([("only good", 1)]).score(["a", None])
    assert len(cq.fit(corpus(1)).score(["a"])) == 1  # too few samples for a trained dictionary


def test_edge_rows(spark, docs_of):
    rows = corpus(60)
    df = docs_of([(i, t) for i, (t, _) in enumerate(rows)] + [(None, "lost"), (900, None)]).withColumn("Predicted", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = cq.train(df, labels)
    got = cq.score(df.unionAll(df), model).collect()
    assert len(got) == 2 * len(rows) + 4 and len({(r["doc_id"], r["score"]) for r in got}) == len(rows) + 2
    assert np.mean([r["predicted"] == rows[r["doc_id"]][1] for r in got if r["doc_id"] is not None and r["doc_id"] < 900]) > 0.95
    assert cq.score(df.limit(0), model).count() == 0 and cq.train(df, labels.limit(0)).score(["a"]) == [0.5]


def test_query_held_out_accuracy(spark, folder):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_compression_quality"](spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == (fold_of(i, 3) == 1) and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [rows[i]["predicted"] == y for i, y in labels.items() if i in rows and rows[i]["held_out"]]
    assert len(held) > 50 and np.mean(held) > 0.9
