import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import queries
from flowlens.llm import vector_search as vs

ROWS = "vec_id bigint, embedding array<float>"


def exact(rows, k=5, every=50):
    """All pairs, on the original numbers in double precision."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    length = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(axis=1) / (length * length[q])
        others = [i for i in range(len(ids)) if i != q]
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in sorted(others, key=lambda i: (-round(score[i], 12), ids[i]))[:k]]
    return out


def found(df, **options):
    out = {}
    for r in vs.nearest(df, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(1)
    index = vs.fit(rng.normal(size=(3000, 16)), 32)
    hits = 0
    for q in vs._unit(rng.normal(size=(50, 16))):
        lists, _ = index.search(q, 40)
        hits += len(set(lists[:10]) & set(np.argsort(-(index.centres @ q))[:10]))
    assert hits > 0.97 * 500


def test_lists_are_balanced_and_boundaries_are_copied():
    rng = np.random.default_rng(2)
    x = vs._unit(rng.normal(size=(4000, 8)))
    index = vs.fit(x, 64)
    rows, lists = index.lists_of_rows(x, 1.08, 4)
    assert set(rows) == set(range(4000)) and 4000 < len(rows) <= 16_000
    assert np.bincount(lists).max() < 8 * 64 and len({*zip(rows, lists)}) == len(rows)


def test_shards_and_blocks_change_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(600)]
    df = spark.createDataFrame(rows, ROWS)
    one = found(df, list_rows=16)
    assert found(df, list_rows=16, shard_rows=40, block=3) == one
    assert recall(one, exact(rows)) >= 0.9


def test_vectors_are_copied_by_what_is_asked_of_their_shard(spark):
    vectors = spark.range(1_000).selectExpr("id as uid", "id % 10 as shard")
    hot = spark.range(900).selectExpr("id as uid", "0L as shard")
    queries_ = hot.unionByName(spark.range(900, 940).selectExpr("id as uid", "1 + id % 4 as shard"))
    for block, copies in ((10_000, 1), (45, 20)):
        sent, copied = vs.in_blocks(queries_, vectors, block)
        assert sent.count() == 940
        got = {r["shard"]: r["count"] for r in copied.groupBy("shard").count().collect()}
        assert got == {0: 100 * copies, **{s: 100 for s in range(1, 5)}}
        meets = sent.select("shard", "block").distinct().join(copied.select("shard", "block").distinct(), ["shard", "block"])
        assert meets.count() == copies + 4


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(1, 120)]
    same = [1.0, 2.0, 3.0, 4.0]
    rows += [(i, same) for i in range(1000, 1700)] + [(50, same), (150, same)]
    bad = [(200, None), (250, [0.0] * 4), (300, [1.0, None, 1.0, 1.0]), (350, [1.0, float("nan"), 1.0, 1.0]),
           (400, [1.0, float("inf"), 0.0, 0.0]), (450, [1.0, 2.0]), (None, same)]
    df = spark.createDataFrame(rows + bad, ROWS).withColumn("rank", F.lit("clash")).withColumn("v", F.lit(1))
    got = found(df, shard_rows=100)
    # 50 stands twice: each of its rows finds the other one.
    assert set(got) == {50, 100, 150, 1000, 1050, 1100, 1150, 1200, 1250, 1300, 1350, 1400, 1450, 1500, 1550, 1600, 1650}
    assert [i for i, _ in got[1000]] == [50, 150, 1001, 1002, 1003] and [i for i, _ in got[150]] == [50, 1000, 1001, 1002, 1003]
    assert all(s == got[1000][0][1] for _, s in got[1000]) and got[1000][0][1] == pytest.approx(1.0)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 0.0])], ROWS)
    rows = sorted(tuple(r) for r in vs.nearest(df).collect())
    assert rows == [(0, 1, 0, 1.0), (0, 1, 0, 1.0), (0, 2, 1, 0.0), (0, 2, 1, 0.0)]
    assert vs.nearest(df.limit(0)).count() == 0 and vs.nearest(df.filter("vec_id = 1")).count() == 0


def test_query_recall(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {}
    for r in queries.QUERIES["op10_posting_lists"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    scores = {q: dict(v) for q, v in exact(rows, k=500).items()}
    assert all(s == pytest.approx(scores[q][i], abs=1e-12) for q, v in got.items() for i, s in v)
