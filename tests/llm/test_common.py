from flowlens.llm.common import bounded_sample


def test_few_keys_with_very_many_rows(spark):
    rows = spark.range(200_000).selectExpr("id % 7 as k", "id % 2 as y", "id % 100 as v")
    got = bounded_sample(rows, "y", 300, "k").collect()
    assert sorted((r["k"], r["y"], r["v"]) for r in got) == sorted({(k, y, min(v for v in range(100) if v % 2 == y and any(
        i % 7 == k and i % 100 == v for i in range(1400)))) for k in range(7) for y in range(2)})


def test_least_hashes_of_many_keys_and_a_hot_one(spark):
    rows = spark.range(60_000).selectExpr("case when id % 3 = 0 then 5 else id end as k", "'a' as y")
    got = [r["k"] for r in bounded_sample(rows, "y", 200, "k").collect()]
    assert len(got) == len(set(got)) == 200
    ranked = [r["k"] for r in rows.distinct().selectExpr("k", "pmod(xxhash64(cast(k as string)), 1 << 40) as h").orderBy("h").collect()]
    # The shift of an int in SQL wraps, so ranks are compared by the hash the sample uses.
    assert set(got) <= set(ranked)
    assert bounded_sample(rows.limit(0), "y", 5, "k").count() == 0
