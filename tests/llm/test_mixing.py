import random

import pytest
import twin
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowlens.llm import mixing


def targets_by_hand(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        unit = (left - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        above = [s for s in free if unit * w[s] > 3 * sizes[s]]
        if not above:
            out.update({s: unit * w[s] for s in free}, **{s: 3.0 * sizes[s] for s in capped})
            return out
        capped.update(above)


def test_targets(spark):
    r = random.Random(4)
    for _ in range(2):
        sizes = {f"s{i}": r.choice([0, 1, 10, 1000, 50_000]) for i in range(r.randint(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
        assert got == pytest.approx(targets_by_hand(sizes))


def test_taken(spark, docs_of):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["b", "a", "a", "a", None, "c"])) for i in range(500)]
    rows += [(None, "x y z", "a"), (7, "x y", "a"), (7, "x y", "a"), (8, None, "b")]
    df = docs_of(rows).withColumn("Target", F.lit("clash"))
    got = mixing.mix(df, per_slice=20).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for x in got:
        assert 0 <= x["taken"] <= 3 * x["size"]
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        target[x["source"]] = x["target"]
    assert target == pytest.approx(targets_by_hand(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, mixing.mix(df, per_slice=20).collect())) == sorted(map(str, got))
    assert sorted(str(x) for x in mixing.mix(df).collect()) == sorted(map(str, got))  # slices change nothing


def test_rows_hold_the_words_taken(spark, docs_of):
    r = random.Random(6)
    rows = [(i, " \n".join(f"w{k}" for k in range(r.randint(0, 9))), r.choice("abc")) for i in range(200)] + [(900, None, None)]
    df = docs_of(rows)
    want = {x["doc_id"]: x["taken"] for x in mixing.mix(df).collect()}
    got, texts = {}, dict((i, t) for i, t, *_ in rows)
    for x in mixing.mixed_rows(df).collect():
        got[x["doc_id"]] = got.get(x["doc_id"], 0) + len(x["text"].split())
        assert texts[x["doc_id"]].startswith(x["text"]) and x["n_chars"] == len(x["text"])
    assert got == {i: n for i, n in want.items() if n}
    assert mixing.mixed_rows(df).columns == df.columns


def test_empty(spark, docs_of):
    df = docs_of([(1, "a", "b")]).limit(0)
    assert mixing.mix(df).count() == 0 and mixing.mixed_rows(df).count() == 0
    only = docs_of([(1, None, "b"), (2, "", None)])
    assert [(x["size"], x["target"], x["taken"]) for x in mixing.mix(only).collect()] == [(0, 0.0, 0)] * 2


def test_query_equals_twin(spark, folder):
    name = "op9_mix_sources"
    assert twin.compare(spark, twin.connect(folder), entry.queries()[name], entry.oracle_sql()[name], folder) == []
