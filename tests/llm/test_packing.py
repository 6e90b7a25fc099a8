import random

from pyspark.sql import functions as F

from flowlens.llm import packing, queries


def pack_by_hand(sizes, sources, clusters, capacity, per_source):
    """Look at every bin for each item."""
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins)
                if capacity - sum(x[0] for x in b) >= size and sum(x[1] == s for x in b) < per_source
                and not (c is not None and any(x[2] == c for x in b))]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[i].append((size, s, c))
        out.append((i, len(bins[i]) - 1))
    return out


def test_best_fit_equals_a_look_at_every_bin():
    for seed in range(30):
        r = random.Random(seed)
        n = r.randint(0, 80)
        sizes = [r.randint(0, 20) for _ in range(n)]
        sources, clusters = [r.choice("aab") for _ in range(n)], [r.choice([None, 1, 1, 2, 3]) for _ in range(n)]
        args = (sizes, sources, clusters, 20, r.randint(1, 3))
        assert packing.pack_items(*args) == pack_by_hand(*args)


def check(rows, texts, capacity, per_source):
    bins = {}
    for x in rows:
        bins.setdefault(x["bin_id"], []).append(x)
    for b in bins.values():
        assert sum(x["size"] for x in b) <= capacity and sorted(x["slot"] for x in b) == list(range(len(b)))
        for s in {x["source"] for x in b}:
            assert sum(x["source"] == s for x in b) <= per_source
    pieces = {}
    for x in rows:
        pieces.setdefault(x["doc_id"], []).append((x["piece"], x["char_start"], x["char_end"], x["size"]))
    for i, t in texts.items():
        mine = sorted(pieces[i])
        assert [p[1] for p in mine] == [0, *[p[2] for p in mine[:-1]]] and mine[-1][2] == len(t or "")
        assert all(len((t or "")[a:b].split()) == n for _, a, b, n in mine)


def test_pieces_and_bins(spark, docs_of):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 70)) + "\n", r.choice(["hot", "hot", "b", None])) for i in range(300)]
    df = docs_of(rows).withColumn("bin_id", F.lit("clash"))
    got = packing.pack(df, capacity=32, shard_rows=50, with_text=True).collect()
    check(got, {i: t for i, t, _ in rows}, 32, packing.PER_SOURCE)
    texts = {i: t for i, t, _ in rows}
    assert all(x["text"] == texts[x["doc_id"]][x["char_start"]:x["char_end"]] for x in got)


def test_copies_never_share_a_bin(spark, docs_of):
    rows = [(1, "one two three", "a")] * 40 + [(i, f"w{i}", "b") for i in range(2, 30)] + [(50, None, "c"), (51, "", None), (None, "x", "d")]
    df = docs_of(rows)
    got = packing.pack(df, capacity=16, shard_rows=1000).collect()
    assert len(got) == len(rows)
    assert len({x["bin_id"] for x in got if x["doc_id"] == 1}) == 40
    assert {x["size"] for x in got if x["doc_id"] in (50, 51)} == {0}
    assert packing.pack(df.limit(0)).count() == 0


def test_query(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_best_fit_packing"](spark, folder).collect()
    check(rows, texts, packing.CAPACITY, packing.PER_SOURCE)
    words = sum(x["size"] for x in rows)
    assert words > 0.75 * packing.CAPACITY * len({x["bin_id"] for x in rows})
