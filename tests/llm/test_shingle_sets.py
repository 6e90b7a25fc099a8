import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import near_duplicates, shingle_sets


def set_by_hand(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components_by_hand(sets, least=0.8):
    """Component of each set, by comparing all pairs; empty sets are alike."""
    distinct = sorted(set(sets), key=sorted)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(distinct, 2):
        if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
            root[find(a)] = find(b)
    return [find(s) for s in sets]


def same_groups(got, want):
    pairs = set(zip(got, want))
    return len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})


def family(r, words, copies, changes):
    out = []
    for _ in range(copies):
        own = list(words)
        for _ in range(r.randint(0, changes)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_links_are_all_similar_pairs_up_to_components():
    r = random.Random(2)
    texts = [t for g in range(4) for t in family(r, [f"g{g}w{i}" for i in range(80)], 25, 4)]
    sets = list(enumerate(map(shingle_sets.shingles, texts)))
    by_hand = list(map(set_by_hand, texts))
    for own, others in ((sets, []), (sets[:40], sets[40:])):
        pairs = shingle_sets.links(own, others)
        assert all(len(by_hand[a] & by_hand[b]) >= 0.8 * len(by_hand[a] | by_hand[b]) for a, b in pairs)
        assert len(pairs) <= 2 * len(sets)
    got = near(sets, shingle_sets.links(sets, []))
    assert same_groups(got, components_by_hand(by_hand))


def near(sets, pairs):
    root = {i: i for i, _ in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i, _ in sets]


def test_parts_of_a_large_bucket_and_edge_rows(spark, docs_of):
    r = random.Random(4)
    texts = [t for g in range(3) for t in family(r, [f"g{g}w{i}" for i in range(100)], 40, 4)]
    texts += [None, "", " \n", "few words", "Few  WORDS", texts[0].upper()]
    df = docs_of(list(enumerate(texts)) + [(None, texts[5]), (200, texts[5])])
    want = components_by_hand([set_by_hand(t) for t in [*texts, texts[5], texts[5]]])
    rows = shingle_sets.near_duplicates(df).select("component_id", "row_key").collect()
    order = {r_["row_key"]: r_["component_id"] for r_ in rows}
    keys = [x["k"] for x in df.select(near_duplicates.row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()]
    assert same_groups([order[k] for k in keys], want) and len(rows) == len(keys)
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:120])], "node bigint, t string")
    bucket = spark.createDataFrame([(0, 7, i, 96) for i in range(120)], "band int, value bigint, node bigint, n bigint")
    sets = list(enumerate(map(shingle_sets.shingles, texts[:120])))
    for rows_, n in ((1_000, 1_000_000), (25, 1_000_000), (1_000, 3_000)):
        pairs = [(x.a, x.b) for x in shingle_sets.links_of(nodes, bucket, max_rows=rows_, max_shingles=n).collect()]
        assert same_groups(near(sets, pairs), want[:120])
    assert shingle_sets.near_duplicates(df.limit(0)).count() == 0


def test_stage_leaves_one_document_of_each_exact_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    want = components_by_hand([set_by_hand(r["text"]) for r in rows])
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, folder).select("doc_id").collect()}
    least = {}
    for r, w in zip(rows, want):
        least[w] = min(least.get(w, r["doc_id"]), r["doc_id"])
    assert kept == set(least.values())


def test_fingerprints_give_pairs_too(docs_of, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "nothing like it at all here")]
    seen, whole = [], shingle_sets.links_of

    def links_of(texts, bucketed, *more):
        seen.extend(bucketed.filter(F.col("band") == shingle_sets.BANDS).collect())
        return whole(texts, bucketed, *more)

    monkeypatch.setattr(shingle_sets, "links_of", links_of)
    found = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_duplicates(docs_of(rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert sorted(Counter(r["value"] for r in seen).values()) == [1, 2]
