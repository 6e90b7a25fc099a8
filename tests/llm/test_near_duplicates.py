import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm import near_duplicates as nd
from flowlens.llm import queries


def fingerprint_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in "\t\n\x0b\x0c\r":
        low = low.replace(b, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components_by_hand(words, radius=4):
    words, root = sorted(set(words)), {}
    for w in words:
        root[w] = w

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for i, a in enumerate(words):
        for b in words[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {w: find(w) for w in words}


def near_words(seed, n, groups):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(groups)]
    out = []
    for _ in range(n):
        w = r.choice(centres)
        for _ in range(r.randint(0, 6)):
            w ^= 1 << r.randrange(64)
        out.append(w)
    return sorted(set(out))


@settings(max_examples=150, deadline=None)
@given(st.text("aBcÄé \n\t ", max_size=60))
def test_fingerprint(text):
    assert nd.fingerprint(text) == fingerprint_by_hand(text)


def test_long_fingerprint():
    text = " ".join(f"w{i % 70_001}" for i in range(140_000))
    assert nd.fingerprint(text) == fingerprint_by_hand(text)


def test_tree_search_gives_all_components():
    for seed in range(20):
        words = near_words(seed, 120, 6)
        pairs = nd.shard_links(words, [])
        joined = components_by_hand(words)
        assert len(pairs) <= len(words) and all((a ^ b).bit_count() <= 4 for a, b in pairs)
        # As many links as joinings are needed, so the components are the same.
        assert len(pairs) == len(words) - len(set(joined.values()))


def test_masks_miss_no_pair():
    r = random.Random(1)
    for agree in (1, 2, 3):
        masks = nd.block_masks(4, agree)
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for i in r.sample(range(64), 4):
                b ^= 1 << i
            assert any((a ^ b) & m == 0 for m in masks)


def test_links_with_split_trees(spark):
    words = near_words(3, 400, 3)
    df = spark.createDataFrame([(nd._signed(w),) for w in words], "word bigint")
    want = components_by_hand(words)
    for max_tree in (20_000, 25):
        links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in nd.links_of(df, max_tree=max_tree).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        root = {w: w for w in words}

        def find(w):
            while root[w] != w:
                w = root[w]
            return w

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {w: find(w) for w in words} == want


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert nd.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edge_rows(spark, docs_of):
    text = " ".join(f"word{i}" for i in range(300))
    df = docs_of([(9, text), (3, text), (3, text), (None, text), (4, None), (5, ""), (6, " \n"), (None, "lone words here"), (8, "é " * 50_000)])
    df = df.withColumn("Fingerprint", F.lit(1)).withColumn("component_id", F.lit(2))
    rows = nd.near_duplicates(df).collect()
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows)
    assert got == sorted([("9", "3"), ("3", "3"), ("3", "3"), ("None", "3"), ("4", "4"), ("5", "4"), ("6", "4"), ("None", "None"), ("8", "8")])
    kept = sorted(str(r["doc_id"]) for r in nd.one_of_each(df).collect())
    assert kept == ["3", "4", "8", "None"]
    assert nd.one_of_each(df).columns == df.columns
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_a_key_are_rows_of_their_own(spark, docs_of):
    a, b, c = (" ".join(f"{w}{i}" for i in range(200)) for w in "abc")
    # Key 5 has two texts; the near copies 7 and 9 of the second one have no other representative.
    rows = [(5, a), (5, b), (7, b), (9, b), (None, c), (None, a + " x"), (5, c, "z"), (5, c, "y")]
    for order in (rows, rows[::-1]):
        kept = nd.one_of_each(docs_of(order).repartition(4)).collect()
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in kept) == [(5, a, "a"), (5, b, "a"), (5, c, "y")]
    hot = [(1, " ".join(f"t{j}w{i}" for i in range(60))) for j in range(30)]
    assert nd.one_of_each(docs_of(hot)).count() == 30


def test_query_against_all_pairs(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    words = {i: fingerprint_by_hand(t) for i, t in texts.items()}
    root = components_by_hand(words.values())
    least = {}
    for i in sorted(words):
        least.setdefault(root[words[i]], i)
    rows = queries.QUERIES["op4_simhash_bktree"](spark, folder).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{w:016x}", least[root[w]]) for i, w in words.items()}
