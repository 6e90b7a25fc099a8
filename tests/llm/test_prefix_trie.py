import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flowlens.llm import prefix_trie, queries
from flowlens.session import materialize

ROWS = "conv_id bigint, turn bigint, role string, text string"


def turn_key(row):
    role, text = row[2] or "", row[3] or ""
    digest = hashlib.sha256(f"{len(role.encode())}:".encode() + role.encode() + text.encode()).hexdigest()
    return row[1] is not None, row[1] or 0, digest


def conversations_by_hand(rows):
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def opened_by_hand(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = [*convs.get(first, [])[:h], *own[h:]]
    return out


def trie_by_hand(convs):
    members, children, nodes = {}, {}, []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[p] for p in below)
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(path)))
        nodes.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children.get(path, [])),
                      leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_prefix_trie"](spark, folder)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert collected(got) == trie_by_hand(opened_by_hand(conversations_by_hand(rows)))


def random_rows(r, n, words, longest):
    return [(c, t, r.choice("ua"), r.choice(words)) for c in range(n) for t in range(r.randint(0, longest))]


@pytest.mark.parametrize("size, shard", [(1_024, 65_536), (4, 30), (1, 1), (3, 500)])
def test_pieces_and_shards_give_the_same_trie(spark, size, shard):
    r = random.Random(5)
    rows = random_rows(r, 60, ["x", "é"], 14) + [(c, t, "u", "hot") for c in range(100, 130) for t in range(12)]
    rows += [(200, t, "u", "x") for t in range(300)] + [(201, t, "u", "x") for t in range(299)]
    turns = materialize(prefix_trie.turns_in_order(spark.createDataFrame(rows, ROWS)), "turns")
    convs = turns.filter("at = 0").select("conv", "n")
    assert collected(prefix_trie.trie(turns, convs, size, shard)) == trie_by_hand(conversations_by_hand(rows))


def test_chains_that_hang_on_chains(spark):
    # Conversation c leaves c - 1 one turn before its end, so the tree of chains is as high as can be.
    rows, turns = [], []
    for c in range(20):
        turns = [*turns[:-1], f"{c}", f"{c}!"]
        rows += [(c, t, "u", x) for t, x in enumerate(turns)]
    df = spark.createDataFrame(rows, ROWS)
    assert collected(prefix_trie.prefix_trie(df)) == trie_by_hand(conversations_by_hand(rows))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "a", "b"), (2, None, "", ""), (None, 1, "u", "t"),
            (3, 1, "user", "long " * 50_000), (-4, 0, "user", "x"), (5, -1, "u", "x"), (2**62, 0, "u", "x")]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("own") for c in ("conv", "at", "n", "digest", "key", "bytes", "_salt")})
    assert collected(prefix_trie.prefix_trie(df)) == trie_by_hand(conversations_by_hand(rows))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    # Turnless conversations are members of the root alone.
    none = materialize(prefix_trie.turns_in_order(df.limit(0)), "none")
    got = collected(prefix_trie.trie(none, spark.createDataFrame([(7, 0), (3, 0)], "conv bigint, n bigint")))
    assert got == trie_by_hand({7: [], 3: []})


def test_openings(spark):
    r = random.Random(11)
    rows = [(c, t, "u", f"{r.randint(0, 2)}") for c in [*range(-12, 40), 71] for t in range(r.choice([1, 2, 9, 12]))]
    turns = materialize(prefix_trie.turns_in_order(spark.createDataFrame(rows, ROWS)), "turns")
    conv = F.col("conv")
    opened = prefix_trie.with_openings(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)
    assert collected(prefix_trie.trie(*opened)) == trie_by_hand(opened_by_hand(conversations_by_hand(rows)))
