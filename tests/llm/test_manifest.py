import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flowlens.llm import manifest, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(values):
    out = b""
    for v in values:
        raw = None if v is None else str(v).encode()
        out += b"-" if raw is None else str(len(raw)).encode() + b":" + raw
    return hashlib.sha256(out).hexdigest()


def low(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels_by_hand(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def steps_by_hand(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at - at % 16:at - at % 16 + 16]
        out.append((at % 16, run[:at % 16] + run[at % 16 + 1:]))
        at //= 16
    return out


def manifest_by_hand(docs):
    """Rows of op12 from (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    rows = {s: sorted(((d[0], leaf_by_hand(d), d) for d in groups[s]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            for s in order}
    trees = {s: levels_by_hand([r[1] for r in rows[s]]) for s in order}
    top = levels_by_hand([trees[s][-1][0] for s in order]) if order else []
    out = []
    for i, s in enumerate(order):
        for j, (key, leaf, d) in enumerate(rows[s]):
            steps, node = steps_by_hand(trees[s], j) + steps_by_hand(top, i), leaf
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0:
                node = leaf_by_hand([*d[:4], low(d[4])])
            for slot, others in steps:
                node = digest("".join(others[:slot]) + node + "".join(others[slot:]))
            shown = digest("".join("".join(x) for _, x in steps))
            out.append((key, leaf, trees[s][-1][0], top[-1][0], shown, node, node == top[-1][0]))
    return sorted(out, key=str)


def run(df, block):
    low_ = F.lower("text")
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                     manifest.leaf([low_ if f == "text" else F.col(f) for f in manifest.FIELDS]))
    out = manifest.proofs(manifest.manifest(df, claimed=claimed, block=block), block)
    out = out.select("key", "leaf", "subroot", "root", manifest.proof_digest(F.col("steps")),
                     manifest.fold(F.col("claimed"), F.col("steps")).alias("folded")).withColumn("ok", F.col("folded") == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select(*manifest.FIELDS).collect()]


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES["op12_merkle_manifest"](spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == manifest_by_hand(rows_of(docs))


@pytest.mark.parametrize("block", [16, 256, 4096])
def test_rounds_of_the_butterfly(spark, docs_of, block):
    r = random.Random(3)
    # Group sizes around powers of the fanout: ragged last subtrees at every level.
    rows = [(i, f"Text {r.random()}", s) for s, n in (("a", 1), ("b", 16), ("c", 17), ("d", 257), ("e", 700), ("f", 2), ("g", 33))
            for i in range(1000 * ord(s), 1000 * ord(s) + n)]
    rows += [(5 * i, f"T{i}", f"s{i:02}") for i in range(20)]
    df = docs_of(rows)
    assert run(df, block) == manifest_by_hand(rows_of(df))


def test_odd_rows(spark, docs_of):
    long = "Long TEXT " * 20_000
    rows = [(7, "A", "x"), (7, "A", "x"), (7, "B", "x"), (None, "N", "x"), (None, None, None), (3, "", None), (4, long, ""),
            (5, "Ärger É", "é"), (-9, "neg", "+"), (12, None, "x")] + [(7, "A", "hot")] * 40
    df = docs_of(rows).withColumns({c: F.lit("own") for c in ("g", "block", "leaf", "root", "at", "n", "_part", "key")})
    assert run(df, 16) == manifest_by_hand(rows_of(df))
    assert manifest.proofs(manifest.manifest(df.limit(0))).count() == 0
    assert run(docs_of([(1, "x", "a")]), 4096) == manifest_by_hand(rows_of(docs_of([(1, "x", "a")])))


def test_meetings_have_fanout_rows_at_most(spark, docs_of):
    df = docs_of([(i, str(i), "hot") for i in range(900)])
    blocks = manifest.manifest(df, block=16)
    assert blocks.count() == 57
    assert max(len(s["siblings"]) for b in blocks.collect() for s in b["upper"]) == 15
