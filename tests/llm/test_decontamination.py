import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontamination as de
from flowlens.llm import queries

ITEMS = "item_id bigint, text string"


def words_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows_by_hand(items):
    out = {}
    for name, text in items:
        words = words_by_hand(text)
        size = min(10, len(words))
        for j in range(len(words) - size + 1) if size else ():
            out.setdefault(tuple(words[j:j + size]), set()).add("" if name is None else str(name))
    return out


def row_by_hand(text, windows):
    words, hit, items = words_by_hand(text), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if (w := tuple(words[i:i + size])) in windows:
                hit.update(range(i, i + size))
                items |= windows[w]
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def found(df, items, **bounds):
    out = de.contamination(df, items, **bounds)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "text", "n_words", hit.alias("n"), F.size("items"), F.sha2(F.array_join("items", ","), 256), F.size("spans") > 0)


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    windows = windows_by_hand([tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_suffix_decontamination"](spark, folder).collect()}
    want = {r["doc_id"]: row_by_hand(r["text"], windows) for r in docs}
    assert got == want and 0 < sum(w[-1] for w in want.values()) < len(want) / 2


def random_texts(r, n, vocabulary, low, high):
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"shard_words": 40}, {"block_words": 60}, {"shard_words": 200, "block_words": 30}])
def test_small_vocabulary_and_short_items(spark, docs_of, bounds):
    r = random.Random(7)
    texts = random_texts(r, 60, ["a", "b", "C", "é"], 0, 60) + ["ha " * 300, None, "", "... --", "b", "A,b;C é"]
    items = [(i, t) for i, t in enumerate(random_texts(r, 12, ["a", "B", "c", "é"], 8, 25))]
    items += [(20, "ha " * 30), (21, None), (22, " .. "), (23, "x y z"), (None, texts[3]), (0, texts[5]), (0, texts[5]), (24, "ha " * 10)]
    df, bench = docs_of(list(enumerate(texts)) + [(5, texts[5]), (None, texts[7])]), spark.createDataFrame(items, ITEMS)
    windows = windows_by_hand(items)
    want = sorted((str((k, t, *row_by_hand(t, windows))) for k, t in [*enumerate(texts), (5, texts[5]), (None, texts[7])]))
    assert sorted(str(tuple(x)) for x in found(df, bench, **bounds).collect()) == want


def test_suffix_arrays_are_sorted(spark):
    r = np.random.RandomState(1)
    for least, depth, words in ((1, 64, 4), (3, 8, 3), (10, 16, 2)):
        seq = r.randint(0, words, 400).astype(np.int32)
        runs = ["".join(map(chr, 97 + seq[i:])).split("a")[0] for i in range(len(seq))]
        got = de.suffix_array(np.append(seq, [0, 0]).astype(np.int32), least, depth)
        wide = 1 << (depth - 1).bit_length()
        assert sorted(got.tolist()) == [i for i, s in enumerate(runs) if len(s) >= least]
        shown = [runs[i][:wide] for i in got]
        assert shown == sorted(shown)


def test_longest_matches_equal_brute_force(spark, docs_of):
    r = random.Random(9)
    texts = random_texts(r, 25, list("abcdef"), 0, 80) + [None]
    items = [(i, t) for i, t in enumerate(random_texts(r, 6, list("abcdefg"), 1, 40))]
    texts[4] += " " + items[2][1]
    got = {(x["item"], x["item_word"]): x for x in de.longest_matches(
        docs_of(list(enumerate(texts))), spark.createDataFrame(items, ITEMS), shard_words=300, block_words=50).collect()}
    for name, text in items:
        words = text.split()
        for j in range(len(words)):
            best = 0
            for t in texts:
                own = (t or "").split()
                for p in range(len(own)):
                    n = 0
                    while p + n < len(own) and j + n < len(words) and own[p + n] == words[j + n]:
                        n += 1
                    best = max(best, n)
            row = got.get((str(name), j))
            assert (row["length"] if row else 0) == best
            if row:
                assert texts[row["key"]].split()[row["doc_word"]:row["doc_word"] + best] == words[j:j + best]
    assert got[("2", 0)]["length"] == len(items[2][1].split())


def test_affected_documents_go(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, f"before {passage.upper()}, after"), (2, "clean text"), (3, " ".join(passage.split()[:9])), (4, None), (2, "clean text")]
    clash = ["n_words", "spans", "items", "_body", "_row", "_text"]
    df = docs_of(rows).withColumns({c: F.lit("own") for c in clash})
    kept = de.decontaminate(df, spark.createDataFrame([(1, passage)], ITEMS))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3, 4]
    assert all(r[c] == "own" for r in kept.collect() for c in clash)
    none = spark.createDataFrame([], ITEMS)
    assert de.decontaminate(df, none).count() == 5 and de.contamination(df.limit(0), none).count() == 0
    assert de.contamination(df, none).filter("size(spans) = 0").count() == 5
    assert de.longest_matches(df, none).count() == 0
    long = docs_of([(1, "w " * 50_000 + passage + " w" * 50_000)])
    row = de.contamination(long, spark.createDataFrame([(1, passage)], ITEMS), shard_words=1_000).first()
    assert [tuple(s) for s in row["spans"]] == [(50_000, 50_012)] and row["n_words"] == 100_012
