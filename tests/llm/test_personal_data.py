import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm import personal_data as pd
from flowlens.llm import queries


def base_by_hand(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        twice = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        if 13 <= len(d) <= 19 and sum(twice) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a.b", "@", "x-y", ".", "_", "%", "é", " ", "-", "1.2.3.4", "300", ".5", "0007", "4111 1111 1111 1111",
                                 "4111-1111", "+1 (973) 555-8270", "+", "(", "12345678901234567890", "\n"]), max_size=12).map("".join))
def test_base_spans_are_the_definition(text):
    assert sorted(pd.base_spans(text)) == base_by_hand(text)


def exact_marginals(field, t):
    """Sum over all labellings; skip groups have a hub of their own."""
    n, width = len(t.spans), len(pd.LABELS)
    u, groups = field.unary(t), pd.skip_groups(t)
    joined = [i for i in range(n - 1) if t.index[i + 1] == t.index[i] + 1]
    total = np.zeros((n, width))
    for y in itertools.product(range(width), repeat=n):
        if any(t.label[i] >= 0 and y[i] != t.label[i] for i in range(n)):
            continue
        s = sum(u[i, y[i]] for i in range(n)) + sum(field.chain[y[i], y[i + 1]] for i in joined)
        w = np.exp(s)
        for g in groups:
            w *= sum(np.exp(sum(field.skip * (y[i] == h) for i in g)) for h in range(width))
        for i in range(n):
            total[i, y[i]] += w
    return total / total.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(3)
    text = "call 5558270 x 123 456 y 5558270 z"
    t = pd.tokens_of(text, [])
    field = pd.Field({s: i for i, s in enumerate(sorted(set(t.shapes)))}, rng.normal(size=(len(set(t.shapes)) + 1, 5)),
                     rng.normal(size=(4, 5)), rng.normal(size=(5, 5)), 1.5)
    assert len(t.spans) == 4 and len(pd.skip_groups(t)) == 2
    # Two keys join the same pair, which is a loop; one of them leaves a tree.
    t.keys = [k[:1] for k in t.keys]
    assert field.marginals(t, rounds=60) == pytest.approx(exact_marginals(field, t), abs=1e-4)


def trained():
    texts = [f"word {'x' * (i % 5)} mail joe{i}@mail{i % 7}.example.com or +1 (9{i % 10}3) 555-8{i:03d} and {i} items" for i in range(200)]
    return pd.fit(texts)


def test_skip_links_make_repeated_tokens_agree():
    field = trained()
    text = "call +1 (973) 555-8270 now. Later 973-555-8270 again, but 555-1234-99 is a part number."
    spans = [(s["kind"], text[s["start"]:s["end"]], s["base"]) for s in pd.scan(text, field)]
    assert ("phone", "+1 (973) 555-8270", True) in spans and ("phone", "973-555-8270", False) in spans
    assert not any(t == "555-1234-99" for _, t, _ in spans)
    clean = "in 1999 there were 25 houses, 3.14 of them 2nd-hand, built for 12,000 each"
    assert pd.scan(clean, field) == []


def test_added_spans_leave_base_spans_alone():
    field = trained()
    text = "a joe1@mail1.example.com 4111111111111111 10.0.0.1 +1 (973) 555-8270 joe1@mail1 4111111111111111x"
    got = pd.scan(text, field)
    base = [(pd.KINDS.index(s["kind"]), s["start"], s["end"]) for s in got if s["base"]]
    assert sorted(base) == base_by_hand(text)
    assert all(s["end"] <= a or s["start"] >= b for s in got if not s["base"] for _, a, b in base)


def test_edge_rows(spark, docs_of):
    field = pd.fit([])
    long = "word " * 100_000 + "a@b.cd" + " 12" * 20_000
    df = docs_of([(1, None), (2, ""), (3, long), (4, "x@y.zz"), (4, "x@y.zz")]).withColumn("PERSONAL", F.lit("clash"))
    rows = pd.find_personal_data(df, field).orderBy("doc_id").collect()
    assert [len([s for s in r["personal"] if s["base"]]) for r in rows] == [0, 0, 1, 1, 1]
    assert pd.find_personal_data(df.limit(0), field).count() == 0
    assert pd.train(df.limit(0)).shapes == {}


def test_query_against_the_definition(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_by_hand(texts[r["doc_id"]])
        listing = ",".join(f"{pd.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in pd.KINDS] == [sum(x == i for x, _, _ in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listing.encode()).hexdigest()
        assert set(listing.split(",")) <= set(r["spans"].split(",")) or not spans


def test_shapes_read_whole_tokens():
    assert pd.shape("a" * 250) == "a" and pd.shape("a" * 250 + "7@b") == "ad1@a"
    assert pd.shape("1" * 100_000) == "d20" and pd.shape("a1" * 50) == "long"
