import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import language, queries
from flowlens.llm.common import fold_of


def grams_by_hand(text, letters):
    """Distinct n-grams after case folding; rare letters are alike, and so are runs of other characters."""
    codes = []
    for c in text.lower():
        code = letters.index(c) + 2 if c in letters else int(c.isalpha())
        if not (code == 0 and codes and codes[-1] == 0):
            codes.append(code)
    grams = {tuple(codes[i:i + n]) for n in (1, 2, 3) for i in range(len(codes) - n + 1)}
    return {g for g in grams if any(g)}


def corpus(n, seed=1):
    r = random.Random(seed)
    words = {"en": "the of and thing with from that".split(), "de": "der die und nicht mit ein über".split()}
    return [(" ".join(r.choice(words[lang]) for _ in range(30)), lang) for _ in range(n) for lang in words]


def test_presence_is_the_set_of_ngrams():
    a = language.Alphabet("abcé")
    for text in ["", "a", "Abc abÉ, zz99", "  ..", "a" * 500, "日本a"]:
        got = a.present(text)
        assert len(got) == len(grams_by_hand(text, "abcé")) and (np.diff(got) > 0).all()


def test_kernel_is_the_normalised_overlap():
    model = language.fit(corpus(20), per_language=3)
    letters = model.alphabet.letters
    marks = [grams_by_hand(t, letters) for t, _ in corpus(20)[:6]]
    for text in ["the und Über 12 qq", corpus(2, 9)[0][0]]:
        mine = grams_by_hand(text, letters)
        want = [len(mine & m) / math.sqrt(len(mine) * len(m)) for m in marks]
        assert model.kernel([text])[0] == pytest.approx(want, abs=1e-5)


def test_edge_texts():
    model = language.fit(corpus(20))
    names, scores = model.predict([None, "", "123 !!", "THE OF AND THAT", "der die und", "x" * 300_000])
    assert names[:5] == ["und", "und", "und", "en", "de"] and scores[:3] == [0.0] * 3
    assert all(0 <= s <= 1 for s in scores)
    assert language.fit([]).predict(["hello"]) == (["und"], [0.0])
    assert language.fit([("hello you", "en")]).predict(["anything"])[0] == ["en"]


def test_edge_rows(spark, docs_of):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(30))]
    df = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = language.train(df)
    more = docs_of([(1, None), (1, None), (2, "%"), (None, "the of and")]).withColumn("Score", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in language.identify(more, model).collect())
    assert got == [("1", "und"), ("1", "und"), ("2", "und"), ("None", "en")]
    assert [r["doc_id"] for r in language.keep_identified(more, model).collect()] == [None]
    assert language.keep_identified(more, model).columns == more.columns
    assert language.identify(df.limit(0), model).count() == 0
    assert language.train(df.limit(0)).languages == [] and language.train(df.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_query_learns_outside_the_fold_only(spark, folder):
    rows = queries.QUERIES["op2_language_kernel"](spark, folder).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r["held_out"] == (fold_of(r["doc_id"], 5) == 0) for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97
