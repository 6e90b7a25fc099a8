import hashlib
import math
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm import queries, secrets

KEY = "Zq8fK2mWx7Lp0TnVb4Rc9YdHs3Gj"


def base_by_hand(text):
    """The fixed patterns, written as the definition says: find all, then drop."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "abcdef0123456789",
                                 "ABCDEFGHIJKLMNOP", "secret", "é", "\n", "a.b-c", "K"]), max_size=14).map("".join))
def test_base_spans_are_the_definition(text):
    assert secrets.base_spans(text) == base_by_hand(text)


@settings(max_examples=100, deadline=None)
@given(st.text("ab01Z", min_size=5, max_size=40))
def test_window_entropies_equal_entropy_of_each_window(run):
    def entropy(w):
        return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))

    assert list(secrets.window_entropies(run, 5)) == pytest.approx([entropy(run[i:i + 5]) for i in range(len(run) - 4)], abs=1e-9)


def test_entropy_adds_random_strings_and_leaves_plain_ones():
    assert secrets.entropy_spans(f"see {KEY} there") == [(4, 4 + len(KEY))]
    plain = ["a" * 10_000, "the quick brown fox " * 50, "123e4567-E89b-12D3-A456-426614174000", "/usr/Local/lib2/python/Site/packages",
             "THISISAVERYLONGUPPERCASEWORD", "MyExampleKey12345678abcdEFGH", "aB1" * 30]
    assert [secrets.entropy_spans(p) for p in plain] == [[]] * len(plain)


def test_random_strings_of_fewer_kinds_are_found():
    r = random.Random(5)
    planted = {"b36": string.ascii_lowercase + string.digits, "b32": string.ascii_uppercase + "234567", "mixed": string.ascii_letters}
    keys = {n: ["".join(r.choice(alphabet) for _ in range(32)) for _ in range(500)] for n, alphabet in planted.items()}
    share = {n: sum(bool(secrets.entropy_spans(f"see {k} there")) for k in ks) / 500 for n, ks in keys.items()}
    assert all(v >= 0.99 for v in share.values()), share
    assert secrets.entropy_spans("a k3v9x0q7zt5w8n2j4m6y1r0p9s7h5g3l b") == [(2, 34)]
    assert secrets.masked("a k3v9x0q7zt5w8n2j4m6y1r0p9s7h5g3l b") == "a <ENTROPY> b"
    assert secrets.entropy_spans("qzjxkvwpyfmghbtdlcrn") == [(0, 20)]
    plain = ["keitstlichschenverpf", "schverlicheinpfauung", "internationalizations", "getUserAccountInformationFromTable", "abc123" * 30]
    assert [secrets.entropy_spans(p) for p in plain] == [[]] * len(plain)


def test_spans_of_several_runs_and_classes():
    assert secrets.entropy_spans(f"{KEY} 9081726354F536271809FACEBD {KEY}") == [(0, 28), (29, 55), (56, 84)]


def test_a_harmless_part_hides_itself_and_not_the_rest():
    for text in (f"releases/latest/{KEY}", f"2024-01-02-{KEY}", f"{KEY}/test/{KEY}", f"2024-01-02T1020Z/{KEY}", f"sample_{KEY}-2024-01-02"):
        clean = secrets.masked(text)
        assert KEY not in clean and clean.count("<ENTROPY>") == text.count(KEY), clean
    r = random.Random(3)
    run = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(3_000))
    run = run[:1_000] + "TeSt" + run[1_000:]
    assert sum(b - a for a, b in secrets.entropy_spans(run)) >= 2_950
    plain = ["2024-01-02-release-notes-Version2", "2024-01-02T102030Z", "docs/latest/test/Samples/example-Two", "2024-01-02_10-20-30-Backup",
             "123e4567-E89b-12D3-A456-42abcdef4000"]
    assert [secrets.entropy_spans(p) for p in plain] == [[]] * len(plain)


def test_entropy_inside_a_base_span_is_no_news():
    kinds = [s["kind"] for s in secrets.scan(f"token={KEY} {KEY}")]
    assert kinds == ["assign", "entropy"]


def test_edge_rows(spark, docs_of):
    long = "word " * 200_000 + "AKIA" + "Q" * 14
    df = docs_of([(1, None), (2, ""), (3, long), (4, "x"), (4, "x")]).withColumn("Secrets", F.lit("clash"))
    rows = secrets.find_secrets(df).orderBy("doc_id").collect()
    assert [len(r["secrets"]) for r in rows] == [0, 0, 1, 0, 0]
    assert rows[2]["secrets"][0]["start"] == 1_000_000 and "lang" in rows[0]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_redaction_keeps_rows_and_masks(docs_of):
    df = docs_of([(1, f"é {KEY} é token=abcdefghijkl."), (2, None), (3, "")])
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert got == {1: "é <ENTROPY> é <ASSIGN>", 2: None, 3: ""}
    assert secrets.redact(df).columns == df.columns


def test_query_against_the_definition(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_secret_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_by_hand(texts[r["doc_id"]])
        listing = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(listing.encode()).hexdigest()
        assert set(listing.split(",")) <= set(r["spans"].split(",")) or not spans


def test_keys_in_dashed_parts_are_found_and_names_are_not():
    for key in ("AbCdEf12-GhIjKl34-MnOpQr56-StUvWx78", "kQzX12_pLmN34_vBtR56_wYcD78_hJfG90"):
        assert secrets.entropy_spans(f"see {key} there"), key
    for name in ("src/main/java/HTMLParserFactory2/TestCase01", "Is-A-Very-Long-Title-Of-Chapter-12", "some_long_variable_name_2024",
                 "CONSTANT_NAMES_IN_UPPER_CASE_9", "path/to/readMeFirst/index2/fileName"):
        assert not secrets.entropy_spans(f"see {name} there"), name
