import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import chat, queries

ROWS = "conv_id bigint, turn bigint, role string, text string"
PIECES = ["\\", "<", "|", "<|turn|>", "<|end|>\n", "[INST]", "</s>", "\n", "\t", "é", "a", "[", "/"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=10).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS) and "\n" not in chat.escape_role(text)


def conversations(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, ["user", "assistant", "system"][t % 3], "hello there" if t < 3 and r.random() < 0.7 else f"text {r.random()}"))
    return rows


def digests(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = [(t if t is not None else -1, role or "", text or "") for k, t, role, text in rows if k == c]
        turns = [x[1:] for x in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(trees, vocabulary=None):
    return {None if r["conv_id"] is None else int(r["conv_id"]): tuple(r)[1:5] for r in chat.conversations_of(trees, vocabulary).collect()}


def test_round_trip_with_bytes_and_vocabulary(spark):
    rows = conversations() + [(900, 0, "user", "</s>[INST] ok [/INST]"), (900, 1, "assistant", "<|end|>\n\\"), (901, 5, None, None),
                              (None, 1, "assistant", "lone"), (902, 0, "a\nb", "x"), (903, 0, "user", "long " * 50_000),
                              (904, 0, "user", "twice"), (904, 0, "user", "twice"), (905, None, "user", "no turn")]
    df = spark.createDataFrame(rows, ROWS)
    for vocabulary in (None, queries.VOCABULARY):
        trees = chat.prefix_trees(df.selectExpr("*", "1 AS tree", "2 AS path"), vocabulary=vocabulary)
        assert read(trees, vocabulary) == digests(rows)


def test_shared_turns_are_emitted_once_with_positions_and_intervals(spark):
    rows = conversations(seed=2)
    trees = [r.asDict(recursive=True) for r in chat.prefix_trees(spark.createDataFrame(rows, ROWS).coalesce(1)).collect()]
    texts = {}
    for c, t, role, text in sorted(rows):
        texts.setdefault(c, []).append((role, text))
    for tree in trees:
        nodes, seen = tree["nodes"], set()
        for k, n in enumerate(nodes):
            chain, p = [], n["parent"]
            while p >= 0:
                chain.append(p)
                p = nodes[p]["parent"]
            inside = {i for a in n["intervals"] for i in range(a["start"], a["end"])}
            assert inside == {i for p in chain for i in range(nodes[p]["start"], nodes[p]["end"])}
            length = sum(nodes[p]["end"] - nodes[p]["start"] for p in chain)
            assert tree["position_ids"][n["start"]:n["end"]] == list(range(length, length + n["end"] - n["start"]))
            assert n["parent"] < k
            seen.add((n["parent"], bytes(tree["token_ids"][n["start"]:n["end"]])))
        assert len(seen) == len(nodes)  # no turn stands twice below the same one
        assert len(tree["token_ids"]) == len(tree["position_ids"]) == len(tree["loss_mask"]) == nodes[-1]["end"]
    # All conversations with one first turn are in one tree when it has room.
    first = {}
    for tree in trees:
        for c in tree["conversations"]:
            first.setdefault(texts[int(c["conv_id"])][0], set()).add(tree["tree"])
    nodes = sum(len(t["nodes"]) for t in trees)
    prefixes = len({tuple(x[:i + 1]) for x in texts.values() for i in range(len(x))})
    assert nodes >= prefixes and nodes <= prefixes + 6 * len(trees)


def test_a_hot_first_turn_is_cut_into_trees(spark):
    rows = [(c, t, "user", "same" if t == 0 else f"{c}") for c in range(300) for t in range(2)]
    trees = chat.prefix_trees(spark.createDataFrame(rows, ROWS), max_tokens=500).collect()
    assert len(trees) > 5 and max(len(t["token_ids"]) for t in trees) < 600
    assert read(chat.prefix_trees(spark.createDataFrame(rows, ROWS), max_tokens=500)) == digests(rows)


def test_a_long_first_turn_is_emitted_once_in_a_task(spark):
    long = "x" * 80_000
    rows = [(c, t, "user", long if t == 0 else f"{c}") for c in range(40) for t in range(2)]
    trees = chat.prefix_trees(spark.createDataFrame(rows, ROWS).coalesce(1)).collect()
    assert sum(len(t["token_ids"]) > 80_000 for t in trees) == len(trees) <= 8  # one for each range of paths at most
    assert sum(len(t["conversations"]) for t in trees) == 40
    assert read(chat.prefix_trees(spark.createDataFrame(rows, ROWS))) == digests(rows)
    # A longer conversation beside the shared path closes the tree again.
    few = chat.prefix_trees(spark.createDataFrame(rows, ROWS), max_tokens=100).collect()
    assert len(few) <= 8


def test_empty(spark):
    assert chat.conversations_of(chat.prefix_trees(spark.createDataFrame([], ROWS))).count() == 0


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.PROBE[1]), (-7, 1, "assistant", queries.PROBE[1])]
    got = queries.QUERIES["op7_chat_tree"](spark, folder).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == digests(rows) and len(got) == len({r[0] for r in rows})
    chars = {}
    for c, _, role, text in rows:
        n = len(chat.OPEN + chat.escape_role(role) + chat.BREAK + chat.escape(text) + chat.CLOSE)
        chars[c] = chars.get(c, 0) + n
    assert {r["conv_id"]: r["formatted_chars"] for r in got} == chars
