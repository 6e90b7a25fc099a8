"""Chat formatting: conversations merged into prefix trees, shared turns emitted once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import schema_of

TREE = ("tree bigint, token_ids array<int>, position_ids array<int>, loss_mask array<boolean>, "
        "nodes array<struct<start:int,end:int,parent:int,position:int,intervals:array<struct<start:int,end:int>>>>, "
        "conversations array<struct<conv_id:string,leaf:int>>")

OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>\n"
# Strings that steer some chat model; none of them appears in an escaped text.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))


def escape(text: str) -> str:
    """Double each backslash and put one behind the first character of a control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    """Like a text; a line break, which would end the header, becomes a backslash and a tab."""
    return escape(role).replace("\n", "\\\t")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "\t" else m[1], role, flags=re.DOTALL)


# ------------------------------------------------------------------ tokens


@lru_cache(maxsize=4)
def tokenizer(path: str | None):
    """(encode, decode) of a byte-level vocabulary file, or of plain UTF-8 bytes without one."""
    if path is None:
        return (lambda s: list(s.encode())), (lambda ids: bytes(ids).decode())
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    made = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(s: str) -> list[int]:
        # Very long runs of one kind of character are slow to merge, so long texts go in pieces.
        return [i for at in range(0, len(s), 2000) for i in made.encode_ordinary(s[at:at + 2000])]

    return encode, (lambda ids: made.decode_bytes(ids).decode())


# ------------------------------------------------------------------ trees


class Tree:
    """One tree in the making: its nodes are turns, written depth first."""

    def __init__(self, number: int, encode):
        self.number, self.encode = number, encode
        self.frame = lru_cache(maxsize=64)(encode)  # heads and ends of turns repeat
        self.ids: list[int] = []
        self.positions: list[int] = []
        self.loss: list[bool] = []
        self.nodes: list[dict] = []
        self.conversations: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # turn and node, from the root

    def shared(self, turns: list[tuple[str, str]]) -> int:
        """How many first turns the last conversation has in common with these."""
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n][0] == turns[n]:
            n += 1
        return n

    def full(self, turns: list[tuple[str, str]], max_tokens: int) -> bool:
        """Whether the tree holds ``max_tokens`` besides those that these turns share with it.

        Beside a longer shared path it may hold as many tokens again, so starting a new tree
        repeats at most as much as the old one added.
        """
        k = self.shared(turns)
        node = self.nodes[self.path[k - 1][1]] if k else None
        common = node["position"] + node["end"] - node["start"] if node else 0
        return len(self.ids) - common >= max(max_tokens, common)

    def add(self, conv_id: str | None, turns: list[tuple[str, str]]) -> None:
        shared = self.shared(turns)
        del self.path[shared:]
        for role, text in turns[shared:]:
            self.path.append(((role, text), self._node(role, text)))
        self.conversations.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def _node(self, role: str, text: str) -> int:
        parent = self.path[-1][1] if self.path else -1
        position = self.nodes[parent]["position"] + self.nodes[parent]["end"] - self.nodes[parent]["start"] if self.path else 0
        start = len(self.ids)
        head = f"{OPEN}{escape_role(role)}{BREAK}"
        for piece, loss in ((head, False), (escape(text), role == "assistant"), (CLOSE, False)):
            made = self.frame(piece) if piece is head or piece is CLOSE else self.encode(piece)
            self.ids += made
            self.loss += [loss] * len(made)
        end = len(self.ids)
        self.positions += range(position, position + end - start)
        above = self.nodes[parent]["intervals"] if self.path else []
        # Ancestors that lie side by side make one interval.
        if self.path:
            a, b = self.nodes[parent]["start"], self.nodes[parent]["end"]
            above = ([*above[:-1], {"start": above[-1]["start"], "end": b}] if above and above[-1]["end"] == a
                     else [*above, {"start": a, "end": b}])
        self.nodes.append({"start": start, "end": end, "parent": parent, "position": position, "intervals": above})
        return len(self.nodes) - 1

    def row(self) -> dict:
        return {"tree": self.number, "token_ids": self.ids, "position_ids": self.positions, "loss_mask": self.loss,
                "nodes": self.nodes, "conversations": self.conversations}


def whole_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text") -> DataFrame:
    """One row a conversation: its turns in order, and the path of their chained hashes.

    A path sorts like a depth-first walk: conversations that share initial turns share the
    beginning of their paths.
    """
    blank = F.lit("")
    part = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), blank).alias("role"),
                    F.coalesce(F.col(f"`{text}`").cast("string"), blank).alias("text"))
    one = rows.select(F.col(f"`{conv}`").cast("string").alias("conv_id"), part.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.lower(F.hex(F.xxhash64(t["role"], t["text"])))), ".")
    return one.withColumn("path", path)


def prefix_trees(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 vocabulary: str | None = None, max_tokens: int = 65_536) -> DataFrame:
    """Trees of the conversations: tokens, position ids, loss mask, nodes and leaves.

    A node is a turn below the turns before it. Nodes are emitted depth first, each once in
    its tree; a token's position continues that of its parent, and a node attends to
    itself and to the ``intervals`` of its ancestors. The loss mask marks the texts of the
    assistant. A conversation is its leaf and the nodes above it.

    Conversations are sorted by their path across the cluster; each task walks its range
    and keeps only the tree at hand. A tree ends with its first turn, at the end of a range,
    or when it holds ``max_tokens`` (or the length of the shared path, if that is more)
    beside the path that the next conversation shares with it. So a first turn that a third
    of all conversations share gives many trees, and one of any length is still emitted once
    for many conversations. A conversation itself stays whole.

    Turns are ordered by turn, then role, then text, nulls first; repeated turns stay. Null
    roles and texts count as empty, and the rows without a conversation id are one
    conversation. Other columns are not used. An empty table gives no tree.
    """
    ready = whole_conversations(rows, conv, turn, role, text)
    ranged = ready.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    schema = schema_of(TREE)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, _ = tokenizer(vocabulary)
        number, tree, first = TaskContext.get().partitionId() << 33, None, None
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = [(t["role"], t["text"]) for t in turns]
                if tree is not None and (pairs[0] != first or tree.full(pairs, max_tokens)):
                    yield pa.RecordBatch.from_pylist([tree.row()], schema=arrow)
                    tree = None
                if tree is None:
                    tree, first = Tree(number, encode), pairs[0]
                    number += 1
                tree.add(conv_id, pairs)
        if tree is not None:
            yield pa.RecordBatch.from_pylist([tree.row()], schema=arrow)

    return ranged.select("conv_id", "turns").mapInArrow(run, schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# ------------------------------------------------------------------ reading back

_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BREAK) + "(.*?)" + re.escape(CLOSE), re.DOTALL)


def read_tree(row: dict, decode) -> Iterator[tuple[str | None, list[tuple[str, str]], list[str], str]]:
    """Of each conversation of a tree: its id, turns, texts under the loss mask, and formatted text."""
    ids, loss, nodes = row["token_ids"], row["loss_mask"], row["nodes"]
    known: dict[int, tuple[str, str | None]] = {}

    def node(k: int) -> tuple[str, str | None]:
        if k not in known:
            a, b = nodes[k]["start"], nodes[k]["end"]
            under = [ids[i] for i in range(a, b) if loss[i]]
            known[k] = decode(ids[a:b]), (decode(under) if under else None)
        return known[k]

    for c in row["conversations"]:
        chain, k = [], c["leaf"]
        while k >= 0:
            chain.append(k)
            k = nodes[k]["parent"]
        parts = [node(k) for k in reversed(chain)]
        formatted = "".join(p[0] for p in parts)
        turns = [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]
        yield c["conv_id"], turns, [unescape(p[1]) for p in parts if p[1] is not None], formatted


def conversations_of(trees: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of every conversation, decoded from the tokens of its path in the tree."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "tree"]
    ddl = ("conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint, tree bigint")
    kinds = _arrow(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = tokenizer(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                row, out = batch.slice(i, 1).to_pylist()[0], []
                for conv_id, turns, loss, formatted in read_tree(row, decode):
                    whole, under = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(loss)
                    out.append([conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(under),
                                hashlib.sha256(under.encode()).hexdigest(), len(formatted), row["tree"]])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds.types)], names=names)

    return trees.select("tree", "token_ids", "loss_mask", "nodes", "conversations").mapInArrow(run, ddl)
