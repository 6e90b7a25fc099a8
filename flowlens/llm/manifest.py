"""Merkle manifest of a dataset: hash trees by group, upper proofs by butterfly exchange."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import schema_of
from flowlens.llm.ordering import positions
from flowlens.session import materialize

FANOUT = 16
# Leaves of a block: whole subtrees of three levels.
BLOCK = FANOUT ** 3
STEP = "struct<slot:int,siblings:array<string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Blocks of a group that take the steps above it from one copy of them.
_CHUNK = 1_000


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of the fields: ``-`` for a null, else count of UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def subtree(leaves: list[str], total: int, block: int) -> list[list[str]]:
    """The levels of the block of these leaves, from the leaves up to its node.

    A tree of ``total`` leaves in all ends where one node is left, so a small one has fewer levels.
    """
    levels, width = [leaves], total
    while width > 1 and FANOUT ** (len(levels) - 1) < block:
        last = levels[-1]
        levels.append([_hash(last[i:i + FANOUT]) for i in range(0, len(last), FANOUT)])
        width = -(-width // FANOUT)
    return levels


def _block_rows(placed: DataFrame, block: int) -> DataFrame:
    """One row a block: its leaves in order and its node. A block has ``block`` leaves at most."""
    entry = F.struct("at", "leaf", "claimed", "key")
    blocks = placed.groupBy("g", F.expr(f"at div {block}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("leaves"))
    blocks = blocks.withColumn("hashes", F.col("leaves.leaf"))
    schema = schema_of("g binary, block bigint, n bigint, node string").add(blocks.schema["leaves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = batch.column("n").to_pylist()
            nodes = [subtree(batch.column("hashes")[i].as_py(), t, block)[-1][0] for i, t in enumerate(totals)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) if c != "node" else pa.array(nodes, pa.string()) for c in schema.names], names=schema.names)

    return blocks.mapInArrow(run, schema)


def butterfly(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``upper``, the steps from a block to the top of its group, and ``top``, the node there.

    In round r a block meets those that differ from it only in digit r (to the base FANOUT) of
    their number. Each brings the node of its own subtree, which all blocks below that node
    have worked out by themselves; each takes its siblings from the others and hashes the
    parent. After the last round every block has its whole proof, and nothing is sent down.
    A last subtree with fewer blocks stands in for those it lacks. A meeting has FANOUT rows
    at most, also in a group that holds a third of all leaves.
    """
    width = F.ceil(F.col("n") / block)
    widest = blocks.agg(F.max(width)).first()[0] or 0
    state = blocks.select("g", "block", width.alias("width"), F.col("node").alias("top"),
                          F.array().cast(f"array<{STEP}>").alias("upper"))
    span = 1
    while span < widest:
        wide = F.ceil(F.col("width") / span) > 1
        own, place = F.expr(f"block div {span}"), F.col("block") % span
        held = F.least(F.lit(span), F.col("width") - own * span)
        serves = F.when(wide, F.sequence(place, F.lit(span - 1).cast("bigint"), held)).otherwise(F.array(place))
        sent = state.withColumns({"digit": (own % FANOUT).cast("int"), "up": F.expr(f"block div {span * FANOUT}"),
                                  "place": place, "wide": wide}).withColumn("to", F.explode(serves))
        meeting = Window.partitionBy("g", "up", "to")
        heard = sent.withColumn("heard", F.sort_array(F.collect_list(F.struct("digit", "top")).over(meeting)))
        heard = heard.filter("to = place")
        others = F.transform(F.filter("heard", lambda h: h["digit"] != F.col("digit")), lambda h: h["top"])
        step = F.struct(F.col("digit").alias("slot"), others.alias("siblings"))
        parent = F.sha2(F.array_join(F.col("heard.top"), "").cast("binary"), 256)
        state = heard.select(
            "g", "block", "width", F.when(F.col("wide"), parent).otherwise(F.col("top")).alias("top"),
            F.when(F.col("wide"), F.concat("upper", F.array(step))).otherwise(F.col("upper")).alias("upper"))
        span *= FANOUT
    return state.drop("width")


def _trees(rows: DataFrame, order: Sequence[str], name: str, block: int) -> DataFrame:
    """Blocks of the trees of rows (g, key, leaf, claimed), with their upper steps and tops."""
    blocks = materialize(_block_rows(positions(rows, "g", order, name), block), f"{name}-blocks")
    upper = butterfly(blocks.select("g", "block", "n", "node"), block)
    return blocks.drop("node").join(upper, ["g", "block"])


def _expanded(blocks: DataFrame, block: int) -> DataFrame:
    """One row a leaf: g, key, at, leaf, claimed, the blocks' tops, and all steps of the leaf."""
    key = blocks.schema["leaves"].dataType.elementType["key"]
    kept = [c for c in blocks.columns if c not in ("block", "leaves", "upper", "n")]
    schema = schema_of(f"at bigint, leaf string, claimed string, steps array<{STEP}>").add(key)
    for c in kept:
        schema.add(blocks.schema[c])
    step = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                leaves = batch.column("leaves")[i].values
                upper, total = batch.column("upper")[i].as_py(), batch.column("n")[i].as_py()
                levels = subtree(leaves.field("leaf").to_pylist(), total, block)
                for first in range(0, len(leaves), 256):
                    part, made = leaves[first:first + 256], []
                    for j in range(first, first + len(part)):
                        steps = []
                        for level in levels[:-1]:
                            slot, start = j % FANOUT, j - j % FANOUT
                            run_ = level[start:start + FANOUT]
                            steps.append({"slot": slot, "siblings": run_[:slot] + run_[slot + 1:]})
                            j //= FANOUT
                        made.append(steps + upper)
                    same = pa.array([0] * len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.field("at"), part.field("leaf"), part.field("claimed"), pa.array(made, step), part.field("key"),
                         *[batch.column(c).slice(i, 1).take(same) for c in kept]], names=schema.names)

    return blocks.mapInArrow(run, schema)


def manifest(df: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS,
             claimed: Column | None = None, block: int = BLOCK) -> DataFrame:
    """The manifest of a table, one row for each block of up to ``block`` leaves, a power of FANOUT.

    Columns: ``g`` (empty for a null group, else ``+`` and its bytes), ``block``, ``n`` (leaves
    of the group), ``leaves`` (place, hash, claimed hash, key), ``upper`` (steps from the block
    to the root), ``subroot`` of the group and ``root`` of the table.

    A row's leaf is the hash of its ``fields``. Leaves of a group ascend by ``key``, nulls
    first, then by hash, so rows with one key and equal rows all have leaves of their own.
    Every FANOUT nodes make one of the next level until one is left, the subroot; subroots
    in the order of their groups, null first, make the root in the same way. ``claimed`` is
    another hash that a reader says the row has (the leaf itself without it). Nulls, empty
    and very long texts are hashed like any value, without Python. An empty table gives no
    block. Other columns are not used.
    """
    by = F.col(f"`{group}`").cast("string")
    own = leaf([F.col(f"`{f}`") for f in fields])
    rows = df.select(F.coalesce(F.concat(F.lit("+"), by), F.lit("")).cast("binary").alias("g"), F.col(f"`{key}`").alias("key"),
                     own.alias("leaf"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed")))
    blocks = materialize(_trees(rows, ["key", "leaf"], "leaves", block).withColumnRenamed("top", "subroot"), "forest")
    tops = blocks.filter("block = 0").select(F.lit(b"").alias("g"), F.col("g").alias("key"), F.col("subroot").alias("leaf"),
                                             F.lit(None).cast("string").alias("claimed"), F.col("n"))
    # A hot group has many blocks: they take its last steps from several copies.
    sizes = tops.select(F.col("key").alias("_g"), F.col("n").alias("_n"))
    groups = _expanded(_trees(tops.drop("n"), ["key"], "groups", block), block).join(sizes, F.col("key") == F.col("_g"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {block * _CHUNK}"))
    groups = groups.select(F.col("_g"), F.explode(copies).alias("_chunk"), F.col("steps").alias("_steps"), F.col("top").alias("root"))
    joined = blocks.join(groups, (F.col("g") == F.col("_g")) & (F.expr(f"block div {_CHUNK}") == F.col("_chunk")))
    return joined.select("g", "block", "n", "leaves", F.concat("upper", "_steps").alias("upper"), "subroot", "root")


def proofs(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a leaf of a manifest with such blocks: key, at, leaf, claimed, subroot, root and its ``steps``.

    A step has the place of the node in its run and the other nodes of the run.
    """
    out = _expanded(blocks, block)
    return out.select("key", "at", "leaf", F.coalesce("claimed", "leaf").alias("claimed"), "subroot", "root", "steps")


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    def parent(acc: Column, s: Column) -> Column:
        others = s["siblings"]
        left = F.array_join(F.slice(others, 1, s["slot"]), "")
        right = F.array_join(F.slice(others, s["slot"] + 1, F.size(others)), "")
        return F.sha2(F.concat(left, acc, right).cast("binary"), 256)

    return F.aggregate(steps, node, parent)


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(steps, lambda s: s["siblings"])), "").cast("binary"), 256)
