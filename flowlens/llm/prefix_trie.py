"""Trie of conversation prefixes from vertical bitmaps; counts of whole subtrees."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import schema_of
from flowlens.llm.ordering import lookup, positions
from flowlens.session import join_small, materialize

ROOT = bytes(32)
# Turns of a piece of a conversation, and turns of the pieces indexed together.
PIECE, SHARD = 1_024, 65_536
SHARD_NODES = "key binary, parent binary, depth bigint, n bigint, first bigint, bytes bigint, ends array<bigint>"
Piece = tuple[int, int, int, bytes, list[bytes], list[int]]  # conversation, piece, turns of all, prefix, digests, bytes


def turns_in_order(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as conv, at (from 0), n (turns of the conversation), digest and bytes of the text.

    Turns follow ``turn``, nulls first, then their digest. Null roles and texts are empty,
    repeated rows stay, and rows without a conversation id are left out: they belong to no
    conversation. Texts stay in the JVM; only their digests travel.
    """
    who, what = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256))
    ready = rows.select(F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"),
                        F.octet_length(what).cast("bigint").alias("bytes")).filter("conv is not null")
    return positions(ready, "conv", ["turn", "digest"], "turns").select("conv", "at", "n", "digest", "bytes")


# ------------------------------------------------------------------ one shard


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def piece_digest(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def walk(pieces: list[Piece], size: int = PIECE) -> Iterator[dict]:
    """Nodes of the trie of some pieces, depth first.

    Every (place, turn) has a bitset of the pieces that hold it, and so has every length at
    which pieces end. The children of a node are the meets of its bitset with the postings
    of the turns at the next place; each takes the turn of the least piece that is left.
    """
    pieces = sorted(pieces, key=lambda p: p[:2])
    starts: dict[tuple[int, bytes], int] = defaultdict(int)
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    longer: dict[int, int] = defaultdict(int)  # pieces with a turn at this place of the piece
    ends: dict[int, int] = defaultdict(int)
    for i, (_, number, n, prefix, digests, _) in enumerate(pieces):
        bit = 1 << i
        starts[number, prefix] |= bit
        for k, d in enumerate(digests):
            postings[number * size + k, d] |= bit
            longer[k] |= bit
        if number * size + len(digests) == n:
            ends[n] |= bit
    for (number, prefix), members in starts.items():
        stack = [(members, 0, prefix, hashlib.sha256(prefix))]
        while stack:
            bits, k, key, state = stack.pop()
            rest = bits & longer.get(k, 0)
            while rest:
                least = (rest & -rest).bit_length() - 1
                conv, _, _, _, digests, sizes = pieces[least]
                child = bits & postings[number * size + k, digests[k]]
                rest ^= child
                grown = state.copy()
                grown.update(digests[k])
                # The last node of a full piece is the prefix of the next one.
                own = grown.digest() if k + 1 < size else next_prefix(prefix, piece_digest(digests))
                depth = number * size + k + 1
                yield {"key": own, "parent": key, "depth": depth, "n": child.bit_count(), "first": conv, "bytes": sizes[k],
                       "ends": [pieces[j][0] for j in _bits(child & ends.get(depth, 0))]}
                stack.append((child, k + 1, own, grown))


def next_prefix(prefix: bytes, digest: bytes) -> bytes:
    return hashlib.sha256(prefix + digest).digest()


# ------------------------------------------------------------------ nodes of all shards


def _prefixes(pieces: DataFrame, size: int) -> DataFrame:
    """(conv, piece, prefix) of every piece but the first: the chained digests of those before.

    Only full pieces of conversations with several pieces come here, a digest for ``size`` turns.
    """
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.lower(F.hex(t["digest"]))), "").cast("binary"), 256)
    full = pieces.filter(F.col("n") > F.lit(size)).filter(F.size("turns") == size)
    rows = full.select("conv", "piece", F.unhex(digest).alias("d")).repartition("conv").sortWithinPartitions("conv", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, prefix = None, ROOT
        for batch in batches:
            out = []
            for c, p, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                prefix = next_prefix(prefix if c == conv else ROOT, d)
                conv = c
                out.append((c, p + 1, prefix))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))],
                                                 names=["conv", "piece", "prefix"])

    return rows.mapInArrow(run, "conv bigint, piece bigint, prefix binary")


def shard_nodes(turns: DataFrame, size: int = PIECE, shard: int = SHARD) -> DataFrame:
    """Nodes of every shard: key, parent, depth, members, least member, bytes of its turn, ends."""
    entry = F.struct("at", "digest", "bytes")
    pieces = turns.groupBy("conv", F.expr(f"at div {size}").alias("piece")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("turns"))
    pieces = materialize(pieces, "pieces").withColumn("piece", F.col("piece").cast("bigint"))
    ready = pieces.join(_prefixes(pieces, size), ["conv", "piece"], "left")
    kinds = schema_of(SHARD_NODES)
    arrow = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("first", pa.int64()),
                       ("bytes", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def nodes(held: list[Piece]) -> Iterator[pa.RecordBatch]:
        out = []
        for node in walk(held, size):
            out.append(node)
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "piece", "n", "prefix", "turns")]
            for conv, piece, n, prefix, own in zip(*columns):
                held.append((conv, piece, n, prefix or ROOT, [t["digest"] for t in own], [t["bytes"] for t in own]))
                count += len(own)
                if count >= shard:
                    yield from nodes(held)
                    held, count = [], 0
        yield from nodes(held)

    return ready.select("conv", "piece", "n", "prefix", "turns").mapInArrow(run, kinds)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv): ids in order, comma-joined.

    Ids are sorted by range and joined in chunks where they are, so only one short row for
    each 4,096 ids of a node comes to the task that hashes the node, which keeps no list.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()),
                                               pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == 4096):
                    yield made()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield made()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    out += [(key, state.hexdigest())] if state else []
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names=["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    sorted_ = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    joined = sorted_.mapInArrow(chunks, "key binary, first bigint, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, ends_sha256 string")


# ------------------------------------------------------------------ subtrees

_SUMS = ("leaves", "saved")


def _totals(chains: DataFrame) -> DataFrame:
    """(chain, leaves, saved) of whole subtrees of chains (chain, up, leaves, saved).

    By doubling: after round k a chain holds the sums of all chains less than 2 ** k below
    it, and points 2 ** k chains up; so a tree of any height takes few rounds.
    """
    state = chains.select("chain", F.col("up").alias("to"), *_SUMS)
    while True:
        state = materialize(state, "subtrees")
        moving = state.filter("to is not null")
        if not moving.limit(1).count():
            return state.select("chain", *_SUMS)
        given = moving.groupBy(F.col("to").alias("at")).agg(*[F.sum(c).alias(f"more_{c}") for c in _SUMS])
        above = state.select(F.col("chain").alias("c"), F.col("to").alias("next"))
        jumped = lookup(state, "to", above, "c", "chain").join(given, F.col("chain") == F.col("at"), "left")
        state = jumped.select("chain", F.col("next").alias("to"),
                              *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in _SUMS])


def _along(nodes: DataFrame, slice_: int = 4_096) -> DataFrame:
    """Turn ``leaves`` and ``saved`` into sums over the node and those below it on its chain.

    A long chain is cut into slices of depths; the sums of the slices give the offsets.
    """
    cut = nodes.withColumn("slice", F.expr(f"depth div {slice_}"))
    sums = cut.groupBy("conv_id", "slice").agg(*[F.sum(c).alias(c) for c in _SUMS])
    below = Window.partitionBy("conv_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select("conv_id", "slice", *[F.sum(c).over(below).alias(f"later_{c}") for c in _SUMS]).filter("later_saved is not null")
    own = Window.partitionBy("conv_id", "slice").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({c: F.sum(c).over(own) for c in _SUMS})
    out = join_small(summed, later, ["conv_id", "slice"], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(f"later_{c}", F.lit(0)) for c in _SUMS}).drop("slice", *[f"later_{c}" for c in _SUMS])


def trie(turns: DataFrame, conversations: DataFrame, size: int = PIECE, shard: int = SHARD) -> DataFrame:
    """One row for every distinct prefix of the conversations, the empty one included.

    ``turns`` has conv, at, n, digest and bytes, ``conversations`` (conv, n) also those
    without a turn. Returned: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Long conversations are cut into pieces of ``size`` turns, whose prefix is a chained
    digest; pieces are indexed in shards of about ``shard`` turns, wherever they lie, and
    the nodes that several shards find are added up. The nodes with the same least member
    are a chain from some node down to the end of that conversation. Sums over subtrees go
    along chains and between them, so no task holds a subtree, a conversation or the
    members of a node. No conversation at all gives no node.
    """
    found = materialize(shard_nodes(turns, size, shard), "shard-nodes")
    key = F.lit(ROOT)
    whole = conversations.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = whole.select(key.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"),
                        F.lit(0).cast("bigint").alias("bytes"), "n_convs", "conv_id")
    nodes = found.groupBy("key", "parent", "depth", "bytes").agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"))
    nodes = materialize(nodes.unionByName(root), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, F.col("key") == F.col("of"), "left").drop("of").fillna(0, ["n_children"])
    above = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    nodes = lookup(nodes, "parent", above, "above", "key").drop("parent")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint")
    nodes = materialize(nodes.withColumns({"leaves": leaves, "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "linked-nodes")

    top = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    chains = nodes.groupBy(F.col("conv_id").alias("chain")).agg(
        F.sum(F.when(top, F.col("parent_conv_id"))).alias("up"), (F.sum(F.when(top, F.col("depth"))) - 1).alias("at"),
        *[F.sum(c).alias(c) for c in _SUMS])
    chains = materialize(chains, "chains")
    hung = chains.drop(*_SUMS).join(_totals(chains), "chain").filter("up is not null")
    hung = hung.groupBy(F.col("up").alias("_up"), F.col("at").alias("_at")).agg(*[F.sum(c).alias(f"hung_{c}") for c in _SUMS])
    nodes = nodes.join(hung, (F.col("conv_id") == F.col("_up")) & (F.col("depth") == F.col("_at")), "left")
    nodes = _along(nodes.withColumns({c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in _SUMS}))

    ends = found.select("key", F.explode("ends").alias("conv")).unionByName(
        conversations.filter("n = 0").select(key.alias("key"), "conv"))
    out = nodes.join(_end_hashes(ends), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations given as rows of turns; see ``turns_in_order`` and ``trie``.

    Two turns are the same if role and text are. Nulls, ties, repeated rows and rows without
    an id are as in ``turns_in_order``; other columns are not used; an empty table gives no node.
    """
    turns = materialize(turns_in_order(rows, conv, turn, role, text), "ordered-turns")
    return trie(turns, turns.filter("at = 0").select("conv", "n"))


def with_openings(turns: DataFrame, group: Column, take: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations, each opened by the first turns of another one.

    ``take`` (at most ``most``) turns of the conversation ``group`` come first, all of them if
    it has fewer and none if it is not there; then the own turns after the first ``take``.
    Both are expressions over ``conv``.
    """
    every = turns.filter("at = 0").select("conv", "n", group.alias("of"), take.cast("bigint").alias("take"))
    lent = every.select(F.col("conv").alias("lender"), F.col("n").alias("lender_n"))
    every = every.join(lent, F.col("of") == F.col("lender"), "left")
    head = F.least("take", F.coalesce("lender_n", F.lit(0)))
    every = every.withColumn("head", head).withColumn("total", F.col("head") + F.greatest(F.col("n") - F.col("take"), F.lit(0)))
    every = materialize(every.select("conv", "of", "take", "head", "total"), "openings")
    firsts = turns.filter(F.col("at") < most).select(F.col("conv").alias("lender"), "at", "digest", "bytes")
    opening = every.join(firsts, (F.col("of") == F.col("lender")) & (F.col("at") < F.col("take")))
    opening = opening.select("conv", "at", F.col("total").alias("n"), "digest", "bytes")
    facts = every.select(F.col("conv").alias("c"), "take", "head", "total")
    own = lookup(turns.drop("n"), "conv", facts, "c", "at").filter("at >= take")
    own = own.select("conv", (F.col("at") - F.col("take") + F.col("head")).alias("at"), F.col("total").alias("n"), "digest", "bytes")
    return opening.unionByName(own), every.select("conv", F.col("total").alias("n"))
