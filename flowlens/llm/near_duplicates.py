"""Near duplicates: SimHash fingerprints, linked by searches in sharded BK-trees."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import add_columns, fresh
from flowlens.session import join_small, materialize

SHINGLE, SEED, RADIUS = 4, 42, 4


def fingerprint(text: str | None) -> int:
    """64 bits, each 1 if it is set in over half of the shingle hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes lower only A-Z
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    hashed = xxhash.xxh64_intdigest
    tails = ends[SHINGLE - 1:] or ends[-1:]
    hashes = np.fromiter((hashed(line[a:b - 1], SEED) for a, b in zip(starts, tails)), np.uint64, len(tails))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ------------------------------------------------------------------ BK-trees of one shard


class BkTree:
    """Distinct 64-bit words; a child hangs at its Hamming distance to the parent.

    ``link`` follows only edges within the radius of the distance, and skips a subtree that
    is known to lie wholly in the component of the word searched for: such a subtree can
    not give a link between components. ``alike[v]`` is true while all below ``v`` is in
    one component.
    """

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.words: list[int] = []
        self.children: list[dict[int, int]] = []
        self.alike: list[bool] = []
        self.parent: list[int] = []
        self.outside: dict[int, int] = {}  # words that are searched for but not stored

    def _root(self, v: int) -> int:
        up = self.parent
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    def _new(self, word: int) -> int:
        self.words.append(word)
        self.children.append({})
        self.alike.append(True)
        self.parent.append(len(self.parent))
        return len(self.words) - 1

    def _search(self, word: int, me: int) -> list[tuple[int, int]]:
        """Join ``me`` to every component within the radius; one pair for each joining."""
        links, stack, r = [], [0], self.radius
        words, children, alike, up = self.words, self.children, self.alike, self.parent
        mine = self._root(me)
        while stack:
            v = stack.pop()
            if alike[v] and self._root(v) == mine:
                continue
            d = (words[v] ^ word).bit_count()
            if d <= r:
                other = self._root(v)
                if other != mine:
                    up[mine] = other
                    mine = other
                    links.append((words[v], word))
            for k, c in children[v].items():
                if d - r <= k <= d + r:
                    stack.append(c)
        return links

    def add(self, word: int, search: bool = True) -> list[tuple[int, int]]:
        """Store a word that is not stored yet; its links to other components."""
        if not self.words:
            self._new(word)
            return []
        # The node is made first, so that the search can join it; it hangs nowhere yet.
        me = self._new(word)
        links = self._search(word, me) if search else []
        mine, v, path = self._root(me), 0, []
        while True:
            path.append(v)
            d = (self.words[v] ^ word).bit_count()
            child = self.children[v].get(d)
            if child is None:
                self.children[v][d] = me
                break
            v = child
        for v in path:
            if self.alike[v] and self._root(v) != mine:
                self.alike[v] = False
        return links

    def probe(self, word: int) -> list[tuple[int, int]]:
        """The links of a word that belongs to another tree."""
        if not self.words:
            return []
        me = self.outside.get(word)
        if me is None:
            me = self.outside[word] = len(self.parent)
            self.words.append(word)
            self.children.append({})
            self.alike.append(True)
            self.parent.append(me)
        return self._search(word, me)


def shard_links(own: list[int], others: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what is within the radius: among ``own``, or from ``others`` to ``own``.

    They leave the same components as all pairs would, and are fewer than the words.
    """
    tree, links = BkTree(radius), []
    for w in own:
        links += tree.add(w, search=not others)
    for w in others:
        links += tree.probe(w)
    return links


# ------------------------------------------------------------------ shards of all words


def block_masks(radius: int, agree: int) -> list[int]:
    """Masks of ``agree`` blocks out of ``radius + agree``.

    Differing bits touch at most ``radius`` blocks, so two words within the radius agree on
    all bits of at least one mask.
    """
    n = radius + agree
    borders = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(borders, borders[1:])]
    return [sum(c) for c in combinations(blocks, agree)]


def _agree_for(words: int, radius: int, per_shard: int = 256) -> int:
    """Blocks that must agree so that an even spread leaves few words in a shard."""
    agree = 1
    while agree < 6 and words >> (64 * agree // (radius + agree)) > per_shard:
        agree += 1
    return agree


def _sorted_shards(shards: DataFrame, radius: int) -> DataFrame:
    """Links of every shard. Its rows come sorted; only one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, others, out = None, [], [], []

        def flush():
            if len(own) > 1 or (own and others):
                out.extend(shard_links(own, others, radius))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for mask, value, t, u, side, word in zip(*columns):
                if (mask, value, t, u) != key:
                    flush()
                    key, own, others = (mask, value, t, u), [], []
                (own if side == 0 else others).append(word & 0xFFFFFFFFFFFFFFFF)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": [_signed(x) for x, _ in out], "b": [_signed(y) for _, y in out]})
                out = []
        flush()
        yield pa.RecordBatch.from_pydict({"a": pa.array([_signed(x) for x, _ in out], pa.int64()),
                                          "b": pa.array([_signed(y) for _, y in out], pa.int64())})

    return shards.mapInArrow(run, "a bigint, b bigint")


def links_of(words: DataFrame, radius: int = RADIUS, max_tree: int = 20_000) -> DataFrame:
    """Links (a, b) between the distinct ``word`` values that give all components.

    A shard holds the words that agree on the bits of one mask. A shard above ``max_tree``
    words is dealt to several trees, and each pair of trees is searched in a task of its
    own, so that no task holds more than two trees.
    """
    masks = block_masks(radius, _agree_for(words.count(), radius))
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("word").bitwiseAND(F.lit(_signed(m))).alias("value"))
                     for i, m in enumerate(masks)])
    rows = words.select("word", F.explode(keys).alias("k")).select("k.mask", "k.value", "word")
    sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_tree)
    trees = sizes.select("mask", "value", F.ceil(F.col("n") / max_tree).cast("int").alias("trees"))
    rows = join_small(rows, trees, ["mask", "value"], "left")
    count = F.coalesce(F.col("trees"), F.lit(1))
    mine = F.pmod(F.xxhash64("word"), count).cast("int")
    # Tree t stores its words; those of a later tree u are searched for in it.
    at = F.transform(F.sequence(F.lit(0), count - 1), lambda o: F.struct(
        F.least(o, F.col("mine")).alias("t"), F.greatest(o, F.col("mine")).alias("u"),
        F.when(o < F.col("mine"), 1).otherwise(0).alias("side")))
    dealt = rows.withColumn("mine", mine).select("mask", "value", "word", F.explode(at).alias("s"))
    dealt = dealt.select("mask", "value", "s.t", "s.u", "s.side", "word")
    key = ["mask", "value", "t", "u"]
    return _sorted_shards(dealt.repartition(*key).sortWithinPartitions(*key, "side", "word"), radius)


# ------------------------------------------------------------------ components


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links; the root is the least node reachable.

    Large and small stars in turn: each node hands its least neighbour to the others, until
    every node hangs at its root. Each round is written to the shared folder.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = materialize(pairs, "links")
    last = None
    while True:
        # Large star: the larger neighbours of a node go to its least neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # Small star: the smaller neighbours of a node, and itself, go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = materialize(small, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


# ------------------------------------------------------------------ operator


def row_key(key: Column, text: Column) -> Column:
    """What tells rows apart: the id, if there is one, and the whole text."""
    body = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.coalesce(F.concat(F.lit("i"), key.cast("string"), F.lit(":"), body), F.concat(F.lit("t"), body))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Key, ``fingerprint``, ``component_id`` and ``representative`` of every row.

    Fingerprints within ``radius`` differing bits are linked; a component is what can be
    reached over links, and its id is the least key in it. ``representative`` is true for
    the rows with that key and, where they differ, the text of least hash in the component.

    Equal fingerprints are one word of the search, so copies cost nothing there. A null
    text counts as empty; all texts without a word have the fingerprint zero. Null keys
    never are an id: a component without any other key has a null id, and the rows of its
    least text represent it. Repeated rows all stay. An empty table gives an empty one.
    Other columns are not returned.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), row_key(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row_key"),
                     F.col(f"`{text}`").alias("t"))
    marked = add_columns(base, ["t"], "word bigint", lambda texts: [[_signed(fingerprint(t)) for t in texts]],
                         keep=["key", "row_key"])
    marked = materialize(marked, "fingerprints")
    return named(marked, lambda words: components(links_of(words, radius)), key)


def named(marked: DataFrame, roots_of: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Component and representative of rows (key, row_key, word), from the roots of the words."""
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("row_key").alias("row_key"))
    words = materialize(marked.groupBy("word").agg(F.min(order).alias("first")), "words")
    roots = roots_of(words.select("word"))
    tree = words.join(roots, words["word"] == roots["node"], "left")
    tree = tree.select("word", "first", F.coalesce("root", "word").alias("root"))
    firsts = tree.groupBy("root").agg(F.min("first").alias("least"))
    least = tree.join(firsts, "root").select("word", "least")
    out = marked.join(least, "word")
    return out.select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"),
        F.col("least.key").alias("component_id"),
        (F.col("row_key") == F.col("least.row_key")).alias("representative"),
        "row_key",
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS,
                found: DataFrame | None = None) -> DataFrame:
    """One row of ``df`` for each component, the same on every run.

    Rows with one key and different texts are rows of their own: each stays unless its own
    component has another representative. Of rows equal in key and text stays the one whose
    other columns, as JSON, come first. ``found`` gives components of another kind.
    """
    found = near_duplicates(df, key, text, radius) if found is None else found
    chosen = found.filter("representative").select("row_key").distinct()
    mark = fresh(df, "_row_key")
    rows = df.withColumn(mark, row_key(F.col(f"`{key}`"), F.col(f"`{text}`")))
    kept = rows.join(chosen.withColumnRenamed("row_key", mark), mark, "left_semi")
    whole = [F.col(f"`{c}`") for c in df.columns]
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c not in (key, text)]
    order = F.to_json(F.struct(F.col(f"`{text}`").isNull().alias("none"), *others))
    kept = kept.groupBy(mark).agg(F.min_by(F.struct(*whole), order).alias("_row"))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
