"""Near copies by the exact Jaccard similarity of word shingles; SimHash and MinHash bands give the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import add_columns
from flowlens.llm.near_duplicates import _signed, components, fingerprint, named, row_key
from flowlens.llm.near_duplicates import links_of as simhash_links
from flowlens.session import join_small, materialize

SHINGLE, SEED, SIMILAR = 5, 42, 0.8
# A pair of similarity 0.8 agrees on no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
_FACTORS = np.random.RandomState(SEED).randint(1, 1 << 62, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_HAS_WORD = r"[^\x20\x09-\x0D]"
_DENSE = 4096  # columns of a dense part of the incidence matrix


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of all runs of five words, sorted; of all words if they are fewer."""
    words = (text or "").encode().lower().split()  # bytes lower only A-Z
    if not words:
        return np.empty(0, np.uint64)
    runs = {b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(runs)))


def bands(hashes: np.ndarray) -> list[int]:
    """One hash a band over the least values of its rows."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096]
        # The upper half of a product depends on all bits of the hash.
        mixed = (part ^ (part >> np.uint64(31)))[:, None] * _FACTORS[None, :]
        least = np.minimum(least, mixed.min(axis=0))
    return [xxhash.xxh64_intdigest(least[b * ROWS:(b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def overlaps(own: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each of ``own`` with each of ``others``."""
    both = own + others
    values, ids = np.unique(np.concatenate(both), return_inverse=True)
    counts = np.bincount(ids, minlength=len(values))
    shared = np.cumsum(counts > 1) - 1  # what occurs once is in no intersection
    row = np.repeat(np.arange(len(both)), [len(b) for b in both])
    keep = counts[ids] > 1
    row, column = row[keep], shared[ids[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(own), len(others)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _DENSE):
        a, b = np.searchsorted(column, [first, first + _DENSE])
        part = np.zeros((len(both), min(_DENSE, int(column[b - 1]) - first + 1)), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += (part[:len(own)] @ part[len(own):].T).astype(np.int64)
    return out


def links(own: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links of pairs with a similarity of at least ``least``: among ``own``, or with ``others``.

    Every pair is compared; of the similar ones those stay that give the same components.
    """
    left, right = own, others or own
    common = overlaps([s for _, s in left], [s for _, s in right])
    sizes = np.add.outer([len(s) for _, s in left], [len(s) for _, s in right])
    alike = common >= least * (sizes - common) - 1e-9
    found, seen_left, seen_right = [], np.zeros(len(left), bool), np.zeros(len(right), bool)
    for start in range(len(left)):
        stack = [] if seen_left[start] else [(start, True)]
        seen_left[start] = True
        while stack:
            v, is_left = stack.pop()
            near, seen = (alike[v], seen_right) if is_left else (alike[:, v], seen_left)
            for w in np.flatnonzero(near & ~seen).tolist():
                seen[w] = True
                a, b = (left[v][0], right[w][0]) if is_left else (left[w][0], right[v][0])
                if a != b:
                    found.append((a, b))
                stack.append((w, not is_left))
    return found


def _bucket_links(rows: DataFrame, least: float) -> DataFrame:
    """Links of every bucket. Its rows come sorted; only one bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, others, out = None, [], [], []

        def flush():
            same = key and key[2] == key[3]
            if own and (len(own) > 1 if same else others):
                out.extend(links(own, others, least))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for band, value, t, u, side, node, packed in zip(*columns):
                if (band, value, t, u) != key:
                    flush()
                    key, own, others = (band, value, t, u), [], []
                (own if side == 0 else others).append((node, np.frombuffer(packed, "<u8")))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})
                out = []
        flush()
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.mapInArrow(run, "a bigint, b bigint")


def links_of(texts: DataFrame, bucketed: DataFrame, least: float = SIMILAR, max_rows: int = 1_000,
             max_shingles: int = 1_000_000) -> DataFrame:
    """Links (a, b) between the nodes of ``texts`` (node, t), from buckets (band, value, node, n).

    Every pair in a bucket is compared. A bucket above ``max_rows`` texts or ``max_shingles``
    is dealt to several parts, and each pair of parts is compared in a task of its own. Sets
    travel only to buckets of two texts or more.
    """
    size = F.greatest(F.count(F.lit(1)) / max_rows, F.sum("n") / max_shingles)
    full = bucketed.groupBy("band", "value").agg(
        F.count(F.lit(1)).alias("size"), F.ceil(size).cast("int").alias("parts"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("size > 1")
    # Buckets with the same texts are one.
    full = full.groupBy("size", "x", "y").agg(F.min(F.struct("band", "value", "parts")).alias("b"))
    rows = bucketed.join(full.select("b.band", "b.value", "b.parts"), ["band", "value"])
    rows = materialize(rows.select("band", "value", "node", "parts"), "buckets")
    wanted = join_small(texts, rows.select("node").distinct(), ["node"])
    sets = add_columns(wanted.dropDuplicates(["node"]), ["t"], "packed binary",
                       lambda ts: [[shingles(t).astype("<u8").tobytes() for t in ts]], keep=["node"])
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # Part t is compared with itself and with every later part u.
    at = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least(o, F.col("mine")).alias("t"), F.greatest(o, F.col("mine")).alias("u"),
        F.when(o < F.col("mine"), 1).otherwise(0).alias("side")))
    dealt = rows.withColumn("mine", mine).select("band", "value", "node", F.explode(at).alias("s"))
    dealt = dealt.select("band", "value", "s.t", "s.u", "s.side", "node").join(sets, "node")
    key = ["band", "value", "t", "u"]
    dealt = dealt.select(*key, "side", "node", "packed").repartition(*key).sortWithinPartitions(*key, "side", "node")
    return _bucket_links(dealt, least)


def simhash_buckets(marked: DataFrame) -> DataFrame:
    """Rows (band, value, node, n): texts whose SimHash fingerprints hang together are one bucket of the band after the last."""
    texts = marked.filter("n > 0").select("word", "n", "simhash")
    words = materialize(texts.select(F.col("simhash").alias("word")).distinct(), "fingerprints")
    roots = components(simhash_links(words)).withColumnRenamed("node", "simhash")
    return texts.join(roots, "simhash", "left").select(
        F.lit(BANDS).alias("band"), F.coalesce("root", "simhash").alias("value"), F.col("word").alias("node"), "n")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """Key, ``component_id``, ``representative`` and ``row_key`` of every row.

    Texts whose sets of five-word shingles have a Jaccard similarity of ``least`` or more are
    linked, and a component is what can be reached over links. The pairs compared are those of
    a SimHash component and those that agree on a MinHash band, which finds the copies too far
    apart for a fingerprint; each is checked by its whole sets. Equal texts are one node,
    and all texts without a word are another one. Keys, nulls and representatives are as
    those of the SimHash components.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    node = F.when(body.rlike(_HAS_WORD), F.xxhash64(body)).otherwise(F.lit(0).cast("bigint"))
    base = df.select(F.col(f"`{key}`").alias("key"), row_key(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row_key"),
                     node.alias("word"), body.alias("t"))

    def work(texts: list) -> list[list]:
        sets = [shingles(t) for t in texts]
        return [[len(s) for s in sets], [bands(s) if len(s) else [] for s in sets],
                [_signed(fingerprint(t)) for t in texts]]

    marked = materialize(add_columns(base, ["t"], "n bigint, bands array<bigint>, simhash bigint", work, keep=["key", "row_key", "word"]), "bands")
    each = marked.select(F.col("word").alias("node"), "n", F.posexplode("bands").alias("band", "value"))
    bucketed = each.unionByName(simhash_buckets(marked)).groupBy("band", "value", "node").agg(F.max("n").alias("n"))
    texts = base.select(F.col("word").alias("node"), "t")
    return named(marked.select("key", "row_key", "word"), lambda words: components(links_of(texts, bucketed, least)), key).drop("fingerprint")
