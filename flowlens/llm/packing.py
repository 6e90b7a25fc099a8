"""Best-fit packing of documents into bins of fixed room, under conflicts."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import WORD, add_columns, schema_of

CAPACITY, PER_SOURCE = 2048, 2
PIECES = "array<struct<piece:int,size:bigint,char_start:bigint,char_end:bigint>>"
COLUMNS = ("bin_id", "slot", "piece", "size", "char_start", "char_end")
_WORD = re.compile(WORD)


def pieces_of(text: str | None, capacity: int) -> list[dict]:
    """Pieces of at most ``capacity`` words that together are the whole text."""
    text = text or ""
    n = len(text.encode().split())
    if n <= capacity:
        return [{"piece": 0, "size": n, "char_start": 0, "char_end": len(text)}]
    starts = [m.start() for i, m in enumerate(_WORD.finditer(text)) if i % capacity == 0]
    starts[0] = 0
    ends = [*starts[1:], len(text)]
    return [{"piece": i, "size": min(capacity, n - i * capacity), "char_start": a, "char_end": b}
            for i, (a, b) in enumerate(zip(starts, ends))]


class Bins:
    """Bins in the order of what is left in them, each with bitmaps of its sources and clusters."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []   # (room left, bin), ascending
        self.full_sources: list[int] = []        # bit s: the bin takes no more of source s
        self.clusters: list[int] = []            # bit c: the bin holds one of cluster c
        self.counts: list[Counter] = []
        self.slots: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and slot: the least room that holds ``size`` without a conflict, else a new bin.

        ``cluster`` below 0 conflicts with nothing. The search starts at the least room
        that is enough and goes on to the next bin until one is compatible.
        """
        source_bit, cluster_bit = 1 << source, (1 << cluster) if cluster >= 0 else 0
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            left, b = self.order[at]
            if not (self.full_sources[b] & source_bit or self.clusters[b] & cluster_bit):
                del self.order[at]
                break
            at += 1
        else:
            left, b = self.capacity, len(self.slots)
            self.full_sources.append(0)
            self.clusters.append(0)
            self.counts.append(Counter())
            self.slots.append(0)
        self.counts[b][source] += 1
        if self.counts[b][source] >= self.per_source:
            self.full_sources[b] |= source_bit
        self.clusters[b] |= cluster_bit
        insort(self.order, (left - size, b))
        self.slots[b] += 1
        return b, self.slots[b] - 1


def pack_items(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """Bin and slot of each item, in the order given; a null cluster conflicts with nothing."""
    bits: dict = {}
    many = Counter(c for c in clusters if c is not None)
    cluster_bits: dict = {}
    bins = Bins(capacity, per_source)
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = bits.setdefault(source, len(bits))
        # A cluster of one needs no bit.
        c = cluster_bits.setdefault(cluster, len(cluster_bits)) if cluster is not None and many[cluster] > 1 else -1
        out.append(bins.place(size, s, c))
    return out


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None,
         capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = 4_000, with_text: bool = False) -> DataFrame:
    """One row a piece: key, source, ``bin_id``, ``slot``, ``piece``, ``size`` (words), ``char_start``, ``char_end``.

    A bin holds at most ``capacity`` words, ``per_source`` pieces of one source, and one
    piece of a duplicate cluster. ``cluster`` is by default the hash of the text. A text
    above the capacity is cut into pieces of full bins and a rest, so nothing is lost. With
    ``with_text`` the text of the piece is a column, too.

    Pieces are dealt at random to shards of about ``shard_rows`` documents, whatever their
    source and cluster. Each shard packs its pieces by falling size into bins of its own.

    Texts that are null or without a word have one piece of size 0, which conflicts only by
    source. Null sources are one source. Equal sizes are placed in the order of cluster,
    key and piece. Repeated rows are packed each. An empty table gives no rows. Columns of
    ``df`` that are not named here are not returned.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("t"),
                     (F.xxhash64(F.col(f"`{text}`")) if cluster is None else cluster).alias("cluster"))
    shards = max(1, -(-df.count() // shard_rows))
    # Rows without any difference still go to different shards.
    base = base.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    cut = add_columns(base, ["t"], f"p {PIECES}", lambda texts: [[pieces_of(t, capacity) for t in texts]],
                      keep=["key", "source", "cluster", "shard", *(["t"] if with_text else [])])
    rows = cut.withColumn("p", F.explode("p"))
    shown = [F.col("t").substr(F.col("p.char_start").cast("int") + 1, (F.col("p.char_end") - F.col("p.char_start")).cast("int"))
             .alias("text")] if with_text else []
    rows = rows.select("key", "source", F.when(F.col("p.size") > 0, F.col("cluster")).alias("cluster"), "shard", "p.*", *shown)
    shown_names = [c for c in rows.columns if c not in ("cluster", "shard")]
    schema = T.StructType([*[rows.schema[c] for c in shown_names], *schema_of("bin_id bigint, slot int").fields])

    def fill(group: pa.Table) -> pa.Table:
        at = {c: group.column(c).to_pylist() for c in ("size", "source", "cluster", "key", "piece", "char_end", "shard")}
        order = sorted(range(group.num_rows), key=lambda i: (-at["size"][i], at["cluster"][i] or 0, str(at["key"][i]),
                                                             at["piece"][i], at["char_end"][i], str(at["source"][i])))
        places = pack_items(*[[at[c][i] for i in order] for c in ("size", "source", "cluster")], capacity, per_source)
        shard = at["shard"][0] << 32
        out = group.select(shown_names).take(pa.array(order, pa.int64()))
        out = out.append_column("bin_id", pa.array([shard + b for b, _ in places], pa.int64()))
        return out.append_column("slot", pa.array([s for _, s in places], pa.int32()))

    packed = rows.groupBy("shard").applyInArrow(fill, schema)
    text_column = ["text"] if with_text else []
    return packed.select(F.col("key").alias(key), F.col("source").alias(source), *COLUMNS, *text_column)
