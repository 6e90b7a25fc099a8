"""Approximate nearest neighbours: balanced posting lists, boundary copies, a graph of centroids."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import join_small, materialize

_LAST = (1 << 63) - 1  # stands for a null id


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _split(x: np.ndarray, rows: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """k-means of some rows into at most ``parts`` lists."""
    centres = x[rng.choice(rows, parts, replace=False)]
    own = np.zeros(len(rows), int)
    for _ in range(8):
        own = np.argmax(x[rows] @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x[rows])
        filled = np.bincount(own, minlength=parts) > 0
        centres = np.where(filled[:, None], _unit(sums), centres)
    return [rows[own == k] for k in range(parts) if (own == k).any()]


@dataclass
class Index:
    """Centroids of the posting lists and a graph that links each to near ones."""

    centres: np.ndarray     # lists x dimensions, unit length
    links: np.ndarray       # lists x neighbours
    entries: np.ndarray     # where a search starts

    def search(self, query: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``wide`` nearest centroids that a best-first walk over the graph finds, nearest first."""
        near = self.centres[self.entries] @ query
        seen = np.zeros(len(self.centres), bool)
        seen[self.entries] = True
        queue = [(-s, int(c)) for s, c in zip(near, self.entries)]
        found = [(s, int(c)) for s, c in zip(near, self.entries)]
        heapq.heapify(queue)
        heapq.heapify(found)
        while len(found) > wide:
            heapq.heappop(found)
        while queue:
            s, c = heapq.heappop(queue)
            if len(found) >= wide and -s < found[0][0]:
                break
            fresh = self.links[c]
            fresh = fresh[~seen[fresh]]
            if not len(fresh):
                continue
            seen[fresh] = True
            for t, k in zip((self.centres[fresh] @ query).tolist(), fresh.tolist()):
                if len(found) < wide or t > found[0][0]:
                    heapq.heappush(queue, (-t, k))
                    heapq.heappush(found, (t, k))
                    if len(found) > wide:
                        heapq.heappop(found)
        found.sort(key=lambda x: (-x[0], x[1]))
        return np.array([k for _, k in found]), np.array([s for s, _ in found])

    def lists_of_query(self, query: np.ndarray, ratio: float, wide: int, least: int = 16) -> np.ndarray:
        """The ``least`` nearest lists, and all whose centroid is at most ``ratio`` times as far as the nearest."""
        lists, near = self.search(query, wide)
        distance = np.sqrt(np.maximum(2 - 2 * near, 0))
        return lists[(distance <= ratio * distance[0] + 1e-9) | (np.arange(len(lists)) < least)]

    def lists_of_rows(self, x: np.ndarray, ratio: float, copies: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each vector: its nearest list, and those hardly farther for a boundary vector.

        A list is left out if its centroid is nearer to that of a list already taken than to
        the vector: the vector lies in the same direction from both.
        """
        near = x @ self.centres.T
        many = min(copies * 2, near.shape[1])
        top = np.argpartition(-near, many - 1, axis=1)[:, :many]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        distance = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, top, 1), 0))
        good = distance <= ratio * distance[:, :1] + 1e-9
        taken = np.zeros_like(good)
        taken[:, 0] = True
        for j in range(1, many):
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nkd->nk", self.centres[top[:, j]], self.centres[top[:, :j]]), 0))
            same_side = ((between < distance[:, j:j + 1]) & taken[:, :j]).any(axis=1)
            taken[:, j] = good[:, j] & ~same_side & (taken[:, :j].sum(axis=1) < copies)
        rows, at = np.nonzero(taken)
        return rows, top[rows, at]


def fit(sample: np.ndarray, list_rows: int = 64, neighbours: int = 24, seed: int = 7) -> Index:
    """Index from a sample: lists above ``list_rows`` sample rows are split until none is."""
    x, rng = _unit(sample.astype(np.float64)), np.random.default_rng(seed)
    todo, done = [np.arange(len(x))] if len(x) else [], []
    while todo:
        rows = todo.pop()
        if len(rows) <= list_rows:
            done.append(rows)
            continue
        parts = _split(x, rows, int(min(16, max(2, -(-len(rows) // list_rows)))), rng)
        # Equal vectors cannot be split; their list stays large.
        (done if len(parts) == 1 else todo).extend(parts)
    centres = _unit(np.stack([x[r].sum(axis=0) for r in done])) if done else np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    n = len(centres)
    near = centres @ centres.T
    np.fill_diagonal(near, -np.inf)
    links = np.argsort(-near, axis=1, kind="stable")[:, :min(neighbours, max(n - 1, 0))]
    far = rng.integers(0, max(n, 1), (n, 4))  # a few long edges keep the graph in one piece
    return Index(centres, np.concatenate([links, far], axis=1).astype(np.int64) if n else np.zeros((0, 0), np.int64),
                 np.arange(0, n, max(1, n // 8)))


# ------------------------------------------------------------------ search in Spark


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(uid, id, v) of the rows whose vector takes part; ``uid`` tells repeated rows apart."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v")).filter(F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def sample_of(rows: DataFrame, n: int, total: int) -> np.ndarray:
    """Up to ``n`` vectors with the least hash of their id."""
    draw = F.pmod(F.xxhash64("id", "uid"), F.lit(1 << 30))
    share = min(1.0, 2.0 * n / max(total, 1))
    found = rows.withColumn("h", draw).filter(F.col("h") < int(share * (1 << 30))).orderBy("h", "uid").limit(n)
    made = [r["v"] for r in found.select("v").collect()]
    return np.array(made, float) if made else np.zeros((0, 0))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def nearest_in_shard(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, chunk: int = 256) -> pd.DataFrame:
    """The ``k`` best vectors of a shard for each query, from the lists that the query selected.

    Of equal vectors in a list only the ``k + 1`` with the least ids can be among the best
    of any query but themselves. A product finds what may be among the best, and the exact
    score, computed pair by pair so that equal vectors tie, decides.
    """
    kinds = {"query_uid": "int64", "query_id": "int64", "vec_id": "int64", "uid": "int64", "score": "float64"}
    empty = pd.DataFrame({c: [] for c in kinds}).astype(kinds)
    if not len(queries) or not len(vectors):
        return empty
    vec_id, uid, lists = (vectors[c].to_numpy(np.int64) for c in ("id", "uid", "list"))
    raw = _matrix(vectors["v"])
    _, same = np.unique(raw, axis=0, return_inverse=True)
    order = np.lexsort((uid, vec_id, same.ravel(), lists))
    runs = np.concatenate([[True], (np.diff(same.ravel()[order]) != 0) | (np.diff(lists[order]) != 0)])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(runs, np.arange(len(order)), 0))
    keep = np.sort(order[rank <= k])
    vec_id, uid, lists, raw = vec_id[keep], uid[keep], lists[keep], raw[keep]
    length = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    unit = raw / length[:, None]
    rows_of = {x: np.flatnonzero(lists == x) for x in np.unique(lists)}
    out = []
    for at in range(0, len(queries), chunk):
        part = queries.iloc[at:at + chunk]
        q, q_uid = _matrix(part["v"]), part["uid"].to_numpy(np.int64)
        q_length = np.sqrt(np.einsum("ij,ij->i", q, q))
        asked: dict = {}
        for i, mine in enumerate(part["lists"]):
            for x in mine:
                asked.setdefault(x, []).append(i)
        pairs_q, pairs_v = [], []
        for x, who in asked.items():
            rows = rows_of.get(x)
            if rows is None:
                continue
            who = np.array(who)
            near = (q[who] / q_length[who, None]) @ unit[rows].T
            near[q_uid[who][:, None] == uid[rows][None, :]] = -np.inf
            if near.shape[1] > k:
                edge = -np.partition(-near, k - 1, axis=1)[:, k - 1]
                hit = (near >= edge[:, None] - 1e-9) & np.isfinite(near)
            else:
                hit = np.isfinite(near)
            a, b = np.nonzero(hit)
            pairs_q.append(who[a])
            pairs_v.append(rows[b])
        if not pairs_q:
            continue
        a, b = np.concatenate(pairs_q), np.concatenate(pairs_v)
        # A vector may be met in several lists.
        code = np.unique(a * np.int64(len(uid)) + b, return_index=True)[1]
        a, b = a[code], b[code]
        score = np.concatenate([
            np.einsum("ij,ij->i", q[a[i:i + 65_536]], raw[b[i:i + 65_536]]) / (q_length[a[i:i + 65_536]] * length[b[i:i + 65_536]])
            for i in range(0, len(a), 65_536)
        ])
        first = np.lexsort((uid[b], vec_id[b], -score, a))
        a, b, score = a[first], b[first], score[first]
        # The copies of a row in several lists follow each other; the first counts.
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(uid[b]) != 0)]) if len(a) else np.zeros(0, bool)
        a, b, score = a[new], b[new], score[new]
        begin = np.concatenate([[True], np.diff(a) != 0]) if len(a) else np.zeros(0, bool)
        place = np.arange(len(a)) - np.maximum.accumulate(np.where(begin, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
        best = place < k
        a, b, score = a[best], b[best], score[best]
        out.append(pd.DataFrame({"query_uid": q_uid[a], "query_id": part["id"].to_numpy(np.int64)[a],
                                 "vec_id": vec_id[b], "uid": uid[b], "score": score}))
    return pd.concat(out) if out else empty


def _mapped(batches: Iterator[pa.RecordBatch], names: list[str], make) -> Iterator[pa.RecordBatch]:
    """Rows made of (uid, id, v) batches: ``make`` gets the matrix and gives row numbers and new columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([np.asarray(v, float) for v in batch.column(2).to_pylist()])
        rows, extra = make(x, batch.column(0).to_numpy())
        take = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*take.columns, *extra], names=names)


def in_blocks(sent: DataFrame, vectors: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Deal the queries of a shard to blocks of about ``block``, and the shard's vectors to each of them.

    A shard has as many blocks as its own queries fill, so its vectors are copied by what
    is asked of it and not by the number of all queries; one that nobody asks goes nowhere.
    """
    asks = sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asks = materialize(asks, "asks")
    queries = join_small(sent, asks, ["shard"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    copied = join_small(vectors, asks, ["shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return queries.drop("blocks"), copied.drop("blocks")


def every_fiftieth(key: Column) -> Column:
    return key % 50 == 0


def nearest(df: DataFrame, queries: Callable[[Column], Column] = every_fiftieth, key: str = "vec_id", vector: str = "embedding", k: int = 5,
            sample: int = 20_000, list_rows: int = 64, copy_ratio: float = 1.08, copies: int = 4,
            search_ratio: float = 1.3, shard_rows: int = 5_000, block: int = 5_000) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest other rows found for each query row.

    The index is fitted on at most ``sample`` vectors and holds every usable one: each in
    the list of its nearest centroid and, near a border, in up to ``copies`` lists whose
    centroids are at most ``copy_ratio`` times as far. A query walks the graph of centroids
    and searches the 16 nearest lists and all up to ``search_ratio`` times as far as the nearest. Lists are
    dealt to shards of about ``shard_rows`` rows, large ones to several, and a shard meets
    the queries that ask for it in blocks of about ``block``, so no task grows with a list.

    ``queries`` gives the condition on the key that makes a row a query. Nearness is the cosine in double precision; ties
    go to the smaller id, null ids last. Vectors that are null, zero, of another length
    than most, or that hold a null or non-finite component take no part. Repeated rows are
    rows of their own: only the very row of the query is left out. Fewer than ``k`` other
    vectors give fewer rows; an empty table gives none.
    """
    rows = usable_vectors(df, key, vector)
    spark, total = rows.sparkSession, rows.count()
    asked = rows.filter(queries(F.col("id")))
    n_asked = asked.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not n_asked or total < 2:
        return spark.createDataFrame([], schema)
    index = fit(sample_of(rows, sample, total), list_rows)
    wide = max(32, len(index.centres) // 2)

    def deal(batches):
        def make(x, uid):
            found, lists = index.lists_of_rows(_unit(x), copy_ratio, copies)
            return found, [pa.array(lists, pa.int32())]

        return _mapped(batches, ["uid", "id", "v", "list"], make)

    posted = materialize(rows.select("uid", "id", "v").mapInArrow(deal, "uid bigint, id bigint, v array<double>, list int"), "lists")
    # One count for each centroid, of which the sample bounds the number.
    sizes = np.zeros(len(index.centres), np.int64)
    for r in posted.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    parts = np.maximum(1, -(-sizes // shard_rows))
    # Lists side by side share shards; a list of several parts has shards of its own.
    first, at, room = np.zeros(len(sizes), np.int64), 0, shard_rows
    for i, (n, p) in enumerate(zip(sizes, parts)):
        if p > 1 or n > room:
            at, room = at + 1, shard_rows
        first[i] = at
        at, room = (at + p, shard_rows) if p > 1 else (at, room - n)
    plan = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts))],
                                 "list int, first bigint, parts bigint")
    vectors = posted.join(F.broadcast(plan), "list")
    vectors = vectors.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts")))
    vectors = vectors.withColumn("id", F.coalesce("id", F.lit(_LAST))).drop("first", "parts")

    def choose(batches):
        def make(x, uid):
            found, shards, lists = [], [], []
            for i, q in enumerate(_unit(x)):
                mine: dict[int, list[int]] = {}
                for c in index.lists_of_query(q, search_ratio, wide).tolist():
                    for s in range(int(parts[c])):
                        mine.setdefault(int(first[c]) + s, []).append(c)
                found += [i] * len(mine)
                shards += mine.keys()
                lists += mine.values()
            return found, [pa.array(shards, pa.int64()), pa.array(lists, pa.list_(pa.int32()))]

        return _mapped(batches, ["uid", "id", "v", "shard", "lists"], make)

    spread = asked.select("uid", "id", "v").repartition(F.col("uid"))
    sent = spread.mapInArrow(choose, "uid bigint, id bigint, v array<double>, shard bigint, lists array<int>")
    sent, vectors = in_blocks(materialize(sent, "routed"), vectors, block)

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return nearest_in_shard(q, v, k)

    found = sent.groupBy("shard", "block").cogroup(vectors.groupBy("shard", "block")).applyInPandas(
        meet, "query_uid bigint, query_id bigint, vec_id bigint, uid bigint, score double")
    # A row may be found in several shards, with the same score.
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    shown = F.when(F.col("vec_id") < _LAST, F.col("vec_id"))
    return ranked.select("query_id", "rank", shown.alias("vec_id"), "score")
