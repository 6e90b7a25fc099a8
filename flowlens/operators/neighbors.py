"""Exact nearest neighbours within a class.

Vectors are cut into axis-parallel cells of bounded size. A query first searches its own
cell, which gives a radius; it is then sent only to the cells whose bounding box lies
within that radius. The cuts come from samples, which affect the balance of the work
but not the result. Equal vectors are collapsed first and carry their multiplicity.

The tree of cells is a table: each round cuts every cell that is too large into up to 64,
in the tasks, and the boxes of all rounds are rows that queries are joined to, level by
level. Neither the cells nor their boxes pass through the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

# Executors get the helpers of this module with the task; nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FOUND = "array<struct<d:double,key:string,m:bigint,vec:array<double>>>"
_FAN_DEPTH = 6  # a round cuts a cell into at most 2 ** 6
_SAMPLE = 4096  # about as many vectors of a cell decide its cuts


def plan_cuts(points: np.ndarray, pieces: int) -> tuple[list[int], list[float]]:
    """Cuts of a cell at medians of its widest axes, as a heap: node 1 is the cell, the
    children of node i are 2i and 2i + 1, and axis -1 marks a part that stays whole."""
    axes, cuts = [-1] * (2 << _FAN_DEPTH), [0.0] * (2 << _FAN_DEPTH)

    def cut(node: int, part: np.ndarray, pieces: int) -> None:
        if pieces < 2 or len(part) < 2 or node >= 1 << _FAN_DEPTH:
            return
        spread = part.max(axis=0) - part.min(axis=0)
        axis = int(spread.argmax())
        if not spread[axis] > 0:
            return
        values = np.sort(part[:, axis])
        at = float(values[(len(values) - 1) // 2])
        if at >= values[-1]:
            at = float(values[values < values[-1]][-1])
        axes[node], cuts[node] = axis, at
        low = part[:, axis] <= at
        cut(2 * node, part[low], pieces // 2)
        cut(2 * node + 1, part[~low], pieces - pieces // 2)

    cut(1, points, pieces)
    return axes, cuts


def _below(vec: str, axes: str, cuts: str) -> Column:
    """Number of the part that a vector falls into, walking down the heap of its cell."""
    def step(node: Column, _: Column) -> Column:
        axis = F.get(axes, node)
        right = F.get(vec, axis) > F.get(cuts, node)
        return F.when(axis < 0, node).otherwise(node * 2 + right.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_FAN_DEPTH)), F.lit(1), step)


def _boxes(points: DataFrame, width: int, max_cell: int) -> DataFrame:
    """Rows and lowest and highest corner of the points of every cell, and whether it is final:
    small enough, or a part 1, which is a cell without a cut."""
    n = F.count(F.lit(1))
    return points.groupBy("cell").agg(
        n.alias("n"), ((n <= max_cell) | F.endswith("cell", F.lit("/1"))).alias("final"),
        F.array(*[F.min(F.get("vec", F.lit(i))) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.get("vec", F.lit(i))) for i in range(width)]).alias("high"),
    )


def _root(cls: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.hex(cls)), F.lit(""))


def build_cells(points: DataFrame, max_cell: int = 4096) -> tuple[DataFrame, list[DataFrame]]:
    """The points (``cls, vec, key, m``) with their ``cell`` of at most ``max_cell`` rows, and
    the boxes of each level.

    A level is a table ``parent, cell, n, final, low, high``; cells of the first level are
    whole classes. A final cell has no rows in the levels below it. Vectors are finite and of
    one length; as they are distinct, a cell that is too large can be cut.
    """
    first = points.select(F.size("vec").alias("width")).first()
    width = first.width if first else 0
    located = points.withColumn("cell", _root("cls"))
    boxes = materialize(_boxes(located, width, max_cell), "boxes")
    levels = [boxes.withColumn("parent", F.lit(""))]
    while not (big := boxes.filter(~F.col("final")).select("cell", "n")).isEmpty():
        wanted = F.xxhash64("key", F.lit(len(levels))).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
        drawn = located.join(big, "cell").filter(wanted * F.col("n") < F.lit(_SAMPLE)).select("cell", "n", "vec")

        def cuts_of(part: pd.DataFrame) -> pd.DataFrame:
            pieces = min(1 << _FAN_DEPTH, -(-2 * int(part["n"].iloc[0]) // max_cell))
            axes, cuts = plan_cuts(np.vstack(part["vec"].to_numpy()), pieces)
            return pd.DataFrame({"cell": [part["cell"].iloc[0]], "axes": [axes], "cuts": [cuts]})

        trees = materialize(drawn.groupBy("cell").applyInPandas(
            cuts_of, "cell string, axes array<int>, cuts array<double>"), "cuts")
        walked = located.join(trees, "cell", "left").withColumn("parent", F.col("cell")).withColumn(
            "cell", F.when(F.col("axes").isNull(), F.col("cell"))
            .otherwise(F.concat("cell", F.lit("/"), _below("vec", "axes", "cuts").cast("string"))))
        located = materialize(walked.drop("axes", "cuts"), "cells")
        moved = located.filter("cell <> parent")
        parents = moved.groupBy("cell").agg(F.first("parent").alias("parent"))
        boxes = materialize(_boxes(moved, width, max_cell).join(parents, "cell"), "boxes")
        levels.append(boxes)
        located = located.drop("parent")
    return located, levels


def _gap(low: str, high: str, vec: str) -> Column:
    """Squared distance from a vector to a box."""
    outside = F.zip_with(F.zip_with(low, vec, lambda a, x: F.greatest(a - x, F.lit(0.0))),
                         F.zip_with(high, vec, lambda b, x: F.greatest(x - b, F.lit(0.0))), lambda a, b: a + b)
    return F.aggregate(outside, F.lit(0.0), lambda total, x: total + x * x)


def reached_cells(asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Other cells within the radius of each query (``cls, key, vec, cell, radius``), as
    ``cls, qkey, qvec, cell``: queries go down level by level to the boxes their ball meets. The first level has only their own class."""
    at = asked.select("cls", F.col("key").alias("qkey"), F.col("vec").alias("qvec"), F.col("cell").alias("own"),
                      # A little more than the radius, for sums that were rounded in another order.
                      (F.col("radius") * F.lit(1 + 1e-9)).alias("reach"), _root("cls").alias("parent"))
    out = None
    for level in levels[1:]:
        met = at.join(level, "parent").filter(_gap("low", "high", "qvec") <= F.col("reach"))
        met = materialize(met.select("cls", "qkey", "qvec", "own", "reach", F.col("cell").alias("parent"), "final"), "met")
        here = met.filter(F.col("final") & (F.col("parent") != F.col("own")))
        here = here.select("cls", "qkey", "qvec", F.col("parent").alias("cell"))
        out = here if out is None else out.unionByName(here)
        at = met.filter(~F.col("final")).drop("final")
    return out


def _nearest(query: np.ndarray, points: np.ndarray, keys: np.ndarray, mult: np.ndarray,
             own: np.ndarray | None, k: int) -> Iterator[list[int]]:
    """Positions of the nearest points until they cover ``k`` rows besides the query."""
    step = max(1, 2_000_000 // max(1, points.size))
    for start in range(0, len(query), step):
        block = query[start:start + step]
        dist = ((block[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        for i, d in enumerate(dist):
            want = k + (1 if own is not None else 0)
            near = np.flatnonzero(d <= np.partition(d, min(want, len(d)) - 1)[min(want, len(d)) - 1])
            order = near[np.lexsort((keys[near], d[near]))]
            picked, rows = [], 0
            for j in order:
                copies = int(mult[j]) - (1 if own is not None and keys[j] == own[start + i] else 0)
                if copies > 0:
                    picked.append((float(d[j]), int(j), copies))
                    rows += copies
                if rows >= k:
                    break
            yield picked


def _as_found(picked: list, keys: np.ndarray, points: np.ndarray) -> list[dict]:
    return [{"d": d, "key": keys[j], "m": m, "vec": points[j].tolist()} for d, j, m in picked]


def nearest_in_class(rows: DataFrame, k: int, queries: DataFrame | None = None,
                     max_cell: int = 4096) -> DataFrame:
    """The ``k`` nearest rows of the same class for every distinct vector.

    ``rows`` has ``cls`` (string) and ``vec`` (array of double). ``queries`` restricts the
    answer to its distinct ``(cls, vec)``. Result: ``cls, vec, neighbours`` with
    ``neighbours`` an array of up to ``k`` vectors, nearest first; a row is not its own
    neighbour, but its copies are.
    """
    points = rows.groupBy("cls", "vec").agg(F.count(F.lit(1)).alias("m"))
    points = points.withColumn("key", F.md5(F.concat_ws("|", "cls", F.to_json("vec"))))
    points = materialize(points, "points")
    located, levels = build_cells(points, max_cell)
    wanted = located
    if queries is not None:
        # Queries are a subset of the points, matched by their key.
        asked = queries.select(
            F.md5(F.concat_ws("|", "cls", F.to_json("vec"))).alias("key")).distinct()
        wanted = located.join(asked, "key", "left_semi")

    # 1. Search the own cell. The radius is infinite when the cell holds too few rows.
    def own_cell(points_pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.vstack(points_pdf["vec"].to_numpy())
        keys, mult = points_pdf["key"].to_numpy(), points_pdf["m"].to_numpy()
        ask = np.flatnonzero(points_pdf["asked"].to_numpy())
        found, radius = [], []
        for picked in _nearest(vectors[ask], vectors, keys, mult, keys[ask], k):
            full = sum(m for _, _, m in picked) >= k
            found.append(_as_found(picked, keys, vectors))
            radius.append(picked[-1][0] if full else float("inf"))
        out = points_pdf.iloc[ask][["cls", "vec", "key", "cell"]].copy()
        # Named types: a cell in which nothing is asked gives empty columns, which have none of their own.
        out["radius"] = pd.Series(radius, index=out.index, dtype="float64")
        out["found"] = pd.Series(found, index=out.index, dtype="object")
        return out

    if queries is None:
        marked = located.withColumn("asked", F.lit(True))
    else:
        marked = located.join(wanted.select("key", F.lit(True).alias("asked")), "key", "left")
        marked = marked.withColumn("asked", F.coalesce("asked", F.lit(False)))
    local = marked.groupBy("cls", "cell").applyInPandas(
        own_cell, f"cls string, vec array<double>, key string, cell string, radius double, found {_FOUND}"
    )
    if len(levels) == 1:
        # Every class is a single cell: nothing lies elsewhere.
        return _merged(local.select("cls", "vec", "key", "found"), k)
    local = materialize(local, "local")

    # 2. Send each query to the other cells its radius reaches.
    trips = materialize(reached_cells(local, levels), "trips")
    # A cell asked by very many queries is copied, one copy per block of queries.
    load = trips.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(20_000.0)).alias("blocks"))
    trips = trips.join(load, "cell").withColumn(
        "block", F.pmod(F.xxhash64("qkey"), F.col("blocks"))).drop("blocks")
    targets = located.join(load, "cell").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))

    def other_cell(asked: pd.DataFrame, points_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(points_pdf):
            return pd.DataFrame({"cls": [], "vec": [], "key": [], "found": []})
        vectors = np.vstack(points_pdf["vec"].to_numpy())
        keys, mult = points_pdf["key"].to_numpy(), points_pdf["m"].to_numpy()
        query = np.vstack(asked["qvec"].to_numpy())
        found = [_as_found(p, keys, vectors) for p in _nearest(query, vectors, keys, mult, None, k)]
        return pd.DataFrame({"cls": asked["cls"].to_numpy(), "vec": list(asked["qvec"]),
                             "key": asked["qkey"].to_numpy(), "found": found})

    remote = trips.groupBy("cell", "block").cogroup(targets.groupBy("cell", "block")).applyInPandas(
        other_cell, f"cls string, vec array<double>, key string, found {_FOUND}"
    )
    return _merged(local.select("cls", "vec", "key", "found").unionByName(remote), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of the candidates of each query, copies counted."""
    best = found.groupBy("cls", "key").agg(
        F.first("vec").alias("vec"), F.array_sort(F.flatten(F.collect_list("found"))).alias("near")
    )
    rows = F.flatten(F.transform("near", lambda x: F.array_repeat(x["vec"], F.least(x["m"], F.lit(k)).cast("int"))))
    return best.select("cls", "vec", F.slice(rows, 1, k).alias("neighbours"))
