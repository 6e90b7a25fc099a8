"""Ranking, prefix sums and joins that stay balanced when one group is hot.

A plain window over a group puts the whole group into one task. Here a group is cut into
slices (by hash prefix or by value range); each slice is ranked on its own and small
per-slice counts supply the offsets. Results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.common import quoted
from flowlens.session import join_small, small_table

_BEFORE = (Window.unboundedPreceding, -1)


def sample_key(seed: int, *columns: str) -> Column:
    """Repeatable pseudo-random order of rows: md5 of seed and row key."""
    key = F.concat_ws("~", *[quoted(c).cast("string") for c in columns])
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def slice_digits(rows: int, per_slice: int = 50_000) -> int:
    """Hex digits of a hash prefix that leave about ``per_slice`` rows or fewer in a slice."""
    return max(1, math.ceil(math.log(max(rows / per_slice, 1.0), 16)))


def _sliced(df: DataFrame, order: Column, digits: int | None) -> DataFrame:
    """Add the order key and its slice, a hash prefix that sorts like the key."""
    digits = slice_digits(df.count()) if digits is None else digits
    out = df.withColumn("_key", order)
    return out.withColumn("_slice", F.substring("_key", 1, digits))


def _renamed_names(group: Sequence[str]) -> list[str]:
    return [f"_g{i}" for i in range(len(group))]


def _renamed(group: Sequence[str]) -> list[Column]:
    return [quoted(g).alias(n) for g, n in zip(group, _renamed_names(group))]


def _same(group: Sequence[str]) -> list[Column]:
    """Join condition between a group and its renamed copy; NULL groups match."""
    return [quoted(g).eqNullSafe(F.col(n)) for g, n in zip(group, _renamed_names(group))]


def _slice_counts(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows per (group, slice) with the running and the total count of the group."""
    counts = df.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    by_slice = Window.partitionBy(*group).orderBy("_slice")
    return counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(by_slice.rowsBetween(*_BEFORE)), F.lit(0)),
        "_total": F.sum("_n").over(Window.partitionBy(*group)),
    })


def mark_first(df: DataFrame, group: Sequence[str], quota: Column, order: Column,
               ties: Sequence[str], flag: str = "_in", digits: int | None = None) -> DataFrame:
    """Flag the first ``quota`` rows of every group in hash order.

    ``quota`` may use ``_total``, the size of the group. Slices wholly inside or outside
    the quota are flagged where they are, without a shuffle; only the one slice per group
    that the quota cuts through is ranked.
    """
    group = list(group)
    sliced = _sliced(df, order, digits)
    counts = _slice_counts(sliced, group).withColumn("_quota", quota.cast("bigint"))
    # The first slice that does not fit is cut; what is left of the quota is taken there.
    split = F.col("_before") + F.col("_n") > F.col("_quota")
    cuts = counts.groupBy(*_renamed(group)).agg(
        F.min(F.when(split, F.col("_slice"))).alias("_cut"),
        F.min_by(F.col("_quota") - F.col("_before"), F.when(split, F.col("_before"))).alias("_take"),
    )
    marked = join_small(sliced, cuts, _same(group)).drop(*_renamed_names(group))
    whole = marked.filter(F.col("_cut").isNull() | (F.col("_slice") != F.col("_cut")))
    whole = whole.withColumn(flag, F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut")))
    ranked = Window.partitionBy(*group, "_slice").orderBy("_key", *ties)
    edge = marked.filter(F.col("_slice") == F.col("_cut"))
    edge = edge.withColumn(flag, F.row_number().over(ranked) <= F.col("_take"))
    extra = ["_key", "_slice", "_cut", "_take"]
    return whole.drop(*extra).unionByName(edge.drop(*extra))


def take_first(df: DataFrame, group: Sequence[str], quota: Column, order: Column,
               ties: Sequence[str], digits: int | None = None) -> DataFrame:
    """The first ``quota`` rows of every group in hash order."""
    marked = mark_first(df, group, quota, order, ties, digits=digits)
    return marked.filter("_in").drop("_in")


def exact_rank(df: DataFrame, group: Sequence[str], order: Column, ties: Sequence[str],
               name: str = "rank", digits: int | None = None) -> DataFrame:
    """1-based rank of every row within its group in hash order.

    Rows are spread over (group, slice), so a hot group is ranked by many tasks.
    """
    sliced = _sliced(df, order, digits)
    offsets = _slice_counts(sliced, group)
    offsets = offsets.select(*_renamed(group), F.col("_slice").alias("_s"), "_before")
    on = [*_same(group), F.col("_slice") == F.col("_s")]
    joined = join_small(sliced, offsets, on, max_rows=100_000).drop("_s", *_renamed_names(group))
    ranked = Window.partitionBy(*group, "_slice").orderBy("_key", *ties)
    rank = F.col("_before") + F.row_number().over(ranked)
    return joined.withColumn(name, rank).drop("_key", "_slice", "_before")


def prefix_sums(df: DataFrame, group: Sequence[str], order: str, sums: dict[str, str],
                descending: bool = False, slices: int | None = None) -> DataFrame:
    """Sum of the rows ordered before each row, per group.

    ``sums`` maps value column to result column. ``order`` is numeric and unique within a
    group (aggregate first). Slices are value ranges with near-equal row counts, cut in each
    group: their borders come from a quantile sketch, so they only balance the work and
    never change the result.
    """
    slices = max(2, min(4096, -(-df.count() // 50_000))) if slices is None else slices
    group = list(group) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if group == ["_all"] else df
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    borders = rows.groupBy(*group).agg(F.percentile_approx(order, shares, 10 * slices).alias("_borders"))
    sliced = join_small(rows, borders, group)
    # Borders rise: the slice is the number of borders below the value.
    sliced = sliced.withColumn("_slice", F.size(F.filter("_borders", lambda b: b < F.col(order)))).drop("_borders")
    totals = sliced.groupBy(*group, "_slice").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums]
    )
    key = F.col("_slice").desc() if descending else F.col("_slice").asc()
    over_slices = Window.partitionBy(*group).orderBy(key).rowsBetween(*_BEFORE)
    offsets = totals.select(
        *group, "_slice",
        *[F.coalesce(F.sum(f"_sum_{c}").over(over_slices), F.lit(0)).alias(f"_off_{c}") for c in sums],
    )
    joined = join_small(sliced, offsets, [*group, "_slice"])
    row = F.col(order).desc() if descending else F.col(order).asc()
    within = Window.partitionBy(*group, "_slice").orderBy(row).rowsBetween(*_BEFORE)
    out = joined.withColumns({
        result: F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))
        for c, result in sums.items()
    })
    return out.drop("_slice", "_all", *[f"_off_{c}" for c in sums])


def repeated(df: DataFrame, times: Column, per_task: int = 10_000) -> DataFrame:
    """Each row ``times`` times. The numbers are made in two steps, so no array is longer
    than ``per_task`` or its share of ``times``."""
    count = times.cast("bigint")
    parts = df.withColumn("_n", count).withColumn("_from", F.explode(F.when(
        F.col("_n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(per_task).cast("bigint")))))
    upto = F.least(F.col("_from") + per_task, F.col("_n")) - 1
    return parts.withColumn("_copy", F.explode(F.sequence("_from", upto))).drop("_n", "_from", "_copy")


def number_copies(df: DataFrame, name: str = "_copy", per_task: int = 100_000) -> DataFrame:
    """Number each row among the rows that are equal to it in every column, from 0.

    One pass over the input and one shuffle: equal rows become one counted row where they
    are read, so a row that a third of the table repeats travels once for each task. Counted
    rows are written out again in chunks of ``per_task``, which many tasks share. Doubles are
    equal as in a group: the two zeros are one, and so are all NaN. Maps are compared by
    their JSON.
    """
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    rows = df.select(*[F.to_json(quoted(c)).alias(c) if c in maps else quoted(c) for c in df.columns])
    counted = rows.groupBy(*[quoted(c) for c in rows.columns]).agg(F.count(F.lit(1)).alias("_n"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(per_task).cast("bigint"))
    parts = counted.withColumn("_from", F.explode(starts))
    upto = F.least(F.col("_from") + per_task, F.col("_n")) - 1
    out = parts.withColumn(name, F.explode(F.sequence("_from", upto)))
    return out.select(*[F.from_json(quoted(c), df.schema[c].dataType).alias(c) if c in maps else quoted(c) for c in df.columns], name)


def dealt(df: DataFrame, rows: int, per_task: int = 20_000) -> DataFrame:
    """``df`` in equal parts of about ``per_task`` of its ``rows`` rows, for work that is long for
    each row. Parts cut by their bytes hold ten times the rows when the table is ten times as large."""
    return df.repartition(max(1, -(-rows // per_task)))


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], row_key: Sequence[str],
                hot_rows: int = 1_000_000, salts: int = 64) -> DataFrame:
    """Inner join whose left side may have hot keys.

    Keys with at least ``hot_rows`` left rows are split over ``salts`` tasks and only
    their right rows are copied to each of them; all other keys join as usual. ``right``
    must be pre-aggregated, so that it has few rows per key.
    """
    on = list(on)
    # Hot keys come from a sample: missing one costs balance, never rows.
    share = min(1.0, 1000.0 / hot_rows)
    seen = left.select(*on) if share == 1.0 else left.select(*on).sample(share, seed=1)
    hot = seen.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_rows * share)
    hot = hot.select(*on, F.lit(True).alias("_hot"))
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    slot = F.pmod(F.xxhash64(*row_key), F.lit(salts)).cast("int")
    spread = join_small(left, hot, on, "left")
    spread = spread.withColumn("_salt", F.when(is_hot, slot).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = join_small(right, hot, on, "left")
    copied = copied.withColumn("_salt", F.explode(copies)).drop("_hot")
    return spread.join(copied, [*on, "_salt"]).drop("_salt")
