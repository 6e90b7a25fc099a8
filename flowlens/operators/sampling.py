"""Class balancing: samples, caps, splits, weights and oversampling plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.common import lookup, quoted
from flowlens.operators.skew import mark_first, sample_key, take_first


def sample_per_class(df: DataFrame, column: str, n: int = 2000, seed: int = 42,
                     row_key: Sequence[str] = ("uid",)) -> DataFrame:
    """Up to ``n`` rows of every class."""
    return take_first(df, [column], F.lit(n), sample_key(seed, *row_key), row_key)


def cap_classes(df: DataFrame, column: str, caps: Mapping[str, int] = S.CLASS_CAPS, seed: int = 42,
                row_key: Sequence[str] = ("uid",)) -> DataFrame:
    """Cut the named classes to their cap; the others stay whole."""
    cap = F.coalesce(lookup(caps, quoted(column)), F.col("_total"))
    return take_first(df, [column], cap, sample_key(seed, *row_key), row_key)


def stratified_split(df: DataFrame, column: str | None, test: float = 0.2, seed: int = 42,
                     row_key: Sequence[str] = ("uid",)) -> tuple[DataFrame, DataFrame]:
    """Train and test frames; every class gives the same share to the test set."""
    marked = mark_split(df, column, test, seed, row_key)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def mark_split(df: DataFrame, column: str | None, test: float = 0.2, seed: int = 42,
               row_key: Sequence[str] = ("uid",)) -> DataFrame:
    """Add ``is_test``. Without a class column the split is not stratified."""
    group = [column] if column else ["_all"]
    frame = df if column else df.withColumn("_all", F.lit(1))
    quota = F.floor(F.col("_total") * F.lit(test) + F.lit(0.5))
    out = mark_first(frame, group, quota, sample_key(seed, *row_key), row_key, flag="is_test")
    return out if column else out.drop("_all")


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """Balanced class weights ``n / (k * n_class)``."""
    counts = df.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per class
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.withColumn("weight", weight)


def class_shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Class counts before and after balancing with their difference."""
    left = before.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("count_before"))
    right = after.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("count_after"))
    joined = left.join(right, column, "left")
    joined = joined.withColumn("count_after", F.coalesce("count_after", F.lit(0)))
    return joined.withColumn("diff", F.col("count_after") - F.col("count_before"))


def smote_plan(counts: DataFrame, mode: str, value: str = "n") -> DataFrame:
    """Target size per class: add ``target`` (never below the current size).

    ``full``       every class to the largest.
    ``dynamic``    classes below a base size to that base; the base is 1.5 medians, at
                   least 5000, at most the largest class. Needs two classes of two rows.
    ``threshold``  classes of 300 up to 15000 rows to 15000.
    ``none``       nothing.
    """
    everything = Window.partitionBy()  # one row per class
    n = F.col(value)
    largest = F.max(n).over(everything)
    if mode == "full":
        target: Column = largest
    elif mode == "dynamic":
        median = F.percentile(n, F.lit(0.5)).over(everything)
        base = F.least(largest, F.greatest(F.lit(5000), F.floor(median * F.lit(1.5))))
        cap = F.least(largest, base * 3)
        possible = (F.count(F.lit(1)).over(everything) > 1) & (F.min(n).over(everything) >= 2)
        target = F.when(possible & (n < base), F.least(base, cap)).otherwise(n)
    elif mode == "threshold":
        wanted = (n >= S.SMOTE_THRESHOLD_MIN) & (n < S.SMOTE_THRESHOLD_TARGET)
        target = F.when(wanted, F.lit(S.SMOTE_THRESHOLD_TARGET)).otherwise(n)
    elif mode == "none":
        target = n
    else:
        raise ValueError(f"unknown mode: {mode}")
    return counts.withColumn("target", target.cast("bigint"))


def neighbour_count(plan: DataFrame, mode: str, value: str = "n") -> int:
    """Neighbours used for oversampling: five, fewer when the smallest class is smaller."""
    if mode == "threshold":
        return 5
    grown = plan.filter(F.col("target") > F.col(value)) if mode == "dynamic" else plan
    if mode == "dynamic":
        grown = grown.filter(F.col(value) > 1)
    smallest = grown.agg(F.min(value)).first()[0]
    return max(1, min(5, (smallest if smallest is not None else 2) - 1))


def rank_features(importance: DataFrame) -> DataFrame:
    """1-based rank by falling importance; the table has one row per feature."""
    order = Window.orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(order))
