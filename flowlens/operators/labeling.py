"""Labelling connections with flow labels, and class filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import labels as L
from flowlens.functions.common import quoted, strip
from flowlens.operators.features import column_named
from flowlens.operators.skew import repeated, spread_join


def with_flow_id(df: DataFrame, name: str = "flow_id") -> DataFrame:
    """Add the flow id of a connection."""
    parts = [column_named(df, c) for c in ("id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p")]
    return df.withColumn(name, L.flow_id(*[quoted(p) for p in parts], quoted("proto")))


def label_by_flow(conn: DataFrame, flows: DataFrame, by_day: bool = False, expand: bool = False,
                  row_key: Sequence[str] = ("uid",), hot_rows: int | None = None) -> DataFrame:
    """Label connections by flow id (and day).

    ``conn`` has ``flow_id`` (and ``day``); ``flows`` has ``flow_id``, ``Label`` (and
    ``day``). A flow id may occur on both sides many times. The flow side is reduced to
    one row per flow id and label first, and the number of matching flow rows is kept in
    ``n_matches``: one output row per connection and label instead of every pair.
    ``expand`` repeats the rows ``n_matches`` times, as a plain join would.

    The flow side has few rows a key, so Spark splits a hot key of the other side at run
    time. ``hot_rows`` salts such keys by hand, for clusters without adaptive execution.
    """
    keys = ["day", "flow_id"] if by_day else ["flow_id"]
    flows = flows.select(*keys, "Label").withColumn("flow_id", strip("flow_id"))
    labels = flows.groupBy(*keys, "Label").agg(F.count(F.lit(1)).alias("n_matches"))
    joined = conn.join(labels, keys) if hot_rows is None else spread_join(conn, labels, keys, row_key, hot_rows=hot_rows)
    if not expand:
        return joined
    return repeated(joined, F.col("n_matches")).drop("n_matches")


def keep_classes(df: DataFrame, column: str, classes: Sequence[str] = S.ATTACK_TYPES) -> DataFrame:
    return df.filter(quoted(column).isin(list(classes)))


def drop_negative(df: DataFrame) -> DataFrame:
    """Drop rows whose duration or byte counts are negative."""
    bad = (F.col("duration") < 0) | (F.col("orig_bytes") < 0) | (F.col("resp_bytes") < 0)
    return df.filter(~F.coalesce(bad, F.lit(False)))


def drop_unmapped(df: DataFrame, column: str, required: bool = False) -> DataFrame:
    """Drop rows without a class; with ``required`` an empty result is an error."""
    kept = df.filter(quoted(column).isNotNull())
    if required and kept.isEmpty():
        raise ValueError(f"no row has a known {column}")
    return kept


def only_attacks(df: DataFrame, column: str = "Label") -> DataFrame:
    return df.filter(quoted(column) != "BENIGN")


def only_correct(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.filter(quoted(truth) == quoted(prediction))


def matches_weight(df: DataFrame) -> Column:
    """Row weight of a labelled frame: the fan-out when it was not expanded."""
    return F.col("n_matches") if "n_matches" in df.columns else F.lit(1).cast("bigint")
