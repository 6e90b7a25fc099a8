"""Incremental sync: process what is newer than the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.common import is_numeric, quoted
from flowlens.functions.numbers import parse_number
from flowlens.session import folder_names, path_exists

STATE_SCHEMA = "last_ts double, uid string"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def new_rows(df: DataFrame, state: DataFrame, ts: str = "ts", uid: str = "uid") -> DataFrame:
    """Rows that are newer than the checkpoint.

    ``state`` holds the last timestamp and every uid seen at it. Rows at that timestamp
    are new when their uid is unseen; older rows and rows without a readable timestamp
    are dropped. The uids stay a frame: a timestamp may have any number of them.
    """
    rows = _timed(df, ts)
    last = state.agg(F.max("last_ts")).first()[0]
    if last is not None:
        seen = state.filter(F.col("last_ts") == F.lit(last)).select(
            F.col("last_ts").alias("_ts"), F.col("uid").alias(uid)).distinct()
        rows = rows.filter(F.col("_ts") >= F.lit(last)).join(seen, ["_ts", uid], "left_anti")
    return rows.select(*df.columns)


def next_state(delta: DataFrame, state: DataFrame, ts: str = "ts", uid: str = "uid") -> DataFrame:
    """Checkpoint after a delta: its newest timestamp and the uids at it.

    When the newest timestamp is the old one, the old uids stay.
    """
    rows = _timed(delta, ts)
    last = state.agg(F.max("last_ts")).first()[0]
    newest = rows.agg(F.max("_ts")).first()[0]
    if newest is None:
        return state
    at_newest = rows.filter(F.col("_ts") == F.lit(newest)).select(
        F.col("_ts").alias("last_ts"), quoted(uid).cast("string").alias("uid"))
    if last == newest:
        at_newest = at_newest.unionByName(state.filter(F.col("last_ts") == F.lit(last)))
    return at_newest.distinct()


def _timed(df: DataFrame, ts: str) -> DataFrame:
    seconds = quoted(ts).cast("double") if is_numeric(df, ts) else parse_number(quoted(ts))
    return df.withColumn("_ts", seconds).filter(F.col("_ts").isNotNull() & ~F.isnan("_ts"))


def incremental_delta(df: DataFrame, state: DataFrame, ts: str = "ts",
                      uid: str = "uid") -> tuple[DataFrame, DataFrame]:
    """The new rows and the next checkpoint."""
    delta = new_rows(df, state, ts, uid)
    return delta, next_state(delta, state, ts, uid)


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Latest written checkpoint and its number; empty and 0 at the first run."""
    if not path_exists(spark, path):
        return empty_state(spark), 0
    # Only folder names are listed; of a checkpoint whose write was cut short the one before counts.
    versions = [int(n.removeprefix("version=")) for n in folder_names(spark, path) if n.startswith("version=")]
    whole = next((v for v in sorted(versions, reverse=True) if path_exists(spark, f"{path}/version={v}/_SUCCESS")), 0)
    if not whole:
        return empty_state(spark), 0
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/version={whole}"), whole


def sync_once(df: DataFrame, state_path: str, output_path: str) -> int:
    """Append the whole delta to the output, then write the next checkpoint.

    The checkpoint follows the output: a run that fails in between repeats its delta and
    writes the same batch folder again. Gives the number of new rows.
    """
    spark = df.sparkSession
    state, version = read_state(spark, state_path)
    batch = f"{output_path}/batch={version + 1}"
    new_rows(df, state).write.mode("overwrite").parquet(batch)
    delta = spark.read.schema(df.schema).parquet(batch)
    count = delta.count()
    if count:
        after = next_state(delta, state)
        after.write.mode("overwrite").parquet(f"{state_path}/version={version + 1}")
    return count


def dedup_stream(df: DataFrame, delay: str, ts: str = "ts", uid: str = "uid") -> DataFrame:
    """Streaming form of the delta: each uid once within the watermark delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([uid])
