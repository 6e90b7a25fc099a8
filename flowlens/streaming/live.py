"""Live alert feeds, log scoring and refreshed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowlens.operators.alerts import sort_order
from flowlens.operators.features import conn_features
from flowlens.operators.models import Bundle, keep_raw, score_to_alerts
from flowlens.schemas import ALERT_SCHEMA
from flowlens.session import folder_names, path_exists, remove
from flowlens.sources.logs import parse_zeek_lines
from flowlens.streaming.follow import follow_log, followed_columns


def stream_alerts(spark: SparkSession, path: str, schema: StructType = ALERT_SCHEMA,
                  max_files: int = 1000) -> DataFrame:
    """Every row appended to a table, whoever wrote it; alerts unless another schema is given."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
          mode: str = "append", every: str | None = None, only_data: bool = False) -> StreamingQuery:
    """Run ``handler`` on each micro-batch; without ``every`` stop after what is there.

    ``only_data`` runs no batch without new rows. State with timers of the wall clock asks for
    such batches for ever, so a query over it stops by itself only with this.
    """
    conf, setting = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(setting, "true")
    writer = df.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    # A query keeps the settings of its start.
    conf.set(setting, "false" if only_data else before)
    try:
        return writer.start()
    finally:
        conf.set(setting, before)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_n(path: str, n: int = 25) -> Callable[[DataFrame, int], None]:
    """Keep the newest ``n`` alerts: each batch is merged with the page of the one before.

    Pages are numbered by batch, so a repeated batch rewrites the same page.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = rows.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/page={number - 1}"))
        rows.orderBy(*sort_order("-timestamp")).limit(n).write.mode("overwrite").parquet(f"{path}/page={number}")

    return write


def last_page(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.parquet(path)
    newest = pages.agg(F.max("page")).first()[0]
    return pages.filter(F.col("page") == newest).drop("page")


def score_stream(spark: SparkSession, path: str, columns: Sequence[str], bundle: Bundle,
                 mode: str = "serve", max_files: int = 1000, since: datetime | None = None) -> DataFrame:
    """Alerts of the rows of new log files. Files are complete when they appear.

    With ``since``, files last changed before that instant are skipped: only what is new
    from then on is scored.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    if since is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since)).select("value")
    rows = conn_features(keep_raw(parse_zeek_lines(lines, columns)), mode)
    return score_to_alerts(rows, bundle, "conn")


def score_followed(spark: SparkSession, path: str, columns: Sequence[str], bundle: Bundle, mode: str = "serve",
                   skip_existing: bool = False) -> DataFrame:
    """Alerts of the rows appended to growing logs, each scored once; see ``follow.follow_log``."""
    rows = followed_columns(follow_log(spark, path, skip_existing), columns)
    return score_to_alerts(conn_features(keep_raw(rows), mode), bundle, "conn")


def counts_per_hour(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running alert counts per hour and severity, for a query in update mode."""
    hour = F.window("timestamp", "1 hour")
    return alerts.withWatermark("timestamp", delay).groupBy(hour, "severity").agg(
        F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("bucket"), "severity", "count")


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts written by a query in update mode: the latest batch wins per bucket."""
    rows = spark.read.parquet(path)
    return rows.groupBy("bucket", "severity").agg(F.max_by("count", "batch").alias("count"))


# --- reused results --------------------------------------------------------------------

# Sums that add up over batches; means and ratios follow from them.
_FACTS = ("n", "malicious", "scored", "score")


def _facts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("batch", F.date_trunc("hour", "timestamp").alias("hour"), "severity", "attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("model_label") == "malicious").alias("malicious"),
        F.count("model_score").alias("scored"), F.coalesce(F.sum("model_score"), F.lit(0.0)).alias("score"))


def refreshed_facts(spark: SparkSession, path: str, reuse: str, every: int = 50) -> DataFrame:
    """Sums per hour, severity and attack type of a table written in batches (``batch_writer``).

    The result is kept under ``reuse`` by batch: a call reads only the batches that were
    written since the one before, so without a write it reads no alert. A batch is known by
    its folder, and a batch that is written again under its number is the same by
    contract. Sums are added as one folder a call and count only when that is complete;
    every ``every`` folders they are merged into one.
    """
    def complete() -> list[str]:
        return [f"{reuse}/{f}" for f in sorted(folder_names(spark, reuse)) if path_exists(spark, f"{reuse}/{f}/_SUCCESS")]

    schema = "batch int, hour timestamp, severity string, attack_type string, n bigint, malicious bigint, scored bigint, score double"
    parts = complete()
    known = {f"batch={r.batch}" for r in spark.read.schema(schema).parquet(*parts).select("batch").distinct().collect()} if parts else set()
    new = [f for f in folder_names(spark, path) if f.startswith("batch=") and f not in known]
    if new:
        rows = spark.read.option("basePath", path).schema(ALERT_SCHEMA).parquet(*[f"{path}/{f}" for f in new])
        # A batch without rows is known, too.
        marks = spark.createDataFrame([(int(f[6:]),) for f in new], "batch int")
        facts = _facts(rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)/[^/]*$", 1).cast("int")))
        marks.join(facts, "batch", "left").select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{reuse}/{uuid.uuid4().hex}")
        parts = complete()
    if len(parts) > every:
        merged = f"{reuse}/{uuid.uuid4().hex}"
        spark.read.schema(schema).parquet(*parts).coalesce(8).write.parquet(merged)
        for old in parts:
            remove(spark, old)
        parts = [merged]
    facts = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return facts.filter("n is not null").groupBy("hour", "severity", "attack_type").agg(*[F.sum(c).alias(c) for c in _FACTS])


def reused_counts(spark: SparkSession, path: str, reuse: str) -> DataFrame:
    """Alerts of every severity with mean score and share of malicious ones, from the kept sums."""
    facts = refreshed_facts(spark, path, reuse).groupBy("severity").agg(*[F.sum(c).alias(c) for c in _FACTS])
    return facts.select("severity", F.col("n").alias("count"), F.coalesce(F.try_divide("score", F.col("scored")), F.lit(0.0)).alias("avg_score"),
                        (F.col("malicious") * F.lit(100.0) / F.col("n")).alias("malicious_ratio"))
