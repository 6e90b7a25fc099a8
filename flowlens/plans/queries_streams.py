"""Registered queries: streaming jobs run over files of the tables until they are done."""

from __future__ import annotations

from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.operators import features as X
from flowlens.operators import models as M
from flowlens.plans.queries_labels import FLOWS_SQL, shown_flows
from flowlens.plans.registry import query
from flowlens.plans.views import Tables
from flowlens.schemas import CLASS_NAMES, CONN_FEATURES
from flowlens.session import scratch_dir
from flowlens.sources import sinks
from flowlens.streaming import live, packets, sync

_LOG_COLUMNS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
                "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]


def _run(df: DataFrame, sink, mode: str = "append", checkpoint: str | None = None, only_data: bool = False) -> int:
    """Run a stream over the files that are there; gives the number of its last batch."""
    job = live.start(df, sink, checkpoint or scratch_dir(df.sparkSession, "checkpoint"), mode, only_data=only_data)
    job.awaitTermination()
    return max((p["batchId"] for p in job.recentProgress), default=0)


def _feed(rows: DataFrame, time: str, steps: int, make_stream, sink, mode: str = "append") -> int:
    """Deliver rows in steps of time: after each one the stream runs on what is new.

    Gives the number of the last batch.
    """
    spark = rows.sparkSession
    feed, checkpoint = scratch_dir(spark, "feed"), scratch_dir(spark, "checkpoint")
    low, high = rows.agg(F.min(time), F.max(time)).first()
    edges = [low + (high - low) * i / steps for i in range(1, steps)]
    last = 0
    for start, end in zip([None, *edges], [*edges, None]):
        part = rows if start is None else rows.filter(F.col(time) >= F.lit(start))
        part = part if end is None else part.filter(F.col(time) < F.lit(end))
        part.write.mode("append").parquet(feed)
        last = max(last, _run(make_stream(feed), sink, mode, checkpoint))
    return last


@query("st1_stream_alerts", "alerts", "SELECT id, epoch_us(timestamp) AS micros, severity, attack_type, model_score FROM alerts")
def st1(t: Tables) -> DataFrame:
    out = scratch_dir(t.spark, "live")
    _feed(t.alerts(), "timestamp", 2, lambda feed: live.stream_alerts(t.spark, feed), live.batch_writer(out))
    return t.spark.read.parquet(out).select("id", F.unix_micros("timestamp").alias("micros"), "severity", "attack_type", "model_score")


@query("st2_sync_once", "conn", """
WITH m AS (SELECT (min(ts_epoch) + max(ts_epoch)) / 2 AS middle FROM conn)
SELECT 1 AS run, count(*) AS n FROM conn, m WHERE ts_epoch <= middle UNION ALL
SELECT 2, count(*) FROM conn, m WHERE ts_epoch > middle UNION ALL SELECT 3, 0""")
def st2_sync(t: Tables) -> DataFrame:
    rows = t.conn().select("uid", F.col("ts_epoch").alias("ts"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    state, out = scratch_dir(t.spark, "state"), scratch_dir(t.spark, "synced")
    first = sync.sync_once(rows.filter(F.col("ts") <= F.lit((low + high) / 2)), state, out)
    second = sync.sync_once(rows, state, out)
    third = sync.sync_once(rows, state, out)
    return t.spark.createDataFrame([(1, first), (2, second), (3, third)], "run int, n bigint")


@query("st2_dedup_stream", "conn", "SELECT uid, epoch_us(ts) AS micros FROM conn")
def st2_dedup(t: Tables) -> DataFrame:
    rows = t.conn().select("uid", "ts")
    feed, out = scratch_dir(t.spark, "feed"), scratch_dir(t.spark, "unique")
    rows.unionByName(rows.filter(F.col("uid").endswith("7"))).write.parquet(feed)
    stream = t.spark.readStream.schema(rows.schema).parquet(feed)
    _run(sync.dedup_stream(stream, "60 days"), live.batch_writer(out))
    return t.spark.read.parquet(out).select("uid", F.unix_micros("ts").alias("micros"))


@query("st3_score_stream", "alerts", """
SELECT attack_type, CASE attack_type WHEN 'BENIGN' THEN 'Low' ELSE 'Critical' END AS severity, count(*) AS n FROM alerts GROUP BY 1, 2""")
def st3(t: Tables) -> DataFrame:
    rows = t.conn().drop("ts").withColumnRenamed("ts_epoch", "ts")
    # The port decides the class: a tree that sees it must score every row right.
    training = X.conn_features(t.conn(), "serve").withColumn("cls", L.label_to_attack("label"))
    bundle = M.train_dt(training, [*CONN_FEATURES, "id_resp_p"], "cls", CLASS_NAMES, depth=6)
    feed, out = scratch_dir(t.spark, "logs"), scratch_dir(t.spark, "scored")
    sinks.write_zeek_log(rows, feed, _LOG_COLUMNS)
    _run(live.score_stream(t.spark, feed, _LOG_COLUMNS, bundle), live.batch_writer(out))
    return t.spark.read.parquet(out).groupBy("attack_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def _append_lines(rows: DataFrame, folder: str, header: str) -> None:
    """Append rows to one log file a partition, as a sensor does; new files begin with the header."""
    cells = [F.coalesce(F.col(c.replace(".", "_")).cast("string"), F.lit("-")) for c in _LOG_COLUMNS]
    lines = rows.select(F.concat_ws("\t", *cells).alias("value"))

    def append(part) -> None:
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base)
        file = f"{base}/conn-{TaskContext.get().partitionId()}.log"
        new = fs.get_file_info(file).type == FileType.NotFound
        with fs.open_append_stream(file) as out:
            if new:
                out.write(header.encode() + b"\n")
            for row in part:
                out.write(row["value"].encode() + b"\n")

    lines.foreachPartition(append)


@query("st3_growing_file", "alerts", """
SELECT attack_type, CASE attack_type WHEN 'BENIGN' THEN 'Low' ELSE 'Critical' END AS severity, count(*) AS n FROM alerts GROUP BY 1, 2""")
def st3_growing(t: Tables) -> DataFrame:
    """Logs that grow between three starts of one query: each line is scored once."""
    rows = t.conn().drop("ts").withColumnRenamed("ts_epoch", "ts").coalesce(8)
    training = X.conn_features(t.conn(), "serve").withColumn("cls", L.label_to_attack("label"))
    bundle = M.train_dt(training, [*CONN_FEATURES, "id_resp_p"], "cls", CLASS_NAMES, depth=6)
    feed, out, checkpoint = (scratch_dir(t.spark, n) for n in ("logs", "scored", "checkpoint"))
    for i in range(3):
        _append_lines(rows.filter(F.col("event_id") % 3 == i), feed, "\t".join(["#fields", *_LOG_COLUMNS]))
        _run(live.score_followed(t.spark, feed, _LOG_COLUMNS, bundle), live.batch_writer(out), checkpoint=checkpoint)
    return t.spark.read.parquet(out).groupBy("attack_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def _flow_states(t: Tables, rows: DataFrame) -> DataFrame:
    """Flows from keyed state, after three deliveries that do not follow the time of the packets."""
    feed, out, checkpoint = (scratch_dir(t.spark, n) for n in ("packets", "flows", "checkpoint"))
    for i in range(3):
        rows.filter(F.pmod(F.xxhash64("uid", "ts", "is_orig", "len"), F.lit(3)) == i).write.mode("append").parquet(feed)
        stream = t.spark.readStream.schema(rows.schema).parquet(feed)
        _run(packets.flow_states(stream, idle_seconds=1e9), live.batch_writer(out), "update", checkpoint, only_data=True)
    return shown_flows(packets.last_records(t.spark, out))


@query("st4_flow_states", "packets", FLOWS_SQL.format(idle=", idle AS idle_min"))
def st4_states(t: Tables) -> DataFrame:
    return _flow_states(t, t.packets())


@query("st4_wrong_date", "packets", FLOWS_SQL.format(idle=", idle AS idle_min").replace("FROM packets)", """FROM (
  SELECT uid, ts, is_orig, flags, len FROM packets UNION ALL
  SELECT uid, CASE WHEN min(len) % 2 = 0 THEN TIMESTAMP '2200-01-01' ELSE TIMESTAMP '1980-01-01' END, true, 'A', 7 FROM packets GROUP BY uid) p)"""))
def st4_wrong(t: Tables) -> DataFrame:
    """A packet of every flow is dated far ahead or far back."""
    rows = t.packets().select("uid", F.col("ts").cast("timestamp").alias("ts"), "is_orig", "flags", F.col("len").cast("bigint").alias("len"))
    wrong = rows.groupBy("uid").agg(F.when(F.min("len") % 2 == 0, F.lit("2200-01-01")).otherwise(F.lit("1980-01-01")).cast("timestamp").alias("ts"))
    wrong = wrong.select("uid", "ts", F.lit(True).alias("is_orig"), F.lit("A").alias("flags"), F.lit(7).cast("bigint").alias("len"))
    return _flow_states(t, rows.unionByName(wrong))


@query("st4_flows_from_packets", "packets", FLOWS_SQL.format(idle=", idle AS idle_min"))
def st4(t: Tables) -> DataFrame:
    # No flow is closed by idleness here, so that flows equal those of the batch operator.
    sink = packets.FlowSink(scratch_dir(t.spark, "flows"), idle_seconds=1e9)
    schema = t.spark.createDataFrame([], packets.PACKET_SCHEMA).schema
    last = _feed(t.packets(), "ts", 3, lambda feed: live.stream_alerts(t.spark, feed, schema), sink)
    return shown_flows(sink.flows(t.spark, last))


@query("st4_out_of_order", "packets", FLOWS_SQL.format(idle=""))
def st4_late(t: Tables) -> DataFrame:
    """Packets come in three deliveries that do not follow their time, and one of them is dated far ahead."""
    sink = packets.FlowSink(scratch_dir(t.spark, "flows"), idle_seconds=1e9)
    rows, schema = t.packets(), t.spark.createDataFrame([], packets.PACKET_SCHEMA).schema
    wrong = t.spark.range(1).select(F.lit("wrong").alias("uid"), F.lit("2200-01-01").cast("timestamp").alias("ts"),
                                    F.lit(True).alias("is_orig"), F.lit("A").alias("flags"), F.lit(0).cast("bigint").alias("len"))
    feed, checkpoint, last = scratch_dir(t.spark, "feed"), scratch_dir(t.spark, "checkpoint"), 0
    for i in range(3):
        part = rows.filter(F.pmod(F.xxhash64("uid", "ts", "is_orig", "len"), F.lit(3)) == i)
        (part.unionByName(wrong) if i == 0 else part).write.mode("append").parquet(feed)
        last = max(last, _run(live.stream_alerts(t.spark, feed, schema), sink, "append", checkpoint))
    return shown_flows(sink.flows(t.spark, last).filter("uid <> 'wrong'"), idle=False)


_SESSIONS_SQL = FLOWS_SQL.format(idle=", idle AS idle_min").replace("FILTER (gap > 0)", "FILTER (gap BETWEEN 1 AND 7776000000000)").replace(
    "WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY uid ORDER BY ts) AS gap FROM packets),",
    """WITH b AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY uid ORDER BY ts) AS gap FROM packets),
g AS (SELECT *, sum(CASE WHEN gap > 7776000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY ts) AS part FROM b),"""
).replace("FROM g GROUP BY uid)", "FROM g GROUP BY uid, part)")


@query("st4_flow_sessions", "packets", _SESSIONS_SQL)
def st4_sessions(t: Tables) -> DataFrame:
    feed, out = scratch_dir(t.spark, "packets"), scratch_dir(t.spark, "sessions")
    rows = t.packets()
    rows.write.parquet(feed)
    # A last packet in the far future lets the watermark close every session.
    end = t.spark.range(1).select(F.lit("end").alias("uid"), F.lit("2200-01-01").cast("timestamp").alias("ts"),
                                  F.lit(True).alias("is_orig"), F.lit("A").alias("flags"), F.lit(0).cast("bigint").alias("len"))
    end.write.mode("append").parquet(feed)
    stream = t.spark.readStream.schema(packets.PACKET_SCHEMA).parquet(feed)
    _run(packets.flow_sessions(stream, "90 days", "36500 days"), live.batch_writer(out))
    return shown_flows(t.spark.read.parquet(out).filter("uid <> 'end'"))


@query("st5_latest_page", "alerts", "SELECT id, epoch_us(timestamp) AS micros FROM alerts ORDER BY timestamp DESC, id LIMIT 25")
def st5(t: Tables) -> DataFrame:
    out = scratch_dir(t.spark, "page")
    _feed(t.alerts(), "timestamp", 2, lambda feed: live.stream_alerts(t.spark, feed), live.latest_n(out, 25))
    return live.last_page(t.spark, out).select("id", F.unix_micros("timestamp").alias("micros"))


@query("st6_counts_per_hour", "alerts", """
SELECT epoch_us(date_trunc('hour', timestamp)) AS micros, severity, count(*) AS "count" FROM alerts GROUP BY 1, 2""")
def st6(t: Tables) -> DataFrame:
    out = scratch_dir(t.spark, "counts")
    _feed(t.alerts(), "timestamp", 2, lambda feed: live.counts_per_hour(live.stream_alerts(t.spark, feed), "60 days"),
          live.batch_writer(out), mode="update")
    return live.current_counts(t.spark, out).select(F.unix_micros("bucket").alias("micros"), "severity", "count")


@query("st6_reused_counts", "alerts", """
SELECT severity, count(*) AS "count", round(coalesce(avg(model_score), 0), 6) AS avg_score,
  round(count(*) FILTER (model_label = 'malicious') * 100.0::DOUBLE / count(*), 6) AS malicious_ratio FROM alerts GROUP BY 1""")
def st6_reused(t: Tables) -> DataFrame:
    """Sums kept by batch: the last call reads the batch that came after the first one."""
    out, reuse = scratch_dir(t.spark, "live"), scratch_dir(t.spark, "reuse")
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    for i in range(2):
        live.batch_writer(out)(t.alerts().filter(half == i), i)
        counts = live.reused_counts(t.spark, out, reuse)
    return counts.select("severity", "count", F.round("avg_score", 6).alias("avg_score"), F.round("malicious_ratio", 6).alias("malicious_ratio"))
