"""Packets to flow records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.times import epoch_seconds
from flowlens.schemas import PACKET_LOG_SCHEMA


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


_ADDED = ("_fn", "_bn", "_fsum", "_bsum", "_bsq", "_data", "_psh")


def packets_to_flows(packets: DataFrame, connections: DataFrame | None = None,
                     slice_seconds: int = 300) -> DataFrame:
    """One flow record per ``uid`` from packet rows ``uid, ts, is_orig, flags, len``.

    ``connections`` (``uid, start_ts, duration`` and endpoints) is optional; without it the
    flow starts with its first packet.
    """
    return flow_record(flow_sums(packets, slice_seconds), connections)


def flow_sums(packets: DataFrame, slice_seconds: int = 300) -> DataFrame:
    """One row of sums per ``uid``.

    The smallest positive gap between packets needs order: gaps are taken inside time
    slices of a flow and then between neighbouring slices, so that a flow with very many
    packets is ordered by many tasks.
    """
    packets = packets.withColumn("ts", F.col("ts").cast("timestamp"))
    size = F.col("len").cast("double")
    rows = packets.withColumns({
        "_slice": F.floor(epoch_seconds("ts") / F.lit(float(slice_seconds))),
        "_fwd": F.when(F.col("is_orig"), size),
        "_bwd": F.when(~F.col("is_orig"), size),
    })
    # Packets of one instant are summed map-side first: copies never meet in one task.
    instants = rows.groupBy("uid", "_slice", "ts").agg(
        F.count("_fwd").alias("_fn"),
        F.count("_bwd").alias("_bn"),
        F.sum("_fwd").alias("_fsum"),
        F.sum("_bwd").alias("_bsum"),
        F.sum(F.col("_bwd") * F.col("_bwd")).alias("_bsq"),
        F.min("_fwd").alias("_fmin"),
        F.min("_bwd").alias("_bmin"),
        F.max("_bwd").alias("_bmax"),
        F.count_if(F.col("_fwd") > 0).alias("_data"),
        F.count_if(F.contains(F.col("flags"), F.lit("P"))).alias("_psh"),
    )
    in_slice = Window.partitionBy("uid", "_slice").orderBy("ts")
    gaps = instants.withColumn("_gap", _seconds(F.col("ts"), F.lag("ts").over(in_slice)))
    slices = gaps.groupBy("uid", "_slice").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"),
                                               F.min("_gap").alias("_gap"), *_combined())
    return merge_sums(slices.drop("_slice"))


def _combined() -> list[Column]:
    return [
        *[F.sum(c).alias(c) for c in _ADDED],
        F.min("_fmin").alias("_fmin"), F.min("_bmin").alias("_bmin"), F.max("_bmax").alias("_bmax"),
    ]


def merge_sums(parts: DataFrame) -> DataFrame:
    """Combine sums of the same flow over consecutive stretches of time."""
    in_order = Window.partitionBy("uid").orderBy("_first")
    edge = _positive(_seconds(F.col("_first"), F.lag("_last").over(in_order)))
    return parts.withColumn("_edge", edge).groupBy("uid").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        F.least(F.min("_gap"), F.min("_edge")).alias("_gap"), *_combined(),
    )


def flow_record(flows: DataFrame, connections: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Flow record from per-flow sums; a side without packets gives zeros. Columns of ``keep`` stay."""
    zero = F.lit(0.0)
    if connections is not None:
        flows = flows.join(connections, "uid", "inner")
        start = F.coalesce(F.col("start_ts").cast("timestamp"), F.col("_first"))
        # The gap from the start of the connection to its first packet counts as well.
        lead = _positive(_seconds(F.col("_first"), start))
        gap = F.least(F.col("_gap"), lead)
    else:
        start, gap = F.col("_first"), F.col("_gap")
    measured = _seconds(F.col("_last"), start)
    if connections is not None and "duration" in connections.columns:
        measured = F.coalesce(F.col("duration").cast("double"), measured)
    duration = F.when(measured > 0, measured).otherwise(F.lit(1e-6))
    fn, bn = F.col("_fn"), F.col("_bn")
    fsum, bsum = F.coalesce(F.col("_fsum"), zero), F.coalesce(F.col("_bsum"), zero)

    def mean(total: Column, n: Column) -> Column:
        return F.coalesce(F.try_divide(total, n.cast("double")), zero)

    bmean = mean(bsum, bn)
    variance = mean(F.coalesce(F.col("_bsq"), zero), bn) - bmean * bmean
    endpoint_types = {f.name: f.dataType for f in PACKET_LOG_SCHEMA}

    def given(name: str) -> Column:
        return (F.col(name) if name in flows.columns else F.lit(None)).cast(endpoint_types[name])

    columns = {
        "ts": start,
        "uid": F.col("uid"),
        "id_orig_h": given("id_orig_h"),
        "id_orig_p": given("id_orig_p"),
        "id_resp_h": given("id_resp_h"),
        "id_resp_p": given("id_resp_p"),
        "duration": duration,
        "total_fwd_pkts": fn,
        "total_bwd_pkts": bn,
        "total_fwd_len": fsum,
        "total_bwd_len": bsum,
        "fwd_pkt_len_min": F.coalesce(F.col("_fmin"), zero),
        "fwd_pkt_len_mean": mean(fsum, fn),
        "bwd_pkt_len_min": F.coalesce(F.col("_bmin"), zero),
        "bwd_pkt_len_mean": bmean,
        "bwd_pkt_len_max": F.greatest(F.coalesce(F.col("_bmax"), zero), zero),
        "bwd_pkt_len_std": F.when((bn > 1) & (variance > 0), F.sqrt(F.abs(variance))).otherwise(zero),
        "pkt_len_mean": mean(fsum + bsum, fn + bn),
        "min_pkt_len": F.coalesce(F.least("_fmin", "_bmin"), zero),
        "avg_fwd_seg_size": mean(fsum, fn),
        "avg_bwd_seg_size": bmean,
        "bwd_pkts_per_sec": bn / duration,
        "psh_flag_count": F.col("_psh"),
        "subflow_fwd_pkts": fn,
        "act_data_pkt_fwd": F.col("_data"),
        "idle_min": F.coalesce(gap, zero),
        "dst_port": given("id_resp_p"),
        "min_seg_size_forward": mean(fsum, fn),
        "init_win_bytes_bwd": zero,
    }
    return flows.select(*[c.alias(n) for n, c in columns.items()], *keep)
