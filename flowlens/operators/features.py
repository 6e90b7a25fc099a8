"""Feature projections: conn features, flow features, targets, scaling, assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.common import is_numeric, lookup, quoted, strip
from flowlens.functions.numbers import coerce_numeric, number_of, safe_double

_MIN_DURATION = 1e-6
_HEADER_BYTES = 20.0
_STD_SHARE = 0.1


def column_named(df: DataFrame, *names: str) -> str | None:
    """First of the names the frame has; ``id.resp_p`` and ``id_resp_p`` are the same."""
    for name in names:
        for spelling in (name, name.replace(".", "_")):
            if spelling in df.columns:
                return spelling
    return None


def _text(df: DataFrame, *names: str) -> Column:
    name = column_named(df, *names)
    return F.lit("") if name is None else F.coalesce(quoted(name).cast("string"), F.lit(""))


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def conn_features(df: DataFrame, mode: str = "serve") -> DataFrame:
    """Add the 14 conn features.

    ``serve``: negatives clamped, ip byte counts as fallback, ratio ``a / max(b, 1e-6)``.
    ``train``: values as they are, ratio ``(a + 1) / (b + 1)``. The two differ on purpose
    of matching results; train and score with the same mode.
    """
    if mode == "serve":
        return _serving_features(df)
    if mode == "train":
        return _training_features(df)
    raise ValueError(f"unknown mode: {mode}")


def _serving_features(df: DataFrame) -> DataFrame:
    def positive(*names: str) -> Column:
        return F.greatest(number_of(df, names), F.lit(0.0))

    port = number_of(df, [column_named(df, "id.resp_p", "resp_p") or ""]).try_cast("bigint")
    proto = F.upper(strip(_text(df, "proto")))
    service = F.lower(strip(_text(df, "service")))
    base = df.withColumns({
        "duration": positive("duration"),
        "orig_bytes": positive("orig_bytes", "orig_ip_bytes"),
        "resp_bytes": positive("resp_bytes", "resp_ip_bytes"),
        "orig_pkts": positive("orig_pkts"),
        "resp_pkts": positive("resp_pkts"),
        "proto_tcp": _flag(proto == "TCP"),
        "proto_udp": _flag(proto == "UDP"),
        "proto_icmp": _flag(proto == "ICMP"),
        "is_http": _flag(
            service.isin(S.HTTP_SERVICES) | F.coalesce(port.isin(S.SERVING_HTTP_PORTS), F.lit(False))
        ),
        "is_ssh": _flag((service == "ssh") | F.coalesce(port == S.SSH_PORT, F.lit(False))),
    })
    tiny = F.lit(1e-6)
    return base.withColumns({
        "bytes_total": F.col("orig_bytes") + F.col("resp_bytes"),
        "bytes_ratio": F.col("orig_bytes") / F.greatest(F.col("resp_bytes"), tiny),
        "pkts_total": F.col("orig_pkts") + F.col("resp_pkts"),
        "pkts_ratio": F.col("orig_pkts") / F.greatest(F.col("resp_pkts"), tiny),
    })


def _training_features(df: DataFrame) -> DataFrame:
    base = coerce_numeric(df, ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"])
    port_name = column_named(df, "id.resp_p", "resp_p")
    port = quoted(port_name) if is_numeric(df, port_name) else quoted(port_name).try_cast("double")
    proto = _text(df, "proto")
    one = F.lit(1.0)
    return base.withColumns({
        "bytes_total": F.col("orig_bytes") + F.col("resp_bytes"),
        "bytes_ratio": (F.col("orig_bytes") + one) / (F.col("resp_bytes") + one),
        "pkts_total": F.col("orig_pkts") + F.col("resp_pkts"),
        "pkts_ratio": (F.col("orig_pkts") + one) / (F.col("resp_pkts") + one),
        "proto_tcp": _flag(proto == "tcp"),
        "proto_udp": _flag(proto == "udp"),
        "proto_icmp": _flag(proto == "icmp"),
        "is_http": _flag(F.coalesce(port.isin(S.TRAINING_HTTP_PORTS), F.lit(False))),
        "is_ssh": _flag(F.coalesce(port == S.SSH_PORT, F.lit(False))),
    })


def cic_features78(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 78 flow features estimated from a conn row, after the ``keep`` columns.

    A conn row has totals only, so lengths and gaps are per-packet averages and spreads a
    fixed share of them. Features without an estimate are 0.
    """
    zero, one = F.lit(0.0), F.lit(1.0)

    def value(name: str, fallback: Column = zero) -> Column:
        if name not in df.columns:
            return fallback
        if is_numeric(df, name):
            return F.coalesce(quoted(name).cast("double"), fallback)
        return F.coalesce(F.nanvl(safe_double(name, float("nan"), "comma"), fallback), fallback)

    history = _text(df, "history")

    def flags(letters: str) -> Column:
        return F.regexp_count(history, F.lit(f"[{letters}]")).cast("double")

    port = column_named(df, "id.resp_p", "resp_p")
    totals = df.select(
        *[quoted(k) for k in keep],
        F.greatest(value("duration"), F.lit(_MIN_DURATION)).alias("_dur"),
        F.greatest(value("orig_pkts"), zero).alias("_fp"),
        F.greatest(value("resp_pkts"), zero).alias("_bp"),
        F.greatest(value("orig_bytes"), zero).alias("_fraw"),
        F.greatest(value("resp_bytes"), zero).alias("_braw"),
        F.greatest(value("orig_ip_bytes", F.greatest(value("orig_bytes"), zero)),
                   value("orig_bytes"), zero).alias("_fb"),
        F.greatest(value("resp_ip_bytes", F.greatest(value("resp_bytes"), zero)),
                   value("resp_bytes"), zero).alias("_bb"),
        (value(port) if port else zero).alias("_port"),
        *[flags(x + x.lower()).alias(f"_n{x}") for x in "SFRAUPE"],
        flags("P").alias("_fwd_psh"), flags("p").alias("_bwd_psh"),
        flags("U").alias("_fwd_urg"), flags("u").alias("_bwd_urg"),
    )

    dur, fp, bp = F.col("_dur"), F.col("_fp"), F.col("_bp")
    fb, bb = F.col("_fb"), F.col("_bb")

    def per_packet(total: Column, packets: Column) -> Column:
        return F.when(packets <= 0, total).otherwise(F.try_divide(total, packets))

    means = totals.withColumns({
        "_fm": per_packet(fb, fp),
        "_bm": per_packet(bb, bp),
        "_am": per_packet(fb + bb, fp + bp),
        "_gap": dur / F.greatest(fp + bp, one),
        "_fgap": dur / F.greatest(fp, one),
        "_bgap": dur / F.greatest(bp, one),
        "_idle": F.greatest(dur - F.least(dur, (fp + bp) * F.lit(0.001)), zero),
    }).withColumn("_active", dur - F.col("_idle"))

    fm, bm, am = F.col("_fm"), F.col("_bm"), F.col("_am")

    def spread(c: Column) -> Column:
        return F.when(c > 0, c * F.lit(_STD_SHARE)).otherwise(zero)

    def positive(c: Column) -> Column:
        return F.when(c > 0, c)

    estimates = {
        "Flow Duration": dur,
        "Destination Port": F.col("_port"),
        "Total Fwd Packets": fp,
        "Total Backward Packets": bp,
        "Subflow Fwd Packets": fp,
        "Subflow Bwd Packets": bp,
        "Total Length of Fwd Packets": fb,
        "Total Length of Bwd Packets": bb,
        "Subflow Fwd Bytes": fb,
        "Subflow Bwd Bytes": bb,
        "Avg Fwd Segment Size": fm,
        "Avg Bwd Segment Size": bm,
        "Fwd Packet Length Mean": fm,
        "Bwd Packet Length Mean": bm,
        "Fwd Packet Length Min": F.when(fm == 0, am).otherwise(fm),
        "Bwd Packet Length Min": F.when(bm == 0, am).otherwise(bm),
        "Fwd Packet Length Max": F.greatest(fm, am),
        "Bwd Packet Length Max": F.greatest(bm, bb / F.greatest(bp, one)),
        "Fwd Packet Length Std": spread(fm),
        "Bwd Packet Length Std": spread(bm),
        "Packet Length Mean": am,
        "Average Packet Size": am,
        "Packet Length Std": spread(am),
        "Packet Length Variance": spread(am) * spread(am),
        "Max Packet Length": F.greatest(fm, bm, am),
        "Min Packet Length": F.coalesce(F.least(positive(fm), positive(bm), positive(am)), zero),
        "min_seg_size_forward": fm,
        "act_data_pkt_fwd": F.greatest(fp - F.col("_fwd_psh") - F.col("_nS"), zero),
        "Flow Packets/s": (fp + bp) / dur,
        "Flow Bytes/s": (fb + bb) / dur,
        "Fwd Packets/s": fp / dur,
        "Bwd Packets/s": bp / dur,
        "Down/Up Ratio": F.when(fb > 0, F.try_divide(bb, fb)).otherwise(bb),
        "Fwd Header Length": fp * F.lit(_HEADER_BYTES),
        "Fwd Header Length.1": fp * F.lit(_HEADER_BYTES),
        "Bwd Header Length": bp * F.lit(_HEADER_BYTES),
        "Init_Win_bytes_forward": F.when(F.col("_fraw") == 0, fb).otherwise(F.col("_fraw")),
        "Init_Win_bytes_backward": F.when(F.col("_braw") == 0, bb).otherwise(F.col("_braw")),
        "SYN Flag Count": F.col("_nS"),
        "FIN Flag Count": F.col("_nF"),
        "RST Flag Count": F.col("_nR"),
        "ACK Flag Count": F.col("_nA"),
        "URG Flag Count": F.col("_nU"),
        "PSH Flag Count": F.col("_nP"),
        "ECE Flag Count": F.col("_nE"),
        "Fwd PSH Flags": F.col("_fwd_psh"),
        "Bwd PSH Flags": F.col("_bwd_psh"),
        "Fwd URG Flags": F.col("_fwd_urg"),
        "Bwd URG Flags": F.col("_bwd_urg"),
        "Fwd IAT Total": dur,
        "Bwd IAT Total": dur,
    }
    for side, gap in (("Flow", "_gap"), ("Fwd", "_fgap"), ("Bwd", "_bgap")):
        for part in ("Mean", "Max", "Min"):
            estimates[f"{side} IAT {part}"] = F.col(gap)
        estimates[f"{side} IAT Std"] = spread(F.col(gap))
    for state, column in (("Idle", "_idle"), ("Active", "_active")):
        estimates[f"{state} Mean"] = F.col(column)
        estimates[f"{state} Min"] = F.col(column) * F.lit(0.8)
        estimates[f"{state} Max"] = F.col(column) * F.lit(1.2)
        estimates[f"{state} Std"] = spread(F.col(column))
    return means.select(
        *[quoted(k) for k in keep], *[estimates.get(n, zero).alias(n) for n in S.CIC_FEATURES]
    )


def cicflow_top20(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 20 leading flow features from packet-log rows; unreadable values are 0."""
    def read(name: str) -> Column:
        c = quoted(name)
        return c.cast("double") if is_numeric(df, name) else c.try_cast("double")

    features = []
    for name, sources in S.PACKET_LOG_SOURCES.items():
        present = [s for s in sources if s in df.columns]
        # A column that exists but cannot be read falls back like a missing one.
        features.append(F.coalesce(*[read(s) for s in present], F.lit(0.0)).alias(name))
    return df.select(*[quoted(k) for k in keep], *features)


def pick_features(df: DataFrame, names: Sequence[str] = S.CONN_FEATURES) -> DataFrame:
    """Named model features from a feature file; missing or unreadable values are 0."""
    out = {}
    for n in names:
        if n not in df.columns:
            out[n] = F.lit(0.0)
        elif is_numeric(df, n):
            out[n] = F.coalesce(quoted(n).cast("double"), F.lit(0.0))
        else:
            out[n] = safe_double(quoted(n), 0.0, "clean")
    return df.withColumns(out)


def binary_target(label: Column, normal: Sequence[str] = ("benign", "normal")) -> Column:
    """0 for benign or normal labels, 1 for the rest; NULL stays NULL."""
    return (~F.lower(strip(label)).isin(list(normal))).cast("int")


def class_order(df: DataFrame, column: str, max_classes: int = 10_000) -> list[str]:
    """Class names in alphabetical order."""
    names = df.select(quoted(column).alias("c")).where("c is not null").distinct()
    rows = names.limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{column} has more than {max_classes} classes")
    return sorted(r.c for r in rows)


def class_code(column: Column, order: Sequence[str]) -> Column:
    """Position of a class in the given order, NULL when it is not listed."""
    return lookup({name: i for i, name in enumerate(order)}, column)


def numeric_features(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    """Numeric columns as float without targets and labels; an error when none is left."""
    names = [c for c in df.columns if c not in drop and is_numeric(df, c)]
    if not names:
        raise ValueError("no numeric feature columns")
    return df.select(*[quoted(n).cast("float").alias(n) for n in names])


def fit_scale(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Population standard deviation per column, 1.0 for constant columns. One pass."""
    row = df.agg(*[F.stddev_pop(quoted(n)).alias(f"s{i}") for i, n in enumerate(names)]).first()
    return {n: (row[i] or 1.0) for i, n in enumerate(names)}


def apply_scale(df: DataFrame, scale: dict[str, float]) -> DataFrame:
    """Divide by the fitted deviation; values are not centred."""
    return df.withColumns({n: quoted(n) / F.lit(s) for n, s in scale.items()})


def assemble(df: DataFrame, names: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol=output).transform(df)


def select_ranked(ranking: DataFrame, n: int) -> list[str]:
    """Names of the ``n`` leading features of a ranking table."""
    return [r.feature for r in ranking.orderBy("rank").limit(n).collect()]

