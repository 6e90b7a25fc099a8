"""Dataset typing, required columns, preview and conversion of flow rows to conn rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import labels as L
from flowlens.functions.alerts import first_present
from flowlens.functions.numbers import parse_number, safe_double, safe_int
from flowlens.functions.times import epoch_seconds, parse_ts
from flowlens.operators.skew import dealt, number_copies
from flowlens.sources.files import clean_name


def _dotted(columns: Sequence[str]) -> set[str]:
    """Column names as in the log format; both spellings of a dotted name count."""
    plain = {c.replace(".", "_"): c for c in S.CONN_COLUMNS}
    return {plain.get(clean_name(c), clean_name(c)) for c in columns}


def missing_flow_columns(columns: Sequence[str]) -> list[str]:
    """Essential flow columns without any of their accepted spellings."""
    have = {clean_name(c) for c in columns}
    return [k for k in S.ESSENTIAL_FLOW_COLUMNS if not have.intersection(S.FLOW_COLUMNS[k])]


def detect_dataset_type(columns: Sequence[str]) -> str:
    """``conn``, ``features`` or ``flow`` (to be converted); an error names what is missing."""
    missing = sorted(set(S.CONN_REQUIRED) - _dotted(columns))
    if not missing:
        return "conn"
    have = {clean_name(c).lower() for c in columns}
    needed = {c.lower() for c in [*S.CONN_FEATURES, *S.FEATURE_FILE_META]}
    if needed <= have and have.intersection(c.lower() for c in S.ORIGINAL_LABEL_COLUMNS):
        return "features"
    if not missing_flow_columns(columns):
        return "flow"
    raise ValueError(f"missing columns: {', '.join(missing)}")


def require_columns(columns: Sequence[str], kind: str) -> None:
    """Raise when a ``conn`` or ``features`` dataset lacks required columns (exact case)."""
    if kind == "features":
        missing = sorted(set([*S.CONN_FEATURES, *S.FEATURE_FILE_META]) - set(columns))
        if missing:
            raise ValueError(f"missing feature columns: {', '.join(missing)}")
        if not set(columns).intersection(S.ORIGINAL_LABEL_COLUMNS):
            raise ValueError("missing label column")
        return
    missing = sorted(set(S.CONN_REQUIRED) - _dotted(columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def preview(df: DataFrame, n: int = 5) -> tuple[list[str], DataFrame]:
    return df.columns, df.limit(n)


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once: filters and later uses do not repeat a generator."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def staged_flows(df: DataFrame) -> DataFrame:
    """Add the logical flow columns as text (``_src_ip`` ...), the parsed time and ports,
    and why a row cannot be converted. Parsed once, used by all later steps."""
    missing = missing_flow_columns(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    texts = _computed(df, {f"_{k}": first_present(df, names) for k, names in S.FLOW_COLUMNS.items()})
    blank = F.lit(False)
    for name in ("_src_ip", "_dst_ip", "_src_port", "_dst_port"):
        blank = blank | (F.col(name) == "")
    parsed = _computed(texts, {
        "_time": parse_ts("_timestamp"),
        "_sport": parse_number("_src_port").try_cast("int"),
        "_dport": parse_number("_dst_port").try_cast("int"),
    })
    reason = (
        F.when(F.col("_time").isNull(), "timestamp")
        .when(blank, "endpoint")
        .when(F.col("_sport").isNull() | F.col("_dport").isNull(), "port")
    )
    return parsed.withColumn("reject_reason", reason)


_STAGED = [f"_{k}" for k in S.FLOW_COLUMNS] + ["_time", "_sport", "_dport"]


def numbered_flows(df: DataFrame) -> DataFrame:
    """Staged flow rows with their number among equal rows, in parts of as many rows."""
    return staged_flows(dealt(number_copies(df), df.count()))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flow rows that can be converted, and the others with ``reject_reason``.

    Rejected: no readable timestamp, no endpoint, or a port that is not a number.
    """
    marked = staged_flows(df).drop(*_STAGED)
    good = marked.filter("reject_reason is null").drop("reject_reason")
    return good, marked.filter("reject_reason is not null")


def convert_cic_to_conn(df: DataFrame, dataset_name: str) -> tuple[DataFrame, DataFrame]:
    """Flow rows to conn rows (text columns as in the file format) and the rejected rows."""
    staged = numbered_flows(df)
    rejected = staged.filter("reject_reason is not null").drop("_copy", *_STAGED)
    return conn_rows(staged, dataset_name, df.columns), rejected


def conn_rows(staged: DataFrame, dataset_name: str, raw: Sequence[str]) -> DataFrame:
    """Conn rows of the staged flow rows that can be converted.

    The ``uid`` is a hash of the ``raw`` columns and of the number of the row among equal
    ones: unique, and the same on every run.
    """
    good = staged.filter("reject_reason is null")
    source = F.col("source_file") if "source_file" in good.columns else F.lit("")
    good = good.withColumns({
        "_ts": F.format_string("%.6f", epoch_seconds("_time")),
        "_proto": L.norm_protocol("_protocol"),
        "_class": L.norm_label("_label"),
        "_up": safe_int("_orig_bytes", 0, "clean").cast("string"),
        "_down": safe_double("_resp_bytes", 0.0, "clean"),
        "_down_pkts": safe_int("_resp_pkts", 0, "clean"),
    })
    silent = (F.col("_down_pkts") == 0) & (F.col("_down") == 0)
    down = F.col("_down").cast("bigint").cast("string")
    duration = safe_double("_flow_duration", 0.0, "clean") / F.lit(1e6)
    columns = {
        "ts": F.col("_ts"),
        "uid": L.row_uid(list(raw), F.col("_copy")),
        "id_orig_h": F.col("_src_ip"),
        "id_orig_p": F.col("_sport").cast("string"),
        "id_resp_h": F.col("_dst_ip"),
        "id_resp_p": F.col("_dport").cast("string"),
        "proto": F.col("_proto.name"),
        "service": L.guess_service("_dport"),
        "duration": F.format_string("%.6f", duration),
        "orig_bytes": F.col("_up"),
        "resp_bytes": down,
        "conn_state": F.when(silent, "S0").otherwise("SF"),
        "local_orig": F.lit("T"),
        "local_resp": F.lit("T"),
        "missed_bytes": F.lit("0"),
        "history": F.when(F.col("_proto.name") == "tcp", "S").otherwise("-"),
        "orig_pkts": safe_int("_orig_pkts", 0, "clean").cast("string"),
        "orig_ip_bytes": F.col("_up"),
        "resp_pkts": F.col("_down_pkts").cast("string"),
        "resp_ip_bytes": down,
        "tunnel_parents": F.lit("-"),
        "ip_proto": F.col("_proto.number"),
        "cicids_label": F.col("_class.label"),
        "cicids_attack": F.col("_class.class"),
        "flow_id": F.col("_flow_id"),
        "source_file": source,
        "dataset_name": F.lit(dataset_name),
    }
    return good.select(*[c.alias(n) for n, c in columns.items()])
