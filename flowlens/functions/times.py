"""Timestamps: parsing, ranges, latency."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.common import as_column, strip
from flowlens.functions.numbers import parse_number
from flowlens.schemas import REPORT_RANGES

_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([ ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
)


def parse_ts(c: Column | str, iso_fallback: bool = True, day_first: bool = False) -> Column:
    """Text to timestamp: epoch seconds, the known patterns, then ISO forms; else NULL.

    A slashed date is read month first when that is possible, else day first
    (``day_first`` turns this round). The shape of the text selects the one pattern that
    can fit, so that no row pays for failing parses.
    """
    text = strip(F.replace(as_column(c), F.lit("T"), F.lit(" ")))

    def read(value: Column, pattern: str) -> Column:
        return F.try_to_timestamp(value, F.lit(pattern))

    dashed = F.when(text.contains("."), read(text, "yyyy-M-d H:m:s.SSSSSS")).otherwise(
        read(text, "yyyy-M-d H:m:s"))
    one, two = (F.split_part(text, F.lit("/"), F.lit(i)) for i in (1, 2))
    # A number above 12 cannot be the month.
    swap = (two.try_cast("int") <= 12) if day_first else (one.try_cast("int") > 12)
    tail = F.split_part(text, F.lit("/"), F.lit(3))
    slashed = F.when(swap, F.concat_ws("/", two, one, tail)).otherwise(text)
    by_slash = (
        F.when(text.rlike("(?i)[ap]m$"), read(slashed, "M/d/yyyy h:m:s a"))
        .when(text.rlike(":[0-9]+:"), read(slashed, "M/d/yyyy H:m:s"))
        .otherwise(read(slashed, "M/d/yyyy H:m"))
    )
    value = (
        F.when(text.rlike("^[0-9]{4}-"), dashed)
        .when(text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} "), by_slash)
        .otherwise(F.timestamp_seconds(parse_number(text)))
    )
    if iso_fallback:
        iso = F.replace(text, F.lit("/"), F.lit("-"))
        value = F.coalesce(value, F.when(iso.rlike(_ISO), iso.try_cast("timestamp")))
    return value


def epoch_seconds(c: Column | str) -> Column:
    """Timestamp to epoch seconds as double, microseconds kept."""
    return F.unix_micros(as_column(c).cast("timestamp")) / F.lit(1e6)


def latency_ms(ingested: Column | str, happened: Column | str) -> Column:
    """Milliseconds between the event and its ingestion."""
    micros = F.unix_micros(as_column(ingested)) - F.unix_micros(as_column(happened))
    return micros / F.lit(1000.0)


def range_start(key: str, as_of: datetime) -> datetime:
    """First instant of a preset range (1h, 24h, 7d, 30d) that ends at ``as_of``."""
    return as_of - timedelta(hours=REPORT_RANGES[key])


def latest(df: DataFrame, column: str = "timestamp", default: datetime = datetime(1970, 1, 1)) -> datetime:
    """Newest timestamp of a frame: one value, used as the literal ``as_of`` of a report.

    ``default`` stands for it when there is none, so that reports of an empty table are zeros.
    """
    newest = df.agg(F.max(column)).first()[0]
    return default if newest is None else newest
