"""Alert queries: filters, sorting, paging, counts, series and reports.

Time-relative operators take ``as_of`` instead of reading the clock.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlens import schemas as S
from flowlens.functions import alerts as A
from flowlens.functions.common import quoted, round_half_up
from flowlens.functions.times import latency_ms, range_start
from flowlens.session import join_small, materialize


def _count() -> Column:
    return F.count(F.lit(1))


# --- filters -------------------------------------------------------------------


@dataclass
class AlertFilters:
    """What to list; empty lists and ``None`` do not restrict."""

    page: int = 1
    page_size: int = 25
    from_ts: datetime | None = None
    to_ts: datetime | None = None
    severity: Sequence[str] = field(default_factory=list)
    attack_type: Sequence[str] = field(default_factory=list)
    protocol: Sequence[str] = field(default_factory=list)
    query: str | None = None
    sort: str = "-timestamp"

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.page_size <= 500:
            raise ValueError("page starts at 1 and page_size is 1 to 500")
        for value, known in ((self.severity, S.SEVERITIES), (self.attack_type, S.ATTACK_TYPES),
                             (self.protocol, S.PROTOCOLS)):
            unknown = set(value) - set(known)
            if unknown:
                raise ValueError(f"unknown values: {sorted(unknown)}")


def time_window(df: DataFrame, since: datetime | None = None,
                until: datetime | None = None) -> DataFrame:
    """Alerts between two instants, both included."""
    if since is not None:
        df = df.filter(F.col("timestamp") >= F.lit(since))
    if until is not None:
        df = df.filter(F.col("timestamp") <= F.lit(until))
    return df


def search(df: DataFrame, query: str, like: bool = False) -> DataFrame:
    """Case-insensitive substring over nine columns.

    With ``like`` the characters ``%`` and ``_`` of the query are wildcards.
    """
    needle = query.lower()
    columns = ["src_ip", "dst_ip", "rule_name", "rule_id", "attack_type", "severity",
               "protocol", "model_label", "model_score"]
    hit = F.lit(False)
    for c in columns:
        text = F.lower(F.col(c).cast("string"))
        hit = hit | (text.like(f"%{needle}%") if like else text.contains(needle))
    return df.filter(hit)


def filter_alerts(df: DataFrame, filters: AlertFilters) -> DataFrame:
    df = time_window(df, filters.from_ts, filters.to_ts)
    for column in ("severity", "attack_type", "protocol"):
        values = list(getattr(filters, column))
        if values:
            df = df.filter(F.col(column).isin(values))
    return search(df, filters.query) if filters.query else df


def range_filter(df: DataFrame, key: str, as_of: datetime) -> DataFrame:
    """Alerts of a preset range (1h, 24h, 7d, 30d) that ends at ``as_of``."""
    return time_window(df, range_start(key, as_of), as_of)


def bucket_filter(df: DataFrame, bucket: datetime, minutes: int = 60) -> DataFrame:
    """Alerts of one series bucket."""
    return time_window(df, bucket, bucket + timedelta(minutes=minutes))


def get_alert(df: DataFrame, alert_id: str) -> DataFrame:
    return df.filter(F.col("id") == alert_id)


def predicted_as(df: DataFrame, attack: str | None = None, limit: int | None = None) -> DataFrame:
    """Scored alerts of one attack type, at most ``limit`` when it is given."""
    if attack:
        df = df.filter(F.col("attack_type") == attack)
    return df.limit(limit) if limit else df


# --- sorting, paging -----------------------------------------------------------


def _sort_value(key: str) -> tuple[Column, bool]:
    """What a sort key compares, and whether it falls; unknown keys mean newest first."""
    columns = {
        "timestamp": F.col("timestamp"),
        "severity": A.severity_rank("severity"),
        "model_score": F.col("model_score"),
    }
    name = key.lstrip("-")
    if name not in columns:
        return columns["timestamp"], True
    return columns[name], key.startswith("-")


def sort_order(key: str) -> list[Column]:
    """Sort columns for a key; ties are broken by id, unknown keys mean newest first."""
    value, falling = _sort_value(key)
    return [value.desc() if falling else value.asc(), F.col("id").asc()]


def sort_alerts(df: DataFrame, key: str = "-timestamp") -> DataFrame:
    return df.orderBy(*sort_order(key))


def page_alerts(df: DataFrame, filters: AlertFilters) -> tuple[DataFrame, DataFrame]:
    """One page of the filtered alerts and a one-row frame with their total."""
    kept = filter_alerts(df, filters)
    start = (filters.page - 1) * filters.page_size
    items = sort_alerts(kept, filters.sort).offset(start).limit(filters.page_size)
    return items, kept.agg(_count().alias("total"))


@dataclass(frozen=True)
class PageKey:
    """Where a page ended: the sort value and id of its last row, and how many rows of the
    filtered table share both and were shown."""

    value: object
    id: str | None
    shown: int = 1


def page_after(df: DataFrame, filters: AlertFilters, after: PageKey | None = None) -> DataFrame:
    """The page that follows ``after`` in the order of ``filters.sort``, nulls included.

    A filter instead of an offset, so deep pages cost the same as the first. Rows with equal
    sort value and id follow each other; the ones already shown are skipped by number.
    """
    kept = filter_alerts(df, filters)
    # Rows that tie in value and id keep one order from page to page.
    order = [*sort_order(filters.sort), F.xxhash64(*[quoted(c) for c in df.columns])]
    if after is None:
        return kept.orderBy(*order).limit(filters.page_size)
    value, falling = _sort_value(filters.sort)
    last, last_id = F.lit(after.value), F.lit(after.id).cast("string")
    beyond = value < last if falling else value > last
    if after.value is None:
        # Spark sorts nulls as the least value.
        beyond = F.lit(False) if falling else value.isNotNull()
    elif falling:
        beyond = beyond | value.isNull()
    same = value.eqNullSafe(last)
    later_id = F.col("id").isNotNull() if after.id is None else F.col("id") > last_id
    rest = kept.filter(F.coalesce(beyond, F.lit(False)) | (same & (F.coalesce(later_id, F.lit(False)) | F.col("id").eqNullSafe(last_id))))
    return rest.orderBy(*order).offset(after.shown).limit(filters.page_size)


def next_page_key(page: DataFrame, filters: AlertFilters, after: PageKey | None = None) -> PageKey | None:
    """Key of the last row of a page, ``None`` when the page is empty. Reads one page."""
    value, _ = _sort_value(filters.sort)
    rows = page.select(value.alias("v"), "id").collect()
    if not rows:
        return None
    last = rows[-1]
    shown = sum(r == last for r in rows)
    if after is not None and shown == len(rows) and (after.value, after.id) == (last["v"], last["id"]):
        shown += after.shown
    return PageKey(last["v"], last["id"], shown)


# Pages in one folder of a page directory.
PAGES_A_FOLDER = 1_000
_IN_PARTITION = (1 << 33) - 1  # the part of monotonically_increasing_id() that numbers rows


def write_pages(df: DataFrame, filters: AlertFilters, path: str, per_folder: int = PAGES_A_FOLDER) -> int:
    """Write the filtered alerts as numbered pages in the order of ``filters.sort``; gives their total.

    Rows are sorted by range over the cluster, each range is numbered where it is, and the
    counts of the ranges, one row each, give the offsets. Pages lie in folders of
    ``per_folder`` pages, so ``read_page`` opens page n without the ones before it. Rows that
    tie in value and id keep the order of their hashes.
    """
    kept = filter_alerts(df, filters)
    order = [*sort_order(filters.sort), F.xxhash64(*[quoted(c) for c in kept.columns])]
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(ranged, "ordered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(_count().alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(counts.select("_part", "_n", F.coalesce(before, F.lit(0)).alias("_before")), "offsets")
    row = F.col("_before") + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))
    numbered = join_small(placed.withColumn("_part", part), offsets, "_part").withColumn("row", row)
    page = F.expr(f"row div {filters.page_size}") + 1
    paged = numbered.withColumn("page", page).withColumn("folder", F.expr(f"(page - 1) div {per_folder}"))
    paged.drop("_at", "_part", "_n", "_before").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/pages")
    total = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.lit(filters.page_size).alias("page_size"),
                        F.lit(per_folder).alias("per_folder"), F.lit(kept.schema.json()).alias("columns"))
    total.coalesce(1).write.mode("overwrite").parquet(f"{path}/total")
    return df.sparkSession.read.parquet(f"{path}/total").first().total


def read_page(spark: SparkSession, path: str, page: int) -> DataFrame:
    """Page ``page`` (from 1) of a page directory, in order; an empty frame behind the last one.

    Only the folder of the page is listed and read, and of its files the parts with the page.
    """
    facts = spark.read.parquet(f"{path}/total").first()
    if page < 1 or (page - 1) * facts.page_size >= facts.total:
        return spark.createDataFrame([], StructType.fromJson(json.loads(facts.columns)))
    rows = spark.read.parquet(f"{path}/pages/folder={(page - 1) // facts.per_folder}")
    return rows.filter(F.col("page") == page).orderBy("row").drop("page", "row")


def recent(df: DataFrame, n: int = 5) -> DataFrame:
    return sort_alerts(df, "-timestamp").limit(n)


def report_page(df: DataFrame, page: int, size: int = 20) -> DataFrame:
    """One report page with the row numbers of its first and last row and the total."""
    items, total = page_alerts(df, AlertFilters(page=page, page_size=size))
    count = total.first().total
    first = F.lit((page - 1) * size + 1 if count else 0).cast("bigint")
    last = F.lit(min(count, page * size)).cast("bigint")
    return items.withColumns({"row_from": first, "row_to": last, "total": F.lit(count).cast("bigint")})


def status_causes(df: DataFrame, as_of: datetime, hours: int = 2, n: int = 3) -> DataFrame:
    """Most severe alerts of the last hours (start excluded), newest first within a rank."""
    kept = df.filter(F.col("timestamp") > F.lit(as_of - timedelta(hours=hours)))
    rank = A.severity_rank("severity", base=1)
    return kept.orderBy(rank.desc(), F.col("timestamp").desc(), F.col("id")).limit(n)


# --- counts --------------------------------------------------------------------


def severity_counts(df: DataFrame, since: datetime | None = None,
                    until: datetime | None = None) -> DataFrame:
    """One row with the four severities as columns, absent ones 0."""
    df = time_window(df, since, until)
    return df.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES])


def attack_distribution(df: DataFrame, since: datetime | None = None,
                        until: datetime | None = None) -> DataFrame:
    kind = F.coalesce(F.nullif("attack_type", F.lit("")), F.lit("UNKNOWN"))
    counts = time_window(df, since, until).groupBy(kind.alias("attack_type"))
    return counts.agg(_count().alias("count")).orderBy(F.desc("count"), "attack_type")


def count_between(df: DataFrame, since: datetime | None = None,
                  until: datetime | None = None) -> DataFrame:
    return time_window(df, since, until).agg(_count().alias("total"))


def midnight(as_of: datetime) -> datetime:
    return as_of.replace(hour=0, minute=0, second=0, microsecond=0)


def avg_score(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg("model_score"), F.lit(0.0)).alias("avg_score"))


def malicious_ratio(df: DataFrame) -> DataFrame:
    """Malicious count and its share of all alerts in percent."""
    counts = df.agg(
        F.count_if(F.col("model_label") == "malicious").alias("malicious"), _count().alias("total")
    )
    share = F.coalesce(F.try_divide(F.col("malicious"), F.col("total")) * F.lit(100.0), F.lit(0.0))
    return counts.withColumn("ratio", share)


def unique_sources(df: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("src_ip") if approximate else F.countDistinct("src_ip")
    return df.agg(distinct.alias("unique_sources"))


def latest_ts(df: DataFrame) -> DataFrame:
    return df.agg(F.max("timestamp").alias("latest"))


def top_rules(df: DataFrame, n: int = 5, since: datetime | None = None,
              until: datetime | None = None) -> DataFrame:
    counts = time_window(df, since, until).groupBy("rule_name").agg(_count().alias("count"))
    return counts.orderBy(F.desc("count"), "rule_name").limit(n)


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(quoted(column)).agg(_count().alias("count"))


def prediction_counts(df: DataFrame, column: str = "attack_type", by_count: bool = False) -> DataFrame:
    order = [F.desc("count"), quoted(column)] if by_count else [quoted(column)]
    return class_counts(df, column).orderBy(*order)


def summary_counts(df: DataFrame) -> DataFrame:
    """Total, per severity and per attack type in one pass."""
    small = df.groupBy("severity", "attack_type").agg(_count().alias("n"))
    entries = F.explode(F.array(
        _entry("total", F.lit(""), F.col("n")),
        _entry("severity", F.col("severity"), F.col("n")),
        _entry("attack_type", F.col("attack_type"), F.col("n")),
    ))
    return _fold(small.select(entries.alias("e")))


# --- series and dashboards -----------------------------------------------------


def _hour_floor(as_of: datetime) -> datetime:
    return as_of.replace(minute=0, second=0, microsecond=0)


def hour_spine(df: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """The last ``hours`` whole-hour buckets up to the current one."""
    start = F.lit(_hour_floor(as_of) - timedelta(hours=hours - 1))
    return df.sparkSession.range(hours, numPartitions=1).select(
        F.timestamp_seconds(F.unix_seconds(start) + F.col("id") * F.lit(3600)).alias("bucket")
    )


def hourly_series(df: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Alerts per hour for the last ``hours`` buckets, empty hours 0."""
    spine = hour_spine(df, as_of, hours)
    first = _hour_floor(as_of) - timedelta(hours=hours - 1)
    last = _hour_floor(as_of) + timedelta(hours=1)
    kept = df.filter((F.col("timestamp") >= F.lit(first)) & (F.col("timestamp") < F.lit(last)))
    counts = kept.groupBy(F.date_trunc("hour", "timestamp").alias("bucket")).agg(
        _count().alias("count")
    )
    # At most one row per bucket of the range, so this side has no more than `hours` rows.
    series = spine.join(F.broadcast(counts), "bucket", "left")
    return series.select("bucket", F.coalesce("count", F.lit(0)).alias("count"))


def peak_bucket(series: DataFrame) -> DataFrame:
    """The fullest bucket, the earliest one on ties."""
    key = F.struct(F.col("count"), -F.unix_seconds("bucket"))
    return series.agg(F.max_by("bucket", key).alias("bucket"), F.max("count").alias("count"))


def _entry(section: str, key: Column, value: Column, when: Column | None = None) -> Column:
    amount = value.cast("bigint")
    amount = amount if when is None else F.when(when, amount).otherwise(F.lit(0))
    return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"),
                    amount.alias("value"))


def _fold(entries: DataFrame) -> DataFrame:
    """Sum the entries per section and key; of ``latest`` the largest."""
    value = F.when(F.col("key") == "latest", F.max("value")).otherwise(F.try_sum("value"))
    return entries.select("e.*").groupBy("section", "key").agg(value.alias("value"))


def _zeros(df: DataFrame, as_of: datetime, severity_sections: Sequence[str]) -> DataFrame:
    """Zero entries for every severity and hour, so that absent ones are reported."""
    fixed = [_entry(s, F.lit(v), F.lit(0)) for s in severity_sections for v in S.SEVERITIES]
    one = df.sparkSession.range(1, numPartitions=1)
    out = one.select(F.explode(F.array(*fixed)).alias("e"))
    hours = hour_spine(df, as_of).select(_entry("series", _hour_text(F.col("bucket")), F.lit(0)).alias("e"))
    return out.unionByName(hours)


def _hour_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _by_hour(df: DataFrame, as_of: datetime, *keys: str) -> DataFrame:
    """Counts per severity, key, and hour; hours outside the last day share one NULL row."""
    recent_day = F.col("timestamp") >= F.lit(as_of - timedelta(hours=24))
    bucket = F.date_trunc("hour", "timestamp")
    first = F.lit(_hour_floor(as_of) - timedelta(hours=23))
    shown = (bucket >= first) & (bucket <= F.lit(_hour_floor(as_of)))
    return df.groupBy(
        *keys,
        recent_day.alias("recent"),
        (F.col("timestamp") >= F.lit(midnight(as_of))).alias("today"),
        F.when(recent_day & shown, _hour_text(bucket)).alias("hour"),
    ).agg(_count().alias("n"), F.max("timestamp").alias("last"))


def metrics_overview(df: DataFrame, as_of: datetime) -> DataFrame:
    """Severity counts of the last day and overall, and the hourly series, in one pass.

    Long form: ``section`` (severity_24h, severity_total, series), ``key``, ``value``.
    """
    small = _by_hour(df, as_of, "severity")
    entries = F.array(
        _entry("severity_24h", F.col("severity"), F.col("n"), F.col("recent")),
        _entry("severity_total", F.col("severity"), F.col("n")),
        _entry("series", F.col("hour"), F.col("n")),
    )
    kept = small.select(F.explode(entries).alias("e")).filter("e.key is not null")
    return _fold(kept.unionByName(_zeros(df, as_of, ["severity_24h", "severity_total"])))


def dashboard_metrics(df: DataFrame, as_of: datetime) -> DataFrame:
    """Totals, today, latest alert, attack distribution, severities and series of the last
    day, in one pass. Long form; the latest alert is in epoch microseconds."""
    small = _by_hour(df, as_of, "severity", "attack_type")
    entries = F.array(
        _entry("total", F.lit("alerts"), F.col("n")),
        _entry("total", F.lit("today"), F.col("n"), F.col("today")),
        _entry("total", F.lit("latest"), F.unix_micros("last")),
        _entry("attack", F.col("attack_type"), F.col("n")),
        _entry("severity_24h", F.col("severity"), F.col("n"), F.col("recent")),
        _entry("series", F.col("hour"), F.col("n")),
    )
    kept = small.select(F.explode(entries).alias("e")).filter("e.key is not null")
    return _fold(kept.unionByName(_zeros(df, as_of, ["severity_24h"])))


# --- reports -------------------------------------------------------------------


def model_performance(df: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Count, average score and latency of the last hours: overall, per attack type and
    per dataset. ``hours`` is held between 1 and 168.

    The frame is reduced once to (attack, source, label); the views are sums over that
    small result.
    """
    hours = max(1, min(hours, 168))
    kept = df.filter(F.col("timestamp") >= F.lit(as_of - timedelta(hours=hours)))
    latency = latency_ms("ingested_at", "timestamp")
    small = kept.groupBy(
        F.coalesce("attack_type", F.lit("UNKNOWN")).alias("attack_type"),
        A.meta_field("meta", "dataset_source").alias("source"),
        A.meta_field("meta", "dataset_label").alias("label"),
    ).agg(_count().alias("n"), F.sum("model_score").alias("score"), F.sum(latency).alias("latency"),
          F.count("model_score").alias("n_score"), F.count(latency).alias("n_latency"))
    sums = [F.sum(c).alias(c) for c in ("n", "score", "latency", "n_score", "n_latency")]
    both = [F.col("attack_type")], [F.col("source"), F.col("label")]
    groups = small.groupingSets(both, F.col("attack_type"), F.col("source"), F.col("label"))
    views = groups.agg(F.grouping("attack_type").alias("of_dataset"), *sums)
    section = F.when(F.col("of_dataset") == 0, "attack_type").otherwise("dataset")
    views = views.withColumn("section", section).drop("of_dataset")
    # The overall line exists even when there is no alert.
    total = small.agg(*sums).withColumn("section", F.lit("total"))

    def mean(of: str) -> Column:
        """Mean of the rows that have a value."""
        return F.coalesce(F.try_divide(F.col(of), F.col(f"n_{of}")), F.lit(0.0))

    return views.unionByName(total, allowMissingColumns=True).select(
        "section", "attack_type", "source", "label",
        F.coalesce("n", F.lit(0)).alias("count"),
        mean("score").alias("avg_model_score"),
        mean("latency").alias("avg_latency_ms"),
    )


def reports_summary(df: DataFrame, from_ts: datetime | None = None,
                    to_ts: datetime | None = None) -> DataFrame:
    """Report of a time range in long form: ``section, key, value``.

    Sections: total (alerts, average_score, malicious_ratio, unique_sources), severity,
    attack, rule (top five). One reduction serves counts, averages and rules; the distinct
    sources need a pass of their own.
    """
    kept = time_window(df, from_ts, to_ts)
    small = kept.groupBy("severity", F.coalesce("attack_type", F.lit("UNKNOWN")).alias("attack_type"), "rule_name").agg(
        _count().alias("n"),
        F.sum("model_score").alias("score"),
        F.count("model_score").alias("scored"),
        F.count_if(F.col("model_label") == "malicious").alias("bad"),
    )
    n, zero = F.col("n"), F.lit(0)

    def entry(section: str, key: Column, value: Column, weight: Column | None = None) -> Column:
        """A value to sum up; with a weight the sum is divided by the summed weight."""
        weight = F.lit(None) if weight is None else weight
        return F.struct(F.lit(section).alias("section"), key.alias("key"),
                        value.cast("double").alias("value"), weight.cast("double").alias("weight"))

    def entries(frame: DataFrame, items: list[Column]) -> DataFrame:
        return frame.select(F.explode(F.array(*items)).alias("e")).select("e.*")

    def totals(count: Column, score: Column, scored: Column, bad: Column) -> list[Column]:
        return [
            entry("total", F.lit("alerts"), count),
            entry("total", F.lit("average_score"), score, scored),
            entry("total", F.lit("malicious_ratio"), bad * F.lit(100.0), count),
        ]

    rows = entries(small, [*totals(n, F.col("score"), F.col("scored"), F.col("bad")), entry("severity", F.col("severity"), n),
                           entry("attack", F.col("attack_type"), n)])
    # Totals and all four severities are reported even when there is no alert.
    fixed = entries(df.sparkSession.range(1, numPartitions=1),
                    [*totals(zero, zero, zero, zero), *[entry("severity", F.lit(s), zero) for s in S.SEVERITIES]])
    sums = rows.unionByName(fixed).groupBy("section", "key").agg(F.sum("value").alias("v"), F.sum("weight").alias("w"))
    value = F.when(F.col("w").isNull(), F.col("v")).otherwise(F.coalesce(F.try_divide("v", "w"), F.lit(0.0)))
    parts = sums.select("section", "key", value.alias("value"))
    rules = small.groupBy("rule_name").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "rule_name").limit(5)
    rules = rules.select(
        F.lit("rule").alias("section"), F.col("rule_name").alias("key"), F.col("count").cast("double").alias("value"))
    sources = unique_sources(kept).select(
        F.lit("total").alias("section"), F.lit("unique_sources").alias("key"), F.col("unique_sources").cast("double").alias("value"))
    return parts.unionByName(rules).unionByName(sources)


def summary_long(report: DataFrame, range_label: str, generated: datetime) -> DataFrame:
    """Report summary as exported: section, key and text value, attacks cut to five."""
    def whole(c: Column) -> Column:
        return c.cast("bigint").cast("string")

    value = F.col("value")
    names = {
        "alerts": ("Alertas", whole(value)),
        "average_score": ("Riesgo promedio", A.percent(value)),
        "malicious_ratio": ("% Maliciosas", F.concat(whole(round_half_up(value)), F.lit("%"))),
        "unique_sources": ("IPs Únicas", whole(value)),
    }
    total = F.col("section") == "total"
    key, text = F.col("key"), whole(value)
    for name, (title, shown) in names.items():
        key = F.when(total & (F.col("key") == name), F.lit(title)).otherwise(key)
        text = F.when(total & (F.col("key") == name), shown).otherwise(text)
    key = F.when(F.col("section") == "attack", A.attack_label("key")).otherwise(key)
    titles = {"total": "Resumen", "severity": "Severidad", "attack": "Ataques", "rule": "Reglas"}
    section = F.col("section")
    for name, title in titles.items():
        section = F.when(F.col("section") == name, F.lit(title)).otherwise(section)
    # The report has a handful of rows per section.
    ranked = Window.partitionBy("section").orderBy(F.desc("value"), "key")
    kept = report.withColumn("_r", F.row_number().over(ranked))
    kept = kept.filter((F.col("section") != "attack") | (F.col("_r") <= 5))
    rows = kept.select(section.alias("section"), key.alias("key"), text.alias("value"))
    head = report.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(
        F.struct(F.lit("Resumen").alias("section"), F.lit("Generado").alias("key"),
                 F.date_format(F.lit(generated), "yyyy-MM-dd HH:mm:ss").alias("value")),
        F.struct(F.lit("Resumen").alias("section"), F.lit("Rango").alias("key"),
                 F.lit(range_label).alias("value")),
    )).alias("e")).select("e.*")
    return head.unionByName(rows)


def report_rows(df: DataFrame, key: str, as_of: datetime, cap: int) -> DataFrame:
    """The ``cap`` newest alerts of a preset range as the eight formatted report columns."""
    newest = sort_alerts(range_filter(df, key, as_of), "-timestamp").limit(cap)
    return newest.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Fecha"),
        F.col("severity").alias("Severidad"),
        F.col("attack_type").alias("Tipo"),
        A.endpoint("src_ip", "src_port").alias("Origen"),
        A.endpoint("dst_ip", "dst_port").alias("Destino"),
        F.col("protocol").alias("Protocolo"),
        F.col("rule_name").alias("Regla"),
        A.display_confidence("model_score", "model_label")["percent"].alias("Score"),
    )


def share(counts: DataFrame, of: str = "max", value: str = "count") -> DataFrame:
    """Rounded percentage of the largest (``max``) or of the sum (``total``) of a count
    table. The table is a report result with one row per category."""
    everything = Window.partitionBy()
    if of == "max":
        base = F.greatest(F.max(value).over(everything), F.lit(1))
    else:
        base = F.sum(value).over(everything)
    percent = round_half_up(F.coalesce(F.try_divide(F.col(value), base), F.lit(0.0)) * F.lit(100.0))
    return counts.withColumn("percent", percent.cast("bigint"))


def health_state(counts: DataFrame) -> DataFrame:
    """State of the network from a severity-count row."""
    state = F.when(F.col("Critical") > 0, "critical").when(F.col("High") > 0, "suspicious")
    return counts.withColumn("state", state.otherwise("safe"))
