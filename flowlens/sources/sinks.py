"""Writers for alerts, conn rows, labelled exports and reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.alerts import with_meta
from flowlens.functions.common import quoted
from flowlens.operators.alerts import AlertFilters, filter_alerts, sort_alerts
from flowlens.operators.features import conn_features
from flowlens.operators.sampling import sample_per_class
from flowlens.sources.checks import conn_rows, numbered_flows

# Quotes inside a quoted cell are doubled and blanks around values are kept.
_CSV_TEXT = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_CSV = {"header": "true", **_CSV_TEXT}

# Row number within a partition is the low part of the generated id.
_FIRST_IN_PARTITION = (1 << 33) - 1


def append_alerts(df: DataFrame, path: str, source: str) -> None:
    """Append alerts, stamping who wrote them and when; one folder per day."""
    stamped = df.withColumns({
        "meta": with_meta("meta", source=F.lit(source)),
        "ingested_at": F.current_timestamp(),
        "date": F.to_date("timestamp"),
    })
    stamped.write.mode("append").partitionBy("date").parquet(path)


def iso_text(c: Column) -> Column:
    """ISO timestamp; the fraction is left out when it is zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(c) % 1_000_000 == 0, whole).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def export_columns(df: DataFrame) -> DataFrame:
    """The 13 exported alert columns, score with four digits, ISO timestamps."""
    shown = {"timestamp": iso_text(F.col("timestamp")), "model_score": F.format_string("%.4f", "model_score")}
    return df.select(*[shown.get(c, F.col(c)).alias(c) for c in S.ALERT_EXPORT_COLUMNS])


def export_alerts_csv(df: DataFrame, filters: AlertFilters, path: str) -> None:
    """Filtered and sorted alerts as CSV; part files follow the sort order."""
    ordered = sort_alerts(filter_alerts(df, filters), filters.sort)
    export_columns(ordered).write.options(**_CSV).csv(path)


def with_header_lines(df: DataFrame, header: str, value: Column) -> DataFrame:
    """Text rows with ``header`` in front of the first row of every partition."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(_FIRST_IN_PARTITION)) == 0
    lines = df.select(value.alias("value"), first.alias("first"))
    return lines.select(
        F.when(F.col("first"), F.concat(F.lit(header + "\n"), F.col("value")))
        .otherwise(F.col("value")).alias("value")
    )


def _write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Write text lines; a table without rows still gets a file with the header."""
    lines.write.text(path)
    if lines.sparkSession.read.text(path).isEmpty():
        lines.sparkSession.createDataFrame([(header,)], "value string").write.mode("append").text(path)


def write_conn_csv(df: DataFrame, path: str) -> None:
    """Conn rows as CSV with a ``#fields`` header in every part file."""
    columns = [c for c in S.CONN_COLUMNS if c.replace(".", "_") in df.columns]
    row = F.struct(*[quoted(c.replace(".", "_")).cast("string").alias(c) for c in columns])
    header = ",".join(["#fields", *columns])
    _write_lines(with_header_lines(df, header, F.to_csv(row, _CSV_TEXT)), header, path)


def write_zeek_log(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Rows as a tab-separated log with a ``#fields`` line in every part file."""
    cells = [F.coalesce(quoted(c.replace(".", "_")).cast("string"), F.lit("-")) for c in columns]
    header = "#separator \\x09\n" + "\t".join(["#fields", *columns])
    _write_lines(with_header_lines(df, header, F.concat_ws("\t", *cells)), header, path)


def convert_and_write(df: DataFrame, path: str, dataset_name: str) -> dict[str, int]:
    """Convert flow rows to conn rows and write them.

    Written, skipped and input counts are observed during the one pass that writes.
    """
    seen = Observation()
    wrong = F.count_if(F.col("reject_reason").isNotNull())
    total = F.count(F.lit(1))
    staged = numbered_flows(df).observe(
        seen, (total - wrong).alias("written"), wrong.alias("skipped"), total.alias("input"))
    write_conn_csv(conn_rows(staged, dataset_name, df.columns), path)
    return seen.get


def alert_ready(df: DataFrame, mapped: bool = False) -> DataFrame:
    """Labelled rows in the fixed export order.

    Missing ``service`` and ``conn_state`` become ``-``; any other missing column is an
    error. ``mapped`` adds the class column.
    """
    columns = [c.replace(".", "_") for c in S.ALERT_READY_COLUMNS] + (["Label_mapped"] if mapped else [])
    for name in ("service", "conn_state"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("-"))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def export_alert_ready(df: DataFrame, path: str, mapped: bool = False) -> None:
    alert_ready(df, mapped).write.options(**_CSV).csv(path)


def dashboard_summary(metrics: DataFrame, generated: datetime) -> DataFrame:
    """Dashboard summary as exported: section, key, text value, and the order of the lines.

    ``metrics`` is the long form of ``dashboard_metrics``: a few rows per section. Attacks
    are cut to the five most frequent.
    """
    section, key, value = F.col("section"), F.col("key"), F.col("value")
    latest = F.when(value.isNull() | (value == 0), F.lit("Sin registros")).otherwise(
        F.date_format(F.timestamp_micros(value), "yyyy-MM-dd HH:mm:ss"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("value"), "key"))
    rows = metrics.filter(section.isin("total", "severity_24h", "attack")).withColumn("_r", rank)
    rows = rows.filter((section != "attack") | (F.col("_r") <= 5))
    total = section == "total"
    title = F.when(total & (key == "today"), "Alertas Hoy").when(total & (key == "alerts"), "Alertas Totales").when(total, "Última alerta")
    severity = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(S.SEVERITIES) for x in (n, i)]), key)
    place = F.when(total, F.when(key == "today", 1).when(key == "alerts", 2).otherwise(3)).when(
        section == "severity_24h", 4 + severity).otherwise(10 + F.col("_r"))
    shown = rows.select(
        F.when(total, "Resumen").when(section == "severity_24h", "Severidad").otherwise("Top Ataques").alias("section"),
        F.coalesce(title, key).alias("key"), F.when(total & (key == "latest"), latest).otherwise(value.cast("string")).alias("value"),
        place.cast("int").alias("line"))
    head = metrics.sparkSession.range(1, numPartitions=1).select(
        F.lit("Resumen").alias("section"), F.lit("Generado").alias("key"),
        F.date_format(F.lit(generated), "yyyy-MM-dd HH:mm:ss").alias("value"), F.lit(0).alias("line"))
    return head.unionByName(shown).orderBy("line")


def export_dashboard_summary(metrics: DataFrame, generated: datetime, path: str) -> None:
    """The dashboard summary as a CSV in which every cell is quoted."""
    names = {"section": "Sección", "key": "Clave", "value": "Valor"}
    rows = dashboard_summary(metrics, generated).select(*[F.col(c).alias(n) for c, n in names.items()])
    rows.coalesce(1).write.mode("overwrite").options(**_CSV, quoteAll="true").csv(path)


def labeled_rows(df: DataFrame) -> DataFrame:
    """Labelled rows without exact duplicates."""
    return df.dropDuplicates()


def ml_rows(df: DataFrame) -> DataFrame:
    """Five base features and the label, without exact duplicate source rows."""
    base = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "Label"]
    return labeled_rows(df).select(*base)


def export_ml(df: DataFrame, path: str) -> None:
    ml_rows(df).write.options(**_CSV).csv(path)


def export_correct_samples(df: DataFrame, path: str, truth: str = "Label_mapped",
                           prediction: str = "predicted", n: int = 50) -> None:
    """Up to ``n`` correctly classified rows per class, one folder per class."""
    correct = df.filter(quoted(truth) == quoted(prediction))
    sample_per_class(correct, truth, n).write.options(**_CSV).partitionBy(truth).csv(path)


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def feature_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The 14 model features of conn rows and the label, when there is one."""
    if limit:
        df = df.limit(limit)
    present = [c for c in ("cicids_attack", "label", "attack") if c in df.columns]
    labels = [F.coalesce(*[F.nullif(quoted(c), F.lit("")) for c in present]).alias("label")] if present else []
    return conn_features(df, "serve").select(*S.CONN_FEATURES, *labels)


def export_features(df: DataFrame, path: str, limit: int | None = None) -> None:
    feature_rows(df, limit).write.options(**_CSV).csv(path)
