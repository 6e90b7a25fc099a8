"""Registered queries: alert filters, sorting, counts, series and reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import alerts as A
from flowlens.functions.times import latest
from flowlens.operators import alerts as Q
from flowlens.plans.registry import query
from flowlens.plans.views import Tables, case_sql
from flowlens.session import scratch_dir
from flowlens.sources import sinks

_AS_OF = "(SELECT max(timestamp) FROM alerts)"


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"


def _as_of(t: Tables) -> datetime:
    return latest(t.events(), "ts")


def _shown(df: DataFrame) -> DataFrame:
    """Identifying alert columns; the time in microseconds."""
    return df.select("id", F.unix_micros("timestamp").alias("micros"), "severity", "attack_type",
                     "protocol", "src_port", "model_score", "model_label", "rule_id")


_SHOWN = ("id, epoch_us(timestamp) AS micros, severity, attack_type, protocol, src_port, model_score,"
          " model_label, rule_id")


# --- filters -----------------------------------------------------------------------


@query("p1_filter_alerts", "alerts", f"""
SELECT {_SHOWN} FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 10 DAY AND timestamp <= {_AS_OF} - INTERVAL 1 DAY
  AND severity IN ('High', 'Critical') AND attack_type IN ('DOS', 'DDOS') AND protocol IN ('TCP', 'UDP')""")
def p1(t: Tables) -> DataFrame:
    now = _as_of(t)
    return _shown(Q.filter_alerts(t.alerts(), Q.AlertFilters(
        from_ts=now - timedelta(days=10), to_ts=now - timedelta(days=1), severity=["High", "Critical"],
        attack_type=["DOS", "DDOS"], protocol=["TCP", "UDP"])))


@query("p2_search", "alerts", f"""
SELECT {_SHOWN} FROM alerts WHERE concat_ws(chr(10), lower(src_ip), lower(dst_ip), lower(rule_name), lower(rule_id),
  lower(attack_type), lower(severity), lower(protocol), lower(model_label), CAST(model_score AS VARCHAR)) LIKE '%0.77%'""")
def p2(t: Tables) -> DataFrame:
    return _shown(Q.search(t.alerts(), "0.77"))


@query("p2_search_wildcard", "alerts", f"""
SELECT {_SHOWN} FROM alerts WHERE lower(rule_name) LIKE '%brute_f%' OR lower(attack_type) LIKE '%brute_f%'""")
def p2_wildcard(t: Tables) -> DataFrame:
    return _shown(Q.search(t.alerts(), "BRUTE_F", like=True))


@query("p3_time_window", "alerts", f"""
SELECT count(*) AS n, round(avg(model_score), 6) AS score FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 5 DAY
  AND timestamp <= {_AS_OF} - INTERVAL 2 DAY""")
def p3(t: Tables) -> DataFrame:
    now = _as_of(t)
    kept = Q.time_window(t.alerts(), now - timedelta(days=5), now - timedelta(days=2))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("model_score"), 6).alias("score"))


@query("p4_predicted_as", "alerts", f"SELECT {_SHOWN} FROM alerts WHERE attack_type = 'PORTSCAN'")
def p4(t: Tables) -> DataFrame:
    return _shown(Q.predicted_as(t.alerts(), "PORTSCAN"))


@query("p10_get_alert", "alerts", f"SELECT {_SHOWN} FROM alerts WHERE id = md5('C77')")
def p10(t: Tables) -> DataFrame:
    import hashlib

    return _shown(Q.get_alert(t.alerts(), hashlib.md5(b"C77").hexdigest()))


@query("p11_range_filter", "alerts", f"""
SELECT * FROM (
SELECT '1h' AS range, count(*) AS n FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 1 HOUR UNION ALL
SELECT '24h', count(*) FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 24 HOUR UNION ALL
SELECT '7d', count(*) FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 168 HOUR UNION ALL
SELECT '30d', count(*) FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 720 HOUR)""")
def p11(t: Tables) -> DataFrame:
    now, alerts = _as_of(t), t.alerts()
    widest = Q.range_filter(alerts, "30d", now)
    starts = {k: now - timedelta(hours=h) for k, h in S.REPORT_RANGES.items()}
    counts = widest.agg(*[F.count_if(F.col("timestamp") >= F.lit(s)).alias(k) for k, s in starts.items()])
    return counts.unpivot([], list(starts), "range", "n")


@query("p11_bucket_filter", "alerts", f"""
SELECT {_SHOWN} FROM alerts WHERE timestamp >= date_trunc('hour', {_AS_OF}) - INTERVAL 3 HOUR
  AND timestamp <= date_trunc('hour', {_AS_OF}) - INTERVAL 2 HOUR""")
def p11_bucket(t: Tables) -> DataFrame:
    hour = _as_of(t).replace(minute=0, second=0, microsecond=0)
    return _shown(Q.bucket_filter(t.alerts(), hour - timedelta(hours=3)))


# --- sorting and paging --------------------------------------------------------------


@query("l1_sort_alerts", "alerts", f"""
SELECT {_SHOWN} FROM alerts ORDER BY {case_sql(S.SEVERITY_RANK, 'severity')} DESC, id""")
def l1(t: Tables) -> DataFrame:
    return _shown(Q.sort_alerts(t.alerts(), "-severity"))


@query("l2_page_alerts", "alerts", f"""
SELECT {_SHOWN}, (SELECT count(*) FROM alerts WHERE attack_type = 'DDOS') AS total FROM alerts WHERE attack_type = 'DDOS'
ORDER BY model_score, id LIMIT 25 OFFSET 50""")
def l2(t: Tables) -> DataFrame:
    items, total = Q.page_alerts(t.alerts(), Q.AlertFilters(page=3, attack_type=["DDOS"], sort="model_score"))
    return _shown(items).withColumn("total", F.lit(total.first().total).cast("bigint"))


@query("l2_page_directory", "alerts", f"""
SELECT {_SHOWN}, (SELECT count(*) FROM alerts WHERE severity IN ('High', 'Critical')) AS total
FROM alerts WHERE severity IN ('High', 'Critical') ORDER BY timestamp DESC, id LIMIT 10 OFFSET 150""")
def l2_directory(t: Tables) -> DataFrame:
    """Page 16 by its number, from a directory that lists every page."""
    path = scratch_dir(t.spark, "pages")
    total = Q.write_pages(t.alerts(), Q.AlertFilters(page_size=10, severity=["High", "Critical"]), path, per_folder=4)
    return _shown(Q.read_page(t.spark, path, 16)).withColumn("total", F.lit(total).cast("bigint"))


@query("l2_page_after", "alerts", f"SELECT {_SHOWN} FROM alerts ORDER BY timestamp DESC, id LIMIT 25 OFFSET 25")
def l2_after(t: Tables) -> DataFrame:
    alerts, filters = t.alerts(), Q.AlertFilters(page_size=25)
    first = Q.page_after(alerts, filters)
    return _shown(Q.page_after(alerts, filters, Q.next_page_key(first, filters)))


# Days and few ids, so that many rows tie; the event number tells them apart.
_TIED = "SELECT *, date_trunc('day', timestamp) AS day, md5(CAST(event_id % 7 AS VARCHAR)) AS tied FROM alerts"


@query("l2_page_walk", "alerts", f"""
WITH p AS ({_TIED}),
a AS (SELECT 'timestamp' AS key, epoch_us(day) AS value, tied AS id FROM p ORDER BY day, tied LIMIT 120),
b AS (SELECT '-severity' AS key, CASE severity WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 3 END AS value, tied AS id
  FROM p ORDER BY value DESC, tied LIMIT 120)
SELECT key, CAST(value AS BIGINT) AS value, id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def l2_walk(t: Tables) -> DataFrame:
    """Three pages by two sort keys over rows that tie; each page starts where the last ended."""
    alerts = t.alerts()
    number = F.substring("rule_id", 7, 20).cast("bigint")
    tied = alerts.withColumns({"timestamp": F.date_trunc("day", "timestamp"), "id": F.md5((number % 7).cast("string"))})
    pages = None
    for key, value in (("timestamp", F.unix_micros("timestamp")), ("-severity", A.severity_rank("severity").cast("bigint"))):
        filters, after = Q.AlertFilters(page_size=40, sort=key), None
        for _ in range(3):
            page = Q.page_after(tied, filters, after)
            after = Q.next_page_key(page, filters, after) or after
            shown = page.select(F.lit(key).alias("key"), value.alias("value"), "id")
            pages = shown if pages is None else pages.unionByName(shown)
    return pages.groupBy("key", "value", "id").agg(F.count(F.lit(1)).alias("n"))


@query("l3_status_causes", "alerts", f"""
SELECT {_SHOWN} FROM alerts WHERE timestamp > {_AS_OF} - INTERVAL 2 HOUR
ORDER BY {case_sql(S.SEVERITY_RANK, 'severity')} DESC, timestamp DESC, id LIMIT 3""")
def l3(t: Tables) -> DataFrame:
    return _shown(Q.status_causes(t.alerts(), _as_of(t)))


@query("l4_recent", "alerts", f"SELECT {_SHOWN} FROM alerts ORDER BY timestamp DESC, id LIMIT 5")
def l4(t: Tables) -> DataFrame:
    return _shown(Q.recent(t.alerts(), 5))


@query("l4_report_page", "alerts", """
SELECT id, CAST(21 AS BIGINT) AS row_from, CAST(40 AS BIGINT) AS row_to, (SELECT count(*) FROM alerts) AS total
FROM alerts ORDER BY timestamp DESC, id LIMIT 20 OFFSET 20""")
def l4_page(t: Tables) -> DataFrame:
    return Q.report_page(t.alerts(), 2).select("id", "row_from", "row_to", "total")


# --- counts --------------------------------------------------------------------------

_SEVERITY_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS \"{s}\"" for s in S.SEVERITIES)


@query("a1_severity_counts", "alerts", f"SELECT {_SEVERITY_COUNTS} FROM alerts")
def a1(t: Tables) -> DataFrame:
    return Q.severity_counts(t.alerts())


@query("a1_severity_counts_24h", "alerts",
       f"SELECT {_SEVERITY_COUNTS} FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 24 HOUR")
def a1_day(t: Tables) -> DataFrame:
    return Q.severity_counts(t.alerts(), since=_as_of(t) - timedelta(hours=24))


@query("a2_attack_distribution", "alerts", 'SELECT attack_type, count(*) AS "count" FROM alerts GROUP BY 1')
def a2(t: Tables) -> DataFrame:
    return Q.attack_distribution(t.alerts())


@query("a3_totals", "alerts", f"""
SELECT 'all' AS span, count(*) AS total FROM alerts UNION ALL
SELECT 'between', count(*) FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 3 DAY AND timestamp <= {_AS_OF} - INTERVAL 1 DAY UNION ALL
SELECT 'today', count(*) FROM alerts WHERE timestamp >= date_trunc('day', {_AS_OF})""")
def a3(t: Tables) -> DataFrame:
    now, alerts = _as_of(t), t.alerts()
    spans = {"all": (None, None), "between": (now - timedelta(days=3), now - timedelta(days=1)),
             "today": (Q.midnight(now), None)}
    frames = [Q.count_between(alerts, *span).withColumn("span", F.lit(n)) for n, span in spans.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).select("span", "total")


@query("a4_avg_score", "alerts", "SELECT round(avg(model_score), 6) AS avg_score FROM alerts")
def a4(t: Tables) -> DataFrame:
    return Q.avg_score(t.alerts()).select(F.round("avg_score", 6).alias("avg_score"))


@query("a5_malicious_ratio", "alerts", """
SELECT count(*) FILTER (model_label = 'malicious') AS malicious, count(*) AS total,
  round(count(*) FILTER (model_label = 'malicious') / count(*) * 100.0, 6) AS ratio FROM alerts""")
def a5(t: Tables) -> DataFrame:
    return Q.malicious_ratio(t.alerts()).withColumn("ratio", F.round("ratio", 6))


@query("a6_unique_sources", "alerts", "SELECT count(DISTINCT src_ip) AS unique_sources FROM alerts")
def a6(t: Tables) -> DataFrame:
    return Q.unique_sources(t.alerts())


@query("a7_latest_ts", "alerts", "SELECT epoch_us(max(timestamp)) AS latest FROM alerts")
def a7(t: Tables) -> DataFrame:
    return Q.latest_ts(t.alerts()).select(F.unix_micros("latest").alias("latest"))


@query("a8_top_rules", "alerts",
       'SELECT rule_name, count(*) AS "count" FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5')
def a8(t: Tables) -> DataFrame:
    return Q.top_rules(t.alerts())


@query("a9_model_performance", "alerts", f"""
WITH w AS (SELECT * FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 168 HOUR)
SELECT 'total' AS section, '' AS attack_type, '' AS source, '' AS label, count(*) AS "count",
  round(avg(model_score), 6) AS avg_model_score, round(avg(CAST(k AS DOUBLE)), 6) AS avg_latency_ms FROM w UNION ALL
SELECT 'attack_type', attack_type, '', '', count(*), round(avg(model_score), 6), round(avg(CAST(k AS DOUBLE)), 6)
  FROM w GROUP BY attack_type UNION ALL
SELECT 'dataset', '', dataset_source, coalesce(dataset_label, ''), count(*), round(avg(model_score), 6),
  round(avg(CAST(k AS DOUBLE)), 6) FROM w GROUP BY dataset_source, dataset_label""")
def a9(t: Tables) -> DataFrame:
    rows = Q.model_performance(t.alerts(), _as_of(t), hours=500)
    text = {c: F.coalesce(c, F.lit("")) for c in ("attack_type", "source", "label")}
    return rows.withColumns({**text, "avg_model_score": F.round("avg_model_score", 6),
                             "avg_latency_ms": F.round("avg_latency_ms", 6)})


_SERIES = f"""
WITH spine AS (SELECT date_trunc('hour', {_AS_OF}) - to_hours(CAST(i AS INTEGER)) AS bucket FROM range(24) r(i)),
c AS (SELECT date_trunc('hour', timestamp) AS bucket, count(*) AS n FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 24 HOUR
  GROUP BY 1)"""


@query("a10_hourly_series", "alerts", f"""{_SERIES}
SELECT {_iso('s.bucket')} AS bucket, coalesce(n, 0) AS "count" FROM spine s LEFT JOIN c USING (bucket)""")
def a10(t: Tables) -> DataFrame:
    series = Q.hourly_series(t.alerts(), _as_of(t))
    return series.select(Q._hour_text(F.col("bucket")).alias("bucket"), "count")


_OVERVIEW = f"""
SELECT 'series' AS section, {_iso('s.bucket')} AS "key", CAST(coalesce(n, 0) AS BIGINT) AS value
  FROM spine s LEFT JOIN c USING (bucket) UNION ALL
SELECT 'severity_24h', v.s, (SELECT count(*) FROM alerts WHERE severity = v.s AND timestamp >= {_AS_OF} - INTERVAL 24 HOUR)
  FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) v(s) UNION ALL"""


@query("a11_metrics_overview", "alerts", f"""{_SERIES}{_OVERVIEW}
SELECT 'severity_total', v.s, (SELECT count(*) FROM alerts WHERE severity = v.s)
  FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) v(s)""")
def a11(t: Tables) -> DataFrame:
    return Q.metrics_overview(t.alerts(), _as_of(t))


@query("a12_dashboard_metrics", "alerts", f"""{_SERIES}{_OVERVIEW}
SELECT 'attack', attack_type, count(*) FROM alerts GROUP BY attack_type UNION ALL
SELECT 'total', 'alerts', count(*) FROM alerts UNION ALL
SELECT 'total', 'today', count(*) FROM alerts WHERE timestamp >= date_trunc('day', {_AS_OF}) UNION ALL
SELECT 'total', 'latest', epoch_us({_AS_OF})""")
def a12(t: Tables) -> DataFrame:
    return Q.dashboard_metrics(t.alerts(), _as_of(t))


_REPORT = f"""
WITH w AS (SELECT * FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 168 HOUR AND timestamp <= {_AS_OF}),
rep AS (SELECT 'total' AS section, 'alerts' AS "key", CAST(count(*) AS DOUBLE) AS value FROM w UNION ALL
SELECT 'total', 'average_score', round(avg(model_score), 6) FROM w UNION ALL
SELECT 'total', 'malicious_ratio', round(count(*) FILTER (model_label = 'malicious') / count(*) * 100.0, 6) FROM w UNION ALL
SELECT 'total', 'unique_sources', CAST(count(DISTINCT src_ip) AS DOUBLE) FROM w UNION ALL
SELECT 'severity', v.s, CAST((SELECT count(*) FROM w WHERE severity = v.s) AS DOUBLE)
  FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) v(s) UNION ALL
SELECT 'attack', attack_type, CAST(count(*) AS DOUBLE) FROM w GROUP BY attack_type UNION ALL
SELECT * FROM (SELECT 'rule', rule_name, CAST(count(*) AS DOUBLE) FROM w GROUP BY rule_name ORDER BY 3 DESC, 2 LIMIT 5))"""


def _report(t: Tables) -> DataFrame:
    now = _as_of(t)
    return Q.reports_summary(t.alerts(), now - timedelta(days=7), now)


@query("a13_reports_summary", "alerts", f"{_REPORT} SELECT * FROM rep")
def a13(t: Tables) -> DataFrame:
    return _report(t).withColumn("value", F.round("value", 6))


@query("a14_share", "alerts", """
WITH c AS (SELECT severity, count(*) AS "count" FROM alerts GROUP BY severity)
SELECT severity, "count", CAST(floor("count" * 100.0 / (SELECT max("count") FROM c) + 0.5) AS BIGINT) AS percent,
  CAST(floor("count" * 100.0 / (SELECT sum("count") FROM c) + 0.5) AS BIGINT) AS percent_of_total FROM c""")
def a14(t: Tables) -> DataFrame:
    counts = Q.class_counts(t.alerts(), "severity")
    of_total = Q.share(counts, of="total").withColumnRenamed("percent", "percent_of_total")
    return Q.share(of_total, of="max")


@query("a15_health_state", "alerts", f"""
WITH c AS (SELECT {_SEVERITY_COUNTS} FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 24 HOUR)
SELECT *, CASE WHEN "Critical" > 0 THEN 'critical' WHEN "High" > 0 THEN 'suspicious' ELSE 'safe' END AS state FROM c""")
def a15(t: Tables) -> DataFrame:
    return Q.health_state(Q.severity_counts(t.alerts(), since=_as_of(t) - timedelta(hours=24)))


@query("a16_summary_counts", "alerts", """
SELECT 'total' AS section, '' AS "key", count(*) AS value FROM alerts UNION ALL
SELECT 'severity', severity, count(*) FROM alerts GROUP BY severity UNION ALL
SELECT 'attack_type', attack_type, count(*) FROM alerts GROUP BY attack_type""")
def a16(t: Tables) -> DataFrame:
    return Q.summary_counts(t.alerts())


@query("a17_class_counts", "conn", 'SELECT label, count(*) AS "count" FROM conn GROUP BY label')
def a17(t: Tables) -> DataFrame:
    return Q.class_counts(t.conn(), "label")


@query("a18_prediction_counts", "scored", f"""
SELECT {case_sql(dict(enumerate(S.CLASS_NAMES)), 'y_pred')} AS attack_type, count(*) AS "count" FROM scored GROUP BY y_pred""")
def a18(t: Tables) -> DataFrame:
    rows = t.scored().select(A.class_to_attack(A.top_class("probabilities")["name"]).alias("attack_type"))
    return Q.prediction_counts(rows, by_count=True)


@query("a22_peak_bucket", "alerts", f"""{_SERIES}
SELECT {_iso('bucket')} AS bucket, n AS "count" FROM c WHERE bucket IN (SELECT bucket FROM spine) ORDER BY n DESC, 1 LIMIT 1""")
def a22(t: Tables) -> DataFrame:
    peak = Q.peak_bucket(Q.hourly_series(t.alerts(), _as_of(t)))
    return peak.select(Q._hour_text(F.col("bucket")).alias("bucket"), "count")


_SUMMARY_TITLES = {"total": "Resumen", "severity": "Severidad", "attack": "Ataques", "rule": "Reglas"}


@query("k7_summary_long", "alerts", f"""{_REPORT}
SELECT 'Resumen' AS section, 'Generado' AS "key", strftime({_AS_OF}, '%Y-%m-%d %H:%M:%S') AS value UNION ALL
SELECT 'Resumen', 'Rango', 'Últimos 7 días' UNION ALL
SELECT {case_sql(_SUMMARY_TITLES, 'section')},
  CASE WHEN section = 'attack' THEN {case_sql(S.ATTACK_TEXT, '"key"')} WHEN section = 'total' THEN
    CASE "key" WHEN 'alerts' THEN 'Alertas' WHEN 'average_score' THEN 'Riesgo promedio'
      WHEN 'malicious_ratio' THEN '% Maliciosas' ELSE 'IPs Únicas' END ELSE "key" END,
  CASE WHEN "key" = 'average_score' THEN printf('%.1f%%', value * 100.0)
    WHEN "key" = 'malicious_ratio' THEN CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR) || '%'
    ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END FROM rep""")
def k7(t: Tables) -> DataFrame:
    return Q.summary_long(_report(t), "Últimos 7 días", _as_of(t))


@query("k8_report_rows", "alerts", f"""
SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS "Fecha", severity AS "Severidad", attack_type AS "Tipo",
  src_ip || ':' || src_port AS "Origen", dst_ip || ':' || dst_port AS "Destino", protocol AS "Protocolo", rule_name AS "Regla",
  printf('%.1f%%', CASE WHEN model_label = 'benign' THEN 1.0 - model_score ELSE model_score END * 100.0) AS "Score"
FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 168 HOUR ORDER BY timestamp DESC, id LIMIT 1000""")
def k8(t: Tables) -> DataFrame:
    return Q.report_rows(t.alerts(), "7d", _as_of(t), cap=1000)


@query("k7_dashboard_summary", "alerts", f"""
WITH s AS (SELECT severity, count(*) AS n FROM alerts WHERE timestamp >= {_AS_OF} - INTERVAL 24 HOUR GROUP BY 1),
a AS (SELECT attack_type, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, attack_type LIMIT 5)
SELECT 'Resumen' AS "Sección", 'Generado' AS "Clave", '2017-07-07 12:00:00' AS "Valor" UNION ALL
SELECT 'Resumen', 'Alertas Hoy', CAST(count(*) FILTER (timestamp >= date_trunc('day', {_AS_OF})) AS VARCHAR) FROM alerts UNION ALL
SELECT 'Resumen', 'Alertas Totales', CAST(count(*) AS VARCHAR) FROM alerts UNION ALL
SELECT 'Resumen', 'Última alerta', strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') FROM alerts UNION ALL
SELECT 'Severidad', v.name, CAST(coalesce(s.n, 0) AS VARCHAR) FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) v(name) LEFT JOIN s ON s.severity = v.name
UNION ALL SELECT 'Top Ataques', attack_type, CAST(n AS VARCHAR) FROM a""")
def k7_dashboard(t: Tables) -> DataFrame:
    metrics = Q.dashboard_metrics(t.alerts(), _as_of(t))
    path = scratch_dir(t.spark, "dashboard")
    sinks.export_dashboard_summary(metrics, datetime(2017, 7, 7, 12), path)
    return t.spark.read.csv(path, header=True)
