"""Registered queries: readers, checks and writers.

The files are written from the tables first, so that reading them back has a twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import alerts as A
from flowlens.functions import labels as L
from flowlens.functions.common import quoted
from flowlens.operators import alerts as Q
from flowlens.operators import features as X
from flowlens.plans.registry import query
from flowlens.plans.views import FLOW_ID_SQL, KDD_TEXTS, TIME_MEANING_SQL, Tables, case_sql, pick, pick_sql
from flowlens.session import scratch_dir
from flowlens.sources import checks, files, logs, sinks

_LOG_COLUMNS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
                "orig_bytes", "resp_bytes", "conn_state", "orig_pkts", "resp_pkts"]


def _text_lines(df: DataFrame, header: str, value: Column, path: str) -> str:
    sinks.with_header_lines(df, header, value).write.text(path)
    return path


def _log_rows(t: Tables) -> DataFrame:
    return t.conn().drop("ts").withColumnRenamed("ts_epoch", "ts")


# --- readers -----------------------------------------------------------------------------


@query("s1_read_zeek_log", "conn", """
SELECT uid, id_orig_h, CAST(id_orig_p AS DOUBLE) AS id_orig_p, proto, round(duration, 6) AS duration,
  CAST(orig_bytes AS DOUBLE) AS orig_bytes, coalesce(CASE WHEN event_id % 4 <> 0 THEN CAST(resp_bytes AS DOUBLE) END, -1) AS resp_bytes
FROM conn WHERE k >= 10""")
def s1(t: Tables) -> DataFrame:
    n = F.col("event_id")
    rows = _log_rows(t).withColumns({
        # A tab inside a field gives the row one field too many: it is dropped.
        "service": F.when(F.col("k") < 10, F.lit("a\tb")).otherwise(F.col("service")),
        "resp_bytes": F.when(n % 4 != 0, F.col("resp_bytes")),
    })
    path = scratch_dir(t.spark, "zeek")
    sinks.write_zeek_log(rows, path, _LOG_COLUMNS)
    log = logs.read_zeek_log(t.spark, path)
    return log.select("uid", "id_orig_h", "id_orig_p", "proto", F.round("duration", 6).alias("duration"), "orig_bytes",
                      F.coalesce("resp_bytes", F.lit(-1.0)).alias("resp_bytes"))


@query("s2_read_conn_csv", "conn", "SELECT uid, id_orig_h, CAST(id_orig_p AS VARCHAR) AS id_orig_p, proto, label AS service FROM conn")
def s2(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "conn")
    # Labels with a comma need quotes in the file.
    sinks.write_conn_csv(_log_rows(t).withColumn("service", F.concat(F.col("label"), F.lit(',"x"'))), path)
    rows = logs.read_conn_csv(t.spark, path)
    return rows.select("uid", "id_orig_h", "id_orig_p", "proto", F.replace("service", F.lit(',"x"'), F.lit("")).alias("service"))


def _quoted_documents(t: Tables, header: str, last: Column) -> str:
    """Documents as CSV lines: the whole text, with its quotes and line breaks, is a quoted cell."""
    text = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return _text_lines(t.table("documents"), header, F.concat(F.col("doc_id").cast("string"), F.lit(","), text, last),
                       scratch_dir(t.spark, "quoted"))


def _source_cell() -> Column:
    return F.concat(F.lit(","), F.coalesce(F.col("source"), F.lit("")))


@query("s2_multiline", "", """
SELECT doc_id AS uid, md5(coalesce(text, '')) AS text_md5, coalesce(source, '') AS service FROM documents""")
def s2_multiline(t: Tables) -> DataFrame:
    """Cells with line breaks: every record comes back whole, whatever block it lies in."""
    rows = logs.read_conn_csv(t.spark, _quoted_documents(t, "uid,body,service", _source_cell()))
    return rows.select(F.col("uid").cast("bigint").alias("uid"), F.md5("body").alias("text_md5"), "service")


@query("s3_quoted_header", "", """
SELECT coalesce(source, '') AS source, count(*) AS n, count(*) FILTER (coalesce(text, '') = '') AS empty,
  CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def s3_quoted(t: Tables) -> DataFrame:
    """A header with a delimiter, quotes and a line break in its names."""
    path = _quoted_documents(t, 'Flow ID,"Body, ""raw""\n text",Label', _source_cell())
    rows = logs.read_cic(t.spark, path, encoding="UTF-8", pattern="*.txt")
    body = F.col('`Body, "raw" text`')
    return rows.groupBy(F.coalesce("Label", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(body.isNull()).alias("empty"),
        F.coalesce(F.sum(F.length(body)), F.lit(0)).cast("bigint").alias("chars"))


@query("s9_quoted", "", """
SELECT 'pad' AS policy, doc_id AS uid, md5(coalesce(text, '')) AS text_md5, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(source, '') END AS service
FROM documents
UNION ALL
SELECT 'skip', doc_id, md5(coalesce(text, '')), coalesce(source, '') FROM documents WHERE doc_id % 3 <> 0""")
def s9_quoted(t: Tables) -> DataFrame:
    """Every third record is short, and has line breaks in quotes like the others."""
    last = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(_source_cell())
    path = _quoted_documents(t, "uid,body,service", last)
    parts = [files.read_ragged(t.spark, path, short=p).select(
        F.lit(p).alias("policy"), F.col("uid").cast("bigint").alias("uid"), F.md5("body").alias("text_md5"), "service") for p in ("pad", "skip")]
    return parts[0].unionByName(parts[1])


def _write_flows(t: Tables, sep: str = ",", encoding: str = "UTF-8") -> str:
    """Raw flow files: headers with outer blanks and a repeated name."""
    path = scratch_dir(t.spark, "flows")
    rows = t.raw_flows().drop("event_id")
    renamed = rows.select(*[quoted(c).alias(c if c == "Flow ID" else f" {c}") for c in rows.columns], F.lit("0").alias("Bulk"),
                          F.lit("1").alias("Bulk "))
    renamed.write.option("sep", sep).option("encoding", encoding).csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("s3_read_cic", "conn dirty", """
SELECT label_text AS label, count(*) AS n, count(*) FILTER (k = 11) AS without_target FROM dirty GROUP BY 1""")
def s3(t: Tables) -> DataFrame:
    rows = logs.read_cic(t.spark, _write_flows(t), encoding="UTF-8")
    target = F.coalesce(F.col("`Destination IP`"), F.lit(""))
    return rows.groupBy(F.col("Label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(target == "").alias("without_target"))


def _kdd_rows(t: Tables) -> DataFrame:
    features = [(F.col("k") + i).cast("string").alias(f"c{i}") for i in range(41)]
    return t.events().select(*features, pick(KDD_TEXTS, F.col("event_id")).alias("c41"))


@query("s4_read_kdd", "ev", f"""
SELECT trim({pick_sql(KDD_TEXTS, 'event_id')}) AS label, count(*) AS n, CAST(sum(k) AS BIGINT) AS duration, CAST(sum(k + 40) AS BIGINT) AS last FROM ev GROUP BY 1""")
def s4(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "kdd")
    _kdd_rows(t).write.csv(path)
    rows = logs.read_kdd(t.spark, path)
    return rows.groupBy(F.trim("label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("duration").cast("bigint")).alias("duration"),
        F.sum(F.col("dst_host_srv_rerror_rate").cast("bigint")).alias("last"))


@query("s5_read_malmem", "conn", """
SELECT CASE WHEN label = 'BENIGN' THEN 'Benign' ELSE 'Malware' END AS class, count(*) AS n, CAST(sum(orig_bytes) AS DOUBLE) AS total,
  'Class' AS label_column FROM conn GROUP BY 1""")
def s5(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "malmem")
    kind = F.when(F.col("label") == "BENIGN", "Benign").otherwise("Malware")
    t.conn().select("orig_bytes", "orig_pkts", kind.alias("Class")).write.csv(path, header=True)
    rows, label = logs.read_malmem(t.spark, path, expected="label")
    return rows.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("orig_bytes").alias("total"), F.lit(label).alias("label_column"))


@query("s6_sniff_csv", "conn", """
SELECT * FROM (VALUES (';', 'UTF-8'), (',', 'ISO-8859-1'), ('tab', 'UTF-8')) v(sep, encoding) WHERE (SELECT count(*) FROM conn) > 0""")
def s6(t: Tables) -> DataFrame:
    rows = t.conn().select("uid", "proto", F.concat(F.lit("señal "), F.col("label")).alias("label"))
    found = []
    for sep, encoding in ((";", "UTF-8"), (",", "ISO-8859-1"), ("\t", "UTF-8")):
        path = scratch_dir(t.spark, "sniff")
        rows.write.option("sep", sep).option("encoding", encoding).csv(path, header=True)
        mark, enc = files.sniff_csv(t.spark, path)
        found.append(("tab" if mark == "\t" else mark, enc))
    return t.spark.createDataFrame(found, "sep string, encoding string")


@query("s7_normalize_columns", "conn", 'SELECT uid AS "Flow ID", label AS "Label", proto AS "Label.1" FROM conn')
def s7(t: Tables) -> DataFrame:
    rows = t.conn().select(F.lit("").alias("#fields"), F.col("uid").alias("﻿Flow   ID "), F.col("label").alias(" Label"),
                           F.col("proto").alias("Label "))
    return files.normalize_columns(rows)


@query("s8_resolve_inputs", "conn", "SELECT 'all' AS kind, count(*) AS n FROM conn UNION ALL SELECT 'newest', 1")
def s8(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "inputs")
    t.conn().select("uid").write.csv(f"{path}/day=1")
    t.spark.range(1).select(F.lit("x")).coalesce(1).write.csv(f"{path}/day=2")
    every = files.resolve_inputs(t.spark, f"{path}/day=1", pattern="*.csv")
    newest = files.resolve_inputs(t.spark, path, newest=True, pattern="*.csv")
    one = t.spark.read.text(every).agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("kind"), "n")
    two = t.spark.read.text(newest).agg(F.count(F.lit(1)).alias("n")).select(F.lit("newest").alias("kind"), "n")
    return one.unionByName(two)




@query("s9_read_ragged", "conn", f"""
SELECT 'pad' AS policy, uid, CASE WHEN k < 25 THEN '' ELSE proto END AS proto FROM conn UNION ALL
SELECT 'skip', uid, proto FROM conn WHERE k >= 25""")
def s9(t: Tables) -> DataFrame:
    k = F.col("k")
    line = F.when(k < 25, F.concat_ws(";", "uid", "label")).when(
        k < 50, F.concat_ws(";", "uid", "label", "proto", F.lit("extra"))).otherwise(F.concat_ws(";", "uid", "label", "proto"))
    path = _text_lines(t.conn(), "uid;label;proto", line, scratch_dir(t.spark, "ragged"))
    padded = files.read_ragged(t.spark, path, short="pad").select(F.lit("pad").alias("policy"), "uid", "proto")
    skipped = files.read_ragged(t.spark, path, short="skip").select(F.lit("skip").alias("policy"), "uid", "proto")
    return padded.unionByName(skipped)


def _feature_file(t: Tables) -> str:
    rows = X.conn_features(t.conn(), "serve")
    columns = [
        F.col("uid").alias("Flow ID"), F.col("id_orig_h").alias("Source IP"), F.col("id_orig_p").alias("Source Port"),
        F.col("id_resp_h").alias("Destination IP"), F.col("id_resp_p").alias("Destination Port"), F.col("proto").alias("Protocol"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), *[F.col(c) for c in S.CONN_FEATURES], F.col("label").alias("Label"),
    ]
    path = scratch_dir(t.spark, "features")
    rows.select(*columns).write.option("sep", ";").csv(path, header=True)
    return path


@query("s10_read_feature_csv", "conn", """
SELECT uid AS flow_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, round(duration, 4) AS duration, CAST(orig_bytes + resp_bytes AS DOUBLE) AS bytes_total,
  label FROM conn""")
def s10(t: Tables) -> DataFrame:
    rows = logs.read_feature_csv(t.spark, _feature_file(t))
    checks.require_columns(rows.columns, "features")
    picked = X.pick_features(rows)
    return picked.select(F.col("`Flow ID`").alias("flow_id"), F.col("Timestamp").alias("time"),
                         F.round("duration", 4).alias("duration"), "bytes_total", A.original_label(rows).alias("label"))


@query("s11_read_packet_log", "conn", """
SELECT uid, epoch_us(ts) AS micros, round(duration, 6) AS duration, orig_pkts AS total_fwd_pkts, id_resp_p FROM conn""")
def s11(t: Tables) -> DataFrame:
    rows = t.conn().select(F.format_string("%.6f", "ts_epoch").alias("ts"), "uid", "duration", F.col("orig_pkts").alias("total_fwd_pkts"), "id_resp_p")
    path = scratch_dir(t.spark, "packetlog")
    sinks.write_zeek_log(rows, path, rows.columns)
    log = logs.read_packet_log(t.spark, path)
    return log.select("uid", F.unix_micros("ts").alias("micros"), F.round("duration", 6).alias("duration"), "total_fwd_pkts", "id_resp_p")


@query("s12_replay_to_alerts", "conn", """
SELECT epoch_us(date_trunc('second', ts)) AS micros, 'Medium' AS severity, label AS attack_type, id_orig_h AS src_ip,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE id_orig_p END AS src_port, upper(proto) AS protocol, 'REPLAY' AS rule_id,
  CAST(0.6 AS DOUBLE) AS model_score, 'malicious' AS model_label, 'replay.csv' AS source FROM conn""")
def s12(t: Tables) -> DataFrame:
    port = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("id_orig_p").cast("string"))
    rows = t.conn().select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("id_orig_h").alias("Source IP"), port.alias("Source Port"),
        F.col("id_resp_h").alias("Destination IP"), F.col("id_resp_p").cast("string").alias("Destination Port"),
        F.upper("proto").alias("Protocol"), F.col("label").alias("Label"))
    alerts = logs.replay_to_alerts(rows, "replay.csv")
    return alerts.select(F.unix_micros("timestamp").alias("micros"), "severity", "attack_type", "src_ip", "src_port", "protocol", "rule_id",
                         "model_score", "model_label", A.meta_field("meta", "source_csv").alias("source"))


@query("s13_with_provenance", "conn", """
SELECT CASE WHEN proto = 'tcp' THEN 'monday' ELSE 'tuesday' END AS day, 'lab' AS dataset_name, count(*) AS n FROM conn GROUP BY 1""")
def s13(t: Tables) -> DataFrame:
    names = F.when(F.col("proto") == "tcp", "Monday-WorkingHours.csv").otherwise("Tuesday-WorkingHours.csv")
    rows = t.conn().select("uid", names.alias("source_file"))
    tagged = files.with_provenance(rows, "flow", dataset="lab")
    return tagged.groupBy("day", "dataset_name").agg(F.count(F.lit(1)).alias("n"))


# --- checks and conversion ---------------------------------------------------------------


@query("v1_detect_dataset_type", "conn", """
SELECT v.name, v.kind, (SELECT count(*) FROM conn) AS n FROM (VALUES ('conn', 'conn'), ('features', 'features'), ('raw', 'flow')) v(name, kind)""")
def v1(t: Tables) -> DataFrame:
    frames = {"conn": _log_rows(t), "features": logs.read_feature_csv(t.spark, _feature_file(t)), "raw": t.raw_flows()}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(checks.detect_dataset_type(df.columns)).alias("kind"), "n")
             for name, df in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("v2_require_columns", "conn", "SELECT 'missing columns: duration, service' AS problem, count(*) AS n FROM conn")
def v2(t: Tables) -> DataFrame:
    rows = _log_rows(t).drop("duration", "service")
    try:
        checks.require_columns(rows.columns, "conn")
        problem = ""
    except ValueError as error:
        problem = str(error)
    return rows.agg(F.lit(problem).alias("problem"), F.count(F.lit(1)).alias("n"))


@query("v3_preview", "conn", "SELECT uid, label FROM conn ORDER BY event_id LIMIT 5")
def v3(t: Tables) -> DataFrame:
    _, rows = checks.preview(t.conn().orderBy("event_id").select("uid", "label"), 5)
    return rows


_PROTO_NUM = """CASE event_id % 9 WHEN 1 THEN '17' WHEN 2 THEN '1' WHEN 4 THEN '17' WHEN 6 THEN '17' ELSE '6' END"""
_CONVERTED = f"""
WITH r AS (SELECT c.*, d.label_text, d.ts_text, {TIME_MEANING_SQL.replace('event_id', 'd.event_id').replace('(ts)', '(d.ts)').replace(', ts)', ', d.ts)')} AS micros
  FROM conn c JOIN dirty d USING (event_id))
SELECT printf('%.6f', micros / CAST(1000000 AS DOUBLE)) AS ts, id_orig_h, CAST(id_orig_p AS VARCHAR) AS id_orig_p,
  {case_sql(S.SERVICE_BY_PORT, 'id_resp_p', "'-'")} AS service, printf('%.6f', floor(duration * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE)) AS duration,
  CAST(orig_bytes AS VARCHAR) AS orig_bytes, CASE WHEN resp_pkts = 0 AND resp_bytes = 0 THEN 'S0' ELSE 'SF' END AS conn_state,
  {_PROTO_NUM} AS ip_proto, {case_sql(S.LABEL_CLASSES, "upper(trim(regexp_replace(replace(replace(replace(label_text, '–', '-'), '—', '-'), '�', ' '), '\\s+', ' ', 'g')))", "'?'")} AS cicids_attack,
  {FLOW_ID_SQL} AS flow_id, 'lab' AS dataset_name FROM r WHERE micros IS NOT NULL AND k NOT IN (11, 13)"""
_CONVERTED_COLUMNS = ["ts", "id_orig_h", "id_orig_p", "service", "duration", "orig_bytes", "conn_state", "ip_proto",
                      "cicids_attack", "flow_id", "dataset_name"]


@query("v4_convert_cic_to_conn", "conn dirty", _CONVERTED)
def v4(t: Tables) -> DataFrame:
    good, _ = checks.convert_cic_to_conn(t.raw_flows(), "lab")
    return good.select(*_CONVERTED_COLUMNS)


@query("v4_unique_uids", "conn dirty", f"""
WITH x AS (SELECT {TIME_MEANING_SQL} IS NOT NULL AND k NOT IN (11, 13) AS good FROM dirty)
SELECT CAST(3 * count(*) AS BIGINT) AS n, CAST(3 * count(*) AS BIGINT) AS uids, count(*) AS same_next_time FROM x WHERE good""")
def v4_uids(t: Tables) -> DataFrame:
    """Flows of one minute that differ only in duration, and equal flows, have uids of their own."""
    rows = t.raw_flows().drop("event_id").withColumn("Timestamp", F.when(F.col("Timestamp") != "garbage", F.lit("7/5/2017 9:30")).otherwise("?"))
    longer = rows.withColumn("Flow Duration", (F.col("Flow Duration").cast("bigint") + 1).cast("string"))
    ends = {c: F.when(F.col(c).isin("", "n/a"), F.col(c)).otherwise("1") for c in ("Source Port",)}
    one, _ = checks.convert_cic_to_conn(rows.withColumns(ends).unionByName(rows.withColumns(ends)).unionByName(longer.withColumns(ends)), "lab")
    again, _ = checks.convert_cic_to_conn(rows, "lab")
    repeat, _ = checks.convert_cic_to_conn(rows, "lab")
    same = again.select("uid").join(repeat.select("uid"), "uid").agg(F.count(F.lit(1)).alias("same_next_time"))
    both = one.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("uids")).unionByName(same, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("n", "uids", "same_next_time")])


# --- writers -----------------------------------------------------------------------------


@query("k1_append_alerts", "alerts", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, 'api' AS source, dataset_source, 2 * count(*) AS n, CAST(2 * count(DISTINCT id) AS BIGINT) AS stamped
FROM alerts GROUP BY 1, dataset_source""")
def k1(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "alerts")
    sinks.append_alerts(t.alerts(), path, "api")
    sinks.append_alerts(t.alerts(), path, "api")
    rows = t.spark.read.parquet(path)
    return rows.groupBy(F.col("date").cast("string").alias("date"), A.meta_field("meta", "source").alias("source"),
                        A.meta_field("meta", "dataset_source").alias("dataset_source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ingested_at") > F.col("timestamp")).alias("stamped"))


@query("k2_export_alerts_csv", "alerts", """
SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, severity, attack_type, src_ip, CAST(src_port AS VARCHAR) AS src_port, dst_ip,
  CAST(dst_port AS VARCHAR) AS dst_port, protocol, rule_id, rule_name, printf('%.4f', model_score) AS model_score, model_label
FROM alerts WHERE attack_type = 'PORTSCAN' AND severity = 'High'""")
def k2(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "export")
    sinks.export_alerts_csv(t.alerts(), Q.AlertFilters(attack_type=["PORTSCAN"], severity=["High"], sort="-model_score"), path)
    return t.spark.read.csv(path, header=True)


@query("k3_write_conn_csv", "conn dirty", f"SELECT uid_rows.*, 27 AS width FROM ({_CONVERTED.replace('WITH r AS', 'WITH r AS')}) uid_rows")
def k3(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "connout")
    sinks.convert_and_write(t.raw_flows(), path, "lab")
    rows = logs.read_conn_csv(t.spark, path)
    return rows.select(*_CONVERTED_COLUMNS, F.lit(len(rows.columns)).alias("width"))


@query("a21_conversion_stats", "conn dirty", f"""
WITH x AS (SELECT {TIME_MEANING_SQL} IS NOT NULL AND k NOT IN (11, 13) AS good FROM dirty)
SELECT count(*) FILTER (good) AS written, count(*) FILTER (NOT good) AS skipped, count(*) AS input FROM x""")
def a21(t: Tables) -> DataFrame:
    counts = sinks.convert_and_write(t.raw_flows(), scratch_dir(t.spark, "stats"), "lab")
    return t.spark.createDataFrame([(counts["written"], counts["skipped"], counts["input"])], "written bigint, skipped bigint, input bigint")


def _labelled(t: Tables) -> DataFrame:
    """Labelled feature rows as the training recipes build them."""
    rows = X.conn_features(_log_rows(t).withColumnRenamed("label", "Label"), "train")
    return rows.withColumn("Label_mapped", L.map_label6("Label"))


@query("k4_export_alert_ready", "conn", """
SELECT uid, '-' AS service, "conn_state" AS conn_state, CAST(orig_bytes + resp_bytes AS DOUBLE) AS bytes_total, label AS "Label",
  CASE label WHEN 'DoS Hulk' THEN 'DOS' WHEN 'DDoS' THEN 'DDOS' WHEN 'PortScan' THEN 'PORTSCAN' WHEN 'FTP-Patator' THEN 'BRUTE_FORCE' ELSE label END
  AS "Label_mapped", 25 AS width FROM conn""")
def k4(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "ready")
    sinks.export_alert_ready(_labelled(t).drop("service"), path, mapped=True)
    rows = t.spark.read.csv(path, header=True)
    return rows.select("uid", "service", "conn_state", F.col("bytes_total").cast("double").alias("bytes_total"), "Label", "Label_mapped",
                       F.lit(len(rows.columns)).alias("width"))


@query("k5_export_ml", "conn", """
SELECT label AS "Label", count(*) AS n, CAST(sum(orig_bytes) AS DOUBLE) AS total FROM conn GROUP BY label""")
def k5_ml(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "ml")
    rows = t.conn().select("uid", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", F.col("label").alias("Label"))
    sinks.export_ml(rows.unionByName(rows), path)
    out = t.spark.read.csv(path, header=True)
    return out.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("orig_bytes").cast("double")).alias("total"))


@query("k6_export_correct_samples", "conn scored", f"""
WITH c AS (SELECT {case_sql(dict(enumerate(S.CLASS_NAMES)), 'y_true')} AS cls, count(*) AS n FROM scored WHERE y_true = y_pred GROUP BY 1)
SELECT cls AS "Label_mapped", least(n, 50) AS n FROM c""")
def k6(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(c) for c in S.CLASS_NAMES])
    rows = t.scored().select(F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("uid"),
                             F.get(names, F.col("y_true")).alias("Label_mapped"), F.get(names, F.col("y_pred")).alias("predicted"))
    path = scratch_dir(t.spark, "samples")
    sinks.export_correct_samples(rows, path)
    out = t.spark.read.csv(path, header=True)
    return out.groupBy("Label_mapped").agg(F.count(F.lit(1)).alias("n"))


@query("k10_save_table", "alerts", 'SELECT attack_type, CAST(count(*) AS VARCHAR) AS "count" FROM alerts GROUP BY 1')
def k10(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "table")
    sinks.save_table(Q.attack_distribution(t.alerts()), path)
    return t.spark.read.csv(path, header=True)


@query("k11_export_features", "conn", """
SELECT label, count(*) AS n, round(sum(duration), 2) AS duration, CAST(sum(orig_bytes + resp_bytes) AS DOUBLE) AS bytes_total FROM conn GROUP BY label""")
def k11(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "export14")
    sinks.export_features(t.conn(), path)
    rows = t.spark.read.csv(path, header=True)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("duration").cast("double")), 2).alias("duration"),
        F.sum(F.col("bytes_total").cast("double")).alias("bytes_total"))


