"""Registered queries: column functions and feature projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import alerts as A
from flowlens.functions import labels as L
from flowlens.functions import numbers as N
from flowlens.functions import times as TM
from flowlens.operators import features as X
from flowlens.operators import models as M
from flowlens.plans.registry import query
from flowlens.plans.views import (
    FLOW_ID_SQL,
    TIME_MEANING_SQL,
    Tables,
    case_sql,
    with_scores,
)
from flowlens.sources import checks

_TRIMMED = "trim(num_text)"
_AS_NUMBER = f"""CASE WHEN {_TRIMMED} = '-inf' THEN CAST('-inf' AS DOUBLE)
  WHEN lower({_TRIMMED}) = 'nan' THEN CAST('nan' AS DOUBLE) ELSE TRY_CAST({{}} AS DOUBLE) END"""


def _shown(value) -> Column:
    """Doubles that may be infinite or NaN, as text."""
    return F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), "inf").otherwise(
        F.format_string("%.4f", value))


_SHOWN_SQL = "CASE WHEN isnan({0}) THEN 'nan' WHEN isinf({0}) THEN 'inf' ELSE printf('%.4f', {0}) END"


@query("f1_safe_double", "dirty", f"""
WITH v AS (SELECT event_id,
  coalesce({_AS_NUMBER.format(_TRIMMED)}, -1.0) AS a,
  coalesce({_AS_NUMBER.format(f"replace({_TRIMMED}, ',', '')")}, -1.0) AS b,
  CASE WHEN lower({_TRIMMED}) IN ('nan', 'inf', '-inf') THEN -1.0
       ELSE coalesce(TRY_CAST(replace({_TRIMMED}, ',', '') AS DOUBLE), -1.0) END AS c
  FROM dirty)
SELECT event_id, {_SHOWN_SQL.format('a')} AS plain, {_SHOWN_SQL.format('b')} AS comma,
  {_SHOWN_SQL.format('c')} AS clean FROM v""")
def f1(t: Tables) -> DataFrame:
    rules = {r: _shown(N.safe_double("num_text", -1.0, r)) for r in ("plain", "comma", "clean")}
    return t.dirty().select("event_id", *[c.alias(n) for n, c in rules.items()])


@query("f2_safe_int", "dirty", f"""
SELECT event_id, CAST(CASE WHEN lower({_TRIMMED}) IN ('nan', 'inf', '-inf') THEN 0
  ELSE coalesce(trunc(TRY_CAST(replace({_TRIMMED}, ',', '') AS DOUBLE)), 0) END AS BIGINT) AS number FROM dirty""")
def f2(t: Tables) -> DataFrame:
    return t.dirty().select("event_id", N.safe_int("num_text", 0, "clean").alias("number"))


@query("f3_first_present", "dirty", """
SELECT event_id, coalesce(nullif(trim(proto_text), ''), nullif(trim(num_text), ''), '') AS value FROM dirty""")
def f3(t: Tables) -> DataFrame:
    df = t.dirty()
    return df.select("event_id", A.first_present(df, ["missing", "proto_text", "num_text"]).alias("value"))


@query("f4_parse_ts", "dirty", f"SELECT event_id, coalesce({TIME_MEANING_SQL}, -1) AS micros FROM dirty")
def f4(t: Tables) -> DataFrame:
    micros = F.coalesce(F.unix_micros(TM.parse_ts("ts_text")), F.lit(-1).cast("bigint"))
    return t.dirty().select("event_id", micros.alias("micros"))


@query("f5_norm_protocol", "dirty", """
SELECT event_id,
  CASE trim(proto_text) WHEN '6' THEN 'tcp' WHEN '17' THEN 'udp' WHEN '1' THEN 'icmp' WHEN 'TCP' THEN 'tcp'
    WHEN 'udp' THEN 'udp' WHEN 'http' THEN 'tcp' WHEN 'dns' THEN 'udp' WHEN '' THEN 'tcp' ELSE 'gre' END AS name,
  CASE trim(proto_text) WHEN '17' THEN '17' WHEN '1' THEN '1' WHEN 'udp' THEN '17' WHEN 'dns' THEN '17'
    ELSE '6' END AS number FROM dirty""")
def f5(t: Tables) -> DataFrame:
    return t.dirty().select("event_id", L.norm_protocol("proto_text").alias("p")).select("event_id", "p.*")


@query("f6_alert_protocol", "dirty", """
WITH u AS (SELECT event_id, upper(trim(proto_text)) AS p FROM dirty)
SELECT event_id,
  CASE WHEN p IN ('6', 'TCP') THEN 'TCP' WHEN p IN ('17', 'UDP') THEN 'UDP' WHEN p IN ('1', 'ICMP') THEN 'ICMP'
    WHEN p IN ('DNS', 'HTTP', 'HTTPS') THEN p ELSE 'Other' END AS by_feature_row,
  CASE WHEN p IN ('TCP', 'UDP', 'ICMP', 'DNS', 'HTTP', 'HTTPS') THEN p ELSE 'Other' END AS by_conn_row FROM u""")
def f6(t: Tables) -> DataFrame:
    return t.dirty().select("event_id", L.alert_protocol("proto_text").alias("by_feature_row"),
                            L.alert_protocol("proto_text", numbers=False).alias("by_conn_row"))


@query("f7_guess_service", "conn",
       f"SELECT event_id, {case_sql(S.SERVICE_BY_PORT, 'id_resp_p', chr(39) + '-' + chr(39))} AS service FROM conn")
def f7(t: Tables) -> DataFrame:
    return t.conn().select("event_id", L.guess_service("id_resp_p").alias("service"))


_LABEL_SQL = ("trim(regexp_replace(replace(replace(replace(label_text, '–', '-'), '—', '-'), '�', ' '),"
              " '\\s+', ' ', 'g'))")


@query("f8_norm_label", "dirty", f"""
WITH l AS (SELECT event_id, {_LABEL_SQL} AS label FROM dirty)
SELECT event_id, label, {case_sql(S.LABEL_CLASSES, 'upper(label)', 'label')} AS class FROM l""")
def f8(t: Tables) -> DataFrame:
    return t.dirty().select("event_id", L.norm_label("label_text").alias("l")).select("event_id", "l.*")


@query("f9_cic_attack_group", "dirty", f"""
SELECT event_id, coalesce({case_sql(S.CIC_DASH_SPELLINGS, 'trim(label_text)')}, trim(label_text)) AS label,
  coalesce({case_sql(S.CIC_ATTACK_GROUPS, 'trim(label_text)')}, '?') AS attack_group FROM dirty""")
def f9(t: Tables) -> DataFrame:
    group = F.coalesce(L.cic_attack_group("label_text"), F.lit("?"))
    return t.dirty().select("event_id", L.cic_label("label_text").alias("label"), group.alias("attack_group"))


_KDD_SQL = "regexp_replace(lower(trim(kdd_text)), '[.]+$', '')"


@query("f10_kdd_superclass", "dirty", f"""
SELECT event_id, {_KDD_SQL} AS label, coalesce({case_sql(S.KDD_CLASS_OF, _KDD_SQL)}, '?') AS superclass FROM dirty""")
def f10(t: Tables) -> DataFrame:
    cls = F.coalesce(L.kdd_superclass("kdd_text"), F.lit("?"))
    return t.dirty().select("event_id", L.kdd_label("kdd_text").alias("label"), cls.alias("superclass"))


_LOW = "lower(trim(label_text))"


@query("f11_map_label10", "dirty", f"""
SELECT event_id, CASE WHEN trim(label_text) = 'BENIGN' THEN 'BENIGN' WHEN {_LOW} LIKE '%web attack%' THEN 'WEB_ATTACK'
  WHEN {_LOW} LIKE '%infiltration%' THEN 'INFILTRATION' WHEN {_LOW} LIKE '%ddos%' THEN 'DDOS'
  WHEN {_LOW} LIKE '%dos %' THEN 'DOS' WHEN {_LOW} LIKE '%portscan%' OR {_LOW} LIKE '%port scan%' THEN 'PORTSCAN'
  WHEN {_LOW} = 'bot' THEN 'BOT'
  WHEN {_LOW} LIKE '%patator%' OR {_LOW} LIKE '%brute force%' OR {_LOW} LIKE '%bruteforce%' THEN 'BRUTE_FORCE'
  WHEN {_LOW} LIKE '%heartbleed%' THEN 'HEARTBLEED' ELSE 'OTHER' END AS class FROM dirty""")
def f11(t: Tables) -> DataFrame:
    return t.dirty().select("event_id", L.map_label10("label_text").alias("class"))


_LABEL6_SQL = f"""CASE WHEN trim(label_text) = 'BENIGN' THEN 'BENIGN'
  WHEN {_LOW} LIKE '%dos%' AND {_LOW} NOT LIKE '%ddos%' THEN 'DOS' WHEN {_LOW} LIKE '%ddos%' THEN 'DDOS'
  WHEN {_LOW} LIKE '%bot%' THEN 'BOT'
  WHEN {_LOW} LIKE '%patator%' OR {_LOW} LIKE '%brute force%' OR {_LOW} LIKE '%bruteforce%' THEN 'BRUTE_FORCE'
  WHEN {_LOW} LIKE '%portscan%' THEN 'PORTSCAN' ELSE 'OTHER' END"""


@query("f12_map_label6", "dirty", f"SELECT event_id, {_LABEL6_SQL} AS class FROM dirty")
def f12(t: Tables) -> DataFrame:
    return t.dirty().select("event_id", L.map_label6("label_text").alias("class"))


_ATTACK_SQL = case_sql(S.LABEL_ATTACK_TYPES, "label_text", "'DOS'")


@query("f13_label_to_attack", "dirty", f"SELECT event_id, {_ATTACK_SQL} AS attack FROM dirty")
def f13(t: Tables) -> DataFrame:
    return t.dirty().select("event_id", L.label_to_attack("label_text").alias("attack"))


_PARSED = {a.lower().replace("_", ""): a for a in S.ATTACK_TYPES}


@query("f14_parse_attack_type", "dirty", f"""
SELECT event_id, coalesce({case_sql(_PARSED, "replace(replace(lower(trim(attack_text)), '_', ''), ' ', '')")}, '?')
  AS attack FROM dirty""")
def f14(t: Tables) -> DataFrame:
    attack = F.coalesce(L.parse_attack_type("attack_text", on_unknown="null"), F.lit("?"))
    return t.dirty().select("event_id", attack.alias("attack"))


@query("f15_flow_id", "conn", f"SELECT event_id, {FLOW_ID_SQL} AS flow_id FROM conn")
def f15(t: Tables) -> DataFrame:
    flow = L.flow_id("id_orig_h", "id_resp_h", "id_orig_p", "id_resp_p", "proto")
    return t.conn().select("event_id", flow.alias("flow_id"))


@query("f16_derived_conn_fields", "conn", """
SELECT event_id, printf('%.6f', floor(duration * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE)) AS duration,
  CASE WHEN resp_pkts = 0 AND resp_bytes = 0 THEN 'S0' ELSE 'SF' END AS conn_state,
  CASE WHEN proto = 'tcp' THEN 'S' ELSE '-' END AS history FROM conn""")
def f16(t: Tables) -> DataFrame:
    raw = t.conn().select(
        F.col("event_id").cast("string").alias("Flow ID"), F.col("id_orig_h").alias("Source IP"), F.lit("1").alias("Source Port"),
        F.col("id_resp_h").alias("Destination IP"), F.lit("2").alias("Destination Port"), F.col("proto").alias("Protocol"),
        F.lit("2017-07-05 09:00:00").alias("Timestamp"), F.floor(F.col("duration") * F.lit(1e6)).cast("string").alias("Flow Duration"),
        F.lit("1").alias("Total Fwd Packets"), F.col("resp_pkts").cast("string").alias("Total Backward Packets"),
        F.lit("1").alias("Total Length of Fwd Packets"), F.col("resp_bytes").cast("string").alias("Total Length of Bwd Packets"),
        F.col("label").alias("Label"))
    rows, _ = checks.convert_cic_to_conn(raw, "lab")
    return rows.select(F.col("flow_id").cast("bigint").alias("event_id"), "duration", "conn_state", "history")


@query("f17_hashed_uid", "conn", """
SELECT event_id, substring(md5(uid || '~' || id_orig_h || '~' || id_orig_p), 1, 20) AS hashed FROM conn""")
def f17(t: Tables) -> DataFrame:
    return t.conn().select("event_id", L.hashed_uid("uid", "id_orig_h", "id_orig_p").alias("hashed"))


@query("f18_severity", "alerts", """
SELECT event_id, model_score, attack_type, severity FROM alerts""")
def f18(t: Tables) -> DataFrame:
    attack = L.label_to_attack("label")
    return t.conn().select("event_id", "model_score", attack.alias("attack_type"),
                           A.severity("model_score", attack).alias("severity"))


@query("f19_severity_policy", "dirty", f"""
WITH x AS (SELECT event_id, k / CAST(100 AS DOUBLE) AS score,
  coalesce({case_sql(_PARSED, "replace(replace(lower(trim(attack_text)), '_', ''), ' ', '')")}, 'UNKNOWN') AS attack FROM dirty)
SELECT event_id, CASE attack WHEN 'BENIGN' THEN 'Low' WHEN 'DOS' THEN 'Medium' WHEN 'PORTSCAN' THEN 'Medium'
  WHEN 'BRUTE_FORCE' THEN 'High' WHEN 'DDOS' THEN 'Critical' WHEN 'BOT' THEN 'Critical'
  ELSE CASE WHEN score >= 0.9 THEN 'Critical' WHEN score >= 0.6 THEN 'High' WHEN score >= 0.3 THEN 'Medium'
    ELSE 'Low' END END AS severity FROM x""")
def f19(t: Tables) -> DataFrame:
    attack = F.coalesce(L.parse_attack_type("attack_text", on_unknown="null"), F.lit("UNKNOWN"))
    return t.dirty().select("event_id", A.severity_policy(F.col("k") / F.lit(100.0), attack).alias("severity"))


@query("f20_malicious_score", "scored", """
SELECT event_id, round(greatest(0.0, least(CAST(0.999 AS DOUBLE), 1.0 - score)), 9) AS score,
  CASE WHEN y_pred = 0 THEN 'benign' ELSE 'malicious' END AS model_label FROM probs WHERE cls = 0""")
def f20(t: Tables) -> DataFrame:
    top = A.top_class("probabilities")
    return t.scored().select(
        "event_id", F.round(A.malicious_score(F.get("probabilities", F.lit(0))), 9).alias("score"),
        A.label_of_class(top["name"]).alias("model_label"))


@query("f21_top_class", "scored", f"""
SELECT event_id, y_pred AS class_index, {case_sql(dict(enumerate(S.CLASS_NAMES)), 'y_pred')} AS class_name,
  round(0.5 + k / CAST(400 AS DOUBLE), 9) AS probability,
  round((SELECT p.score FROM probs p WHERE p.event_id = s.event_id AND p.cls = 3), 9) AS p_ddos FROM scored s""")
def f21(t: Tables) -> DataFrame:
    top = t.scored().select("event_id", A.top_class("probabilities").alias("top"))
    return top.select(
        "event_id", F.col("top.index").alias("class_index"), F.col("top.name").alias("class_name"),
        F.round("top.probability", 9).alias("probability"),
        F.round(F.try_element_at("top.probabilities", F.lit("DDOS")), 9).alias("p_ddos"))


@query("f22_label_from_score", "conn", """
SELECT event_id, CASE WHEN label <> 'BENIGN' AND model_score >= 0.5 THEN 'malicious' ELSE 'benign' END AS model_label
FROM conn""")
def f22(t: Tables) -> DataFrame:
    return t.conn().select("event_id", A.label_from_score("label", "model_score").alias("model_label"))


@query("f23_top_k_map", "conn", """
WITH f AS (SELECT event_id, n, v, row_number() OVER (PARTITION BY event_id ORDER BY v DESC, o) AS place FROM (
  SELECT event_id, 1 AS o, 'duration' AS n, duration AS v FROM conn UNION ALL
  SELECT event_id, 2, 'orig_bytes', orig_bytes FROM conn UNION ALL
  SELECT event_id, 3, 'resp_bytes', resp_bytes FROM conn UNION ALL
  SELECT event_id, 4, 'orig_pkts', orig_pkts FROM conn UNION ALL
  SELECT event_id, 5, 'resp_pkts', resp_pkts FROM conn))
SELECT event_id, CAST(place AS INTEGER) AS place, n AS name, round(CAST(v AS DOUBLE), 6) AS value FROM f WHERE place <= 3""")
def f23(t: Tables) -> DataFrame:
    names = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    top = t.conn().select("event_id", F.posexplode(A.top_k_map(values, 3)).alias("place", "e"))
    return top.select("event_id", (F.col("place") + 1).alias("place"), F.col("e.key").alias("name"),
                      F.round("e.value", 6).alias("value"))


@query("f24_display_confidence", "alerts", """
WITH c AS (SELECT event_id, model_label, CASE WHEN model_label = 'benign' THEN 1.0 - model_score ELSE model_score END AS v
  FROM alerts)
SELECT event_id, round(v, 9) AS value, CASE WHEN model_label = 'benign' THEN 'Confianza en benigno'
  ELSE 'Probabilidad de ataque' END AS title, printf('%.1f%%', v * 100.0) AS percent FROM c""")
def f24(t: Tables) -> DataFrame:
    shown = t.conn().select("event_id", A.display_confidence(
        "model_score", A.label_from_score("label", "model_score")).alias("c"))
    return shown.select("event_id", F.round("c.value", 9).alias("value"), "c.title", "c.percent")


@query("f25_endpoint", "alerts", """
SELECT id, src_ip || ':' || src_port AS origin, src_ip || ':' || src_port || ' → ' || dst_ip || ':' || dst_port AS route
FROM alerts""")
def f25(t: Tables) -> DataFrame:
    df = t.alerts()
    return df.select("id", A.endpoint("src_ip", "src_port").alias("origin"), A.endpoints(df).alias("route"))


@query("f26_display_labels", "alerts", f"""
SELECT id, {case_sql(S.ATTACK_TEXT, 'attack_type', "replace(attack_type, '_', ' ')")} AS attack,
  {case_sql(S.SEVERITY_TEXT, 'severity', 'severity')} AS severity_text, replace('WEB_' || attack_type, '_', ' ') AS unknown
FROM alerts""")
def f26(t: Tables) -> DataFrame:
    return t.alerts().select(
        "id", A.attack_label("attack_type").alias("attack"), A.severity_label("severity").alias("severity_text"),
        A.attack_label(F.concat(F.lit("WEB_"), F.col("attack_type"))).alias("unknown"))


@query("f27_incident_context", "alerts", f"""
SELECT id, {case_sql(S.INCIDENT_TITLES, 'attack_type', case_sql(S.ATTACK_TEXT, 'attack_type'))} AS title,
  {case_sql(S.INCIDENT_TITLES, 'attack_type', 'attack_type')} AS summary,
  {case_sql({a: p[0] for a, p in S.FALLBACK_PLAYBOOKS.items()}, 'attack_type')} AS first_step,
  {case_sql(S.ATTACK_SUMMARY, 'attack_type')} AS briefing,
  {case_sql({a: len(S.ATTACK_PLAYBOOKS.get(a, [])) for a in S.ATTACK_TYPES}, 'attack_type')} AS steps FROM alerts""")
def f27(t: Tables) -> DataFrame:
    context = A.incident_context("attack_type", "meta")
    briefing = A.attack_briefing("attack_type")
    return t.alerts().select(
        "id", context["title"].alias("title"), context["summary"].alias("summary"),
        F.get(context["playbook"], F.lit(0)).alias("first_step"),
        briefing["summary"].alias("briefing"), F.size(briefing["playbook"]).alias("steps"))


@query("f28_meta_field", "alerts", """
SELECT id, dataset_source, coalesce(dataset_label, dataset_source) AS dataset FROM alerts""")
def f28(t: Tables) -> DataFrame:
    return t.alerts().select("id", A.meta_field("meta", "dataset_source").alias("dataset_source"),
                             A.dataset_label("meta").alias("dataset"))


@query("f29_latency_ms", "alerts", "SELECT id, CAST(k AS DOUBLE) AS latency_ms FROM alerts")
def f29(t: Tables) -> DataFrame:
    return t.alerts().select("id", TM.latency_ms("ingested_at", "timestamp").alias("latency_ms"))


_WORD_SQL = f"CASE WHEN lower({_TRIMMED}) IN ('nan', '-inf') THEN 0.0 ELSE coalesce(TRY_CAST({_TRIMMED} AS DOUBLE), 0.0) END"


@query("f30_clean_features", "dirty", f"SELECT event_id, round({_WORD_SQL}, 6) AS num FROM dirty")
def f30(t: Tables) -> DataFrame:
    df = t.dirty().select("event_id", N.parse_number("num_text").alias("num"))
    return N.clean_features(df, ["num"]).select("event_id", F.round("num", 6).alias("num"))


@query("f31_coerce_numeric", "dirty", f"""
SELECT event_id, CASE WHEN {_TRIMMED} = '-inf' THEN 'inf' ELSE printf('%.4f', {_WORD_SQL}) END AS num FROM dirty""")
def f31(t: Tables) -> DataFrame:
    df = N.coerce_numeric(t.dirty().select("event_id", F.col("num_text").alias("num")), ["num"])
    return df.select("event_id", _shown(F.col("num")).alias("num"))


@query("f32_flag_counts", "conn", """
SELECT event_id, CAST(length(regexp_replace(history, '[^Ss]', '', 'g')) AS DOUBLE) AS syn,
  CAST(length(regexp_replace(history, '[^Pp]', '', 'g')) AS DOUBLE) AS psh,
  CAST(length(regexp_replace(history, '[^P]', '', 'g')) AS DOUBLE) AS fwd_psh,
  CAST(length(regexp_replace(history, '[^u]', '', 'g')) AS DOUBLE) AS bwd_urg FROM conn""")
def f32(t: Tables) -> DataFrame:
    names = {"SYN Flag Count": "syn", "PSH Flag Count": "psh", "Fwd PSH Flags": "fwd_psh", "Bwd URG Flags": "bwd_urg"}
    rows = X.cic_features78(t.conn(), keep=["event_id"])
    return rows.select("event_id", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])


@query("f33_format_bytes", "conn", """
WITH b AS (SELECT event_id, ts, orig_bytes * orig_bytes * resp_pkts AS n FROM conn),
p AS (SELECT *, CASE WHEN n > 0 THEN least(floor(ln(n) / ln(1024)), 4) ELSE 0 END AS e FROM b)
SELECT event_id, CASE WHEN n <= 0 THEN '0 B' ELSE printf('%.1f', floor(n / pow(1024, e) * 10 + 0.5) / 10) || ' ' ||
  list_extract(['B', 'KB', 'MB', 'GB', 'TB'], CAST(e AS INTEGER) + 1) END AS size,
  strftime(ts, '%d/%m/%Y %-I:%M %p') AS shown FROM p""")
def f33(t: Tables) -> DataFrame:
    n = F.col("orig_bytes") * F.col("orig_bytes") * F.col("resp_pkts")
    return t.conn().select("event_id", N.format_bytes(n).alias("size"), N.format_date("ts").alias("shown"))


_CLASS_SQL = "list_extract([" + ", ".join(f"'{c}'" for c in S.CLASS_NAMES) + "], y_pred + 1)"


@query("f34_alert_identity", "conn scored", f"""
SELECT kind, prefix || uid AS rule_id, name || {_CLASS_SQL} AS rule_name, id_orig_h AS src_ip, id_orig_p AS src_port
FROM conn JOIN scored USING (event_id), (VALUES ('conn', 'ZEEK-', 'Zeek '), ('features', 'FEATURE-', 'FeatureDataset ')) v(kind, prefix, name)""")
def f34(t: Tables) -> DataFrame:
    conn = with_scores(t.conn())
    flows = conn.select("probabilities", F.col("uid").alias("Flow ID"), F.col("id_orig_h").alias("Source IP"),
                        F.col("id_orig_p").alias("Source Port"), F.col("ts").alias("Timestamp"), F.lit(0.0).alias("duration"))
    parts = [M.to_alerts(df, ["duration"], kind).select(F.lit(kind).alias("kind"), "rule_id", "rule_name", "src_ip", "src_port")
             for kind, df in (("conn", conn), ("features", flows))]
    return parts[0].unionByName(parts[1])


@query("f35_original_label", "dirty", "SELECT event_id, label_text AS original_label FROM dirty")
def f35(t: Tables) -> DataFrame:
    df = t.dirty().withColumnsRenamed({"label_text": "cicids_attack", "kdd_text": "cicids_label"})
    return df.select("event_id", A.original_label(df).alias("original_label"))


@query("f36_tag_dataset", "alerts", """
SELECT id, 'reference' AS dataset_source, 'Dataset de referencia' AS dataset_label, 'd7' AS dataset_id,
  CAST(k AS VARCHAR) AS k FROM alerts""")
def f36(t: Tables) -> DataFrame:
    tagged = A.tag_dataset(t.alerts(), "reference", "d7")
    names = ["dataset_source", "dataset_label", "dataset_id", "k"]
    return tagged.select("id", *[A.meta_field("meta", n).alias(n) for n in names])


@query("f37_severity_rank", "alerts", f"""
SELECT id, {case_sql(S.SEVERITY_RANK, 'severity')} AS policy_rank,
  {case_sql({s: r + 1 for s, r in S.SEVERITY_RANK.items()}, 'severity')} AS dashboard_rank FROM alerts""")
def f37(t: Tables) -> DataFrame:
    return t.alerts().select("id", A.severity_rank("severity").alias("policy_rank"),
                             A.severity_rank("severity", base=1).alias("dashboard_rank"))


# --- feature projections -----------------------------------------------------------


def _rounded(df: DataFrame, names: list[str], key: str = "event_id", digits: int = 4) -> DataFrame:
    scale = F.lit(10.0 ** digits)
    return df.select(key, *[
        (F.floor(F.col(f"`{n}`").cast("double") * scale + 0.5) / scale).alias(n) for n in names])


def _rounded_sql(expr: str, digits: int = 4) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}"


def _features_sql(ratio: str, http: str, source: str = "conn") -> str:
    return f"""
WITH b AS (SELECT event_id, proto, service, id_resp_p, CAST(duration AS DOUBLE) AS duration, CAST(orig_bytes AS DOUBLE) AS orig_bytes,
  CAST(resp_bytes AS DOUBLE) AS resp_bytes, CAST(orig_pkts AS DOUBLE) AS orig_pkts, CAST(resp_pkts AS DOUBLE) AS resp_pkts FROM {source})
SELECT event_id, {_rounded_sql('duration')} AS duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts,
  orig_bytes + resp_bytes AS bytes_total, {_rounded_sql(ratio.format('orig_bytes', 'resp_bytes'))} AS bytes_ratio,
  orig_pkts + resp_pkts AS pkts_total, {_rounded_sql(ratio.format('orig_pkts', 'resp_pkts'))} AS pkts_ratio,
  CASE WHEN proto = 'tcp' THEN CAST(1 AS DOUBLE) ELSE 0 END AS proto_tcp, CASE WHEN proto = 'udp' THEN CAST(1 AS DOUBLE) ELSE 0 END AS proto_udp,
  CASE WHEN proto = 'icmp' THEN CAST(1 AS DOUBLE) ELSE 0 END AS proto_icmp, CASE WHEN {http} THEN CAST(1 AS DOUBLE) ELSE 0 END AS is_http,
  CASE WHEN id_resp_p = 22 OR service = 'ssh' THEN CAST(1 AS DOUBLE) ELSE 0 END AS is_ssh FROM b"""


@query("t1_conn_features_serve", "conn", _features_sql(
    "{0} / greatest({1}, CAST(0.000001 AS DOUBLE))",
    "service IN ('http', 'http-alt', 'https') OR id_resp_p IN (80, 8080, 8000, 443)"))
def t1(t: Tables) -> DataFrame:
    return _rounded(X.conn_features(t.conn(), "serve"), S.CONN_FEATURES)


@query("t2_conn_features_train", "conn", _features_sql("({0} + 1) / ({1} + 1)", "id_resp_p IN (80, 8080, 443)"))
def t2(t: Tables) -> DataFrame:
    return _rounded(X.conn_features(t.conn(), "train"), S.CONN_FEATURES)


_FLOW_SQL = {
    "Flow Duration": "dur", "Destination Port": "port", "Total Fwd Packets": "fp", "Total Backward Packets": "bp",
    "Subflow Fwd Packets": "fp", "Subflow Bwd Packets": "bp", "Total Length of Fwd Packets": "fb",
    "Total Length of Bwd Packets": "bb", "Subflow Fwd Bytes": "fb", "Subflow Bwd Bytes": "bb",
    "Avg Fwd Segment Size": "fm", "Avg Bwd Segment Size": "bm", "Fwd Packet Length Mean": "fm",
    "Bwd Packet Length Mean": "bm", "Fwd Packet Length Min": "CASE WHEN fm = 0 THEN am ELSE fm END",
    "Bwd Packet Length Min": "CASE WHEN bm = 0 THEN am ELSE bm END", "Fwd Packet Length Max": "greatest(fm, am)",
    "Bwd Packet Length Max": "greatest(bm, bb / greatest(bp, 1))", "Fwd Packet Length Std": "0.1::DOUBLE * fm",
    "Bwd Packet Length Std": "0.1::DOUBLE * bm", "Packet Length Mean": "am", "Average Packet Size": "am",
    "Packet Length Std": "0.1::DOUBLE * am", "Packet Length Variance": "(0.1::DOUBLE * am) * (0.1::DOUBLE * am)",
    "Max Packet Length": "greatest(fm, bm, am)",
    "Min Packet Length": "coalesce(least(nullif(fm, 0), nullif(bm, 0), nullif(am, 0)), 0)",
    "min_seg_size_forward": "fm", "act_data_pkt_fwd": "greatest(fp - n_fp - n_s, 0)", "Flow Packets/s": "(fp + bp) / dur",
    "Flow Bytes/s": "(fb + bb) / dur", "Fwd Packets/s": "fp / dur", "Bwd Packets/s": "bp / dur",
    "Down/Up Ratio": "CASE WHEN fb > 0 THEN bb / fb ELSE bb END", "Fwd Header Length": "fp * 20",
    "Fwd Header Length.1": "fp * 20", "Bwd Header Length": "bp * 20",
    "Init_Win_bytes_forward": "CASE WHEN fraw = 0 THEN fb ELSE fraw END",
    "Init_Win_bytes_backward": "CASE WHEN braw = 0 THEN bb ELSE braw END", "SYN Flag Count": "n_s",
    "FIN Flag Count": "n_f", "RST Flag Count": "n_r", "ACK Flag Count": "n_a", "URG Flag Count": "n_fu + n_bu",
    "PSH Flag Count": "n_fp + n_bp", "ECE Flag Count": "n_e", "Fwd PSH Flags": "n_fp", "Bwd PSH Flags": "n_bp",
    "Fwd URG Flags": "n_fu", "Bwd URG Flags": "n_bu", "Fwd IAT Total": "dur", "Bwd IAT Total": "dur",
    **{f"{s} IAT {p}": f"dur / greatest({n}, 1)" for s, n in (("Flow", "fp + bp"), ("Fwd", "fp"), ("Bwd", "bp"))
       for p in ("Mean", "Max", "Min")},
    **{f"{s} IAT Std": f"0.1::DOUBLE * (dur / greatest({n}, 1))" for s, n in (("Flow", "fp + bp"), ("Fwd", "fp"), ("Bwd", "bp"))},
    **{f"{s} {p}": f"{f} * ({e})" for s, e in (("Idle", "idle"), ("Active", "dur - idle"))
       for p, f in (("Mean", "1"), ("Min", "0.8::DOUBLE"), ("Max", "1.2::DOUBLE"), ("Std", "0.1::DOUBLE"))},
}


def _letters(letters: str) -> str:
    return f"CAST(length(regexp_replace(history, '[^{letters}]', '', 'g')) AS DOUBLE)"


_CIC_SQL = f"""
WITH a AS (SELECT event_id, greatest(duration, 0.000001::DOUBLE) AS dur, CAST(orig_pkts AS DOUBLE) AS fp, CAST(resp_pkts AS DOUBLE) AS bp,
  CAST(orig_bytes AS DOUBLE) AS fraw, CAST(resp_bytes AS DOUBLE) AS braw, CAST(greatest(coalesce(orig_ip_bytes, orig_bytes), orig_bytes) AS DOUBLE) AS fb,
  CAST(greatest(coalesce(resp_ip_bytes, resp_bytes), resp_bytes) AS DOUBLE) AS bb, CAST(id_resp_p AS DOUBLE) AS port,
  {_letters('Ss')} AS n_s, {_letters('Ff')} AS n_f, {_letters('Rr')} AS n_r, {_letters('Aa')} AS n_a, {_letters('Ee')} AS n_e,
  {_letters('P')} AS n_fp, {_letters('p')} AS n_bp, {_letters('U')} AS n_fu, {_letters('u')} AS n_bu FROM conn),
m AS (SELECT *, CASE WHEN fp <= 0 THEN fb ELSE fb / fp END AS fm, CASE WHEN bp <= 0 THEN bb ELSE bb / bp END AS bm,
  CASE WHEN fp + bp <= 0 THEN fb + bb ELSE (fb + bb) / (fp + bp) END AS am,
  greatest(dur - least(dur, (fp + bp) * 0.001::DOUBLE), 0) AS idle FROM a)
SELECT event_id, {', '.join(f'{_rounded_sql(_FLOW_SQL.get(n, "0"), 8)} AS "{n}"' for n in S.CIC_FEATURES)} FROM m"""


@query("t3_cic_features78", "conn", _CIC_SQL)
def t3(t: Tables) -> DataFrame:
    return _rounded(X.cic_features78(t.conn(), keep=["event_id"]), S.CIC_FEATURES, digits=8)


@query("t4_cicflow_top20", "conn", """
SELECT event_id, CAST(orig_pkts AS DOUBLE) AS "Subflow Fwd Packets", CAST(orig_pkts AS DOUBLE) AS "Total Fwd Packets",
  CAST(id_resp_p AS DOUBLE) AS "Destination Port", CAST(orig_bytes AS DOUBLE) AS "min_seg_size_forward",
  CAST(orig_bytes AS DOUBLE) AS "Avg Fwd Segment Size", CAST(0 AS DOUBLE) AS "Idle Min" FROM conn""")
def t4(t: Tables) -> DataFrame:
    rows = t.conn().select("event_id", F.col("orig_pkts").alias("total_fwd_pkts"), F.col("id_resp_p").alias("dst_port"),
                           F.col("orig_bytes").alias("avg_fwd_seg_size"), F.lit("bad").alias("idle_min"))
    names = ["Subflow Fwd Packets", "Total Fwd Packets", "Destination Port", "min_seg_size_forward",
             "Avg Fwd Segment Size", "Idle Min"]
    return X.cicflow_top20(rows, keep=["event_id"]).select("event_id", *names)


@query("t5_pick_features", "dirty", f"""
SELECT event_id, round(CASE WHEN lower({_TRIMMED}) IN ('nan', '-inf') THEN 0.0
  ELSE coalesce(TRY_CAST(replace({_TRIMMED}, ',', '') AS DOUBLE), 0.0) END, 6) AS duration, CAST(0 AS DOUBLE) AS is_ssh FROM dirty""")
def t5(t: Tables) -> DataFrame:
    picked = X.pick_features(t.dirty().withColumnRenamed("num_text", "duration"))
    return picked.select("event_id", F.round("duration", 6).alias("duration"), "is_ssh")


@query("t6_binary_target", "conn", "SELECT event_id, CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END AS target FROM conn")
def t6(t: Tables) -> DataFrame:
    return t.conn().select("event_id", X.binary_target(F.col("label")).alias("target"))


@query("t7_class_code", "conn", """
WITH o AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM conn))
SELECT event_id, CAST(code AS INTEGER) AS code FROM conn JOIN o USING (label)""")
def t7(t: Tables) -> DataFrame:
    df = t.conn()
    return df.select("event_id", X.class_code(F.col("label"), X.class_order(df, "label")).alias("code"))


@query("t8_numeric_features", "conn", """
SELECT CAST(duration AS FLOAT) AS duration, CAST(orig_bytes AS FLOAT) AS orig_bytes, CAST(resp_bytes AS FLOAT) AS resp_bytes,
  CAST(orig_pkts AS FLOAT) AS orig_pkts FROM conn""")
def t8(t: Tables) -> DataFrame:
    rows = t.conn().select("uid", "label", "k", "duration", "orig_bytes", "resp_bytes", "orig_pkts")
    return X.numeric_features(rows, drop=["k"])


@query("t9_scale", "conn", """
WITH s AS (SELECT stddev_pop(duration) AS a, stddev_pop(orig_bytes) AS b FROM conn)
SELECT event_id, round(duration / s.a, 6) AS duration, round(orig_bytes / s.b, 6) AS orig_bytes, CAST(7 AS DOUBLE) AS fixed FROM conn, s""")
def t9(t: Tables) -> DataFrame:
    df = t.conn().select("event_id", "duration", F.col("orig_bytes").cast("double").alias("orig_bytes"), F.lit(7.0).alias("fixed"))
    scaled = X.apply_scale(df, X.fit_scale(df, ["duration", "orig_bytes", "fixed"]))
    return scaled.select("event_id", F.round("duration", 6).alias("duration"), F.round("orig_bytes", 6).alias("orig_bytes"), "fixed")


@query("t10_assemble", "conn", "SELECT event_id, round(duration + orig_bytes + orig_pkts, 6) AS total, 3 AS width FROM conn")
def t10(t: Tables) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = X.assemble(t.conn(), ["duration", "orig_bytes", "orig_pkts"])
    array = vector_to_array("features")
    total = F.aggregate(array, F.lit(0.0), lambda a, b: a + b)
    return rows.select("event_id", F.round(total, 6).alias("total"), F.size(array).alias("width"))


