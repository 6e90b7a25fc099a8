"""Registered queries: joins, row filters, sampling, set operations, packets to flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import labels as L
from flowlens.functions.times import latest
from flowlens.operators import alerts as Q
from flowlens.operators import features as X
from flowlens.operators import flows, labeling, sampling, smote
from flowlens.plans.registry import query
from flowlens.plans.views import FLOW_ID_SQL, TIME_MEANING_SQL, Tables, case_sql
from flowlens.sources import checks
from flowlens.streaming import sync

_ATTACK_SQL = case_sql(S.LABEL_ATTACK_TYPES, "label", "'DOS'")


def _with_day(t: Tables) -> DataFrame:
    """Unlabelled connections with flow id and day."""
    return labeling.with_flow_id(t.conn().drop("label")).withColumn("day", F.to_date("ts"))


# --- joins -----------------------------------------------------------------------------


@query("j1_label_by_flow", "conn cic", f"""
SELECT uid, "Label", count(*) AS n_matches FROM (SELECT uid, {FLOW_ID_SQL} AS flow_id FROM conn) z
JOIN cic USING (flow_id) GROUP BY uid, "Label\"""")
def j1(t: Tables) -> DataFrame:
    return labeling.label_by_flow(_with_day(t).drop("day"), t.cic()).select("uid", "Label", "n_matches")


@query("j1_labelled_rows", "conn cic", f"""
SELECT "Label", count(*) AS n FROM (SELECT {FLOW_ID_SQL} AS flow_id FROM conn) z JOIN cic USING (flow_id) GROUP BY 1""")
def j1_rows(t: Tables) -> DataFrame:
    labelled = labeling.label_by_flow(_with_day(t).drop("day"), t.cic())
    return labelled.groupBy("Label").agg(F.sum(labeling.matches_weight(labelled)).alias("n"))


@query("j2_label_by_day", "conn cic", f"""
SELECT uid, "Label", count(*) AS n_matches FROM (SELECT uid, CAST(ts AS DATE) AS day, {FLOW_ID_SQL} AS flow_id FROM conn) z
JOIN cic USING (day, flow_id) GROUP BY uid, "Label\"""")
def j2(t: Tables) -> DataFrame:
    return labeling.label_by_flow(_with_day(t), t.cic(), by_day=True).select("uid", "Label", "n_matches")


@query("j3_hour_spine", "alerts", """
WITH spine AS (SELECT date_trunc('hour', (SELECT max(timestamp) FROM alerts)) - to_hours(CAST(i AS INTEGER)) AS bucket FROM range(72) r(i))
SELECT epoch_us(bucket) AS micros, (SELECT count(*) FROM alerts a WHERE a.attack_type = 'BOT' OR (a.attack_type = 'DDOS'
  AND date_trunc('hour', a.timestamp) = s.bucket)) AS "count" FROM spine s""")
def j3(t: Tables) -> DataFrame:
    alerts = t.alerts()
    series = Q.hourly_series(Q.predicted_as(alerts, "DDOS"), latest(alerts), hours=72)
    return series.select(F.unix_micros("bucket").alias("micros"), "count")


@query("j4_class_shift", "conn", """
SELECT label, count(*) AS count_before, least(count(*), 1500) AS count_after, least(count(*), 1500) - count(*) AS diff
FROM conn GROUP BY label""")
def j4(t: Tables) -> DataFrame:
    conn = t.conn().select("uid", "label")
    return sampling.class_shift(conn, sampling.sample_per_class(conn, "label", 1500), "label")


@query("j5_dimension_lookup", "conn", f"""
SELECT {case_sql(S.SERVICE_BY_PORT, 'id_resp_p', "'-'")} AS service, {_ATTACK_SQL} AS attack, count(*) AS n
FROM conn GROUP BY 1, 2""")
def j5(t: Tables) -> DataFrame:
    rows = t.conn().select(L.guess_service("id_resp_p").alias("service"), L.label_to_attack("label").alias("attack"))
    return rows.groupBy("service", "attack").agg(F.count(F.lit(1)).alias("n"))


_SECONDS = "floor(ts_epoch / 3600) * 3600"
_STATE_SQL = f"""
WITH h AS (SELECT uid, k, {_SECONDS} AS ts FROM conn),
s AS (SELECT max(ts) AS last_ts FROM h WHERE ts <= (SELECT (min(ts) + max(ts)) / 2 FROM h)),
seen AS (SELECT uid FROM h, s WHERE h.ts = s.last_ts AND k >= 50)"""


def _hourly(t: Tables) -> DataFrame:
    """Connections with whole-hour timestamps: many share one."""
    return t.conn().select("uid", "k", (F.floor(F.col("ts_epoch") / 3600) * 3600).cast("double").alias("ts"))


def _state(rows: DataFrame) -> DataFrame:
    """Checkpoint at an hour in the middle, with some of its uids seen."""
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    last = rows.filter(F.col("ts") <= F.lit((low + high) / 2)).agg(F.max("ts")).first()[0]
    return rows.filter((F.col("ts") == F.lit(last)) & (F.col("k") >= 50)).select(
        F.col("ts").alias("last_ts"), "uid")


@query("j6_unseen_uids", "conn", f"""{_STATE_SQL}
SELECT h.uid FROM h, s WHERE h.ts = s.last_ts AND h.uid NOT IN (SELECT uid FROM seen)""")
def j6(t: Tables) -> DataFrame:
    rows = _hourly(t)
    state = _state(rows)
    delta = sync.new_rows(rows, state)
    return delta.join(F.broadcast(state.agg(F.max("last_ts").alias("ts"))), "ts", "left_semi").select("uid")


@query("st2_incremental_delta", "conn", f"""{_STATE_SQL}
SELECT h.uid, CAST(h.ts AS DOUBLE) AS ts FROM h, s WHERE h.ts > s.last_ts OR (h.ts = s.last_ts AND h.uid NOT IN (SELECT uid FROM seen))""")
def st2(t: Tables) -> DataFrame:
    rows = _hourly(t)
    return sync.new_rows(rows, _state(rows)).select("uid", "ts")


@query("st2_next_state", "conn", f"""{_STATE_SQL}
SELECT CAST(ts AS DOUBLE) AS last_ts, uid FROM h WHERE ts = (SELECT max(ts) FROM h)""")
def st2_state(t: Tables) -> DataFrame:
    rows = _hourly(t)
    return sync.incremental_delta(rows, _state(rows))[1]


def _importance(t: Tables) -> DataFrame:
    """Spread of each numeric column as a stand-in for an importance."""
    names = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]
    wide = t.conn().agg(*[F.round(F.stddev_pop(n), 6).alias(n) for n in names])
    return wide.unpivot([], names, "feature", "importance")


_IMPORTANCE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(stddev_pop({n}), 6) AS importance FROM conn"
    for n in ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"))
_RANKED_SQL = f"""WITH i AS ({_IMPORTANCE_SQL}),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM i)"""


@query("w5_rank_features", "conn", f"{_RANKED_SQL} SELECT * FROM r")
def w5(t: Tables) -> DataFrame:
    return sampling.rank_features(_importance(t))


@query("j7_selected_features", "conn", f"{_RANKED_SQL} SELECT * FROM r WHERE rank <= 3")
def j7(t: Tables) -> DataFrame:
    ranking = sampling.rank_features(_importance(t))
    chosen = ranking.filter("rank <= 3").select("feature")
    return ranking.join(chosen, "feature", "left_semi")


@query("l5_select_top_features", "conn", f"""{_RANKED_SQL}
SELECT count(*) AS n, (SELECT string_agg(feature, ',' ORDER BY rank) FROM r WHERE rank <= 2) AS features,
  round(avg(orig_bytes), 4) AS mean_of_first FROM conn""")
def l5(t: Tables) -> DataFrame:
    names = X.select_ranked(sampling.rank_features(_importance(t)), 2)
    kept = t.conn().select(*names)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(names)).alias("features"),
                    F.round(F.avg(names[0]), 4).alias("mean_of_first"))


# --- row filters -------------------------------------------------------------------------


@query("p5_drop_negative", "conn", """
SELECT uid, round(duration - 5, 6) AS duration FROM conn WHERE duration - 5 >= 0 AND orig_bytes - 600 >= 0""")
def p5(t: Tables) -> DataFrame:
    rows = t.conn().withColumns({"duration": F.col("duration") - 5, "orig_bytes": F.col("orig_bytes") - 600})
    return labeling.drop_negative(rows).select("uid", F.round("duration", 6).alias("duration"))


@query("p6_keep_classes", "dirty", """
SELECT event_id, class FROM (SELECT event_id, CASE WHEN lower(label_text) LIKE '%ddos%' THEN 'DDOS'
  WHEN lower(label_text) LIKE '%dos%' THEN 'DOS' WHEN lower(label_text) LIKE '%bot%' THEN 'BOT'
  WHEN lower(label_text) LIKE '%patator%' OR lower(label_text) LIKE '%brute force%' THEN 'BRUTE_FORCE'
  WHEN label_text = 'BENIGN' THEN 'BENIGN' WHEN lower(label_text) LIKE '%portscan%' THEN 'PORTSCAN' ELSE 'OTHER' END AS class
  FROM dirty) WHERE class <> 'OTHER'""")
def p6(t: Tables) -> DataFrame:
    rows = t.dirty().select("event_id", L.map_label6("label_text").alias("class"))
    return labeling.keep_classes(rows, "class")


@query("p7_drop_unmapped", "dirty", f"""
SELECT event_id, {case_sql(S.CIC_ATTACK_GROUPS, 'trim(label_text)')} AS attack_group FROM dirty
WHERE {case_sql(S.CIC_ATTACK_GROUPS, 'trim(label_text)')} IS NOT NULL""")
def p7(t: Tables) -> DataFrame:
    rows = t.dirty().select("event_id", L.cic_attack_group("label_text").alias("attack_group"))
    return labeling.drop_unmapped(rows, "attack_group", required=True)


@query("p8_only_attacks", "conn", "SELECT uid, label FROM conn WHERE label <> 'BENIGN'")
def p8(t: Tables) -> DataFrame:
    return labeling.only_attacks(t.conn(), "label").select("uid", "label")


@query("p8_only_correct", "scored", "SELECT event_id, y_true FROM scored WHERE y_true = y_pred")
def p8_correct(t: Tables) -> DataFrame:
    return labeling.only_correct(t.scored(), "y_true", "y_pred").select("event_id", "y_true")


@query("p9_split_valid", "dirty", f"""
SELECT event_id, CASE WHEN {TIME_MEANING_SQL} IS NULL THEN 'timestamp' WHEN k = 11 THEN 'endpoint'
  WHEN k = 13 THEN 'port' ELSE 'ok' END AS outcome FROM dirty""")
def p9(t: Tables) -> DataFrame:
    good, bad = checks.split_valid(t.raw_flows())
    return good.select("event_id", F.lit("ok").alias("outcome")).unionByName(
        bad.select("event_id", F.col("reject_reason").alias("outcome")))


# --- sampling ----------------------------------------------------------------------------


def _ordered(seed: int, group: str = "label") -> str:
    return f"row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}:' || uid), uid)"


@query("w1_sample_per_class", "conn", f"""
SELECT uid, label FROM (SELECT uid, label, {_ordered(42)} AS r FROM conn) WHERE r <= 200""")
def w1(t: Tables) -> DataFrame:
    return sampling.sample_per_class(t.conn().select("uid", "label"), "label", 200)


@query("w2_cap_classes", "conn", f"""
SELECT uid, attack FROM (SELECT uid, attack, {_ordered(42, 'attack')} AS r FROM (SELECT uid, {_ATTACK_SQL} AS attack FROM conn))
WHERE r <= CASE attack WHEN 'BENIGN' THEN 800 WHEN 'DOS' THEN 700 WHEN 'DDOS' THEN 500 ELSE r END""")
def w2(t: Tables) -> DataFrame:
    rows = t.conn().select("uid", L.label_to_attack("label").alias("attack"))
    return sampling.cap_classes(rows, "attack", {"BENIGN": 800, "DOS": 700, "DDOS": 500})


@query("w3_stratified_split", "conn", f"""
SELECT uid, label, r <= floor(0.2 * n + 0.5) AS is_test FROM (SELECT uid, label, {_ordered(42)} AS r,
  count(*) OVER (PARTITION BY label) AS n FROM conn)""")
def w3(t: Tables) -> DataFrame:
    return sampling.mark_split(t.conn().select("uid", "label"), "label", 0.2)


@query("w4_first_per_class", "conn scored", f"""
SELECT uid, y_true FROM (SELECT uid, y_true, {_ordered(42, 'y_true')} AS r FROM conn JOIN scored USING (event_id)
  WHERE y_true = y_pred) WHERE r <= 50""")
def w4(t: Tables) -> DataFrame:
    correct = labeling.only_correct(t.scored(), "y_true", "y_pred")
    rows = correct.select(F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("uid"), "y_true")
    return sampling.sample_per_class(rows, "y_true", 50)


_PLAN_COUNTS = """WITH c AS (SELECT label, count(*) * 4 AS n FROM conn WHERE label <> 'DDoS' OR duration >= 60 GROUP BY label)"""


@query("w6_smote_plan", "conn", f"""{_PLAN_COUNTS},
b AS (SELECT max(n) AS m, min(n) AS lo, count(*) AS k, least(max(n), greatest(5000, floor(1.5 * median(n)))) AS base FROM c)
SELECT label, n, m AS full_target, CAST(CASE WHEN k > 1 AND lo >= 2 AND n < base THEN least(base, least(m, base * 3)) ELSE n END AS BIGINT) AS dynamic_target,
  CASE WHEN n >= 300 AND n < 15000 THEN 15000 ELSE n END AS threshold_target, n AS none_target FROM c, b""")
def w6(t: Tables) -> DataFrame:
    rows = t.conn().filter((F.col("label") != "DDoS") | (F.col("duration") >= 60))
    plan = rows.groupBy("label").agg((F.count(F.lit(1)) * 4).alias("n"))
    for mode in ("full", "dynamic", "threshold", "none"):
        plan = sampling.smote_plan(plan, mode).withColumnRenamed("target", f"{mode}_target")
    return plan


_SMOTE_FEATURES = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]


@query("w7_smote", "conn", """
WITH c AS (SELECT label, count(*) AS n FROM conn GROUP BY label)
SELECT label, n AS real_rows, (SELECT max(n) FROM c) - n AS synthetic_rows, 0 AS outside FROM c""")
def w7(t: Tables) -> DataFrame:
    rows = t.conn().select("uid", "label", *_SMOTE_FEATURES)
    both, _ = smote.smote(rows, "label", _SMOTE_FEATURES, "full")
    # Synthetic points lie between two rows, so inside the range of their class.
    ranges = rows.groupBy(F.col("label").alias("of")).agg(
        *[F.min(f).cast("double").alias(f"lo_{f}") for f in _SMOTE_FEATURES],
        *[F.max(f).cast("double").alias(f"hi_{f}") for f in _SMOTE_FEATURES])
    inside = F.lit(True)
    for f in _SMOTE_FEATURES:
        inside = inside & F.col(f).between(F.col(f"lo_{f}") - 1e-6, F.col(f"hi_{f}") + 1e-6)
    checked = both.join(F.broadcast(ranges), F.col("label").eqNullSafe(F.col("of")))
    return checked.groupBy("label").agg(
        F.count_if(~F.col("synthetic")).alias("real_rows"), F.count_if("synthetic").alias("synthetic_rows"),
        F.count_if(~inside).cast("int").alias("outside"))


@query("a19_class_weights", "conn", """
SELECT label, count(*) AS n, round((SELECT count(*) FROM conn) / ((SELECT count(DISTINCT label) FROM conn) * count(*)), 9) AS weight
FROM conn GROUP BY label""")
def a19(t: Tables) -> DataFrame:
    return sampling.class_weights(t.conn(), "label").withColumn("weight", F.round("weight", 9))


# --- set operations ------------------------------------------------------------------------


@query("u1_union_by_name", "conn", """
SELECT uid, label, CASE WHEN proto = 'tcp' THEN proto ELSE '?' END AS proto FROM conn""")
def u1(t: Tables) -> DataFrame:
    conn = t.conn()
    tcp = conn.filter("proto = 'tcp'").select("uid", "label", "proto")
    other = conn.filter("proto <> 'tcp'").select("label", "uid")
    return tcp.unionByName(other, allowMissingColumns=True).withColumn("proto", F.coalesce("proto", F.lit("?")))


@query("u2_distinct_rows", "cic", 'SELECT DISTINCT flow_id, "Label", CAST(day AS VARCHAR) AS day FROM cic')
def u2(t: Tables) -> DataFrame:
    return t.cic().dropDuplicates().withColumn("day", F.col("day").cast("string"))


# --- packets to flows ------------------------------------------------------------------------

FLOWS_SQL = """
WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY uid ORDER BY ts) AS gap FROM packets),
f AS (SELECT uid, epoch_us(min(ts)) AS ts_micros, (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS span,
  count(*) FILTER (is_orig) AS fn, count(*) FILTER (NOT is_orig) AS bn,
  CAST(coalesce(sum(len) FILTER (is_orig), 0) AS DOUBLE) AS fsum, CAST(coalesce(sum(len) FILTER (NOT is_orig), 0) AS DOUBLE) AS bsum,
  CAST(coalesce(min(len) FILTER (is_orig), 0) AS DOUBLE) AS fmin, CAST(coalesce(min(len) FILTER (NOT is_orig), 0) AS DOUBLE) AS bmin,
  CAST(coalesce(max(len) FILTER (NOT is_orig), 0) AS DOUBLE) AS bmax, coalesce(stddev_pop(len) FILTER (NOT is_orig), 0) AS bstd,
  count(*) FILTER (flags LIKE '%P%') AS psh, count(*) FILTER (is_orig AND len > 0) AS data, CAST(min(len) AS DOUBLE) AS least_len,
  coalesce(min(gap) FILTER (gap > 0), 0) / CAST(1000000 AS DOUBLE) AS idle FROM g GROUP BY uid)
SELECT uid, ts_micros, CASE WHEN span > 0 THEN span ELSE 0.000001::DOUBLE END AS duration, fn AS total_fwd_pkts, bn AS total_bwd_pkts,
  fsum AS total_fwd_len, bsum AS total_bwd_len, fmin AS fwd_pkt_len_min, round(CASE WHEN fn > 0 THEN fsum / fn ELSE 0 END, 6) AS fwd_pkt_len_mean,
  bmin AS bwd_pkt_len_min, round(CASE WHEN bn > 0 THEN bsum / bn ELSE 0 END, 6) AS bwd_pkt_len_mean, bmax AS bwd_pkt_len_max,
  round(bstd, 4) AS bwd_pkt_len_std, round((fsum + bsum) / (fn + bn), 6) AS pkt_len_mean, least_len AS min_pkt_len,
  round(bn / CASE WHEN span > 0 THEN span ELSE 0.000001::DOUBLE END, 9) AS bwd_pkts_per_sec, psh AS psh_flag_count,
  fn AS subflow_fwd_pkts, data AS act_data_pkt_fwd{idle} FROM f"""


def shown_flows(df: DataFrame, idle: bool = True) -> DataFrame:
    rounded = {"fwd_pkt_len_mean": 6, "bwd_pkt_len_mean": 6, "pkt_len_mean": 6, "bwd_pkt_len_std": 4, "bwd_pkts_per_sec": 9}
    names = ["uid", "duration", "total_fwd_pkts", "total_bwd_pkts", "total_fwd_len", "total_bwd_len", "fwd_pkt_len_min",
             "bwd_pkt_len_min", "bwd_pkt_len_max", "min_pkt_len", "psh_flag_count", "subflow_fwd_pkts", "act_data_pkt_fwd"]
    return df.select(F.unix_micros("ts").alias("ts_micros"), *names, *(["idle_min"] if idle else []),
                     *[F.round(c, d).alias(c) for c, d in rounded.items()])


@query("a20_packets_to_flows", "packets", FLOWS_SQL.format(idle=", idle AS idle_min"))
def a20(t: Tables) -> DataFrame:
    return shown_flows(flows.packets_to_flows(t.packets()))


@query("k5_labeled_rows", "conn cic", f"""
SELECT DISTINCT uid, duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, "Label"
FROM (SELECT * EXCLUDE (label), {FLOW_ID_SQL} AS flow_id FROM conn) z JOIN cic USING (flow_id)""")
def k5(t: Tables) -> DataFrame:
    from flowlens.sources.sinks import labeled_rows

    # Distinct rows need no repeats of a match.
    labelled = labeling.label_by_flow(_with_day(t).drop("day"), t.cic()).drop("n_matches")
    return labeled_rows(labelled).select("uid", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "Label")


