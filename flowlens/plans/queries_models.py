"""Registered queries: evaluation, models and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import alerts as A
from flowlens.functions import labels as L
from flowlens.operators import evaluation as E
from flowlens.operators import features as X
from flowlens.operators import models as M
from flowlens.operators.sampling import stratified_split
from flowlens.plans.registry import query
from flowlens.plans.views import SEVERITY_SQL, Tables, case_sql, with_scores
from flowlens.session import materialize, scratch_dir
from flowlens.sources import logs

_NAME = case_sql(dict(enumerate(S.CLASS_NAMES)), "{0}")


def _pairs(t: Tables) -> DataFrame:
    return E.confusion_pairs(t.scored(), "y_true", "y_pred")


@query("e1_confusion", "scored", f"""
SELECT y_true AS truth, {', '.join(f'count(*) FILTER (y_pred = {c}) AS pred_{c}' for c in range(6))} FROM scored GROUP BY y_true""")
def e1(t: Tables) -> DataFrame:
    return E.confusion(_pairs(t), range(6))


@query("e2_accuracy", "scored", "SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM scored")
def e2(t: Tables) -> DataFrame:
    return E.accuracy(_pairs(t)).select(F.round("accuracy", 9).alias("accuracy"))


_PER_CLASS = """
WITH m AS (SELECT c AS class, (SELECT count(*) FROM scored WHERE y_true = c) AS support,
  (SELECT count(*) FROM scored WHERE y_pred = c) AS called,
  (SELECT count(*) FROM scored WHERE y_true = c AND y_pred = c) AS hits FROM range(6) r(c)),
p AS (SELECT class, support, coalesce(hits / nullif(called, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM m),
pc AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p)"""


@query("e3_per_class", "scored", f"""{_PER_CLASS}
SELECT CAST(class AS INTEGER) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM pc""")
def e3(t: Tables) -> DataFrame:
    return _rounded(E.per_class(_pairs(t)))


_GLOBAL = """SELECT 'GLOBAL_macro' AS class, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1,
  CAST(sum(support) AS BIGINT) AS support FROM pc UNION ALL
SELECT 'GLOBAL_weighted', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
  round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM pc"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("e4_global_rows", "scored", f"{_PER_CLASS} {_GLOBAL}")
def e4(t: Tables) -> DataFrame:
    return _rounded(E.global_rows(E.per_class(_pairs(t))))


@query("u3_class_report", "scored", f"""{_PER_CLASS}
SELECT CAST(class AS VARCHAR) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM pc
UNION ALL {_GLOBAL}""")
def u3(t: Tables) -> DataFrame:
    return _rounded(E.class_report(_pairs(t)))


@query("e5_code_errors", "scored", """
SELECT round(avg(abs(y_true - y_pred)), 9) AS mae, round(avg((y_true - y_pred) * (y_true - y_pred)), 9) AS mse,
  round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 9) AS rmse FROM scored""")
def e5(t: Tables) -> DataFrame:
    return E.code_errors(_pairs(t)).select(*[F.round(c, 9).alias(c) for c in ("mae", "mse", "rmse")])


_AUC = """
WITH s AS (SELECT cls, score, count(*) FILTER (y_true = cls) AS pos, count(*) FILTER (y_true <> cls) AS neg FROM probs GROUP BY cls, score),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
a AS (SELECT cls, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY cls)"""


@query("e6_class_auc", "scored", f"{_AUC} SELECT cls AS class, round(auc, 9) AS auc FROM a")
def e6_class(t: Tables) -> DataFrame:
    return E.class_auc(t.scored(), "y_true", "probabilities").select("class", F.round("auc", 9).alias("auc"))


@query("e6_macro_auc", "scored", f"{_AUC} SELECT round(avg(auc), 9) AS auc FROM a")
def e6(t: Tables) -> DataFrame:
    return E.macro_auc(t.scored(), "y_true", "probabilities").select(F.round("auc", 9).alias("auc"))


_ROC = """
WITH s AS (SELECT round(score, 12) AS score, count(*) FILTER ({hit}) AS pos, count(*) FILTER (NOT ({hit})) AS neg FROM probs WHERE {rows} GROUP BY 1),
t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM s)
SELECT round(score, 9) AS threshold, round(sum(neg) OVER w / (SELECT n FROM t), 9) AS fpr,
  round(sum(pos) OVER w / (SELECT p FROM t), 9) AS tpr FROM s WINDOW w AS (ORDER BY score DESC)
UNION ALL SELECT 9.0, 0, 0"""


def _shown_roc(points: DataFrame) -> DataFrame:
    threshold = F.when(F.col("threshold") > 8, F.lit(9.0)).otherwise(F.round("threshold", 9))
    return points.select(threshold.alias("threshold"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def _graded(t: Tables) -> DataFrame:
    """Scores on a fixed grid, so that both engines see the same ties."""
    return t.scored().withColumn("probabilities", F.transform("probabilities", lambda p: F.round(p, 12)))


@query("e7_roc_points", "scored", _ROC.format(hit="y_true = cls", rows="true"))
def e7(t: Tables) -> DataFrame:
    return _shown_roc(E.roc_points(_graded(t), "y_true", "probabilities"))


@query("e7_roc_points_binary", "scored", _ROC.format(hit="y_true = 1", rows="cls = 1"))
def e7_binary(t: Tables) -> DataFrame:
    return _shown_roc(E.roc_points(_graded(t), "y_true", "probabilities", binary=True))


def _result(t: Tables, model: str, prediction: str) -> DataFrame:
    metrics = E.global_metrics(E.confusion_pairs(
        t.scored().withColumn("late", F.when(F.col("k") < 60, F.col("y_true")).otherwise(F.col("y_pred"))
                              ).withColumn("early", (F.col("y_true") + F.when(F.col("k") < 50, 0).otherwise(1)) % 6),
        "y_true", prediction))
    return E.result_row(metrics, model, 1.5, 0.5, False, "none")


def _model_sql(name: str, family: str, prediction: str) -> str:
    return f"""SELECT '{family}' AS "Family", '{name}' AS "Model", round(100 * avg(f1), 6) AS "F1-score (%)",
  round(100 * (SELECT avg(CASE WHEN y_true = {prediction} THEN 1.0 ELSE 0 END) FROM sc), 6) AS "Accuracy (%)" FROM (
  SELECT c, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM (SELECT c,
    coalesce((SELECT count(*) FROM sc WHERE y_true = c AND {prediction} = c) / nullif((SELECT count(*) FROM sc WHERE {prediction} = c), 0), 0) AS pr,
    coalesce((SELECT count(*) FROM sc WHERE y_true = c AND {prediction} = c) / nullif((SELECT count(*) FROM sc WHERE y_true = c), 0), 0) AS rc
    FROM range(6) r(c)))"""


@query("e8_compare_models", "scored", f"""
WITH sc AS (SELECT *, (y_true + CASE WHEN k < 50 THEN 0 ELSE 1 END) % 6 AS early, y_pred AS late FROM scored)
{_model_sql('LATE', 'ML', 'late')} UNION ALL {_model_sql('EARLY', 'ML', 'early')} UNION ALL {_model_sql('OTHER', 'DL', 'early')}""")
def e8(t: Tables) -> DataFrame:
    rows = E.compare({"ML": [_result(t, "EARLY", "early"), _result(t, "LATE", "late")], "DL": [_result(t, "OTHER", "early")]})
    return rows.select("Family", "Model", F.round("F1-score (%)", 6).alias("F1-score (%)"),
                       F.round("Accuracy (%)", 6).alias("Accuracy (%)"))


@query("e9_result_row", "scored", f"""{_PER_CLASS}
SELECT 'RF' AS "Model", round(100 * (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END) FROM scored), 6) AS "Accuracy (%)",
  round(100 * avg(precision), 6) AS "Precision (%)", round(100 * avg(recall), 6) AS "Recall (%)", round(100 * avg(f1), 6) AS "F1-score (%)",
  round((SELECT avg(abs(y_true - y_pred)) FROM scored), 6) AS "MAE", CAST(1.5 AS DOUBLE) AS "Train_time_s", 'full' AS "SMOTE_MODE" FROM pc""")
def e9(t: Tables) -> DataFrame:
    row = E.result_row(E.global_metrics(_pairs(t)), "RF", 1.5, 0.5, False, "full")
    shares = ["Accuracy (%)", "Precision (%)", "Recall (%)", "F1-score (%)", "MAE"]
    return row.select("Model", *[F.round(c, 6).alias(c) for c in shares], "Train_time_s", "SMOTE_MODE")


@query("e10_agreement", "scored", f"""
SELECT {_NAME.format('y_true')} AS label, count(*) AS n, count(*) FILTER (y_true = y_pred) AS agree FROM scored GROUP BY y_true""")
def e10(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(c) for c in S.CLASS_NAMES])
    rows = t.scored().select(F.get(names, F.col("y_true")).alias("label"), A.top_class("probabilities")["name"].alias("p"))
    return E.agreement(rows, "label", "p")


@query("m5_to_alerts", "conn scored", f"""
WITH x AS (SELECT c.*, s.y_pred, greatest(0.0, least(CAST(0.999 AS DOUBLE), 1.0 - (SELECT score FROM probs p WHERE p.event_id = c.event_id AND p.cls = 0))) AS score,
  {_NAME.format('s.y_pred')} AS attack FROM conn c JOIN scored s USING (event_id))
SELECT epoch_us(ts) AS micros, {SEVERITY_SQL.format(score='score', attack='attack')} AS severity, attack AS attack_type,
  id_orig_h AS src_ip, id_orig_p AS src_port, id_resp_h AS dst_ip, id_resp_p AS dst_port, upper(proto) AS protocol, 'ZEEK-' || uid AS rule_id,
  'Zeek ' || attack AS rule_name, round(score, 9) AS model_score, CASE WHEN attack = 'BENIGN' THEN 'benign' ELSE 'malicious' END AS model_label,
  y_pred AS class_index, 'uploaded' AS dataset_source, round(duration, 6) AS raw_duration, CAST(resp_bytes AS VARCHAR) AS raw_resp_bytes FROM x""")
def m5(t: Tables) -> DataFrame:
    conn = t.conn().withColumnRenamed("ts", "time").withColumnRenamed("ts_epoch", "ts")
    scored = with_scores(X.conn_features(M.keep_raw(conn), "serve"))
    alerts = M.to_alerts(scored, S.CONN_FEATURES, "conn", tags={"dataset_source": "uploaded"})
    return alerts.select(
        F.unix_micros("timestamp").alias("micros"), "severity", "attack_type", "src_ip", "src_port", "dst_ip", "dst_port",
        "protocol", "rule_id", "rule_name", F.round("model_score", 9).alias("model_score"), "model_label",
        A.meta_field("meta", "model.class_index").cast("int").alias("class_index"),
        A.meta_field("meta", "dataset_source").alias("dataset_source"),
        F.round(A.meta_field("meta", "zeek_conn.duration").cast("double"), 6).alias("raw_duration"),
        A.meta_field("meta", "zeek_conn.resp_bytes").alias("raw_resp_bytes"))


@query("m5_unique_ids", "conn", "SELECT CAST(3 * count(*) AS BIGINT) AS n, CAST(3 * count(*) AS BIGINT) AS ids FROM conn")
def m5_ids(t: Tables) -> DataFrame:
    """Rows that share rule and time, and rows that are equal, still get ids of their own."""
    conn = t.conn().withColumnRenamed("ts", "time").withColumnRenamed("ts_epoch", "ts").withColumn("uid", F.lit(None).cast("string"))
    rows = conn.unionByName(conn).unionByName(conn.withColumn("duration", F.col("duration") + 1))
    alerts = M.to_alerts(with_scores(X.conn_features(M.keep_raw(rows), "serve")), S.CONN_FEATURES, "conn")
    return alerts.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


# --- fitted models ---------------------------------------------------------------------------
# A column of the test tables decides the class, so that the expected result is known.


def _training(t: Tables) -> DataFrame:
    """Feature rows with their class; all rows of the table take part."""
    rows = X.conn_features(t.conn(), "train").withColumn("cls", L.label_to_attack("label"))
    return rows.select("uid", "cls", "ts", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", *S.CONN_FEATURES)


def _evaluated(bundle: M.Bundle, test: DataFrame, model: str) -> DataFrame:
    scored = M.predict(test, bundle)
    coded = scored.withColumns({"t": X.class_code(F.col("cls"), bundle.classes),
                                "p": X.class_code(F.col("predicted"), bundle.classes)})
    metrics = E.global_metrics(E.confusion_pairs(coded, "t", "p"), E.macro_auc(coded, "t", "probabilities"))
    return E.result_row(metrics, model, bundle.meta["train_time_s"])


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    train, test = stratified_split(_training(t), "cls")
    return materialize(train, "train"), test


# The destination port decides the class of the test tables. A tree that sees it must get
# every row right, which gives the next queries a twin.
_DECIDING = [*S.CONN_FEATURES, "id_resp_p"]
_PORTS = (80, 443, 8000, 22, 53)


def _good(row: DataFrame, test: DataFrame) -> DataFrame:
    """Whether a model got nearly all test rows right, and how many there were."""
    good = (F.col("Accuracy (%)") >= 95) & (F.col("F1-score (%)") >= 90)
    return row.select("Model", good.alias("good"), F.lit(test.count()).cast("bigint").alias("test_rows"))


_GOOD = """SELECT '{}' AS "Model", true AS good, CAST(sum(n) AS BIGINT) AS test_rows
FROM (SELECT CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS n FROM conn GROUP BY label)"""


@query("m1_train_forest", "conn", _GOOD.format("RF"))
def m1(t: Tables) -> DataFrame:
    """A forest of 20 trees: the size is a parameter, the recipes use 200 to 400."""
    train, test = _split(t)
    return _good(_evaluated(M.train_rf(train, _DECIDING, "cls", trees=20, depth=10), test, "RF"), test)


@query("m2_train_tree", "conn", """
SELECT 'DT' AS "Model", CAST(100 AS DOUBLE) AS "Accuracy (%)", CAST(100 AS DOUBLE) AS "F1-score (%)", CAST(100 AS DOUBLE) AS "AUC (%)",
  CAST(0 AS DOUBLE) AS "MAE", CAST(sum(n) AS BIGINT) AS test_rows FROM (SELECT CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS n FROM conn GROUP BY label)""")
def m2(t: Tables) -> DataFrame:
    train, test = _split(t)
    row = _evaluated(M.train_dt(train, _DECIDING, "cls", depth=10), test, "DT")
    shown = row.select("Model", *[F.round(c, 6).alias(c) for c in ("Accuracy (%)", "F1-score (%)", "AUC (%)", "MAE")])
    return shown.withColumn("test_rows", F.lit(test.count()).cast("bigint"))


@query("m3_train_perceptron", "conn", _GOOD.format("MLP"))
def m3(t: Tables) -> DataFrame:
    """Sigmoid units learn from one flag per port, each of which decides a class."""
    def flagged(df: DataFrame) -> DataFrame:
        return df.withColumns({f"port_{p}": (F.col("id_resp_p") == p).cast("double") for p in _PORTS})

    train, test = _split(t)
    names = [f"port_{p}" for p in _PORTS]
    order = X.class_order(train, "cls")
    bundle = M.fit(flagged(train), M.perceptron(len(names), len(order), iterations=60), names, "cls", order)
    return _good(_evaluated(bundle, flagged(test), "MLP"), test)


@query("m4_feature_importance", "conn", "SELECT 'id_resp_p' AS feature, 1 AS rank, 15 AS features FROM conn HAVING count(*) > 0")
def m4(t: Tables) -> DataFrame:
    """Ten boosted trees of depth 4 rank the column that decides the class first; 200 of depth 6 is the recipe."""
    rows = _training(t).drop("is_http").withColumn("kind", F.when(F.col("cls") == "BENIGN", "BENIGN").otherwise("ATTACK"))
    bundle = M.rank_by_boosting(rows.withColumn("is_http", F.lit(0.0)), _DECIDING, "kind", trees=10, depth=4)
    table = M.importance_table(t.spark, bundle)
    return table.filter("rank = 1").select("feature", F.col("rank").cast("int").alias("rank"), F.lit(len(_DECIDING)).alias("features"))


@query("m5_score_to_alerts", "alerts", """
SELECT attack_type, CASE attack_type WHEN 'BENIGN' THEN 'Low' ELSE 'Critical' END AS severity,
  CASE attack_type WHEN 'BENIGN' THEN 'benign' ELSE 'malicious' END AS model_label, count(*) AS n FROM alerts GROUP BY 1, 2, 3""")
def m5_scored(t: Tables) -> DataFrame:
    rows = _training(t)
    bundle = M.train_dt(rows, _DECIDING, "cls", S.CLASS_NAMES, depth=6)
    alerts = M.score_to_alerts(rows, bundle, "conn")
    return alerts.groupBy("attack_type", "severity", "model_label").agg(F.count(F.lit(1)).alias("n"))


@query("m6_train_and_evaluate", "conn", """
SELECT 'DT' AS "Model", CAST(100 AS DOUBLE) AS "Accuracy (%)", CAST(100 AS DOUBLE) AS "F1-score (%)", CAST(100 AS DOUBLE) AS "AUC (%)",
  CAST(0 AS DOUBLE) AS "MAE", 'dynamic' AS "SMOTE_MODE" FROM conn HAVING count(*) > 0""")
def m6(t: Tables) -> DataFrame:
    rows = X.conn_features(t.conn(), "train").select("uid", F.col("label").alias("Label"), *_DECIDING)
    cfg = M.TrainingConfig(smote_mode="dynamic", model="DT", params={"depth": 8})
    row = M.train_and_evaluate(rows, cfg, _DECIDING)[1]
    return row.select("Model", *[F.round(c, 6).alias(c) for c in ("Accuracy (%)", "F1-score (%)", "AUC (%)", "MAE")], "SMOTE_MODE")


@query("k9_load_or_train", "alerts", """
SELECT attack_type AS cls, count(*) AS n, count(*) AS agree, true AS loaded FROM alerts GROUP BY 1""")
def k9(t: Tables) -> DataFrame:
    rows = _training(t)
    path = scratch_dir(t.spark, "model")
    M.load_or_train(t.spark, path, lambda: M.train_dt(rows, _DECIDING, "cls", depth=6))
    bundle, loaded = M.load_or_train(t.spark, path, lambda: None)
    return M.score_and_compare(rows, bundle, "cls").withColumn("loaded", F.lit(loaded))


# --- whole training runs from files ---------------------------------------------------------

_RUN = """SELECT 'DT' AS "Model", true AS good, CAST(2 AS BIGINT) AS logged, {loaded} AS loaded, {features} AS features FROM conn HAVING count(*) > 0"""


def _run_twice(df: DataFrame, cfg: M.TrainingConfig, top_n: int | None = None) -> DataFrame:
    """Train and save, then load: both runs are logged, and both get nearly all test rows right."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "runs")
    ranker = {"trees": 5, "depth": 4}
    first = M.run_training(df, cfg, path, "run", top_n=top_n, ranker=ranker)
    second = M.run_training(df, cfg, path, "run", top_n=top_n, ranker=ranker)
    place = M.recorded_models(spark, f"{path}/register").first()["path"]
    features = len(M.load_model(spark, place).features)
    logged = M.logged_results(spark, f"{path}/results", "run").count()
    rows = first.unionByName(second)
    return rows.groupBy("Model").agg(
        F.min((F.col("Accuracy (%)") >= 95) & (F.col("AUC (%)") >= 95)).alias("good"), F.lit(logged).cast("bigint").alias("logged"),
        F.max("Loaded_from_ckpt").alias("loaded"), F.lit(features).alias("features"))


def _cic_files(t: Tables) -> DataFrame:
    """Flow files as readers give them: all columns are text."""
    path = scratch_dir(t.spark, "cicfiles")
    rows = t.conn().select(
        F.col("uid").alias("Flow ID"), F.col("id_orig_h").alias(" Source IP"), F.col("id_resp_p").alias(" Destination Port"),
        F.when(F.col("event_id") % 11 == 0, "Infinity").otherwise(F.col("duration").cast("string")).alias(" Flow Duration"),
        F.col("orig_pkts").alias(" Total Fwd Packets"), F.col("resp_bytes").alias(" Total Length of Bwd Packets"), F.col("label").alias(" Label"))
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return logs.read_cic(t.spark, path, encoding="UTF-8")


@query("m6_full", "conn", _RUN.format(loaded="true", features=4))
def m6_full(t: Tables) -> DataFrame:
    return _run_twice(_cic_files(t), M.TrainingConfig(smote_mode="full", model="DT", params={"depth": 8}))


@query("m6_cic_binary", "conn", _RUN.format(loaded="true", features=2))
def m6_cic_binary(t: Tables) -> DataFrame:
    return _run_twice(_cic_files(t), M.TrainingConfig(task="binary", model="DT", params={"depth": 8}), top_n=2)


@query("m6_kdd", "conn", _RUN.format(loaded="true", features=41))
def m6_kdd(t: Tables) -> DataFrame:
    n, path = F.col("event_id"), scratch_dir(t.spark, "kddfile")
    label = F.when(F.col("k") < 60, "normal.").when(F.col("k") < 80, "smurf.").otherwise("nmap.")
    cells = [F.col("k") if i == 0 else F.lit("tcp") if i == 1 else (n * (i + 3) % 17) for i in range(41)]
    t.conn().select(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(cells)], label.alias("c41")).write.csv(path)
    cfg = M.TrainingConfig(dataset="KDD", task="binary", model="DT", label="label", params={"depth": 8})
    return _run_twice(logs.read_kdd(t.spark, path), cfg)


@query("m6_malmem", "conn", _RUN.format(loaded="true", features=3))
def m6_malmem(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "malmemfile")
    kind = F.when(F.col("label") == "BENIGN", "Benign").otherwise("Malware")
    t.conn().select("id_resp_p", "orig_pkts", "resp_pkts", kind.alias("Class")).write.csv(path, header=True)
    rows, label = logs.read_malmem(t.spark, path)
    return _run_twice(rows, M.TrainingConfig(dataset="MalMem2022", model="DT", label=label, params={"depth": 8}))


@query("k9_result_log", "scored", """
SELECT 'b' AS run, 'second' AS name, CAST(2 AS BIGINT) AS entries, round(CAST(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS DOUBLE) * 100, 6) AS accuracy
FROM scored""")
def k9_log(t: Tables) -> DataFrame:
    path, register = scratch_dir(t.spark, "resultlog"), scratch_dir(t.spark, "register")
    row = E.result_row(E.global_metrics(_pairs(t)), "RF")
    for run in ("a", "b", "b"):
        M.log_result(row, path, run)
    for place in ("first", "second"):
        M.record_model(t.spark, register, "forest", place)
    name = M.recorded_models(t.spark, register).first()["path"]
    entries = M.logged_results(t.spark, path, "b")
    accuracy = F.get_json_object("entry", "$['Accuracy (%)']").cast("double")
    return entries.agg(F.lit("b").alias("run"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("entries"),
                       F.round(F.max(accuracy), 6).alias("accuracy"))
