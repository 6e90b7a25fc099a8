"""Classifiers, persistence, scoring and the end-to-end training."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import schemas as S
from flowlens.functions import alerts as A
from flowlens.functions import labels as L
from flowlens.functions.common import is_numeric, quoted, strip
from flowlens.functions.numbers import clean_features, coerce_numeric, finite_or_zero, parse_number, safe_int
from flowlens.functions.times import parse_ts
from flowlens.operators import evaluation as E
from flowlens.operators import features as X
from flowlens.operators.sampling import mark_split, rank_features
from flowlens.operators.skew import number_copies
from flowlens.operators.smote import smote
from flowlens.session import materialize, path_exists


@dataclass
class Bundle:
    """A fitted model with what scoring needs to know about it."""

    model: PipelineModel
    features: list[str]
    classes: list[str]
    scale: dict[str, float] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


def random_forest(trees: int = 400, depth: int = 30, min_leaf: int = 2, seed: int = 42,
                  weight: str | None = None) -> RandomForestClassifier:
    """Forest with square-root feature choice. Trees are at most 30 levels deep."""
    forest = RandomForestClassifier(
        labelCol="_code", featuresCol="_vector", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed,
    )
    return forest.setWeightCol(weight) if weight else forest


def decision_tree(depth: int = 30, seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol="_code", featuresCol="_vector", maxDepth=depth, seed=seed)


def perceptron(inputs: int, classes: int, iterations: int = 30, seed: int = 42) -> MultilayerPerceptronClassifier:
    """Two hidden layers of 128 and 64 units."""
    return MultilayerPerceptronClassifier(
        labelCol="_code", featuresCol="_vector", layers=[inputs, 128, 64, classes],
        maxIter=iterations, seed=seed,
    )


def fit(df: DataFrame, estimator, features: Sequence[str], label: str,
        classes: Sequence[str] | None = None, scale: dict[str, float] | None = None,
        meta: dict | None = None) -> Bundle:
    """Fit a classifier on named feature columns and a class-name column."""
    order = list(classes) if classes else X.class_order(df, label)
    data, inputs = _inputs(df, features, scale or {})
    data = data.withColumn("_code", X.class_code(quoted(label), order).cast("double"))
    data = data.filter(F.col("_code").isNotNull())
    data = _dealt(data.select(*inputs, "_code", *_weights(estimator)))
    assembler = VectorAssembler(inputCols=inputs, outputCol="_vector")
    started = time.monotonic()
    fitted = Pipeline(stages=[assembler, estimator]).fit(data)
    # A copy leaves the training summary behind, which holds the session and with it what
    # tasks cannot carry.
    model = PipelineModel([*fitted.stages[:-1], fitted.stages[-1].copy()])
    info = {"train_time_s": time.monotonic() - started, **(meta or {})}
    return Bundle(model, list(features), order, dict(scale or {}), info)


def _weights(estimator) -> list[str]:
    """The weight column of an estimator, if it has one."""
    named = estimator.hasParam("weightCol") and estimator.isDefined("weightCol")
    return [estimator.getOrDefault("weightCol")] if named else []


def _dealt(data: DataFrame, per_task: int = 25_000) -> DataFrame:
    """Training rows in equal parts. A fit holds a part in memory and passes over it many times;
    files of few or repeated values are small, so their parts would be as few as they are long."""
    rows = materialize(data, "training")
    return rows.repartition(max(1, -(-rows.count() // per_task)))


def _inputs(df: DataFrame, features: Sequence[str], scale: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """Model input columns: cleaned features, divided by their scale when there is one."""
    columns = {
        f"_f{i}": finite_or_zero(quoted(f) / F.lit(scale.get(f, 1.0)) if scale else quoted(f))
        for i, f in enumerate(features)
    }
    return df.withColumns(columns), list(columns)


def train_rf(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[str] | None = None,
             **params) -> Bundle:
    return fit(df, random_forest(**params), features, label, classes)


def train_dt(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[str] | None = None,
             **params) -> Bundle:
    return fit(df, decision_tree(**params), features, label, classes)


def predict(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Add ``probabilities`` (array in class order) and ``predicted`` (class name)."""
    data = X.pick_features(df, bundle.features)
    inputs, _ = _inputs(data, bundle.features, bundle.scale)
    scored = bundle.model.transform(inputs).select(
        *[quoted(c) for c in data.columns], vector_to_array("probability").alias("probabilities")
    )
    names = F.array(*[F.lit(c) for c in bundle.classes])
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return scored.withColumn("predicted", F.get(names, best.cast("int")))


def save_model(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Write the model and a JSON sidecar with features, classes, scale and run data."""
    bundle.model.write().overwrite().save(f"{path}/model")
    side = {"features": bundle.features, "classes": bundle.classes, "scale": bundle.scale,
            "meta": bundle.meta}
    row = spark.createDataFrame([(json.dumps(side),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def load_model(spark: SparkSession, path: str) -> Bundle:
    model = PipelineModel.load(f"{path}/model")
    side = json.loads(spark.read.text(f"{path}/sidecar").first().value)
    return Bundle(model, side["features"], side["classes"], side["scale"], side["meta"])


def load_or_train(spark: SparkSession, path: str, train) -> tuple[Bundle, bool]:
    """Saved model if there is one (flag true), else ``train()`` saved to ``path``."""
    if path_exists(spark, f"{path}/sidecar/_SUCCESS"):
        return load_model(spark, path), True
    bundle = train()
    save_model(spark, bundle, path)
    return bundle, False


def record_model(spark: SparkSession, path: str, name: str, model_path: str) -> None:
    """Register where a model is; a later entry of the same name takes its place."""
    row = spark.createDataFrame([(name, model_path)], "name string, path string")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def recorded_models(spark: SparkSession, path: str) -> DataFrame:
    """Name and path of every registered model."""
    return spark.read.parquet(path).groupBy("name").agg(F.max_by("path", "at").alias("path"))


def log_result(result: DataFrame, path: str, run: str) -> None:
    """Append result lines to the log of a run; column names are kept as JSON."""
    row = F.to_json(F.struct(*[quoted(c) for c in result.columns]))
    lines = result.select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), row.alias("entry"))
    lines.coalesce(1).write.mode("append").partitionBy("run").parquet(path)


def logged_results(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Entries of a run in the order in which they were logged."""
    return spark.read.parquet(path).filter(F.col("run") == run).select("at", "entry").orderBy("at")


def feature_importance(bundle: Bundle) -> list[tuple[str, float]]:
    """Feature importances of the fitted tree model."""
    values = bundle.model.stages[-1].featureImportances.toArray().tolist()
    return list(zip(bundle.features, values))


def importance_table(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """Ranking table ``feature, importance, rank``: one row per feature."""
    rows = spark.createDataFrame(feature_importance(bundle), "feature string, importance double")
    return rank_features(rows)


def rank_by_boosting(df: DataFrame, features: Sequence[str], label: str, seed: int = 42,
                     trees: int = 200, depth: int = 6) -> Bundle:
    """Tree model for the ranking: boosted trees for two classes, a forest for more."""
    order = X.class_order(df, label)
    if len(order) == 2:
        model = GBTClassifier(labelCol="_code", featuresCol="_vector", maxIter=trees,
                              maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    else:
        model = random_forest(trees=trees, depth=depth, min_leaf=1, seed=seed)
    return fit(df, model, features, label, order)


# --- alerts from scored rows -----------------------------------------------------


def score_to_alerts(df: DataFrame, bundle: Bundle, kind: str = "conn", tags: dict | None = None) -> DataFrame:
    """Score conn rows (``conn``) or feature rows (``features``) into alert rows.

    Rows without a readable timestamp are left out; ``without_timestamp`` returns them.
    """
    return to_alerts(predict(keep_raw(df), bundle), bundle.features, kind, bundle.classes, tags)


RAW, ROW_ID = "_raw_row", "_row_id"


def keep_raw(df: DataFrame) -> DataFrame:
    """Add the row as it is (JSON of its texts) and its identity, before features replace columns.

    The identity is a hash of the whole row and its number among equal rows. A stream has
    no such number: there, equal rows have one identity.
    """
    if RAW in df.columns:
        return df
    numbered = df.withColumn("_copy", F.lit(0)) if df.isStreaming else number_copies(df)
    row = F.struct(*[quoted(f.name).cast("string").alias(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)])
    raw = numbered.withColumn(RAW, F.to_json(row))
    return raw.withColumn(ROW_ID, L.hashed_uid(RAW, "_copy")).drop("_copy")


def without_timestamp(df: DataFrame, kind: str = "conn") -> DataFrame:
    return df.filter(_event_time(df, kind).isNull())


def _event_time(df: DataFrame, kind: str) -> Column:
    name = X.column_named(df, *(("ts",) if kind == "conn" else ("Timestamp", "timestamp")))
    if name is None:
        return F.lit(None).cast("timestamp")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return quoted(name).cast("timestamp")
    if isinstance(dtype, T.NumericType):
        return F.timestamp_seconds(quoted(name))
    return parse_ts(name, iso_fallback=False)


def to_alerts(scored: DataFrame, features: Sequence[str], kind: str = "conn",
              classes: Sequence[str] | None = None, tags: dict | None = None) -> DataFrame:
    """Alert rows from rows with a ``probabilities`` array in class order.

    ``keep_raw`` before the features keeps the row as it was read in the metadata; without
    it, the columns as they are here are kept.
    """
    conn = kind == "conn"
    names = (
        ("id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "uid") if conn
        else ("Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol", "Flow ID")
    )

    def text(name: str, default: str | None = None) -> Column:
        found = X.column_named(scored, name)
        value = quoted(found).cast("string") if found else F.lit(None).cast("string")
        return value if default is None else F.coalesce(value, F.lit(default))

    def port(name: str) -> Column:
        return safe_int(text(name, ""), 0, "plain" if conn else "clean").cast("int")

    if RAW not in scored.columns:
        held = ["probabilities", *[c for c in ("predicted",) if c in scored.columns]]
        scored = keep_raw(scored.withColumn("_held", F.struct(*held)).drop(*held))
        scored = scored.select("*", *[F.col(f"_held.{c}").alias(c) for c in held]).drop("_held")
    values = F.create_map(*[x for f in features for x in (F.lit(f), quoted(f).cast("double"))])
    # Plain columns in steps: each is computed once, however often it is used below.
    base = scored.withColumns({
        "_index": A.top_index("probabilities"),
        "_labels": A.class_labels("probabilities", list(classes or S.CLASS_NAMES)),
        "_time": _event_time(scored, kind),
    }).withColumns({
        "_name": F.get("_labels", F.col("_index")),
        "_probabilities": F.map_from_arrays("_labels", "probabilities"),
    }).withColumns({
        "_attack": A.class_to_attack("_name"),
        "_score": A.malicious_score(F.coalesce(
            F.try_element_at("_probabilities", F.lit("BENIGN")), F.lit(0.0))),
    })
    key = text("uid", "NA") if conn else F.coalesce(
        F.nullif(text("Flow ID"), F.lit("")), F.col(ROW_ID))
    meta = [
        values.alias("features"),
        F.struct(F.col("_probabilities").alias("probabilities"),
                 F.col("_index").alias("class_index")).alias("model"),
        *([] if conn else [A.original_label(scored).alias("original_label")]),
        *[F.lit(v).alias(k) for k, v in (tags or {}).items()],
    ]
    src_ip, src_port, dst_ip, dst_port, proto, _ = names
    rule_id = F.concat(F.lit("ZEEK-" if conn else "FEATURE-"), key)
    alerts = base.filter(F.col("_time").isNotNull()).select(
        L.hashed_uid(rule_id, F.col("_time"), ROW_ID).alias("id"),
        F.col("_time").alias("timestamp"),
        F.current_timestamp().alias("ingested_at"),
        A.severity("_score", "_attack").alias("severity"),
        F.col("_attack").alias("attack_type"),
        text(src_ip, "0.0.0.0").alias("src_ip"),
        port(src_port).alias("src_port"),
        text(dst_ip, "0.0.0.0").alias("dst_ip"),
        port(dst_port).alias("dst_port"),
        L.alert_protocol(text(proto, ""), numbers=not conn).alias("protocol"),
        rule_id.alias("rule_id"),
        F.concat(F.lit("Zeek " if conn else "FeatureDataset "), F.col("_name")).alias("rule_name"),
        F.col("_score").alias("model_score"),
        A.label_of_class("_name").alias("model_label"),
        F.concat(F.lit(f'{{"{"zeek_conn" if conn else "feature_row"}":'), F.col(RAW), F.lit(","),
                 F.substring(F.to_json(F.struct(*meta)), 2, 1 << 30)).alias("meta"),
    )
    return alerts


def score_and_compare(df: DataFrame, bundle: Bundle, label: str) -> DataFrame:
    """Classify a whole frame and count agreement with its labels."""
    return E.agreement(predict(df, bundle), label, "predicted")


# --- end-to-end training ---------------------------------------------------------


@dataclass
class TrainingConfig:
    """One training run: dataset kind, task, oversampling and model."""

    dataset: str = "CICIDS2017"
    task: str = "multiclass"
    smote_mode: str = "none"
    model: str = "RF"
    label: str = "Label"
    test: float = 0.2
    seed: int = 42
    leaky: bool = False  # oversample before the split, so that test rows may be synthetic
    params: dict = field(default_factory=dict)


def target_column(df: DataFrame, cfg: TrainingConfig) -> tuple[DataFrame, list[str]]:
    """Add ``target`` (class name) and give the class order of the task."""
    label = quoted(cfg.label)
    if cfg.dataset == "CICIDS2017":
        df = df.withColumn("target", L.cic_attack_group(label)).filter("target is not null")
        if cfg.task == "binary":
            kind = F.when(F.col("target") == "BENIGN", F.lit("BENIGN")).otherwise(F.lit("ATTACK"))
            return df.withColumn("target", kind), ["BENIGN", "ATTACK"]
        return df, X.class_order(df, "target")
    if cfg.dataset == "KDD":
        if cfg.task == "binary":
            attack = L.kdd_label(label) != "normal"
            kind = F.when(attack, F.lit("attack")).otherwise(F.lit("normal"))
            return df.withColumn("target", kind), ["normal", "attack"]
        df = df.withColumn("target", L.kdd_superclass(label)).filter("target is not null")
        return df, list(S.KDD_CLASSES)
    if cfg.dataset == "MalMem2022":
        attack = X.binary_target(label, ["benign"]) == 1
        kind = F.when(attack, F.lit("Malware")).otherwise(F.lit("Benign"))
        return df.withColumn("target", kind), ["Benign", "Malware"]
    raise ValueError(f"unknown dataset: {cfg.dataset}")


def numeric_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns that hold numbers: typed ones, and texts whose every value reads as one."""
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    typed = {n for n in names if is_numeric(df, n)}
    if texts:
        def value(n: str) -> Column:
            return F.nullif(strip(quoted(n)), F.lit(""))

        row = df.agg(*[
            F.struct(F.count(value(n)).alias("n"), F.count_if(value(n).isNotNull() & parse_number(quoted(n)).isNull()).alias("bad"))
            .alias(f"c{i}") for i, n in enumerate(texts)
        ]).first()
        typed |= {n for i, n in enumerate(texts) if row[i]["n"] and not row[i]["bad"]}
    return [n for n in names if n in typed]


def prepare_features(df: DataFrame, cfg: TrainingConfig, features: Sequence[str] | None,
                     row_key: Sequence[str] | None) -> tuple[DataFrame, list[str], list[str], list[str]]:
    """Target, numeric features and a row key, as readers of text files leave them to do.

    Without ``features``, all columns that hold numbers take part; of KDD files all but the
    label, with unreadable values as 0. Without ``row_key``, rows are told apart by their
    content and a number among equal rows.
    """
    data, classes = target_column(df, cfg)
    if features is None:
        skip = {"target", cfg.label, "source_file", *(row_key or ())}
        names = [c for c in data.columns if c not in skip]
        features = names if cfg.dataset == "KDD" else numeric_columns(data, names)
    features = list(features)
    if not features:
        raise ValueError("no numeric feature columns")
    data = data.select("target", *[quoted(k) for k in row_key or ()], *[quoted(f) for f in features])
    data = clean_features(coerce_numeric(data, features), features)
    if row_key is None:
        numbered = number_copies(data)
        data = numbered.withColumn("_row", L.row_uid(data.columns, F.col("_copy"))).drop("_copy")
        row_key = ["_row"]
    return materialize(data, "prepared"), classes, features, list(row_key)


def train_and_evaluate(df: DataFrame, cfg: TrainingConfig, features: Sequence[str] | None = None,
                       row_key: Sequence[str] | None = ("uid",), top_n: int | None = None,
                       ranker: dict | None = None) -> tuple[Bundle, DataFrame]:
    """Target, numbers, cleaning, split, ranking, scaling, oversampling, fit, and the result line.

    With ``top_n`` the features are ranked by boosted trees on the training rows (``ranker``:
    their size) and the leading ones are used. The split comes before oversampling unless
    ``cfg.leaky`` is set.
    """
    data, classes, features, row_key = prepare_features(df, cfg, features, row_key)
    if cfg.leaky:
        scale = X.fit_scale(data, features)
        grown, _ = smote(X.apply_scale(data, scale), "target", features, cfg.smote_mode, cfg.seed, row_key)
        grown = materialize(grown.withColumn("_row", L.hashed_uid("target", *features)), "grown")
        marked = mark_split(grown, "target", cfg.test, cfg.seed, ["_row"])
        train, test = marked.filter(~F.col("is_test")), marked.filter("is_test")
    else:
        marked = materialize(mark_split(data, "target", cfg.test, cfg.seed, row_key), "split")
        train, test = marked.filter(~F.col("is_test")), marked.filter("is_test")
        scale = X.fit_scale(train, features)
        train, test = X.apply_scale(train, scale), X.apply_scale(test, scale)
    if top_n is not None and top_n < len(features):
        ranking = importance_table(df.sparkSession, rank_by_boosting(train, features, "target", cfg.seed, **(ranker or {})))
        features = X.select_ranked(ranking, top_n)
        scale = {f: scale[f] for f in features}
    if not cfg.leaky:
        train, _ = smote(train, "target", features, cfg.smote_mode, cfg.seed, row_key)
    makers = {
        "RF": lambda: random_forest(**{"trees": 200, "min_leaf": 1, "seed": cfg.seed, **cfg.params}),
        "DT": lambda: decision_tree(**{"seed": cfg.seed, **cfg.params}),
        "MLP": lambda: perceptron(len(features), len(classes), **{"seed": cfg.seed, **cfg.params}),
    }
    bundle = fit(train, makers[cfg.model](), features, "target", classes, meta=asdict(cfg))
    # Scoring takes unscaled rows; the scale belongs to the model.
    whole = Bundle(bundle.model, features, classes, scale, bundle.meta)
    return whole, _test_result(bundle, test, cfg, False)


def _test_result(bundle: Bundle, test: DataFrame, cfg: TrainingConfig, loaded: bool) -> DataFrame:
    """Result line of a model on test rows that have a ``target``."""
    started = time.monotonic()
    scored = materialize(predict(test, bundle).select("target", "predicted", "probabilities"), "scored")
    elapsed = time.monotonic() - started
    coded = scored.withColumns({
        "t": X.class_code(F.col("target"), bundle.classes), "p": X.class_code(F.col("predicted"), bundle.classes),
    })
    auc = (E.binary_auc if len(bundle.classes) == 2 else E.macro_auc)(coded, "t", "probabilities")
    metrics = E.global_metrics(E.confusion_pairs(coded, "t", "p"), auc)
    return E.result_row(metrics, cfg.model, bundle.meta["train_time_s"], elapsed, loaded, cfg.smote_mode)


def run_training(df: DataFrame, cfg: TrainingConfig, path: str, run: str, features: Sequence[str] | None = None,
                 row_key: Sequence[str] | None = None, top_n: int | None = None, ranker: dict | None = None) -> DataFrame:
    """One whole run: load the saved model of the run or train and save it; log and give its result line.

    ``path`` holds the model, the model register and the result log. A model that is already
    there is not trained again; it is evaluated on the same test rows. It must have been
    trained with the same configuration: another one under the same run name is an error.
    """
    spark, place = df.sparkSession, f"{path}/models/{run}"
    asked = json.loads(json.dumps({**asdict(cfg), "features": list(features) if features else None, "top_n": top_n, "ranker": ranker}))
    if path_exists(spark, f"{place}/sidecar/_SUCCESS"):
        bundle = load_model(spark, place)
        stored = bundle.meta.get("run")
        if stored != asked:
            differ = sorted(k for k in asked if (stored or {}).get(k) != asked[k])
            raise ValueError(f"run {run} was trained with other settings: {differ}")
        data, _, _, key = prepare_features(df, cfg, bundle.features, row_key)
        test = mark_split(data, "target", cfg.test, cfg.seed, key).filter("is_test")
        result = _test_result(bundle, test, cfg, True)
    else:
        bundle, result = train_and_evaluate(df, cfg, features, row_key, top_n, ranker)
        bundle.meta["run"] = asked
        save_model(spark, bundle, place)
        record_model(spark, f"{path}/register", run, place)
    result = materialize(result, "result")
    log_result(result, f"{path}/results", run)
    return result
