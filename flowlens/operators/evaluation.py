"""Evaluation of scored frames: confusion, per-class metrics, errors, AUC, ROC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.common import quoted
from flowlens.operators.skew import prefix_sums
from flowlens.session import materialize


def confusion_pairs(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Row counts per true and predicted class; the input of the metrics below."""
    return df.groupBy(quoted(truth).alias("truth"), quoted(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion(pairs: DataFrame, labels: Sequence) -> DataFrame:
    """Confusion matrix: one row per true class in order, one column per predicted class."""
    cells = [
        F.sum(F.when(F.col("prediction") == x, F.col("n")).otherwise(F.lit(0))).alias(f"pred_{x}")
        for x in labels
    ]
    known = pairs.filter(F.col("truth").isin(list(labels)))
    return known.groupBy("truth").agg(*cells).orderBy("truth")


def accuracy(pairs: DataFrame) -> DataFrame:
    hits = F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)))
    return pairs.agg(F.coalesce(F.try_divide(hits, F.sum("n")), F.lit(0.0)).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _class_sums(pairs: DataFrame, errors: bool = False) -> DataFrame:
    """Support, calls and hits of every class, and with ``errors`` the gaps of its codes."""
    n = F.col("n")
    same = F.col("truth") == F.col("prediction")
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    gap = (F.col("truth") - F.col("prediction")).cast("double") if errors else none
    views = F.explode(F.array(
        F.struct(F.col("truth").alias("class"), n.alias("support"), zero.alias("called"),
                 F.when(same, n).otherwise(zero).alias("hits"), (F.abs(gap) * n).alias("gap"), (gap * gap * n).alias("gap2")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), n.alias("called"),
                 zero.alias("hits"), none.alias("gap"), none.alias("gap2")),
    ))
    return pairs.select(views.alias("v")).groupBy("v.class").agg(
        *[F.sum(f"v.{c}").alias(c) for c in ("support", "called", "hits", "gap", "gap2")])


def _class_metrics(sums: DataFrame) -> DataFrame:
    p = _ratio(F.col("hits"), F.col("called"))
    r = _ratio(F.col("hits"), F.col("support"))
    return sums.withColumns({"precision": p, "recall": r, "f1": _ratio(F.lit(2.0) * p * r, p + r)})


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that is true or predicted."""
    return _class_metrics(_class_sums(pairs)).select("class", "precision", "recall", "f1", "support")


_NAMES = ("precision", "recall", "f1")


def _macro(n: str) -> Column:
    return F.avg(n)


def _weighted(n: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")), F.lit(0.0))


def _line(name: str, of) -> Column:
    return F.struct(F.lit(name).alias("class"), *[of(n).alias(n) for n in _NAMES], F.sum("support").alias("support"))


def global_rows(classes: DataFrame) -> DataFrame:
    """Macro and support-weighted averages as two rows of the per-class table, in one pass."""
    lines = classes.agg(F.array(_line("GLOBAL_macro", _macro), _line("GLOBAL_weighted", _weighted)).alias("g"))
    return lines.select(F.inline("g"))


def class_report(pairs: DataFrame) -> DataFrame:
    """Per-class rows of the true classes followed by the two global rows.

    The pairs are reduced once; the table of classes, which is small, is gathered in one row.
    """
    classes = per_class(pairs).withColumn("class", F.col("class").cast("string"))
    row = F.struct("class", *_NAMES, "support")
    own = F.collect_list(F.when(F.col("support") > 0, row))
    lines = classes.agg(F.concat(own, F.array(_line("GLOBAL_macro", _macro), _line("GLOBAL_weighted", _weighted))).alias("g"))
    return lines.select(F.inline("g"))


def code_errors(pairs: DataFrame) -> DataFrame:
    """MAE, MSE and RMSE of integer class codes."""
    gap = (F.col("truth") - F.col("prediction")).cast("double")
    n = F.sum("n")
    mae = F.try_divide(F.sum(F.abs(gap) * F.col("n")), n)
    mse = F.try_divide(F.sum(gap * gap * F.col("n")), n)
    return pairs.agg(mae.alias("mae"), mse.alias("mse")).withColumn("rmse", F.sqrt("mse"))


def _one_vs_rest(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    """Positives and negatives per class position and score."""
    rows = df.select(
        quoted(truth).alias("_truth"), F.posexplode(quoted(probabilities)).alias("class", "score")
    )
    hit = F.coalesce(F.col("_truth") == F.col("class"), F.lit(False))
    return rows.groupBy("class", "score").agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )


def class_auc(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    """One-vs-rest AUC per class position; NULL for a class without both kinds of rows, or
    with a score that is NULL or not a number.

    Rows are first reduced to distinct scores; ties count one half.
    """
    scores = materialize(_one_vs_rest(df, truth, probabilities), "scores")
    odd = F.col("score").isNull() | F.isnan("score")
    below = prefix_sums(scores.filter(~odd), ["class"], "score", {"neg": "neg_below"})
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    aucs = below.groupBy("class").agg(F.try_divide(won, pairs).alias("auc"), F.lit(False).alias("odd"))
    bad = scores.filter(odd).select("class", F.lit(None).cast("double").alias("auc"), F.lit(True).alias("odd"))
    both = aucs.unionByName(bad).groupBy("class").agg(F.max("auc").alias("auc"), F.max("odd").alias("odd"))
    return both.select("class", F.when(~F.col("odd"), F.col("auc")).alias("auc"))


def macro_auc(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    """Mean one-vs-rest AUC, NULL when it is undefined for a class."""
    aucs = class_auc(df, truth, probabilities)
    undefined = F.count_if(F.col("auc").isNull()) > 0
    return aucs.agg(F.when(~undefined, F.avg("auc")).alias("auc"))


def binary_auc(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    """AUC of the second class position of a two-class model."""
    return class_auc(df, truth, probabilities).filter(F.col("class") == 1).select("auc")


def roc_points(df: DataFrame, truth: str, probabilities: str | None, binary: bool = False) -> DataFrame | None:
    """ROC points by falling threshold: binary, else micro-averaged over the classes.

    Scores that are NULL or not a number give no point. ``None`` for a model without probabilities. Starts at (0, 0) with an infinite threshold.
    """
    if probabilities is None:
        return None
    scores = _one_vs_rest(df, truth, probabilities)
    if binary:
        scores = scores.filter(F.col("class") == 1)
    scores = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    scores = scores.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    scores = materialize(scores, "scores")
    total = scores.agg(F.sum("pos"), F.sum("neg")).first()
    above = prefix_sums(scores, [], "score", {"pos": "pos_above", "neg": "neg_above"}, descending=True)
    points = above.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_above") + F.col("neg"), F.lit(float(total[1] or 0))).alias("fpr"),
        F.try_divide(F.col("pos_above") + F.col("pos"), F.lit(float(total[0] or 0))).alias("tpr"),
    )
    start = df.sparkSession.range(1, numPartitions=1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def global_metrics(pairs: DataFrame, auc: DataFrame | None = None) -> DataFrame:
    """One row: accuracy, macro and weighted metrics, code errors and AUC, 0 to 1.

    The pairs are read once: all values are sums over the classes.
    """
    classes = _class_metrics(_class_sums(pairs, errors=True))
    total = F.sum("support")
    row = classes.agg(
        _ratio(F.sum("hits"), total).alias("accuracy"),
        *[_macro(n).alias(f"{n}_macro") for n in _NAMES],
        *[_weighted(n).alias(f"{n}_weighted") for n in _NAMES],
        F.try_divide(F.sum("gap"), total).alias("mae"), F.try_divide(F.sum("gap2"), total).alias("mse"),
    ).withColumn("rmse", F.sqrt("mse"))
    if auc is None:
        return row.withColumn("auc", F.lit(None).cast("double"))
    # Both sides are one row; their columns are put side by side by an aggregate.
    both = row.unionByName(auc.select("auc"), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in [*row.columns, "auc"]])


def result_row(metrics: DataFrame, model: str, train_time_s: float | None = None,
               predict_time_s: float | None = None, loaded: bool = False,
               smote_mode: str = "none") -> DataFrame:
    """Result line of a model: shares in percent, errors as they are, timing and run tag."""
    shares = {
        "Accuracy (%)": "accuracy", "Precision (%)": "precision_macro",
        "Recall (%)": "recall_macro", "F1-score (%)": "f1_macro", "AUC (%)": "auc",
        "Precision_weighted (%)": "precision_weighted",
        "Recall_weighted (%)": "recall_weighted", "F1_weighted (%)": "f1_weighted",
    }
    return metrics.select(
        F.lit(model).alias("Model"),
        *[(F.col(c) * F.lit(100.0)).alias(n) for n, c in shares.items()],
        F.col("mae").alias("MAE"), F.col("mse").alias("MSE"), F.col("rmse").alias("RMSE"),
        F.lit(train_time_s).cast("double").alias("Train_time_s"),
        F.lit(predict_time_s).cast("double").alias("Predict_time_s"),
        F.lit(loaded).alias("Loaded_from_ckpt"),
        F.lit(smote_mode).alias("SMOTE_MODE"),
    )


def compare(families: dict[str, Sequence[DataFrame]]) -> DataFrame:
    """Result lines of all models by family, best F1 first within a family."""
    rows = None
    for family, results in families.items():
        for result in results:
            tagged = result.withColumn("Family", F.lit(family))
            rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no results to compare")
    return rows.orderBy("Family", quoted("F1-score (%)").desc(), "Model")


def agreement(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Rows, and rows whose prediction agrees with the label, per label."""
    return df.groupBy(quoted(truth)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(quoted(truth) == quoted(prediction)).alias("agree"),
    )
