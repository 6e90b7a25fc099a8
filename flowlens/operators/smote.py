"""Oversampling of small classes by interpolation between neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.common import lookup, quoted
from flowlens.operators.neighbors import nearest_in_class
from flowlens.operators.sampling import neighbour_count, smote_plan
from flowlens.operators.skew import exact_rank, sample_key, spread_join
from flowlens.session import materialize


def synthesize(df: DataFrame, column: str, features: Sequence[str], plan: DataFrame, k: int,
               seed: int = 42, row_key: Sequence[str] = ("uid",), max_cell: int = 4096) -> DataFrame:
    """Synthetic rows ``column, features...`` that lift every class to its ``target``.

    ``plan`` has one row per class: ``cls, n, target``. A synthetic row lies at a
    random point between a random row of its class and one of that row's ``k`` nearest
    neighbours. All draws come from hashes of the draw number: reruns give the same rows.
    Rows with a component that is missing or not finite lie nowhere: they count in ``n``, but
    nothing is drawn from them. NULL is a class like any other.
    """
    spark = df.sparkSession
    grown = [(r["cls"], r["target"] - r["n"]) for r in plan.filter("target > n").collect()]
    texts = [None if c is None else str(c) for c, _ in grown]

    def number(c: str) -> Column:
        """Number of a class among those that grow, NULL for the others."""
        found = F.lit(None).cast("int")
        for i, name in enumerate(texts):
            found = F.when(F.col(c).eqNullSafe(F.lit(name)), F.lit(i)).otherwise(found)
        return found

    # The two zeros are one point.
    values = [F.when(quoted(f).cast("double") == 0, F.lit(0.0)).otherwise(quoted(f).cast("double")) for f in features]
    base = df.select(quoted(column).cast("string").alias("cls"), F.array(*values).alias("vec"), *[quoted(r) for r in row_key])
    base = base.withColumn("class", number("cls")).filter(F.col("class").isNotNull())
    base = base.filter(F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    base = materialize(base, "classes")
    sizes = {r["class"]: r["n"] for r in base.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    single = [c for i, (c, _) in enumerate(grown) if sizes.get(i, 0) < 2]
    if single:
        raise ValueError(f"classes with fewer than two complete rows cannot be oversampled: {single}")
    ranked = exact_rank(base, ["class"], sample_key(seed, *row_key), row_key, name="row")

    # Draw numbers 0..total-1, consecutive ranges belong to one class.
    cls, total = F.lit(None).cast("int"), 0
    for i, (_, wanted) in enumerate(grown):
        cls = F.when(F.col("id") >= total, F.lit(i)).otherwise(cls)
        total += wanted
    draws = spark.range(total).withColumn("class", cls)
    size = lookup(sizes or {0: 1}, "class")

    def draw(stream: int):
        return F.xxhash64(F.col("id"), F.lit(seed), F.lit(stream))

    draws = draws.select(
        "id", "class",
        (F.pmod(draw(0), size) + 1).alias("row"),
        F.pmod(draw(1), F.lit(1 << 30)).alias("pick"),
        (F.pmod(draw(2), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("u"),
    )
    seeds = draws.join(ranked.select("class", "cls", "row", "vec"), ["class", "row"])
    seeds = materialize(seeds, "seeds")
    near = nearest_in_class(base.select("cls", "vec"), k, seeds.select("cls", "vec"), max_cell)
    near = materialize(near.withColumn("class", number("cls")).drop("cls"), "neighbours")
    pairs = spread_join(seeds, near, ["class", "vec"], ["id"])
    other = F.get("neighbours", F.pmod(F.col("pick"), F.size("neighbours")).cast("int"))
    point = F.zip_with("vec", other, lambda a, b: a + (b - a) * F.col("u"))
    out = pairs.select("cls", point.alias("vec"))
    kind = df.schema[column].dataType
    return out.select(
        F.col("cls").cast(kind).alias(column),
        *[F.get("vec", F.lit(i)).alias(f) for i, f in enumerate(features)],
    )


def smote(df: DataFrame, column: str, features: Sequence[str], mode: str, seed: int = 42,
          row_key: Sequence[str] = ("uid",), max_cell: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Real and synthetic rows (``synthetic`` tells which) and the plan that was used."""
    counts = df.groupBy(quoted(column).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    plan = materialize(smote_plan(counts, mode), "plan")
    real = df.select(column, *[quoted(f).cast("double").alias(f) for f in features])
    real = real.withColumn("synthetic", F.lit(False))
    if plan.filter("target > n").isEmpty():
        return real, plan
    k = neighbour_count(plan, mode)
    new = synthesize(df, column, features, plan, k, seed, row_key, max_cell)
    return real.unionByName(new.withColumn("synthetic", F.lit(True))), plan
