"""Mixing sources to target weights: random order, prefix sums, an exact cut each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import BLANKS, WORD, add_columns, fresh
from flowlens.session import join_small, materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3
COLUMNS = ("size", "source_size", "target", "taken")
_BEFORE = (Window.unboundedPreceding, -1)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Number the rows of a summary from 0 by ``order``, nulls last, without one sorting task."""
    part = fresh(df, "_part")
    ranged = df.repartitionByRange(F.col(order).asc_nulls_last()).sortWithinPartitions(F.col(order).asc_nulls_last())
    ranged = materialize(ranged.withColumn(part, F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(*_BEFORE)), F.lit(0))
    # One row a partition, of which there are as many as shuffle partitions.
    offsets = F.broadcast(counts.select(part, before.alias("_before")))
    within = F.row_number().over(Window.partitionBy(part).orderBy(F.col(order).asc_nulls_last()))
    return ranged.join(offsets, part).withColumn(name, F.col("_before") + within - 1).drop(part, "_before")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): shares by weight, none above ``repeats`` times its size.

    ``sources`` has one row (source, source_size) each. Sources take the weights in turn, by
    code point, null last. What a cap frees is shared again by weight among the others
    until no share is above its cap: only two sums reach the driver in each round.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    table = numbered(sources, "source", "_i").withColumn("_w", turn).withColumn("_cap", F.col("source_size") * repeats)
    table = materialize(table, "sources")
    unit, seen = None, -1
    while True:
        # Shares only grow, so a source once above its cap stays there.
        above = F.lit(False) if unit is None else F.lit(unit[0] / unit[1]) * F.col("_w") > F.col("_cap")
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("_cap")).otherwise(0)).alias("held"),
                        F.sum(F.when(above, 0).otherwise(F.col("_w"))).alias("weight"),
                        F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == seen or not row["weight"]:
            break
        unit, seen = (float(row["all"] - row["held"]), float(row["weight"])), row["n"]
    level = F.lit(unit[0] / unit[1] if unit else 0.0)
    share = F.when(level * F.col("_w") > F.col("_cap"), F.col("_cap").cast("double")).otherwise(level * F.col("_w"))
    return table.select("source", "source_size", share.alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7,
        weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, per_slice: int = 50_000) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``taken`` (words) to every row.

    The rows of a source are ordered by an md5 of seed and key. The budget of a source is
    its target, rounded. All rows are taken as often as the budget holds the whole source;
    of the rest, the first rows are taken once more, and the row at the cut in part.

    A source is cut into slices, ranges of the key. Sums of slices give the prefix sum at
    each slice border; only the slice in which the budget ends is ordered row by row, so
    a source of any share of the table keeps no task busy alone.

    Null texts have size 0 and are never taken. The null source is one of its own, the last.
    Rows with equal keys are ordered by their size; repeated rows are rows of their own. An
    empty table gives an empty one. Columns named like a new one are replaced by it.
    """
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in COLUMNS])
    src, order, piece, once = (fresh(base, n) for n in ("_src", "_order", "_slice", "_once"))
    rows = base.withColumn("size", word_count(text)).withColumn(src, F.col(f"`{source}`").cast("string"))
    rows = rows.withColumn(order, F.md5(F.concat_ws("~", F.lit(str(seed)), F.col(f"`{key}`").cast("string"))))
    light = materialize(rows.select(src, order, "size"), "sizes")
    digits = max(1, math.ceil(math.log(max(light.count() / per_slice, 1), 16)) + 1)
    cut = F.substring(F.col(order), 1, digits)
    slices = light.groupBy(F.col(src).alias("source"), cut.alias("_s")).agg(F.sum("size").alias("_sum"))
    slices = materialize(slices, "slices")
    plan = targets(slices.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, repeats)
    budget = F.round(F.col("target")).cast("bigint")
    plan = plan.withColumn("_full", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("_rest", budget - F.col("_full") * F.col("source_size"))
    plan = materialize(plan, "plan")
    named = plan.withColumnRenamed("source", "_p")
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_s").rowsBetween(*_BEFORE)), F.lit(0))
    borders = slices.withColumn("_before", before).join(named, F.col("source").eqNullSafe(F.col("_p"))).drop("_p")
    # The first slice that the rest does not hold whole is cut; earlier ones are taken whole.
    broken = F.col("_before") + F.col("_sum") > F.col("_rest")
    edge = borders.groupBy("source", "source_size", "target", "_full").agg(
        F.min(F.when(broken, F.col("_s"))).alias("_cut"),
        F.min_by(F.greatest(F.col("_rest") - F.col("_before"), F.lit(0)), F.when(broken, F.col("_s"))).alias("_left"),
    )
    m = "_m"
    while any(c.lower().startswith(m) for c in base.columns):
        m = f"_{m}"
    edge = edge.select(*[F.col(c).alias(f"{m}{c}") for c in edge.columns])
    joined = join_small(rows.withColumn(piece, cut), edge, F.col(src).eqNullSafe(F.col(f"{m}source")))
    at_cut = F.col(f"{m}_cut").isNotNull() & (F.col(piece) == F.col(f"{m}_cut"))
    held = F.when(F.col(f"{m}_cut").isNull() | (F.col(piece) < F.col(f"{m}_cut")), F.col("size")).otherwise(0)
    whole = joined.filter(~at_cut).withColumn(once, held)
    ahead = Window.partitionBy(src, piece).orderBy(order, "size").rowsBetween(*_BEFORE)
    spent = F.coalesce(F.sum("size").over(ahead), F.lit(0))
    part = joined.filter(at_cut).withColumn(once, F.greatest(F.least(F.col("size"), F.col(f"{m}_left") - spent), F.lit(0)))
    out = whole.unionByName(part)
    return out.select(
        *[F.col(f"`{c}`") for c in base.columns], "size", F.col(f"{m}source_size").alias("source_size"),
        F.col(f"{m}target").alias("target"), (F.col(f"{m}_full") * F.col("size") + F.col(once)).alias("taken"),
    )


def first_words(text: str | None, n: int) -> str:
    """The text up to the end of its ``n``-th word."""
    text, at, left = text or "", 0, n
    while left > 0:
        while at < len(text) and text[at] in BLANKS:
            at += 1
        while at < len(text) and text[at] not in BLANKS:
            at += 1
        left -= 1
    return text[:at]


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
               length: str = "n_chars", **options) -> DataFrame:
    """The rows that the mix takes, with the columns of ``df``: one row for each repeat.

    The repeat at the cut holds the first words of its text up to the budget, and its
    ``length`` column, if there is one, follows.
    """
    own = df.columns
    # Columns that are named like one of the mix keep their values.
    aside = {c: fresh(df, f"_own_{c}") for c in own if c.lower() in COLUMNS}
    df = df.withColumnsRenamed(aside)
    mixed = mix(df, aside.get(key, key), aside.get(text, text), aside.get(source, source), **options).filter("taken > 0")
    text = aside.get(text, text)
    copies, words = fresh(mixed, "_copies"), fresh(mixed, "_words")
    each = F.greatest(F.col("size"), F.lit(1))
    full, rest = F.floor(F.col("taken") / each), F.col("taken") % each
    takes = F.concat(F.array_repeat(F.col("size"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array()))
    rows = mixed.withColumn(copies, takes).withColumn(words, F.explode(copies)).drop(copies)
    whole = rows.filter(F.col(words) == F.col("size"))
    clean = fresh(rows, "_text")
    part = add_columns(rows.filter(F.col(words) < F.col("size")), [text, words], f"`{clean}` string",
                       lambda texts, counts: [[first_words(t, n) for t, n in zip(texts, counts)]])
    part = part.withColumn(text, F.col(clean)).drop(clean)
    if length in df.columns:
        part = part.withColumn(length, F.length(text).cast(df.schema[length].dataType))
    return whole.unionByName(part).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in own])
