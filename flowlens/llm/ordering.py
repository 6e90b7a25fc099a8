"""Places of rows in the order of their group, and lookups that stay balanced for hot keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import join_small, materialize


def positions(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``at``, the place of a row in its group counted from 0, and ``n``, the size of the group.

    ``group`` holds no nulls; ``order`` puts nulls first, and rows that are equal in it come
    in any order. Rows are sorted by range over the whole cluster, so a group of any size,
    equal rows included, is spread over tasks. A task counts its own part of a group; the
    counts of the parts, one row for each part of a group, give the offsets.
    """
    salted = materialize(rows.withColumn("_salt", F.monotonically_increasing_id()), name)
    by = [group, *order, "_salt"]
    ranged = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_i", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            values = batch.column(group)
            starts = np.concatenate(([0], 1 + np.flatnonzero(pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False))))
            runs = np.diff(np.append(starts, size))
            index = np.arange(size) - np.repeat(starts, runs)
            if seen and values[0].as_py() == last:
                index[:runs[0]] += seen
            last, seen = values[size - 1].as_py(), int(index[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(size, part, np.int32)), pa.array(index)],
                                             names=schema.names)

    placed = materialize(ranged.mapInArrow(run, schema), f"{name}-placed")
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    found = join_small(placed, offsets, [group, "_part"])
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_i")).alias("at"), "n")


def lookup(rows: DataFrame, on: str, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join of ``rows`` to ``table``, whose ``key`` is unique, where ``on`` equals it.

    The rows of one value of ``on`` are dealt by a hash of the column ``spread``, and the
    row of the table is copied only to the parts that ask for it, so a value that a third
    of all rows hold is joined by many tasks.
    """
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(spread), F.lit(parts)))
    asked = dealt.filter(F.col(on).isNotNull()).select(F.col(on).alias("_on"), F.col("_deal").alias("_to")).distinct()
    found = asked.join(table, F.col("_on") == F.col(key)).drop(key)
    return dealt.join(found, (F.col(on) == F.col("_on")) & (F.col("_deal") == F.col("_to")), "left").drop("_deal", "_to", "_on")
