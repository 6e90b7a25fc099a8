"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowlens.session import configure, join_small

# Words of a text: runs of everything but space, tab, line feed, vertical tab, form feed
# and carriage return. bytes.split() cuts UTF-8 at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

Columns = list[list]


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings; small Arrow batches bound the memory of a Python task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return configure(spark)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns that clash with ``names``, in whatever case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def add_columns(df: DataFrame, inputs: Sequence[str], ddl: str,
                work: Callable[..., Columns], keep: Sequence[str] | None = None) -> DataFrame:
    """Add columns computed by Python from Arrow batches, one list per column.

    ``work`` gets a list for each name of ``inputs`` and returns a list for each field of
    ``ddl``. The columns of ``keep`` (all without it) pass through untouched; those whose
    names clash with a new one are replaced by it.
    """
    new = schema_of(ddl)
    kept = [c for c in (df.columns if keep is None else keep)
            if c.lower() not in {n.lower() for n in new.names}]
    columns = list(dict.fromkeys([*kept, *inputs]))
    source = df.select(*[F.col(f"`{c}`") for c in columns])
    schema = T.StructType([*[source.schema[c] for c in kept], *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(*[batch.column(columns.index(c)).to_pylist() for c in inputs])
            arrays = [batch.column(columns.index(c)) for c in kept]
            arrays += [pa.array(v, type=k) for v, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def text_of(name: str = "text") -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def folds(key: Column, n: int) -> Column:
    """Fold of a row: crc32 of the key written as text, modulo ``n``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(key: object, n: int) -> int:
    return zlib.crc32(str("" if key is None else key).encode()) % n


def stable_hash(key: object) -> int:
    """Repeatable pseudo-random number of a key, for an order on the driver."""
    return xxhash.xxh64_intdigest(str(key).encode(), 42)


def bounded_sample(df: DataFrame, group: str, per_group: int, key: str) -> DataFrame:
    """One row for each of the ``per_group`` keys with the least hash, of each value of ``group``.

    The number of distinct keys of a group gives the share of hashes that holds about four
    times as many keys; only these are ranked, so a task ranks about as many rows of a group
    whatever its size. Rows of one key count once, however many there are: the one whose
    other columns come first stays. A group with fewer keys gives all of them.
    """
    names = {n: fresh(df, n) for n in ("_hash", "_share", "_at")}
    hashed, share, at = (F.col(n) for n in names.values())
    by_key = F.xxhash64(F.col(f"`{key}`").cast("string"))
    drawn = df.withColumn(names["_hash"], F.pmod(by_key, F.lit(1 << 40)))
    wanted = F.lit(float(4 * per_group + 100)) / F.approx_count_distinct(by_key) * F.lit(float(1 << 40))
    drawn = join_small(drawn, df.groupBy(group).agg(wanted.alias(names["_share"])), [group]).filter(hashed < share)
    others = [c for c in df.columns if c not in (group, key)]
    first = [F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_first")] if others else []
    single = drawn.groupBy(group, key, names["_hash"])
    single = single.agg(*first) if first else single.agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(group).orderBy(hashed, key)
    ranked = single.withColumn(names["_at"], F.row_number().over(order)).filter(at <= per_group)
    return ranked.select(*[F.col("_first").getField(c).alias(c) if c in others else F.col(f"`{c}`") for c in df.columns])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))
