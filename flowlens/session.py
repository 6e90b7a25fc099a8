"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job relies on. Partition counts are left to the session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Larger generated methods are never compiled by the JVM; the split form is faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_OWNED: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end: write the result before."""
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            remove(spark, path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory path for intermediate tables.

    The base is the shared folder the cluster names in ``spark.checkpoint.dir``. Only a
    local-mode session without that setting falls back to a machine-local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="flowlens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return it read back.

    Cuts the lineage: the result survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    if _OWNED:
        _OWNED[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int = 10_000) -> DataFrame | None:
    """``df`` as a broadcastable table if it has at most ``max_rows`` rows, else ``None``.

    Meant for per-class and per-cell summaries. At most ``max_rows + 1`` rows reach the
    driver, so the size of what is broadcast is checked, never assumed.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_small(df: DataFrame, side: DataFrame, on, how: str = "inner",
               max_rows: int = 10_000) -> DataFrame:
    """Join a summary to ``df``: broadcast when its size was checked, shuffled otherwise."""
    table = small_table(side, max_rows)
    return df.join(side if table is None else table, on, how)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, on whatever file system the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or directory exists, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, on whatever file system the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
