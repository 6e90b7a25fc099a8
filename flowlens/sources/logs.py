"""Connection logs, packet logs and dataset files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import schemas as S
from flowlens.functions.common import quoted, strip
from flowlens.functions.numbers import parse_number, safe_double, safe_int
from flowlens.functions.times import parse_ts
from flowlens.sources.files import (
    normalize_columns,
    plain_names,
    read_ragged,
    resolve_inputs,
)
from flowlens.session import join_small, materialize


def parse_zeek_lines(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tab-separated log lines (``value``) to string columns with plain names.

    Comment lines and rows with another number of fields are dropped.
    """
    rows = lines.filter(~F.startswith(F.col("value"), F.lit("#")))
    rows = rows.withColumn("_cells", F.split(strip("value"), "\t", -1))
    rows = rows.filter(F.size("_cells") == len(columns))
    extra = [c for c in lines.columns if c != "value"]
    names = [c.strip().replace(".", "_") for c in columns]
    return rows.select(*[F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)], *extra)


def _numeric_conn(df: DataFrame) -> DataFrame:
    """The numeric conn columns as double, unreadable values NULL."""
    names = [n for n in (c.replace(".", "_") for c in S.CONN_NUMERIC) if n in df.columns]
    return df.withColumns({n: parse_number(quoted(n)) for n in names})


def _located(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with their file, and their place in it: block, then row within the block."""
    return spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
        F.when(F.startswith(F.col("value"), F.lit("#fields")), strip("value")).alias("_mark"),
    )


def zeek_headers(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], DataFrame]:
    """The distinct ``#fields`` lines of log files, and (file, headers) of every file.

    One distributed pass. A file with lines but without a ``#fields`` line is an error.
    """
    lines = _located(spark, paths)
    files = materialize(lines.groupBy("_file").agg(F.collect_set("_mark").alias("headers")), "headers")
    bare = [r["_file"] for r in files.filter(F.size("headers") == 0).select("_file").limit(5).collect()]
    if bare:
        raise ValueError(f"no #fields line in {bare}")
    headers = sorted(r["h"] for r in files.select(F.explode("headers").alias("h")).distinct().collect())
    if not headers:
        raise ValueError(f"no #fields line in {list(paths)[:5]}")
    return headers, files


def with_latest_header(lines: DataFrame) -> DataFrame:
    """Add ``_header``: the last ``#fields`` line above each line of its file.

    Within a block by a window over the block; a block without one above takes that of an
    earlier block, so a large file is not ordered in one task.
    """
    above = Window.partitionBy("_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    blocks = lines.groupBy("_file", "_block").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    marked = lines.withColumn("_own", F.last("_mark", ignorenulls=True).over(above)).join(blocks, ["_file", "_block"])
    return marked.withColumn("_header", F.coalesce("_own", "_carried")).drop("_own", "_carried")


def _by_header(lines: DataFrame, headers: Sequence[str]) -> DataFrame:
    """Lines with a ``_header`` to the columns of all headers; rows of another width are dropped."""
    names = {h: [c.strip().replace(".", "_") for c in h.split("\t")[1:]] for h in headers}
    rows = lines.filter(~F.startswith(F.col("value"), F.lit("#"))).withColumn("_cells", F.split(strip("value"), "\t", -1))
    width = F.coalesce(*[F.when(F.col("_header") == h, F.lit(len(n))) for h, n in names.items()])
    rows = rows.filter(F.size("_cells") == width)
    columns = list(dict.fromkeys(c for n in names.values() for c in n))
    cells = [
        F.coalesce(*[F.when(F.col("_header") == h, F.get("_cells", F.lit(n.index(c)))) for h, n in names.items() if c in n]).alias(c)
        for c in columns
    ]
    return rows.select(*cells, "source_file")


def read_zeek_log(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
                  provenance: bool = False, typed: bool = True) -> DataFrame:
    """Tab-separated log with its names in a ``#fields`` line.

    A row belongs to the last such line above it; files may have different ones, or
    several. Pass ``columns`` when the header is known: the data is then read only once.
    A path that is listed twice is read once.
    """
    files = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    if columns is None:
        headers, by_file = zeek_headers(spark, files)
    else:
        headers = ["\t".join(["#fields", *columns])]
    if len(headers) == 1:
        lines = spark.read.text(files).select("value", F.col("_metadata.file_name").alias("source_file"))
        result = parse_zeek_lines(lines, headers[0].split("\t")[1:])
    else:
        lines = _located(spark, files)
        if by_file.filter(F.size("headers") > 1).isEmpty():
            lines = join_small(lines, by_file.select("_file", F.get("headers", F.lit(0)).alias("_header")), "_file")
        else:
            lines = with_latest_header(lines)
        result = _by_header(lines, headers)
    result = result if provenance else result.drop("source_file")
    return _numeric_conn(result) if typed else result


def read_conn_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
                  provenance: bool = False) -> DataFrame:
    """Conn CSV with a ``#fields,...`` or plain header; short and blank rows are skipped."""
    return plain_names(read_ragged(spark, paths, columns, sep=",", short="skip", provenance=provenance))


def read_packet_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Packet-statistics log with its columns typed."""
    rows = read_zeek_log(spark, paths, typed=False)
    types = {f.name: f.dataType for f in S.PACKET_LOG_SCHEMA}
    out = []
    for name in rows.columns:
        kind = types.get(name, T.StringType())
        value = quoted(name)
        if isinstance(kind, T.TimestampType):
            value = parse_ts(name)
        elif not isinstance(kind, T.StringType):
            value = parse_number(name).try_cast(kind)
        out.append(value.alias(name))
    return rows.select(*out)


def _read_csv(spark: SparkSession, paths: Sequence[str], encoding: str, sep: str = ",") -> DataFrame:
    """CSV files by header group, all strings, cleaned and unique names; empty cells are NULL."""
    rows = read_ragged(spark, paths, sep=sep, short="pad", encoding=encoding, provenance=True)
    return rows.select(*[F.nullif(quoted(c), F.lit("")).alias(c) for c in rows.columns])


def read_cic(spark: SparkSession, directory: str, encoding: str = "ISO-8859-1", pattern: str = "*.csv") -> DataFrame:
    """Flow dataset: the known day files, else all files of the directory with a name like ``pattern``."""
    files = resolve_inputs(spark, directory, pattern=pattern)
    by_name = {f.rsplit("/", 1)[-1]: f for f in files}
    days = [by_name[n] for n in S.CIC_DAY_FILES if n in by_name]
    return _read_csv(spark, days or files, encoding)


def read_kdd(spark: SparkSession, path: str) -> DataFrame:
    """Headerless file: the last column is the label, the others get the known names.

    With another number of columns the names are given as far as they go.
    """
    df = spark.read.csv(path, header=False)
    width = len(df.columns) - 1
    names = [S.KDD_FEATURES[i] if i < len(S.KDD_FEATURES) else f"f{i}" for i in range(width)]
    return df.toDF(*names, "label")


def read_malmem(spark: SparkSession, path: str, expected: str = "Class") -> tuple[DataFrame, str]:
    """Memory-dump dataset with numeric features, and the name of its label column."""
    df = normalize_columns(spark.read.csv(path, header=True))
    label = detect_label_col(df.columns, expected)
    return df.select(*[quoted(c) if c == label else parse_number(quoted(c)).alias(c) for c in df.columns]), label


def detect_label_col(columns: Sequence[str], expected: str) -> str:
    if expected in columns:
        return expected
    for name in columns:
        if name.strip().casefold() in ("label", "class"):
            return name
    raise KeyError(f"no label column in {list(columns)[:20]}")


def read_feature_csv(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Feature file, any delimiter; long rows are cut, short rows skipped."""
    return read_ragged(spark, paths, short="skip", encoding=encoding)


def replay_to_alerts(df: DataFrame, source_csv: str) -> DataFrame:
    """Replay rows to alert rows with defaults; the raw row is kept in the metadata."""
    def value(name: str, default: str) -> Column:
        return F.coalesce(quoted(name), F.lit(default)) if name in df.columns else F.lit(default)

    raw = F.struct(*[quoted(c) for c in df.columns])
    return df.select(
        parse_ts("timestamp").alias("timestamp"),
        value("Severity", "Medium").alias("severity"),
        value("Label", "Other").alias("attack_type"),
        quoted("Source IP").alias("src_ip"),
        safe_int(value("Source Port", "0"), 0).cast("int").alias("src_port"),
        quoted("Destination IP").alias("dst_ip"),
        safe_int(value("Destination Port", "0"), 0).cast("int").alias("dst_port"),
        value("Protocol", "TCP").alias("protocol"),
        value("Rule ID", "REPLAY").alias("rule_id"),
        value("Rule Name", "Replay Import").alias("rule_name"),
        safe_double(value("Score", "0.6"), 0.6).alias("model_score"),
        value("Model Label", "malicious").alias("model_label"),
        F.to_json(F.struct(F.lit(source_csv).alias("source_csv"), raw.alias("raw_row"))).alias("meta"),
    )

