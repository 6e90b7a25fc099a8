"""File discovery, delimiter and encoding checks, and rows of uneven length."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.common import BOM, collapse_blanks, quoted, strip
from flowlens.sources.records import QUOTED, cells_of, read_lines, records, split_cells, state_after

def list_files(spark: SparkSession, target: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Files under a file, directory (searched recursively) or glob: path, time, size.

    Only metadata is read; the listing is distributed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(target).select("path", "modificationTime", "length")


def resolve_inputs(spark: SparkSession, target: str | Sequence[str], newest: bool = False,
                   pattern: str | None = None) -> list[str]:
    """Sorted file paths of an input, or only the newest file by modification time."""
    files = list_files(spark, target, pattern)
    if newest:
        row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
        found = [row.path] if row.path else []
    else:
        found = sorted({r.path for r in files.select("path").toLocalIterator()})
    if not found:
        raise FileNotFoundError(f"no input files: {target}")
    return found


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """First line of a file: the read stops after it."""
    row = read_lines(spark, path, encoding).limit(1).first()
    if row is None:
        raise ValueError(f"empty file: {path}")
    return row.value.split("\r")[0]


def delimiter_of(line: str) -> str:
    """Tab if there is one, else ``;`` when it is more frequent than ``,``."""
    if "\t" in line:
        return "\t"
    return ";" if line.count(";") > line.count(",") else ","


def sniff_csv(spark: SparkSession, path: str) -> tuple[str, str]:
    """Delimiter and encoding (UTF-8, or latin-1 when a line is not valid UTF-8)."""
    lines = spark.read.text(path)
    broken = lines.filter(~F.is_valid_utf8("value")).limit(1)
    encoding = "UTF-8" if broken.isEmpty() else "ISO-8859-1"
    return delimiter_of(first_line(spark, path, encoding)), encoding


def clean_name(name: str) -> str:
    """Column name without byte-order mark, outer blanks and runs of blanks."""
    return " ".join(name.replace(BOM, "").split())


def unique_names(names: Iterable[str]) -> list[str]:
    """Repeated names get ``.1``, ``.2`` and so on; case does not tell names apart."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name.lower(), 0)
        seen[name.lower()] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def header_columns(line: str, sep: str) -> list[str]:
    """Column names of a header line; a leading ``#fields`` cell is dropped."""
    cells = cells_of(line, sep)
    if cells and cells[0].replace(BOM, "").startswith("#fields"):
        cells = cells[1:]
    return unique_names(clean_name(c) for c in cells)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Clean all column names and drop a ``#fields`` column."""
    kept = [c for c in df.columns if not c.replace(BOM, "").startswith("#fields")]
    return df.select(*[quoted(c) for c in kept]).toDF(*unique_names(clean_name(c) for c in kept))


def first_record(spark: SparkSession, path: str, encoding: str, sep: str, lines: int = 16) -> str:
    """First record of a file whose first line ends inside a quoted cell."""
    while True:
        rows = [r.value.removesuffix("\r") for r in read_lines(spark, path, encoding).limit(lines).collect()]
        state = QUOTED
        for i, line in enumerate(rows):
            state = state_after(line, sep, state if i else 0)
            if state != QUOTED:
                return "\n".join(rows[:i + 1])
        if len(rows) < lines:
            return "\n".join(rows)
        lines *= 16


def header_groups(spark: SparkSession, paths: Sequence[str], encoding: str, sep: str | None = None) -> dict[str, list[str]]:
    """Files grouped by their header, the first record: by lines first, longer ones file by file."""
    groups: dict[str, list[str]] = {}
    for line, files in _line_groups(spark, paths, encoding).items():
        mark = sep or delimiter_of(line)
        if state_after(line, mark) != QUOTED:
            groups.setdefault(line, []).extend(files)
            continue
        for file in files:
            groups.setdefault(first_record(spark, file, encoding, mark), []).append(file)
    return dict(sorted(groups.items()))


def _line_groups(spark: SparkSession, paths: Sequence[str], encoding: str) -> dict[str, list[str]]:
    """Files grouped by their first line, found in one distributed pass over all files.

    Rows of a block keep their order, so the first row of the block at the start of a
    file is its header. Files without any line have no rows and no group.
    """
    if len(set(paths)) == 1:
        return {first_line(spark, paths[0], encoding): list(paths)}
    lines = read_lines(spark, paths, encoding)
    lines = lines.select(F.substring_index("value", "\r", 1).alias("value"), F.col("_file").alias("file"), F.col("_block").alias("block"),
                         F.monotonically_increasing_id().alias("at"))
    heads = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))
    groups = {r["head"]: sorted(r["files"]) for r in heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()}
    return groups


def header_cells(line: str, sep: str) -> list[str]:
    """Cleaned cells of a header line, as ``parse_ragged`` compares them."""
    return [clean_name(c.replace('"', "")) for c in cells_of(line, sep)]


def parse_ragged(lines: DataFrame, columns: Sequence[str], sep: str, short: str,
                 header: Sequence[str] | None = None) -> DataFrame:
    """Text rows ``value`` to columns. Long rows are cut; short rows are skipped
    (``skip``) or filled with empty text (``pad``). Blank lines are dropped, and lines
    whose cleaned cells are those of the ``header``."""
    if short not in ("skip", "pad"):
        raise ValueError(f"unknown policy: {short}")
    rows = lines.filter(F.length(strip("value")) > 0).withColumn("_cells", split_cells(F.col("value"), sep))
    if header:
        def clean(c: Column) -> Column:
            return collapse_blanks(F.translate(c, BOM + '"', ""))

        # The first cell decides for nearly all rows.
        first = F.coalesce(clean(F.get("_cells", F.lit(0))) == header[0], F.lit(False))
        same = F.transform("_cells", clean) == F.array(*[F.lit(h) for h in header])
        rows = rows.filter(~F.when(first, same).otherwise(False))
    if short == "skip":
        rows = rows.filter(F.size("_cells") >= len(columns))
    extra = [c for c in lines.columns if c != "value"]
    cells = [F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)]
    return rows.select(*cells, *extra)


def read_ragged(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
                sep: str | None = None, short: str = "skip", encoding: str = "UTF-8",
                provenance: bool = False, multiline: bool | None = None) -> DataFrame:
    """Delimited text with a header per file and rows of uneven length, all strings.

    Files with different headers are read apart and joined by column name. With
    ``columns`` no header is looked up: rows that repeat the column names are dropped.
    Quoted cells and headers may hold delimiters and line breaks; ``multiline=False`` says
    that no cell holds a line break and saves the pass that looks for one.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    if columns is None:
        files = resolve_inputs(spark, files)
        groups = header_groups(spark, files, encoding, sep)
    else:
        groups = {(sep or ",").join(columns): files}
    result = None
    for line, members in groups.items():
        mark = sep or delimiter_of(line)
        names = list(columns) if columns is not None else header_columns(line, mark)
        lines = records(spark, members, mark, encoding, multiline)
        lines = lines if provenance else lines.drop("source_file")
        body = F.replace("value", F.lit(BOM), F.lit(""))
        lines = lines.filter(~F.startswith(body, F.lit("#fields")))
        part = parse_ragged(lines, names, mark, short, header_cells(line, mark))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def plain_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores (``id.orig_h`` to ``id_orig_h``)."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def with_provenance(df: DataFrame, kind: str = "flow", dataset: str | None = None) -> DataFrame:
    """Add source file, day (from the file name) and dataset name to a file-based frame.

    ``flow`` files start with the day (``Monday-...``), ``conn`` files have it second
    (``conn_monday_full.log``).
    """
    name = F.col("source_file") if "source_file" in df.columns else F.col("_metadata.file_name")
    if kind == "flow":
        day = F.lower(F.split_part(name, F.lit("-"), F.lit(1)))
    else:
        day = F.replace(F.split_part(name, F.lit("_"), F.lit(2)), F.lit(".log"), F.lit(""))
    out = df.withColumns({"source_file": name, "day": day})
    return out.withColumn("dataset_name", F.lit(dataset)) if dataset else out
