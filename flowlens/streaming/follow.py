"""Following logs that grow: a stream source whose offset is a byte in each file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from flowlens.functions.common import strip

NAME = "growing_log"
SCHEMA = "file string, position bigint, header string, value string"
PIECE_BYTES = 32 << 20
_READ = 1 << 20
_MARK = b"#fields"


def _lines(fs: pafs.FileSystem, file: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in a range of bytes, with their place; the last one may end behind it."""
    with fs.open_input_file(file) as source:
        source.seek(start)
        at, rest = start, b""
        while at < end:
            block = source.read(_READ)
            if not block:
                return
            parts = (rest + block).split(b"\n")
            rest = parts.pop()
            for line in parts:
                if at >= end:
                    return
                yield at, line
                at += len(line) + 1


def _last_break(fs: pafs.FileSystem, file: str, start: int, size: int) -> int:
    """Place behind the last line break of a range, or its start."""
    with fs.open_input_file(file) as source:
        high = size
        while high > start:
            low = max(start, high - _READ)
            source.seek(low)
            found = source.read(high - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return start


@dataclass
class Piece(InputPartition):
    file: str
    start: int
    end: int
    skip: bool    # the first line began in the piece before
    header: str   # the #fields line in force at the start


class GrowingLogReader(DataSourceStreamReader):
    """Offsets are ``{file: [bytes, header]}``: what was read of each file, up to a line break, and
    the ``#fields`` line in force there."""

    def __init__(self, options: dict) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(options["path"])
        self.skip = options.get("skipexisting", "false").lower() == "true"
        self.piece = int(options.get("piecebytes", PIECE_BYTES))
        self.known: dict[str, list] = {}
        self.marks: dict[tuple[str, int, int], list[tuple[int, str]]] = {}

    def _sizes(self) -> dict[str, int]:
        info = self.fs.get_file_info(self.base)
        if info.type == pafs.FileType.File:
            return {self.base: info.size}
        found = self.fs.get_file_info(pafs.FileSelector(self.base, recursive=True, allow_not_found=True))
        names = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        return {f.path: f.size for f in sorted(names, key=lambda f: f.path)}

    def _marks(self, file: str, start: int, end: int) -> list[tuple[int, str]]:
        """The ``#fields`` lines of a range; new bytes are looked at once."""
        key = (file, start, end)
        if key not in self.marks:
            self.marks[key] = [(at, line.decode("utf-8", "replace").rstrip("\r")) for at, line in _lines(self.fs, file, start, end)
                               if line.startswith(_MARK)]
        return self.marks[key]

    def _offset(self) -> dict:
        out = {}
        for file, size in self._sizes().items():
            start, header = self.known.get(file, [0, ""])
            if size < start:  # begun anew under the same name
                start, header = 0, ""
            end = _last_break(self.fs, file, start, size)
            marks = self._marks(file, start, end) if end > start else []
            out[file] = [end, marks[-1][1] if marks else header]
        self.known = out
        return out

    def initialOffset(self) -> dict:
        return dict(self._offset()) if self.skip else {}

    def latestOffset(self) -> dict:
        return dict(self._offset())

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for file, (stop, _) in end.items():
            first, header = start.get(file, [0, ""])
            if stop < first:
                first, header = 0, ""
            if stop == first:
                continue
            marks = self._marks(file, first, stop)
            for low in range(first, stop, self.piece):
                above = [h for at, h in marks if at < low]
                pieces.append(Piece(file, low, min(stop, low + self.piece), low > first, above[-1] if above else header))
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        rows, header = [], partition.header
        # A line belongs to the piece in which it begins; the byte before tells whether one begins here.
        start = partition.start - 1 if partition.skip else partition.start
        lines = _lines(self.fs, partition.file, start, partition.end)
        if partition.skip:
            next(lines, None)

        def made() -> pa.RecordBatch:
            at, heads, values = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(rows)), pa.array(at, pa.int64()), pa.array(heads),
                                               pa.array(values)], names=["file", "position", "header", "value"])

        for at, line in lines:
            text = line.decode("utf-8", "replace").rstrip("\r")
            if line.startswith(_MARK):
                header = text
            elif not line.startswith(b"#"):
                rows.append((at, header, text))
            if len(rows) == 4096:
                yield made()
                rows = []
        if rows:
            yield made()

    def commit(self, end: dict) -> None:
        self.marks = {k: v for k, v in self.marks.items() if k[2] > end.get(k[0], [0])[0]}


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader({k.lower(): v for k, v in self.options.items()})


def follow_log(spark: SparkSession, path: str, skip_existing: bool = False, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Lines appended to a log file, or to any file of a folder, with the ``#fields`` line above each.

    Columns ``file``, ``position`` (byte), ``header`` and ``value``. A line is read once, when its
    line break is there, also across restarts with one checkpoint; ``skip_existing`` leaves out what is
    there at the first start. A file that got shorter is read again from its begin. Comment lines
    are dropped. Large additions are cut into pieces of ``piece_bytes`` for several tasks; the
    driver looks through new bytes once, in small blocks, for header lines.
    """
    spark.dataSource.register(GrowingLog)
    reader = spark.readStream.format(NAME).option("path", path).option("skipExisting", str(skip_existing).lower())
    return reader.option("pieceBytes", str(piece_bytes)).load()


def followed_columns(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns of followed lines, all strings, with dots in names as underscores.

    A line without a header, or with another number of fields than its header, is dropped; a
    column that the header does not have is NULL.
    """
    names = F.transform(F.slice(F.split("header", "\t", -1), 2, 1_000_000), lambda c: F.replace(F.trim(c), F.lit("."), F.lit("_")))
    rows = lines.filter(F.col("header") != "").withColumns({"_names": names, "_cells": F.split(strip("value"), "\t", -1)})
    rows = rows.filter(F.size("_names") == F.size("_cells"))

    def cell(name: str) -> Column:
        at = F.array_position("_names", name)
        return F.when(at > 0, F.get("_cells", (at - 1).cast("int")))

    return rows.select(*[cell(c.replace(".", "_")).alias(c.replace(".", "_")) for c in columns])
