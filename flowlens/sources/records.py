"""Delimited records: quoted cells may hold the delimiter, quotes and line breaks.

The rules are those of Python's ``csv.reader`` with its defaults: a quote opens a quoted
cell only at the start of the cell, elsewhere it is text; inside, two quotes are one; text
behind a closing quote belongs to the cell; a line break ends the record unless a quoted
cell is open; a record that the file ends in is taken as it is.

A line break inside quotes cannot be told from the end of a record by looking at one line,
and a file is read in blocks by many tasks. Each line maps "a quoted cell is open before it"
to "is open behind it". The maps of a block compose to one, a scan over the maps of a
file's blocks says how every block begins, and then each block cuts its own records. Only
the pieces of a record at the borders of blocks are put together across tasks.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import materialize, small_table

# Executors get the helpers of this module with the task; nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Stand for a delimiter outside quotes and for the sign itself, once the text is escaped.
_CUT, _SIGN = "﷐", "﷑"

# State of the reader behind some text.
START, PLAIN, QUOTED, CLOSED = 0, 1, 2, 3
_AFTER_QUOTE = (QUOTED, PLAIN, CLOSED, QUOTED)


# ------------------------------------------------------------------ one line


def state_after(line: str, sep: str, state: int = START) -> int:
    """State of the reader behind a line, its end not counted."""
    parts = line.split('"')
    for i, part in enumerate(parts):
        if i:
            state = _AFTER_QUOTE[state]
        if part and state != QUOTED:
            state = START if part[-1] == sep else PLAIN
    return state


def cells_of(record: str, sep: str) -> list[str]:
    """Cells of one record on the driver; for headers."""
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=sep), [])


def _next_state(state: Column, part: Column, i: Column, sep: str) -> Column:
    quoted = F.when(state == PLAIN, PLAIN).when(state == QUOTED, CLOSED).otherwise(QUOTED)
    after = F.when(i == 0, state).otherwise(quoted)
    plain = F.when(F.endswith(part, F.lit(sep)), START).otherwise(PLAIN)
    return F.when((part == "") | (after == QUOTED), after).otherwise(plain)


def split_cells(line: Column, sep: str) -> Column:
    """Cells of a record. Records without a quote are split at every delimiter."""
    plain = F.split(line, re.escape(sep), -1)
    escaped = F.replace(F.replace(line, F.lit(_SIGN), F.lit(f"{_SIGN}1")), F.lit(_CUT), F.lit(f"{_SIGN}0"))

    def cut(parts: Column) -> Column:
        """The record again, its delimiters outside quotes marked."""
        numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        first = F.struct(F.lit(START).alias("state"), F.array().cast("array<int>").alias("states"))

        def step(acc: Column, x: Column) -> Column:
            state = _next_state(acc["state"], x["p"], x["i"], sep)
            return F.struct(state.alias("state"), F.concat(acc["states"], F.array(state)).alias("states"))

        states = F.aggregate(numbered, first, step, lambda acc: acc["states"])
        marked = F.zip_with(parts, states, lambda p, s: F.when(s == QUOTED, p).otherwise(F.replace(p, F.lit(sep), F.lit(_CUT))))
        return F.array_join(marked, '"')

    def value(cell: Column) -> Column:
        """A cell without its quotes; what is behind the closing one is text."""
        body = F.replace(F.substr(cell, F.lit(2)), F.lit('""'), F.lit(_CUT))
        end = F.instr(body, '"')
        inside = F.when(end == 0, body).otherwise(F.substr(body, F.lit(1), end - 1))
        behind = F.when(end == 0, F.lit("")).otherwise(F.substr(body, end + 1))
        whole = F.concat(F.replace(inside, F.lit(_CUT), F.lit('"')), F.replace(behind, F.lit(_CUT), F.lit('""')))
        return F.when(F.startswith(cell, F.lit('"')), whole).otherwise(cell)

    def back(cell: Column) -> Column:
        return F.replace(F.replace(cell, F.lit(f"{_SIGN}0"), F.lit(_CUT)), F.lit(f"{_SIGN}1"), F.lit(_SIGN))

    # A lambda binds the parts: they are cut once, not once for each of them.
    marked = F.get(F.transform(F.array(F.split(escaped, '"', -1)), cut), F.lit(0))
    careful = F.transform(F.split(marked, _CUT, -1), lambda c: back(value(c)))
    return F.when(line.contains('"'), careful).otherwise(plain)


# ------------------------------------------------------------------ lines of files


def read_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    r"""Text files by ``\n``, as valid text: the reader of lines hands on the bytes as they are.

    Bytes that are not UTF-8 become U+FFFD.
    """
    raw = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    utf8 = encoding.upper() in ("UTF-8", "UTF8")
    text = F.make_valid_utf8("value") if utf8 else F.decode(F.col("value").cast("binary"), encoding)
    return raw.withColumns({"value": text, "_file": F.col("_metadata.file_path"), "source_file": F.col("_metadata.file_name"),
                            "_block": F.col("_metadata.file_block_start")})


def located_lines(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    r"""Lines (``value``), the break that ends each (``_end``), and the block of the file it begins in.

    Lines end at ``\n``, ``\r\n`` or a lone ``\r``. A file with lone ones only is one line to the
    reader of blocks and is cut afterwards.
    """
    v = F.col("value")
    lone = F.when(v.contains("\r"), v.rlike("\r(?!\\z)")).otherwise(F.lit(False))
    rows = read_lines(spark, paths, encoding).withColumn("_lone", lone)
    lines = F.when(F.col("_lone"), F.split(F.concat(v, F.lit("\n")), "(?<=\r)(?!\n)", -1)).otherwise(F.array(v))
    rows = rows.withColumn("value", F.explode(lines))
    back = F.endswith(v, F.lit("\r"))
    end = F.when(F.col("_lone"), F.when(back, "\r").when(F.endswith(v, F.lit("\r\n")), "\r\n").otherwise("\n"))
    end = end.otherwise(F.when(back, "\r\n").otherwise("\n"))
    bare = F.when(back | F.col("_lone"), F.regexp_replace(v, "\r?\n?\\z", "")).otherwise(v)
    return rows.withColumns({"_end": end, "value": bare}).drop("_lone")


def block_maps(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, after_closed, after_open, opens) of the blocks that hold a quote.

    ``after_closed`` and ``after_open`` say whether a quoted cell is open behind the block if
    none, or one, is open before it; ``opens``, whether some line may end inside one. Lines
    without a quote change nothing and are left out before Python sees them.
    """
    rows = lines.filter(F.col("value").contains('"')).select("_file", "_block", "value")
    names = ["_file", "_block", "after_closed", "after_open", "opens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, closed, open_, opens = None, False, True, False

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*place, closed, open_, opens)], names=names)

        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != place:
                    if place is not None:
                        yield made()
                    place, closed, open_, opens = (file, block), False, True, False
                from_closed = state_after(value, sep) == QUOTED
                from_open = state_after(value, sep, QUOTED) == QUOTED
                opens = opens or from_closed
                closed, open_ = (from_open if closed else from_closed), (from_open if open_ else from_closed)
        if place is not None:
            yield made()

    # A block is read by one task, from its begin to its end.
    return rows.mapInArrow(run, "_file string, _block bigint, after_closed boolean, after_open boolean, opens boolean")


def open_ranges(maps: DataFrame) -> DataFrame:
    """(file, from, to) of the blocks, behind ``from`` up to ``to``, that begin inside a quoted cell.

    A map that does not depend on how its block begins decides for those behind it; maps
    that turn the state around since then are counted.
    """
    order = Window.partitionBy("_file").orderBy("_block")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    turns = F.col("after_closed") & ~F.col("after_open")
    fixed = F.col("after_closed") == F.col("after_open")
    counted = maps.withColumn("turned", F.sum(F.when(turns, 1).otherwise(0)).over(so_far))
    fact = F.last(F.when(fixed, F.struct("after_closed", "turned")), ignorenulls=True).over(so_far)
    known = counted.withColumn("fact", fact).withColumn("_to", F.lead("_block").over(order))
    turned = (F.col("turned") - F.coalesce("fact.turned", F.lit(0))) % 2 == 1
    behind = F.coalesce("fact.after_closed", F.lit(False)) != turned
    return known.filter(behind).select(F.col("_file").alias("_f"), F.col("_block").alias("_from"), "_to")


def _with_states(lines: DataFrame, ranges: DataFrame, max_rows: int) -> DataFrame:
    """Add ``_open``, whether the block of a line begins inside a quoted cell; blocks stay whole and in order."""
    within = (F.col("_file") == F.col("_f")) & (F.col("_block") > F.col("_from")) & (
        F.col("_to").isNull() | (F.col("_block") <= F.col("_to")))
    few = small_table(ranges, max_rows)
    if few is not None:
        return lines.join(few, within, "left").withColumn("_open", F.col("_f").isNotNull())
    numbered = lines.withColumn("_at", F.monotonically_increasing_id())
    blocks = lines.select("_file", "_block").distinct().join(ranges, within).select("_file", "_block", F.lit(True).alias("_open"))
    joined = numbered.join(blocks, ["_file", "_block"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    return joined.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_at")


# Pieces of a record that does not lie in one block, in their order within a block.
ENDS, GOES_ON, BEGINS = 0, 1, 2


def _cut(lines: DataFrame, sep: str) -> DataFrame:
    """Records of blocks: ``piece`` is null for a whole one, else what of it the block holds."""
    names = ["_file", "source_file", "_block", "piece", "value"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, held, early, out = None, START, [], False, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for file, name, block, begins, value, end in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, name, block) != place:
                    if held:
                        out.append((*place, GOES_ON if early else BEGINS, "".join(held)))
                    place, held, early = (file, name, block), [], begins
                    state = QUOTED if begins else START
                if '"' in value:
                    state = state_after(value, sep, state)
                if state == QUOTED:
                    held += [value, end]
                    continue
                out.append((*place, ENDS if early else None, "".join([*held, value])))
                held, early, state = [], False, START
            if len(out) >= 1024:
                yield made()
                out = []
        if held:
            out.append((*place, GOES_ON if early else BEGINS, "".join(held)))
        if out:
            yield made()

    rows = lines.select("_file", "source_file", "_block", "_open", "value", "_end")
    return rows.mapInArrow(run, "_file string, source_file string, _block bigint, piece int, value string")


def records(spark: SparkSession, paths: Sequence[str], sep: str, encoding: str = "UTF-8", multiline: bool | None = None,
            max_rows: int = 100_000) -> DataFrame:
    """Records of files (``value``, without the break that ends them) and their ``source_file``.

    Without ``multiline`` one pass looks at the lines with quotes first, and where no line can
    end inside a quoted cell every line is a record, cut without Python. ``False`` says so
    beforehand and saves the pass. A record that the end of a file leaves open loses its last
    line break, because readers of lines do not tell whether the file ends in one.
    """
    lines = located_lines(spark, paths, encoding)
    if multiline is False:
        return lines.select("value", "source_file")
    maps = materialize(block_maps(lines, sep), "quote-maps")
    if maps.filter("opens").isEmpty():
        return lines.select("value", "source_file")
    cut = _cut(_with_states(lines, open_ranges(maps), max_rows), sep)
    # Two pieces of a block at most; all others are whole.
    pieces = materialize(cut.filter("piece is not null"), "pieces")
    order = Window.partitionBy("_file").orderBy("_block", "piece").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.withColumn("_n", F.sum(F.when(F.col("piece") == BEGINS, 1).otherwise(0)).over(order))
    parts = F.sort_array(F.collect_list(F.struct("_block", "piece", "value")))
    joined = numbered.groupBy("_file", "source_file", "_n").agg(parts.alias("parts"))
    text = F.array_join(F.col("parts.value"), "")
    left_open = F.element_at(F.col("parts.piece"), -1) != ENDS
    joined = joined.select(F.when(left_open, F.regexp_replace(text, "(\r\n|\n|\r)\\z", "")).otherwise(text).alias("value"), "source_file")
    return cut.filter("piece is null").select("value", "source_file").unionByName(joined)
