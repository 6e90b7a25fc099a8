"""Helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\r\n\u000b\u000c \u0085  　"
BOM = "﻿"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quoted(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col(f"`{name}`")


def strip(c: Column | str) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.trim(as_column(c), F.lit(BLANKS))


def collapse_blanks(c: Column | str) -> Column:
    return strip(F.regexp_replace(as_column(c), rf"[{BLANKS}]+", " "))


def lookup(table: Mapping, key: Column | str) -> Column:
    """Value of ``key`` in a fixed table, NULL when absent."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), as_column(key))


def lookup_list(table: Mapping[str, list[str]], key: Column | str) -> Column:
    pairs: list[Column] = []
    for name, values in table.items():
        pairs += [F.lit(name), F.array(*[F.lit(v) for v in values])]
    return F.try_element_at(F.create_map(*pairs), as_column(key))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def round_half_up(c: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(c + F.lit(0.5))
