"""Numbers from text, feature cleaning and number formatting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.common import as_column, is_numeric, quoted, strip

_DIGITS = r"[0-9]+(_[0-9]+)*"
_NUMBER = (
    rf"(?i)^[+-]?({_DIGITS}([.]({_DIGITS})?)?([e][+-]?{_DIGITS})?|[.]{_DIGITS}([e][+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)


def parse_number(c: Column | str) -> Column:
    """Text to double: digits with optional ``_`` separators, exponents, inf and nan.

    NULL for anything else. Suffixed forms such as ``1.0d`` are not numbers.
    """
    text = strip(c)
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def safe_double(c: Column | str, default: float = 0.0, rule: str = "plain") -> Column:
    """Text to double with a default for missing or unreadable values.

    ``plain``  blank or ``-`` is missing, no thousands separators.
    ``comma``  as plain, and a value that fails is read again without commas.
    ``clean``  as comma, and ``nan``, ``inf`` and ``-inf`` are missing too.
    """
    if rule not in ("plain", "comma", "clean"):
        raise ValueError(f"unknown rule: {rule}")
    text = strip(c)
    # A readable number has no comma, so one attempt without commas covers both.
    value = parse_number(text if rule == "plain" else F.replace(text, F.lit(","), F.lit("")))
    if rule == "clean":
        value = F.when(~F.lower(text).isin("nan", "inf", "-inf"), value)
    return F.coalesce(value, F.lit(float(default)))


def safe_int(c: Column | str, default: int = 0, rule: str = "plain") -> Column:
    """Text to whole number, truncated toward zero."""
    return F.coalesce(
        safe_double(c, float(default), rule).try_cast("bigint"), F.lit(default).cast("bigint")
    )


def number_of(df: DataFrame, names: Iterable[str], default: float = 0.0) -> Column:
    """The first named column that has a value, as double.

    A value that is present but unreadable gives the default; it does not fall through
    to the next name.
    """
    branches = None
    for name in [n for n in names if n in df.columns]:
        column = quoted(name)
        if is_numeric(df, name):
            present, value = column.isNotNull(), column.cast("double")
        else:
            present = column.isNotNull() & ~strip(column).isin("", "-")
            value = safe_double(column, default, "comma")
        branches = F.when(present, value) if branches is None else branches.when(present, value)
    missing = F.lit(float(default))
    return missing if branches is None else branches.otherwise(missing)


def finite_or_zero(c: Column) -> Column:
    value = c.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def clean_features(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Infinities, NaN and NULL become 0 in the named columns."""
    return df.withColumns({n: finite_or_zero(quoted(n)) for n in names})


def coerce_numeric(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Named columns as double; unreadable or missing values become 0."""
    out = {}
    for n in names:
        value = quoted(n).cast("double") if is_numeric(df, n) else parse_number(quoted(n))
        out[n] = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))
    return df.withColumns(out)


def format_bytes(c: Column | str, decimals: int = 1) -> Column:
    """Byte count as text with a unit from B to TB (base 1024)."""
    size = as_column(c).cast("double")
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")])
    power = F.least(F.floor(F.log(size) / F.log(F.lit(1024.0))), F.lit(4)).cast("int")
    scaled = F.format_string(f"%.{decimals}f", size / F.pow(F.lit(1024.0), power))
    return F.when(size.isNull() | (size <= 0), F.lit("0 B")).otherwise(
        F.concat_ws(" ", scaled, F.get(units, power))
    )


def format_date(c: Column | str, pattern: str = "dd/MM/yyyy h:mm a") -> Column:
    return F.coalesce(F.date_format(as_column(c), pattern), F.lit("—"))
