"""Rounding, signed text and a repeatable pseudo-random number, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_DIGITS = 13  # 52 bits: a double holds them exactly


def unit(id_col: Column | str, label: str | int | Column) -> Column:
    """A number in [0, 1) fixed by (id, label), the same under any partitioning.

    It is the head of an MD5 sum, so numbers of different ids or labels are independent
    of each other for all that matters here.
    """
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    name = label if isinstance(label, Column) else F.lit(str(label))
    digest = F.md5(F.concat(ident.cast("string"), F.lit(":"), name.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def half_up(x: Column, digits: int) -> Column:
    """Round half away from zero in plain double arithmetic, so engines agree at ties."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * (F.floor(F.abs(x) * scale + F.lit(0.5)).cast("double") / scale)


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text of an already rounded value; minus zero prints as zero."""
    return F.format_string(f"%.{digits}f", half_up(x, digits) + F.lit(0.0))


def signed_fixed(x: Column, digits: int) -> Column:
    """Fixed-point text with a plus sign for positive values only."""
    return F.concat(F.when(x > 0, F.lit("+")).otherwise(F.lit("")), fixed(x, digits))


def percent_of(delta: Column, base: Column, if_zero: Column) -> Column:
    """``delta`` in percent of ``base``; ``if_zero`` is used where ``base`` is not positive."""
    return F.when(base > 0, delta / base * 100).otherwise(if_zero)


def clamp(value: Column, low: float, high: float) -> Column:
    """Bring an input into [low, high]; missing and zero count as ``low``."""
    filled = F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(float(low)))
    return F.greatest(F.least(filled, F.lit(float(high))), F.lit(float(low)))
