"""Sentences that explain a verdict, built in the JVM.

Numbers round half to even before formatting, so 2.5 reads "2" at no decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(v: Column, digits: int = 0, signed: bool = False) -> Column:
    sign, v = "+" if signed else "", v.cast("double")
    # Rounding the size keeps the sign of a small negative number ("-0.0").
    rounded = F.when(v < 0, -F.bround(-v, digits)).otherwise(F.bround(v, digits))
    return F.format_string(f"%{sign}.{digits}f", rounded)


def words(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def reasons(*parts: Column) -> Column:
    """Ordered list of the sentences that apply; a NULL part is left out."""
    return F.array_compact(F.array(*parts))


def joined(*lists: Column) -> Column:
    """Concatenate lists, reading NULL as empty."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(x, empty) for x in lists])
