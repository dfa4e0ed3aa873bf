"""Numbers: rounding that does not depend on how an engine prints a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: str | Column, digits: int) -> Column:
    """Half away from zero on ``value * 10**digits`` in double arithmetic.

    Spark's own round works on the shortest decimal text of a double, which moves values
    such as 2.0235 (in binary just below the tie) up; this rounds what the double holds."""
    column = F.col(value) if isinstance(value, str) else value
    unit = F.lit(float(10**digits))
    return F.round(column * unit) / unit
