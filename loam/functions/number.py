"""Numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def rounded(x: Column, digits: int) -> Column:
    """A double to some decimals, halves away from zero. What is rounded is the scaled double, as SQL engines do, and not the decimals
    that the double prints, as `round` does: 1.005 * 100 is 100.49999999999999, so it is 1.0 here and 1.01 there. What overflows stays."""
    scaled = F.round(x * 10.0**digits) / 10.0**digits
    return let(scaled, lambda r: F.when(F.isnan(r) | (F.abs(r) == float("inf")), x).otherwise(r))
