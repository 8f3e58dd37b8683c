"""Number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(value: Column) -> Column:
    """Two decimals, half to even on the exact binary value.

    ``round`` and ``bround`` work on the shortest decimal text of the double
    and differ from this on values such as 0.285.
    """
    return F.call_function("format_number", value.cast("double"), F.lit("0.00")).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to two decimals, 0 when whole is not positive."""
    return F.when(whole > 0, round2(part / whole)).otherwise(F.lit(0.0))
