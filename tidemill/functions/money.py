"""Sums of money that don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amounts have at most four decimals, so each is a whole number of these.
UNITS = 10_000


def units(amount: str = "amount") -> Column:
    return F.round(F.col(amount) * UNITS).cast("long")


def half_up(c: Column | str, places: int) -> Column:
    """Rounded half up by operations that any engine does alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10**places + 0.5) / 10**places
