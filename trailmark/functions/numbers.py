"""Rounding that does not depend on the order of partial sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_round(c: Column, decimals: int) -> Column:
    """Round through 10 decimals first.

    Partial sums of doubles arrive in any order, so a value on a rounding edge
    may differ in its last bits from run to run; the first rounding removes that.
    """
    return F.round(F.round(c, 10), decimals)
