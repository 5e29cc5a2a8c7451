"""Predicates on valid time (inclusive ends, null open) and system time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_at(day: str) -> Column:
    d = F.lit(day).cast("date")
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d))


def still_valid(day: str, historical: bool = False) -> Column:
    return F.lit(True) if historical else F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(day).cast("date"))


def known() -> Column:
    """Not superseded: what the system holds to be true now."""
    return F.col("superseded_on").isNull()
