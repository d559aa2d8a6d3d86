"""Quotes to implied probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_implied(odds: Column) -> Column:
    return 1.0 / odds


def american_implied(odds: Column) -> Column:
    zero = F.raise_error(F.lit("American odds cannot be 0")).cast("double")
    return (
        F.when(odds > 0, 100.0 / (odds + 100.0))
        .when(odds < 0, -odds / (-odds + 100.0))
        .when(odds == 0, zero)
    )


def devig(p_first: Column, p_second: Column) -> tuple[Column, Column]:
    """Share the margin in proportion so the two sides sum to one."""
    return p_first / (p_first + p_second), p_second / (p_first + p_second)
