"""Logistic rating arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INITIAL_RATING = 1500.0
# Fixed value: strikes that one takedown or submission attempt is worth.
GRAPPLING_EVENT_WEIGHT = 5.0


@dataclass(frozen=True)
class RatingParams:
    k_early: float = 40.0
    k_late: float = 24.0
    early_contests: int = 5
    finish_bonus: float = 1.2


# The tuned parameters.
TUNED = RatingParams(k_early=64.0, k_late=48.0, early_contests=5, finish_bonus=1.4)


def expected_score(rating_a: Column, rating_b: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (rating_b - rating_a) / 400.0))


def striking_share(sig: Column, td: Column, sub: Column, ctrl: Column) -> Column:
    """Striking part of a contest in [0, 1]; one half when nothing was counted."""

    def num(value: Column) -> Column:
        return F.coalesce(value.cast("double"), F.lit(0.0))

    total = num(sig) + (GRAPPLING_EVENT_WEIGHT * (num(td) + num(sub)) + num(ctrl) / 60.0)
    return F.when(total == 0, F.lit(0.5)).otherwise(num(sig) / total)


def k_factor(count: Column, finish: Column, params: Column) -> Column:
    """K of a side from its contest count, times the bonus of a finish."""
    base = F.when(count < params["early_contests"], params["k_early"]).otherwise(params["k_late"])
    return base * F.when(finish, params["finish_bonus"]).otherwise(F.lit(1.0))


def score_of(winner: Column, side: str) -> Column:
    return F.when(winner == "draw", 0.5).when(winner == side, 1.0).otherwise(0.0)
