"""Probability arithmetic shared by scoring and evaluation."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def clipped(p: Column, eps: float = EPSILON) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def log_loss_term(y: Column, p: Column) -> Column:
    q = clipped(p)
    return -(y * F.ln(q) + (1.0 - y) * F.ln(1.0 - q))


def brier_term(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def hit(y: Column, p: Column) -> Column:
    """1 where the side with p >= 0.5 won; a tie picks the first side."""
    return ((p >= 0.5) == (y == 1.0)).cast("double")


def normalised(weights: Mapping[str, Column], fallback: Mapping[str, Column]) -> dict[str, Column]:
    """Weights over their sum, or the fallback where the sum is not positive."""
    total = reduce(add, weights.values())
    return {
        name: F.when(total > 0, weight / total).otherwise(fallback[name])
        for name, weight in weights.items()
    }


def prior_corrected(probs: Mapping[str, Column], factors: Mapping[str, Column]) -> dict[str, Column]:
    """p(c) * factor(c), renormalised; unchanged where all products vanish."""
    return normalised({c: p * factors[c] for c, p in probs.items()}, probs)


def mask_long_rounds(probs: Mapping[str, Column], scheduled: Column) -> dict[str, Column]:
    """Class "45" cannot happen in a contest of at most three rounds."""
    short = F.coalesce(scheduled, F.lit(3)) <= 3
    kept = {c: (F.when(short, 0.0).otherwise(p) if c == "45" else p) for c, p in probs.items()}
    return normalised(kept, kept)
