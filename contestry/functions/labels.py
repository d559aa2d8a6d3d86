"""Outcome and context labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contestry.functions.parsing import clean_text, strip

# Classes in match order, longer names before the names they contain.
WEIGHT_CLASSES = (
    "Women's Strawweight",
    "Women's Flyweight",
    "Women's Bantamweight",
    "Women's Featherweight",
    "Light Heavyweight",
    "Heavyweight",
    "Middleweight",
    "Welterweight",
    "Lightweight",
    "Featherweight",
    "Bantamweight",
    "Flyweight",
    "Strawweight",
    "Catch Weight",
    "Catchweight",
    "Open Weight",
)
# Result methods that make a contest without a winner a no-contest.
NO_CONTEST_METHODS = ("overturned", "could not continue", "dq")
METHODS = ("ko_tko", "submission", "decision")
FINISHES = ("ko_tko", "submission")
ROUND_CLASSES = ("1", "2", "3", "45")
DECISION_SUBTYPES = ("unanimous", "split", "majority")
DECISIVE = ("a", "b")
RATED = ("a", "b", "draw")


def first_match(pairs: list[tuple[Column, Column]]) -> Column:
    """Value of the first pair whose condition holds, else null."""
    head, *rest = pairs
    return reduce(lambda acc, pair: acc.when(*pair), rest, F.when(*head))


def plain_text(raw: Column) -> Column:
    """The text that the names below are looked for in."""
    return F.lower(clean_text(raw))


def method(raw: Column) -> Column:
    return method_in(plain_text(raw))


def method_in(text: Column) -> Column:
    """Method out of a ``plain_text``."""
    knockout = text.contains("ko/tko") | text.contains("doctor") | text.startswith("tko")
    return first_match(
        [
            (knockout, F.lit("ko_tko")),
            (text.contains("submission"), F.lit("submission")),
            (text.contains("decision"), F.lit("decision")),
        ]
    )


def decision_subtype(raw: Column) -> Column:
    return decision_subtype_in(plain_text(raw))


def decision_subtype_in(text: Column) -> Column:
    """Kind of decision out of a ``plain_text``."""
    kinds = first_match([(text.contains(kind), F.lit(kind)) for kind in DECISION_SUBTYPES])
    return F.when(text.contains("decision"), kinds)


def scheduled_rounds(raw: Column) -> Column:
    digits = F.regexp_extract(clean_text(raw), r"^(\d+)\s*Rnd", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def weight_class(raw: Column) -> Column:
    return weight_class_in(plain_text(raw))


def weight_class_in(text: Column) -> Column:
    """Class out of a ``plain_text``."""
    canonical = {"Catchweight": "Catch Weight"}
    known = F.array(*[F.struct(F.lit(n.lower()).alias("part"), F.lit(canonical.get(n, n)).alias("name")) for n in WEIGHT_CLASSES])
    return F.get(F.filter(known, lambda c: text.contains(c["part"])), F.lit(0))["name"]


def is_title(raw: Column) -> Column:
    return F.coalesce(F.lower(clean_text(raw)).contains("title"), F.lit(False))


def winner_code(winner_id: Column, id_a: Column, id_b: Column, raw_method: Column) -> Column:
    """a / b by id; without a winner nc or draw by method; an unknown winner is nc."""
    text = F.coalesce(F.lower(strip(raw_method)), F.lit(""))
    return (
        F.when(winner_id.isNull() & text.isin(*NO_CONTEST_METHODS), "nc")
        .when(winner_id.isNull(), "draw")
        .when(strip(winner_id) == id_a, "a")
        .when(strip(winner_id) == id_b, "b")
        .otherwise("nc")
    )


def is_finish(method_col: Column) -> Column:
    return F.coalesce(method_col.isin(*FINISHES), F.lit(False))


ROUND_SECONDS = 300


def finish_round(method_col: Column, last_round: Column) -> Column:
    return F.when(is_finish(method_col), last_round)


def duration_seconds(
    method_col: Column, last_round: Column, scheduled: Column, clock: Column
) -> Column:
    """Elapsed seconds with fixed-length rounds; full distance for decisions."""
    stopped = ((last_round - 1) * ROUND_SECONDS + clock).cast("double")
    distance = (scheduled * ROUND_SECONDS).cast("double")
    return F.coalesce(
        F.when(is_finish(method_col), stopped),
        F.when(method_col == "decision", distance),
        stopped,
    )


def round_bucket(round_col: Column) -> Column:
    return F.when(round_col >= 4, F.lit("45")).otherwise(round_col.cast("string"))


def inferred_rounds(title: Column, main_event: Column) -> Column:
    return F.when(F.coalesce(title | main_event, F.lit(False)), 5).otherwise(3)


def class_or_default(weight_class_col: Column) -> Column:
    return F.coalesce(F.nullif(weight_class_col, F.lit("")), F.lit("Lightweight"))
