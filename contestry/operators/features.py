"""Model-ready features: one row per decisive contest, first side minus second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.labels import round_bucket
from contestry.operators.careers import STAT_NAMES
from contestry.operators.dataset import decisive, one_row, sides

ELO_COLUMNS = ("pre_overall", "pre_striking", "pre_grappling", "pre_fights")
# Source column -> stem of its difference column.
DIFF_STEMS = {name: name for name in STAT_NAMES} | {
    "pre_overall": "elo",
    "pre_striking": "striking_elo",
    "pre_grappling": "grappling_elo",
    "pre_fights": "elo_fights",
    "height_cm": "height",
    "reach_cm": "reach",
    "age": "age",
}
PER_SIDE = ("age", "career_fights", "reach_missing", "dob_missing", "southpaw", "debut")
IDENTIFIERS = ("contest_id", "date", "swapped")
TARGETS = ("y_winner", "y_method", "y_finish_round")
# Flags that only tell the era apart; left out of the scaled inputs.
DROPPED = ("reach_missing_a", "reach_missing_b", "dob_missing_a", "dob_missing_b")


def swap_side(contest_id: Column) -> Column:
    """A stable coin flip per contest: parity of its md5."""
    return F.substring(F.md5(contest_id), 32, 1).isin(*"13579bdf")


def by_contest(long: DataFrame, fields: tuple[str, ...], label: str) -> DataFrame:
    """Two side rows per contest to the structs ``label_a`` and ``label_b``."""
    packed = F.struct(*fields)
    return long.groupBy("contest_id").agg(
        *[
            F.first(F.when(F.col("side") == s, packed), ignorenulls=True).alias(f"{label}_{s}")
            for s in "ab"
        ]
    )


def side_frame(
    contests: DataFrame, competitors: DataFrame, ratings: DataFrame, history: DataFrame
) -> DataFrame:
    """Decisive contests with the structs side_a and side_b.

    Biographies join the narrow side rows by competitor; ratings and history are
    folded to one row per contest first, so all further joins share one
    partitioning by contest_id.
    """
    chosen = decisive(contests)
    bios = sides(chosen).join(
        competitors.select("competitor_id", "height_cm", "reach_cm", "stance", "dob"), "competitor_id", "left"
    )
    joined = (
        chosen.join(by_contest(bios, ("height_cm", "reach_cm", "stance", "dob"), "bio"), "contest_id", "left")
        .join(by_contest(ratings, ELO_COLUMNS, "elo"), "contest_id", "left")
        .join(by_contest(history, STAT_NAMES, "career"), "contest_id", "left")
    )
    return joined.select(*chosen.columns, *[_side_struct(s) for s in "ab"])


def _side_struct(side: str) -> Column:
    bio, elo, career = (F.col(f"{label}_{side}") for label in ("bio", "elo", "career"))
    age = F.datediff("date", bio["dob"]) / 365.25
    return F.struct(
        *[career[c].alias(c) for c in STAT_NAMES],
        *[elo[c].alias(c) for c in ELO_COLUMNS],
        bio["height_cm"].alias("height_cm"),
        bio["reach_cm"].alias("reach_cm"),
        age.alias("age"),
        bio["reach_cm"].isNull().alias("reach_missing"),
        bio["dob"].isNull().alias("dob_missing"),
        F.coalesce(bio["stance"] == "Southpaw", F.lit(False)).alias("southpaw"),
        (F.coalesce(career["career_fights"], F.lit(0)) == 0).alias("debut"),
    ).alias(f"side_{side}")


def matchup_columns(first: Column, second: Column) -> list[Column]:
    """Difference, per-side and pair columns of two side structs."""
    diffs = [
        (first[source].cast("double") - second[source].cast("double")).alias(f"{stem}_diff")
        for source, stem in DIFF_STEMS.items()
    ]
    each = [
        side[name].alias(f"{name}_{letter}")
        for letter, side in (("a", first), ("b", second))
        for name in PER_SIDE
    ]
    return [
        *diffs,
        *each,
        (first["debut"] != second["debut"]).alias("debut_matchup"),
        (first["southpaw"] != second["southpaw"]).alias("stance_mismatch"),
    ]


def build_features(
    contests: DataFrame, competitors: DataFrame, ratings: DataFrame, history: DataFrame
) -> DataFrame:
    frame = side_frame(contests, competitors, ratings, history).withColumn(
        "swapped", swap_side(F.col("contest_id"))
    )
    swapped = F.col("swapped")
    oriented = frame.withColumns(
        {
            "first": F.when(swapped, F.col("side_b")).otherwise(F.col("side_a")),
            "second": F.when(swapped, F.col("side_a")).otherwise(F.col("side_b")),
        }
    )
    won = F.when(swapped, F.col("winner") == "b").otherwise(F.col("winner") == "a")
    return oriented.select(
        "contest_id",
        "date",
        "swapped",
        won.cast("int").alias("y_winner"),
        F.col("method").alias("y_method"),
        round_bucket(F.col("finish_round")).alias("y_finish_round"),
        "weight_class",
        "title_fight",
        "scheduled_rounds",
        *matchup_columns(F.col("first"), F.col("second")),
    )


def model_inputs(features: DataFrame) -> list[str]:
    """The columns a model sees: everything but identifiers and targets."""
    return [c for c in features.columns if c not in IDENTIFIERS + TARGETS]


def numeric_inputs(features: DataFrame) -> list[str]:
    """The scaled numeric inputs."""
    return [c for c in model_inputs(features) if c != "weight_class" and c not in DROPPED]


def feature_frame(features: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Inputs as doubles, the category as its index (0 when unknown)."""
    numeric = [F.col(c).cast("double").alias(c) for c in model_inputs(features) if c != "weight_class"]
    if categories is None:
        return features.select("contest_id", *numeric)
    indexed = features.join(categories, "weight_class", "left")
    index = F.coalesce("weight_class_index", F.lit(0)).alias("weight_class_index")
    return indexed.select("contest_id", index, *numeric)


def truncation_differences(full: DataFrame, truncated: DataFrame, cutoff) -> DataFrame:
    """Rows before ``cutoff`` that differ between the two builds; must be empty."""
    old = full.filter(F.col("date") < cutoff)
    cut = truncated.filter(F.col("date") < cutoff)
    return old.exceptAll(cut).withColumn("only_in", F.lit("full")).unionByName(
        cut.exceptAll(old).withColumn("only_in", F.lit("truncated"))
    )


def feature_checks(features: DataFrame, contests: DataFrame) -> DataFrame:
    """Row count against the decisive contests, and balance of the swapped target."""
    rows = features.agg(F.count("*").alias("n_features"), F.avg("y_winner").alias("target_mean"))
    return one_row(rows, decisive(contests).agg(F.count("*").alias("n_decisive")))
