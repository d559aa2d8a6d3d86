"""Metrics of probabilities and labels, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.probability import brier_term, hit, log_loss_term
from contestry.operators.dataset import one_row


def winner_metrics(scored: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """Count, accuracy, log-loss and Brier score, per group if any."""
    outcome, prob = F.col(y), F.col(p)
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(hit(outcome, prob)).alias("accuracy"),
        F.avg(log_loss_term(outcome, prob)).alias("log_loss"),
        F.avg(brier_term(outcome, prob)).alias("brier"),
    )


def baseline_ladder(scored: DataFrame) -> DataFrame:
    """Coin flip, higher-rating pick and rating probability, side by side.

    The pick turns ``p > 0.5`` into a hard 0/1, so an even contest goes to side
    b there and to side a in the probability's own accuracy.
    """
    p = F.col("p")
    models = F.array(
        F.struct(F.lit("coin_flip").alias("model"), F.lit(0.5).alias("q")),
        F.struct(F.lit("higher_elo").alias("model"), (p > 0.5).cast("double").alias("q")),
        F.struct(F.lit("elo").alias("model"), p.alias("q")),
    )
    metrics = winner_metrics(scored.select("y", F.inline(models)), "model", p="q")
    hard = F.col("model") == "higher_elo"
    return metrics.withColumns(
        {c: F.when(~hard, F.col(c)) for c in ("log_loss", "brier")}
    )


def macro_f1(labelled: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Unweighted mean F1 over all labels seen as truth or prediction."""
    t, q = F.col(truth), F.col(predicted)
    cells = labelled.groupBy(t.alias("t"), q.alias("q")).agg(F.count("*").alias("n"))
    per_label = (
        cells.select(
            "n",
            (F.col("t") == F.col("q")).alias("same"),
            F.explode(F.array("t", "q")).alias("label"),
        )
        .groupBy("label")
        .agg(F.sum("n").alias("n_seen"), F.sum(F.when(F.col("same"), F.col("n"))).alias("n_same"))
    )
    # Each cell counts once for its true and once for its predicted label, so the
    # sum is 2tp + fp + fn and the agreeing part is 2tp.
    score = F.coalesce("n_same", F.lit(0)) / F.col("n_seen")
    f1 = per_label.agg(F.avg(score).alias("macro_f1"))
    hits = cells.agg(
        F.sum("n").alias("n"), (F.sum(F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")
    )
    return one_row(hits, f1)


def majority_class(df: DataFrame, column: str) -> DataFrame:
    """The commonest value; the smallest one of a tie."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).count()
    return counts.orderBy(F.desc("count"), "label").limit(1).select("label")


def majority_baseline(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Accuracy and macro-F1 of always answering the training majority."""
    answer = majority_class(train, column).scalar()
    known = test.filter(F.col(column).isNotNull()).select(F.col(column).alias("truth"))
    return macro_f1(known.withColumn("majority", answer), "truth", "majority")


N_BINS = 10


def right_closed_bin(p: Column, n_bins: int = N_BINS) -> Column:
    """Bin number with edges belonging to the lower bin; zero is in bin 0."""
    edges = [i / n_bins for i in range(1, n_bins)]
    passed = [F.when(p > edge, 1).otherwise(0) for edge in edges]
    total = passed[0]
    for one in passed[1:]:
        total = total + one
    return total


def bin_label(index: Column, n_bins: int = N_BINS) -> Column:
    low = F.format_string("%.1f", index / n_bins)
    high = F.format_string("%.1f", (index + 1) / n_bins)
    return F.concat(F.lit("["), low, F.lit(", "), high, F.lit(")"))


def calibration_table(scored: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """Ten bins of predicted probability; empty bins stay, with null means."""
    binned = scored.groupBy(*by, right_closed_bin(F.col(p)).alias("bin_index")).agg(
        F.count("*").alias("count"), F.avg(p).alias("mean_pred"), F.avg(y).alias("empirical_rate")
    )
    bins = F.explode(F.sequence(F.lit(0), F.lit(N_BINS - 1))).alias("bin_index")
    groups = scored.select(*by).distinct() if by else scored.agg(F.count("*").alias("_n"))
    frame = groups.select(*by, bins)
    full = frame.join(binned, [*by, "bin_index"], "left")
    return full.select(
        *by,
        bin_label(F.col("bin_index")).alias("bin"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.round("mean_pred", 4).alias("mean_pred"),
        F.round("empirical_rate", 4).alias("empirical_rate"),
    )


def histogram(df: DataFrame, column: str, n_bins: int = 20) -> DataFrame:
    """Counts of values clipped to [0, 1], left-closed bins, the last one closed."""
    value = F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(1.0))
    index = F.least(F.floor(value * n_bins), F.lit(n_bins - 1)).cast("int")
    counts = df.groupBy(index.alias("bin_index")).agg(F.count("*").alias("n"))
    bins = df.agg(F.count("*").alias("_n")).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin_index")
    )
    joined = bins.join(counts, "bin_index", "left")
    return joined.select(
        F.format_string("%.2f", F.col("bin_index") / n_bins).alias("edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def compare(scored: DataFrame, first: str, second: str, y: str = "y") -> DataFrame:
    """Metrics of two probabilities on the same rows, their differences, and a gate.

    A log-loss better than the second's by more than 0.02 is implausible.
    """
    both = F.array(
        *[F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in (first, second)]
    )
    m = winner_metrics(scored.select(F.col(y).alias("y"), F.inline(both)), "model")
    of = {
        c: [F.max(F.when(F.col("model") == name, F.round(c, 4))).alias(f"{name}_{c}") for name in (first, second)]
        for c in ("accuracy", "log_loss", "brier")
    }
    wide = m.agg(F.max("n").alias("n"), *[col for cols in of.values() for col in cols])
    deltas = {
        f"delta_{c}": F.round(F.col(f"{first}_{c}") - F.col(f"{second}_{c}"), 4) for c in of
    }
    return wide.withColumns(deltas).withColumn("implausible", F.col("delta_log_loss") < -0.02)


def fixed_rows(df: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    """Every row once per value of a short fixed list."""
    return df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
