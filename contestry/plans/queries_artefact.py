"""Registered queries of the stored outcome models: training results, checks, cards, held-out evaluation.

Every query scores with models read back from the artefact's folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.operators import artefact, dataset, evaluation, explain, features, learn, predictions
from contestry.plans.oracle import r6 as q6
from contestry.plans.queries_models import _metrics_sql
from contestry.plans.queries_tables import scored_table
from contestry.plans.registry import TEST_START, TODAY, TRAIN_END, VAL, Tables, register, rounded
from contestry.session import materialise, scratch_path

VERSION = f"trained-before-{TRAIN_END}"
_SPLITS = {"train_end": TRAIN_END, "val": VAL, "test_start": TEST_START}
_TASKS = ", ".join(f"('{task}', '{column}')" for task, (column, _) in artefact.TASKS.items())


def models_of(t: Tables) -> artefact.OutcomeModels:
    """The artefact of these tables, fitted and stored once a session, as read back from its folder."""

    def build():
        parts = [learn.split(t.features, part, **_SPLITS) for part in ("train", "val")]
        folder = artefact.fit(*parts, VERSION).save(t.spark, scratch_path(t.spark, "outcome-models"))
        return artefact.load(t.spark, folder)

    return t.stored("outcome-models", build)


def _prepared(t: Tables) -> DataFrame:
    """All feature rows with both input vectors, stored once."""
    return t.stored("prepared-features", lambda: materialise(models_of(t).prepared(t.features), "prepared-features"))


def _part(t: Tables, part: str) -> DataFrame:
    return learn.split(_prepared(t), part, **_SPLITS)


def _y(df: DataFrame) -> DataFrame:
    return df.withColumn("y", F.col("y_winner").cast("double"))


# --- what training gives ---------------------------------------------------------------------


@register("winner_model")
def _(t: Tables):
    return evaluation.winner_metrics(_y(models_of(t).boosted_winner(_part(t, "val"))))


@register("feature_importances")
def _(t: Tables):
    models = models_of(t)
    return learn.importances(models.boosted["winner"], models.names, t.features, k=len(models.names))


def _class_results(t: Tables, task: str, part: str) -> DataFrame:
    """Each model of a task and the training majority: macro-F1, accuracy, log-loss (the majority's: of the training shares)."""
    models, (column, classes) = models_of(t), artefact.TASKS[task]
    known = _part(t, part).filter(F.col(column).isNotNull())
    train = learn.split(t.features, "train", **_SPLITS)
    truth = F.col(column)

    def row(name: str, scored: DataFrame, chance: dict[str, Column]) -> DataFrame:
        own = reduce(lambda rest, c: F.when(truth == c, chance[c]).otherwise(rest), classes, F.lit(None))
        own = -F.ln(F.greatest(own, F.lit(1e-12)))
        stored = scored.select(truth.alias("truth"), "predicted", own.alias("loss"))
        both = dataset.one_row(evaluation.macro_f1(stored, "truth", "predicted"), stored.agg(F.avg("loss").alias("log_loss")))
        return both.select(F.lit(task).alias("task"), F.lit(name).alias("model"), "n", "accuracy", "macro_f1", "log_loss")

    columns = {c: F.col(f"p_{c}") for c in classes}
    answer = evaluation.majority_class(train, column).first()["label"]
    shares = {r["label"]: r["n"] for r in train.filter(truth.isNotNull()).groupBy(truth.alias("label")).agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    return reduce(
        DataFrame.unionByName,
        [
            row("boosted", models.boosted_classes(known, task), columns),
            row("ensemble", models.linear_classes(known, task), columns),
            row("majority", known.withColumn("predicted", F.lit(answer)), {c: F.lit(shares.get(c, 0) / total) for c in classes}),
        ],
    )


@register("method_model")
def _(t: Tables):
    return _class_results(t, "method", "val")


@register("finish_round_model")
def _(t: Tables):
    return _class_results(t, "finish_round", "val")


@register("ensemble")
def _(t: Tables):
    scored = materialise(_y(models_of(t).ensemble_winner(_part(t, "val"))).select("y", "winner_prob", "winner_spread"), "ensemble-scores")
    return dataset.one_row(evaluation.winner_metrics(scored, p="winner_prob"), scored.agg(F.avg("winner_spread").alias("mean_spread")))


# --- checks that hold for every row ------------------------------------------------------------

_INPUTS = ["weight_class", "title_fight", "scheduled_rounds", *[f"{s}_diff" for s in features.DIFF_STEMS.values()]]
_INPUTS += [f"{n}_{s}" for s in "ab" for n in features.PER_SIDE] + ["debut_matchup", "stance_mismatch"]


def _unit(p: Column) -> Column:
    return p.between(0.0, 1.0)


@register(
    "importance_checks",
    "SELECT feature, true AS in_range, 1.0::DOUBLE AS total, (SELECT count(*) FROM train) AS n_train FROM (VALUES "
    + ", ".join(f"('{c}')" for c in _INPUTS)
    + ") v(feature)",
)
def _(t: Tables):
    models = models_of(t)
    found = learn.importances(models.boosted["winner"], models.names, t.features, k=len(models.names))
    total = found.agg(F.sum("importance").alias("total"))
    counted = learn.split(t.features, "train", **_SPLITS).agg(F.count("*").alias("n_train"))
    listed = found.select("feature", _unit(F.col("importance")).alias("in_range"))
    return rounded(listed.join(F.broadcast(dataset.one_row(total, counted)), F.lit(True)))


@register(
    "winner_model_checks",
    "SELECT contest_id, true AS in_range, CAST(5 AS BIGINT) AS n_members, true AS mean_of_members, true AS spread_of_members FROM features",
)
def _(t: Tables):
    models = models_of(t)
    scored = models.ensemble_winner(models.boosted_winner(_prepared(t)), members=True)
    each = F.col("members")
    low, high = F.array_min(each), F.array_max(each)
    mean = F.aggregate(each, F.lit(0.0), lambda a, p: a + p) / F.size(each)
    return rounded(
        scored.select(
            "contest_id",
            (_unit(F.col("p")) & _unit(low) & _unit(high)).alias("in_range"),
            F.size(each).alias("n_members"),
            ((F.abs(F.col("winner_prob") - mean) < 1e-9) & F.col("winner_prob").between(low - 1e-9, high + 1e-9)).alias("mean_of_members"),
            (F.abs(F.col("winner_spread") - (high - low)) < 1e-9).alias("spread_of_members"),
        )
    )


@register(
    "class_model_checks",
    f"""SELECT contest_id, task, model, true AS in_range, true AS sums_to_one, true AS likeliest,
               CASE WHEN task = 'finish_round' AND coalesce(scheduled_rounds, 3) <= 3 THEN true END AS no_late_round
        FROM features CROSS JOIN (VALUES {_TASKS}) v(task, target) CROSS JOIN (VALUES ('boosted'), ('ensemble')) w(model)""",
)
def _(t: Tables):
    models, rows = models_of(t), []
    for task, (_, classes) in artefact.TASKS.items():
        for name, scored in (("boosted", models.boosted_classes(_prepared(t), task)), ("ensemble", models.linear_classes(_prepared(t), task))):
            each = F.array(*[F.col(f"p_{c}") for c in classes])
            chosen = reduce(lambda rest, c: F.when(F.col("predicted") == c, F.col(f"p_{c}")).otherwise(rest), classes, F.lit(None))
            late = F.when((F.lit(task) == "finish_round") & (F.coalesce("scheduled_rounds", F.lit(3)) <= 3), F.col(f"p_{classes[-1]}") == 0.0)
            rows.append(
                scored.select(
                    "contest_id",
                    F.lit(task).alias("task"),
                    F.lit(name).alias("model"),
                    F.forall(each, _unit).alias("in_range"),
                    (F.abs(F.aggregate(each, F.lit(0.0), lambda a, p: a + p) - 1.0) < 1e-9).alias("sums_to_one"),
                    (chosen == F.array_max(each)).alias("likeliest"),
                    late.alias("no_late_round"),
                )
            )
    return reduce(DataFrame.unionByName, rows)


# --- explanations of the stored winner model ---------------------------------------------------------


def _parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each contest's parts of the boosted winner's log-odds, as listed and with sides exchanged, stored once."""
    models = models_of(t)

    def build() -> tuple[DataFrame, DataFrame]:
        leaves = materialise(explain.leaf_parts(t.spark, f"{models.folder}/boosted/winner", models.names), "leaf-parts")
        rows = (_prepared(t), models.prepared(explain.turned(t.features)))
        model = models.boosted["winner"].copy().setFeaturesCol(artefact.TREES)
        return tuple(materialise(explain.contributions(model, r, leaves), "parts") for r in rows)

    return t.stored("winner-parts", build)


@register(
    "contribution_checks",
    "SELECT contest_id, true AS adds_up, true AS turned_adds_up, true AS symmetrised_adds_up FROM features",
)
def _(t: Tables):
    """Parts of both orientations against the log-odds the model gives, and their halved difference."""
    models, (forward, backward) = models_of(t), _parts(t)

    def odds(rows: DataFrame, name: str) -> DataFrame:
        p = F.col("p")
        return models.boosted_winner(models.prepared(rows)).select("contest_id", (F.ln(p) - F.ln(1.0 - p)).alias(name))

    def total(parts: DataFrame, column: str, name: str) -> DataFrame:
        return parts.groupBy("contest_id").agg(F.sum(column).alias(name))

    halves = explain.symmetrised(forward, backward)
    both = odds(t.features, "ab").join(odds(explain.turned(t.features), "ba"), "contest_id")
    both = both.join(total(forward, "part", "sum_ab"), "contest_id", "left").join(total(backward, "part", "sum_ba"), "contest_id", "left")
    both = both.join(total(halves, "contribution", "sum_half"), "contest_id", "left")
    half = F.coalesce("sum_half", F.lit(0.0))
    return both.select(
        "contest_id",
        (F.abs(F.col("ab") - F.col("sum_ab")) < 1e-6).alias("adds_up"),
        (F.abs(F.col("ba") - F.col("sum_ba")) < 1e-6).alias("turned_adds_up"),
        (F.abs((F.col("ab") - F.col("ba")) / 2 - half) < 1e-6).alias("symmetrised_adds_up"),
    )


@register("model_factors")
def _(t: Tables):
    """The six strongest parts of every contest, in words, with the side each favours."""
    a, b, size = F.col("competitor_a_id"), F.col("competitor_b_id"), F.abs("contribution")
    swapped = features.swap_side(F.col("contest_id"))
    names = dataset.decisive(t.contests).select(
        "contest_id", F.when(swapped, b).otherwise(a).alias("first"), F.when(swapped, a).otherwise(b).alias("second")
    )
    label = F.create_map(*[F.lit(v) for pair in learn.FEATURE_LABELS.items() for v in pair])[F.col("feature")]
    top = explain.strongest(explain.symmetrised(*_parts(t)))
    return top.join(names, "contest_id").select(
        "contest_id",
        "rank",
        F.coalesce(label, "feature").alias("label"),
        "contribution",
        F.when(F.col("contribution") >= 0, F.col("first")).otherwise(F.col("second")).alias("favors"),
        F.when(size > 0.3, "strong").when(size > 0.1, "moderate").otherwise("slight").alias("strength"),
    )


# --- held-out evaluation of the stored models ----------------------------------------------------


def _final(t: Tables) -> DataFrame:
    """Every model and baseline on the test split; nothing is fitted here."""
    models = models_of(t)

    def build() -> DataFrame:
        test = _y(_part(t, "test"))
        ladder = evaluation.baseline_ladder(learn.split(scored_table(t), "test", **_SPLITS))
        trained = {"boosted": (models.boosted_winner(test), "p"), "ensemble": (models.ensemble_winner(test), "winner_prob")}
        winner = [ladder] + [evaluation.winner_metrics(df, p=p).withColumn("model", F.lit(name)) for name, (df, p) in trained.items()]
        parts = [reduce(DataFrame.unionByName, winner).withColumn("task", F.lit("winner"))]
        parts += [_class_results(t, task, "test") for task in artefact.TASKS]
        return materialise(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "final-evaluation")

    return t.stored("final-evaluation", build)


@register("final_evaluation")
def _(t: Tables):
    return _final(t).select("task", "model", "n", "accuracy", "macro_f1", "log_loss", "brier")


def _majority_sql(task: str, column: str) -> str:
    return f"""
SELECT '{task}' AS task, 'majority' AS model, count(*) AS n, {q6(f"avg(CASE WHEN {column} = m THEN 1.0 ELSE 0.0 END)")} AS accuracy,
       {q6(f"2.0 * count(*) FILTER ({column} = m) / (count(*) FILTER ({column} = m) + count(*)) / (count(DISTINCT {column}) + CASE WHEN count(*) FILTER ({column} = m) = 0 THEN 1 ELSE 0 END)")} AS macro_f1,
       NULL AS brier, true AS in_bounds
FROM test, (SELECT {column} AS m FROM train WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) WHERE {column} IS NOT NULL"""


_TRAINED_SQL = " UNION ALL ".join(
    f"SELECT '{task}', '{model}', count({column}), NULL, NULL, NULL, true FROM test"
    for task, column in (("winner", "y_winner"), *((k, c) for k, (c, _) in artefact.TASKS.items()))
    for model in ("boosted", "ensemble")
)


@register(
    "final_evaluation_checks",
    f"""WITH test AS (SELECT * FROM features WHERE date >= DATE '{TEST_START}'),
        {", ".join(f"majority_{k} AS ({_majority_sql(k, c)})" for k, (c, _) in artefact.TASKS.items())}
        SELECT 'winner' AS task, model, n, accuracy, NULL AS macro_f1, CASE WHEN model <> 'higher_elo' THEN brier END AS brier, true AS in_bounds
        FROM (SELECT model, {_metrics_sql('q')} FROM (
                SELECT 'coin_flip' AS model, y, 0.5 AS q FROM scored WHERE date >= DATE '{TEST_START}'
                UNION ALL SELECT 'higher_elo', y, CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END FROM scored WHERE date >= DATE '{TEST_START}'
                UNION ALL SELECT 'elo', y, p FROM scored WHERE date >= DATE '{TEST_START}') GROUP BY model)
        UNION ALL {" UNION ALL ".join(f"SELECT * FROM majority_{k}" for k in artefact.TASKS)}
        UNION ALL {_TRAINED_SQL}""",
)
def _(t: Tables):
    """Exact numbers of the baselines, and bounds that the stored models' numbers keep."""
    fitted = F.col("model").isin("boosted", "ensemble")
    unit = [F.coalesce(_unit(F.col(c)), F.lit(True)) for c in ("accuracy", "macro_f1", "brier")]
    bounds = reduce(lambda a, b: a & b, unit) & F.coalesce(F.col("log_loss") > 0, F.lit(True)) & F.col("accuracy").isNotNull()
    kept = {c: F.when(~fitted, F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "brier")}
    return rounded(_final(t).select("task", "model", "n", *kept.values(), bounds.alias("in_bounds")))


# --- cards scored by the stored models --------------------------------------------------------------


def _modelled_log(t: Tables) -> DataFrame:
    """The log of all cards as the stored models predict them, stamped with their version."""
    models = models_of(t)

    def build() -> DataFrame:
        made = predictions.predict_matchups(t.run_matchups(), models.score, detail=True)
        at = F.concat(F.date_format(F.date_sub("event_date", 7), "yyyy-MM-dd"), F.lit("T12:00:00Z"))
        return materialise(predictions.stamped(made, at, F.lit(models.version)), "modelled-log")

    return t.stored("modelled-log", build)


_MADE = "CASE WHEN NOT skipped THEN true END"


@register(
    "modelled_cards",
    f"""SELECT event_name, CAST(event_date AS VARCHAR) AS event_date, position, skipped, reason, a_id AS competitor_a_id, b_id AS competitor_b_id,
               '{VERSION}' AS model_version, {_MADE} AS orientations_differ, {_MADE} AS averaged, {_MADE} AS in_range, {_MADE} AS classes_sum_to_one,
               CASE WHEN scheduled_rounds = 3 THEN true END AS no_late_round, event_date >= DATE '{TEST_START}' AS unseen FROM log""",
)
def _(t: Tables):
    made, p = ~F.col("skipped"), F.col("p_a_wins")
    ab, ba = F.col("prob_ab"), F.col("prob_ba")
    sums = [F.abs(F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + x) - 1.0) < 1e-9 for c in ("method_probs", "round_probs")]
    flags = {
        "orientations_differ": ab != 1.0 - ba,
        "averaged": F.abs(p - (ab + 1.0 - ba) / 2.0) < 1e-9,
        "in_range": _unit(p) & _unit(ab) & _unit(ba) & _unit(F.col("winner_spread")),
        "classes_sum_to_one": sums[0] & sums[1],
        "no_late_round": F.when(F.col("scheduled_rounds") <= 3, F.col("round_probs")["45"] == 0.0),
    }
    return rounded(
        _modelled_log(t).select(
            *predictions.BOUT_KEY, "skipped", "reason", "competitor_a_id", "competitor_b_id", "model_version",
            *[F.when(made, flag).alias(name) for name, flag in flags.items()],
            (F.col("event_date") >= F.lit(TEST_START).cast("date")).alias("unseen"),
        )
    )


@register(
    "modelled_track_record",
    f"""SELECT CASE WHEN model_version IS NOT NULL THEN '{VERSION}' END AS model_version, n_predicted, n_graded, first_prediction_at,
               coin_flip_accuracy, elo_dummy_n, elo_dummy_accuracy, true AS in_bounds
        FROM (SELECT '{VERSION}' AS model_version, count(*) AS n_predicted, count(won) AS n_graded, min(predicted_at_utc) AS first_prediction_at,
                     {q6('avg(CAST(coin AS INTEGER))')} AS coin_flip_accuracy, count(dummy) AS elo_dummy_n,
                     {q6('avg(CAST(dummy AS INTEGER))')} AS elo_dummy_accuracy FROM graded WHERE NOT skipped)
             CROSS JOIN (VALUES (1), (2)) v(part) """.replace("CASE WHEN model_version IS NOT NULL", "CASE WHEN part = 1"),
)
def _(t: Tables):
    graded = predictions.grade(_modelled_log(t), t.contests, F.lit(TODAY).cast("date"))
    record = predictions.track_record(graded)
    bounds = _unit(F.col("accuracy")) & _unit(F.col("brier")) & (F.col("log_loss") > 0)
    kept = ("model_version", "n_predicted", "n_graded", "first_prediction_at", "coin_flip_accuracy", "elo_dummy_n", "elo_dummy_accuracy")
    return rounded(record.select(*kept, bounds.alias("in_bounds")))
