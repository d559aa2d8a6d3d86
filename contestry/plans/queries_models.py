"""Registered queries: evaluation, market, names, cards, the log and the models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions import labels, probability
from contestry.functions.labels import METHODS, ROUND_CLASSES
from contestry.operators.careers import STAT_NAMES
from contestry.operators import dataset, evaluation, features, learn, market, predictions, ratings, resolve
from contestry.plans import views
from contestry.plans.oracle import r6 as q6
from contestry.plans.queries_tables import LOG_FIELDS, scored_table, train_rows
from contestry.session import materialise, scratch_path
from contestry.plans.registry import TEST_START, TODAY, TRAIN_END, VAL, Tables, r6, register, rounded
from contestry.sources import documents

_LL = "-(y * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12)))"


def _metrics_sql(p: str) -> str:
    return (
        f"count(*) AS n, {q6(f'avg(CASE WHEN ({p} >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy, "
        f"{q6(f'avg({_LL.format(p=p)})')} AS log_loss, {q6(f'avg(({p} - y) * ({p} - y))')} AS brier"
    )


# --- evaluation -----------------------------------------------------------------------------


@register("winner_metrics", f"SELECT weight_class, {_metrics_sql('p')} FROM scored GROUP BY weight_class")
def _(t: Tables):
    return rounded(evaluation.winner_metrics(scored_table(t), "weight_class"))


@register(
    "baseline_ladder",
    f"""SELECT model, n, accuracy, CASE WHEN model <> 'higher_elo' THEN log_loss END AS log_loss,
               CASE WHEN model <> 'higher_elo' THEN brier END AS brier
        FROM (SELECT model, {_metrics_sql('q')} FROM (
                SELECT 'coin_flip' AS model, y, 0.5 AS q FROM scored
                UNION ALL SELECT 'higher_elo', y, CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END FROM scored
                UNION ALL SELECT 'elo', y, p FROM scored) GROUP BY model)""",
)
def _(t: Tables):
    return rounded(evaluation.baseline_ladder(scored_table(t)))


@register(
    "held_out_evaluation",
    f"""SELECT model, n, accuracy, log_loss, brier FROM (
          SELECT model, {_metrics_sql('q')} FROM (
            SELECT 'coin_flip' AS model, y, 0.5 AS q FROM scored WHERE date >= DATE '{TEST_START}'
            UNION ALL SELECT 'elo', y, p FROM scored WHERE date >= DATE '{TEST_START}') GROUP BY model)
        UNION ALL
        SELECT 'method_majority', (SELECT count(*) FROM scored WHERE date >= DATE '{TEST_START}' AND y_method IS NOT NULL),
               {q6(f'''(SELECT avg(CASE WHEN y_method = m THEN 1.0 ELSE 0.0 END) FROM scored,
                    (SELECT y_method AS m FROM train WHERE y_method IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
                    WHERE date >= DATE '{TEST_START}' AND y_method IS NOT NULL)''')}, NULL, NULL""",
)
def _(t: Tables):
    scored = scored_table(t)
    test = learn.split(scored, "test", test_start=TEST_START)
    ladder = evaluation.baseline_ladder(test).filter("model <> 'higher_elo'")
    majority = evaluation.majority_baseline(train_rows(scored), test, "y_method")
    return rounded(
        ladder.unionByName(
            majority.select(F.lit("method_majority").alias("model"), "n", "accuracy"), allowMissingColumns=True
        )
    )


@register(
    "macro_f1",
    f"""SELECT (SELECT count(*) FROM scored WHERE y_method IS NOT NULL) AS n,
               {q6("(SELECT avg(CASE WHEN y_method = guess THEN 1.0 ELSE 0.0 END) FROM guessed)")} AS accuracy,
               {q6("avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END)")} AS macro_f1
        FROM (SELECT l, count(*) FILTER (y_method = l AND guess = l) AS tp,
                     count(*) FILTER (y_method <> l AND guess = l) AS fp,
                     count(*) FILTER (y_method = l AND guess <> l) AS fn
              FROM guessed, (SELECT y_method AS l FROM guessed UNION SELECT guess FROM guessed) GROUP BY l)""".replace(
        "guessed",
        """(SELECT y_method, CASE WHEN p_ko_tko >= p_submission AND p_ko_tko >= p_decision THEN 'ko_tko'
              WHEN p_submission >= p_decision THEN 'submission' ELSE 'decision' END AS guess
            FROM scored JOIN given USING (contest_id) WHERE y_method IS NOT NULL)""",
    ),
)
def _(t: Tables):
    p = {m: F.col(f"p_{m}") for m in METHODS}
    guess = (
        F.when((p["ko_tko"] >= p["submission"]) & (p["ko_tko"] >= p["decision"]), "ko_tko")
        .when(p["submission"] >= p["decision"], "submission")
        .otherwise("decision")
    )
    known = dataset.decisive(given_probs(t)).filter("method IS NOT NULL").withColumn("guess", guess)
    return rounded(evaluation.macro_f1(known, "method", "guess"))


@register(
    "majority_baseline",
    f"""SELECT n, accuracy, {q6('2 * accuracy_raw / (1 + accuracy_raw) / k')} AS macro_f1 FROM (
          SELECT count(*) AS n, {q6('avg(CASE WHEN y_method = m THEN 1.0 ELSE 0.0 END)')} AS accuracy,
                 avg(CASE WHEN y_method = m THEN 1.0 ELSE 0.0 END) AS accuracy_raw,
                 len(list_distinct(list_append(list(y_method), any_value(m)))) AS k
          FROM scored, (SELECT y_method AS m FROM train WHERE y_method IS NOT NULL GROUP BY 1
                        ORDER BY count(*) DESC, 1 LIMIT 1)
          WHERE date >= DATE '{TEST_START}' AND y_method IS NOT NULL)""",
)
def _(t: Tables):
    scored = scored_table(t)
    test = learn.split(scored, "test", test_start=TEST_START)
    return rounded(evaluation.majority_baseline(train_rows(scored), test, "y_method"))


@register(
    "calibration",
    """SELECT '[' || printf('%.1f', i / 10.0) || ', ' || printf('%.1f', (i + 1) / 10.0) || ')' AS bin,
              count(p) AS count, round(avg(p), 4) AS mean_pred, round(avg(y), 4) AS empirical_rate
       FROM range(10) r(i) LEFT JOIN scored ON (p > i / 10.0 OR i = 0) AND (p <= (i + 1) / 10.0 OR i = 9)
       GROUP BY i""",
)
def _(t: Tables):
    return rounded(evaluation.calibration_table(scored_table(t)))


@register(
    "probability_histogram",
    """SELECT printf('%.2f', i / 20.0) AS edge, count(p) AS n FROM range(20) r(i)
       LEFT JOIN scored ON least(CAST(floor(least(greatest(p, 0), 1) * 20) AS BIGINT), 19) = i GROUP BY i""",
)
def _(t: Tables):
    return rounded(evaluation.histogram(scored_table(t), "p"))


@register(
    "best_parameters",
    f"""SELECT grid_index, k_early, k_late, early_contests, finish_bonus, {q6('loss')} AS log_loss FROM (
          SELECT pid AS grid_index, k_early, k_late, early AS early_contests, bonus AS finish_bonus, log_loss AS loss
          FROM grid JOIN grid_loss USING (pid) ORDER BY log_loss, pid LIMIT 1)""",
)
def _(t: Tables):
    return rounded(ratings.first_minimum(t.grid_losses))


@register(
    "temperature",
    f"""SELECT round(t, 2) AS t, {q6('log_loss')} AS log_loss FROM (
          SELECT i, 0.5 + 0.01 * i AS t, avg({_LL.format(p='1.0 / (1.0 + exp(-(logit / (0.5 + 0.01 * i))))')}) AS log_loss
          FROM (SELECT y, ln(p / (1 - p)) AS logit FROM scored), range(251) r(i) GROUP BY i)
        ORDER BY log_loss, t LIMIT 1""".replace("1 - y)", "1 - y)"),
)
def _(t: Tables):
    p = F.col("p")
    logits = scored_table(t).select("y", F.ln(p / (1.0 - p)).alias("logit"))
    return rounded(learn.fit_temperature(logits))


# --- class probabilities -----------------------------------------------------------------------


def given_probs(t: Tables) -> DataFrame:
    """Method probabilities read off each contest's own counts."""
    totals = t.stats.groupBy("contest_id").agg(
        F.sum("kd").alias("kd"), F.sum("sub_att").alias("sub"), F.sum("td_landed").alias("td")
    )
    n = {c: F.coalesce(c, F.lit(0.0)) for c in ("kd", "sub", "td")}
    whole = 3 + n["kd"] + n["td"] + n["sub"]
    shares = {"ko_tko": n["kd"], "submission": n["sub"], "decision": n["td"]}
    return t.contests.join(totals, "contest_id", "left").select(
        "contest_id", "date", "winner", "method", "finish_round", "scheduled_rounds",
        *[((1 + v) / whole).alias(f"p_{m}") for m, v in shares.items()],
    )


_FACTORS = {"ko_tko": 0.5, "submission": 1.5, "decision": 1.1}


@register(
    "prior_correction",
    "SELECT contest_id, "
    + ", ".join(f"{q6(f'p_{m} * {f} / total')} AS {m}" for m, f in _FACTORS.items())
    + " FROM (SELECT *, "
    + " + ".join(f"p_{m} * {f}" for m, f in _FACTORS.items())
    + " AS total FROM given)",
)
def _(t: Tables):
    corrected = probability.prior_corrected(
        {m: F.col(f"p_{m}") for m in METHODS}, {m: F.lit(f) for m, f in _FACTORS.items()}
    )
    return given_probs(t).select("contest_id", *[r6(v).alias(m) for m, v in corrected.items()])


_ROUND_P = {"1": "p_ko_tko * 0.6", "2": "p_submission * 0.7", "3": "p_decision", "45": "1 - p_ko_tko * 0.6 - p_submission * 0.7 - p_decision"}


def _round_probs(t: Tables) -> DataFrame:
    return given_probs(t).select(
        "contest_id", "scheduled_rounds", *[F.expr(e).alias(f"p_{c}") for c, e in _ROUND_P.items()]
    )


@register(
    "masked_rounds",
    "SELECT contest_id, "
    + ", ".join(
        f"{q6(f'CASE WHEN coalesce(scheduled_rounds, 3) <= 3 THEN {keep} ELSE {e} END')} AS p_{c}"
        for c, e, keep in [
            (c, e, "0.0" if c == "45" else f"({e}) / (p_ko_tko * 0.6 + p_submission * 0.7 + p_decision)")
            for c, e in _ROUND_P.items()
        ]
    )
    + " FROM given",
)
def _(t: Tables):
    return rounded(learn.masked_rounds(_round_probs(t)).drop("scheduled_rounds"))


@register(
    "outcome_grid",
    "SELECT contest_id, s AS winner_side, m AS method, "
    + q6("CASE s WHEN 'a' THEN p_a ELSE 1.0 - p_a END * CASE m WHEN 'ko_tko' THEN p_ko_tko WHEN 'submission' THEN p_submission ELSE p_decision END")
    + " AS probability FROM predictions JOIN given USING (contest_id), (VALUES ('a'), ('b')) v(s), "
    "(VALUES ('ko_tko'), ('submission'), ('decision')) w(m)",
)
def _(t: Tables):
    given = given_probs(t).select("contest_id", *[f"p_{m}" for m in METHODS])
    return rounded(learn.outcome_grid(t.predictions.select("contest_id", "p_a").join(given, "contest_id"), p="p_a"))


_PRIOR_SQL = """
SELECT 'method' AS prior, label, {m} AS share FROM (VALUES ('ko_tko'), ('submission'), ('decision')) v(label)
UNION ALL SELECT 'round_3', label, CASE label WHEN '45' THEN 0.0 ELSE {r3} END FROM (VALUES ('1'), ('2'), ('3'), ('45')) v(label)
UNION ALL SELECT 'round_5', label, {r5} FROM (VALUES ('1'), ('2'), ('3'), ('45')) v(label)""".format(
    m=q6("(SELECT count(*) FILTER (y_method = label) / count(y_method) FROM train)"),
    r3=q6(
        "(SELECT count(*) FILTER (y_finish_round = label) / count(*) FILTER (y_finish_round <> '45') FROM train "
        "WHERE coalesce(scheduled_rounds, 3) <= 3)"
    ),
    r5=q6("(SELECT count(*) FILTER (y_finish_round = label) / count(y_finish_round) FROM train WHERE scheduled_rounds = 5)"),
)


def _train_labels(t: Tables) -> DataFrame:
    return train_rows(dataset.decisive(t.contests)).select(
        "contest_id",
        "weight_class",
        "scheduled_rounds",
        F.col("method").alias("y_method"),
        labels.round_bucket(F.col("finish_round")).alias("y_finish_round"),
    )


@register("class_priors", _PRIOR_SQL)
def _(t: Tables):
    return rounded(learn.class_priors(_train_labels(t)))


@register(
    "class_weights",
    f"""SELECT label, {q6('total / (3 * n)')} AS weight FROM (
          SELECT label, n, sum(n) OVER () AS total FROM (
            SELECT label, greatest(count(y_method), 1) AS n FROM (VALUES ('ko_tko'), ('submission'), ('decision')) v(label)
            LEFT JOIN train ON y_method = label GROUP BY label))""",
)
def _(t: Tables):
    return rounded(learn.class_weights(_train_labels(t), "y_method", METHODS))


@register(
    "majority_class",
    "SELECT y_method AS label FROM train WHERE y_method IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
)
def _(t: Tables):
    return evaluation.majority_class(_train_labels(t), "y_method")


@register(
    "category_index",
    """SELECT contest_id, coalesce(i, 0) AS weight_class_index FROM decisive LEFT JOIN (
         SELECT weight_class, row_number() OVER (ORDER BY weight_class) AS i FROM (
           SELECT DISTINCT weight_class FROM train WHERE weight_class IS NOT NULL)) USING (weight_class)""",
)
def _(t: Tables):
    index = learn.category_index(_train_labels(t), "weight_class")
    rows = learn.with_category(dataset.decisive(t.contests), index, "weight_class")
    return rounded(rows.select("contest_id", "weight_class_index"))


_CORRECTION = {m: f"p_{m}" for m in METHODS}


@register(
    "correction_step",
    f"""SELECT label, {q6("CASE WHEN mean >= 1e-6 THEN share / mean ELSE 0 END")} AS factor FROM (
          SELECT label, (SELECT count(*) FILTER (y_method = label) / count(y_method) FROM train) AS share,
                 (SELECT avg(CASE label WHEN 'ko_tko' THEN p_ko_tko WHEN 'submission' THEN p_submission ELSE p_decision END)
                  FROM given WHERE winner IN ('a', 'b') AND method IS NOT NULL AND date < DATE '{TRAIN_END}') AS mean
          FROM (VALUES ('ko_tko'), ('submission'), ('decision')) v(label))""",
)
def _(t: Tables):
    shares = learn.class_priors(_train_labels(t)).filter("prior = 'method'").select("label", "share")
    return rounded(learn.share_ratios(shares, _train_probs(t), METHODS))


def _train_probs(t: Tables) -> DataFrame:
    return train_rows(dataset.decisive(given_probs(t))).filter("method IS NOT NULL")


def _prior_groups(t: Tables) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """Training probabilities of each group of priors."""
    rounds = learn.masked_rounds(_round_probs(t)).join(_train_probs(t).select("contest_id"), "contest_id", "left_semi")
    long = F.coalesce("scheduled_rounds", F.lit(3)) == 5
    return {
        "method": (_train_probs(t), METHODS),
        "round_3": (rounds.filter(F.coalesce("scheduled_rounds", F.lit(3)) <= 3), ROUND_CLASSES),
        "round_5": (rounds.filter(long), ROUND_CLASSES),
    }


@register(
    "correction_factors",
    f"SELECT prior, label, share AS empirical, true AS met, share > 0 AS used FROM ({_PRIOR_SQL})",
)
def _(t: Tables):
    """Priors with whether the corrected mean meets them; the factors are fitted out of stored rows."""
    shares: dict[str, dict[str, float]] = {}
    for r in learn.class_priors(_train_labels(t)).collect():
        shares.setdefault(r["prior"], {})[r["label"]] = r["share"]
    rows = []
    for group, (probs, classes) in _prior_groups(t).items():
        probs = materialise(probs.select(*[f"p_{c}" for c in classes]), "probabilities")
        factors = learn.prior_factors(probs, shares[group])
        mean = learn.mean_probs(probs, classes, factors).first().asDict()
        rows += [(group, c, shares[group][c], abs((mean[c] or 0.0) - shares[group][c]) < 1e-6, factors[c] > 0) for c in classes]
    return rounded(t.spark.createDataFrame(rows, "prior string, label string, empirical double, met boolean, used boolean"))


# --- preprocessing ---------------------------------------------------------------------------------

_NUMERIC = [f"{stem}_diff" for stem in features.DIFF_STEMS.values()] + [
    "age_a", "career_fights_a", "age_b", "career_fights_b", "title_fight", "scheduled_rounds",
    "southpaw_a", "debut_a", "southpaw_b", "debut_b", "debut_matchup", "stance_mismatch",
]


def _stat_sql(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS c, m, avg(coalesce({v}, m)) AS a, stddev_pop(coalesce({v}, m)) AS s
               FROM train, (SELECT coalesce(median({v}), 0) AS m FROM train) GROUP BY m"""


_STATS_SQL = " UNION ALL ".join(_stat_sql(c) for c in _NUMERIC)


@register(
    "preprocessing_stats",
    f"""SELECT c AS "column", {q6('m')} AS median, {q6('a')} AS mean, {q6('CASE WHEN s > 0 THEN s ELSE 1 END')} AS std
        FROM ({_STATS_SQL})""",
)
def _(t: Tables):
    built = t.features
    return rounded(learn.preprocessing_stats(train_rows(built), features.numeric_inputs(built)))


@register(
    "standardised_inputs",
    "SELECT contest_id, "
    + ", ".join(
        f"{q6(f'(coalesce(CAST({c} AS DOUBLE), m_{c}) - a_{c}) / s_{c}')} AS {c}" for c in _NUMERIC
    )
    + " FROM features, "
    + ", ".join(
        f"(SELECT m AS m_{c}, a AS a_{c}, CASE WHEN s > 0 THEN s ELSE 1 END AS s_{c} FROM ({_stat_sql(c)}))" for c in _NUMERIC
    ),
)
def _(t: Tables):
    built = t.features
    scale = learn.fitted(learn.preprocessing_stats(train_rows(built), features.numeric_inputs(built)))
    return rounded(learn.standardised(built, scale, "contest_id"))


@register(
    "feature_frame",
    "SELECT contest_id, coalesce(i, 0) AS weight_class_index, "
    + ", ".join(
        f"{q6(f'CAST({c} AS DOUBLE)')} AS {c}"
        for c in [*_NUMERIC, *features.DROPPED]
    )
    + """ FROM features LEFT JOIN (SELECT weight_class, row_number() OVER (ORDER BY weight_class) AS i FROM (
           SELECT DISTINCT weight_class FROM train WHERE weight_class IS NOT NULL)) USING (weight_class)""",
)
def _(t: Tables):
    index = learn.category_index(_train_labels(t), "weight_class")
    return rounded(features.feature_frame(t.features, index))


# --- names and market ----------------------------------------------------------------------------------


@register("name_resolution", "SELECT name, resolved_id, match_tier, reason FROM resolved WHERE name IN (SELECT listed_name FROM listed)")
def _(t: Tables):
    listed = t.table("customer").select(views.listed_name(F.col("c_custkey")).alias("name"))
    return resolve.resolve_names(listed, t.competitors)


def _alignment(t: Tables) -> DataFrame:
    return market.align(market.with_ids(t.quotes), t.contests, t.competitors)


@register(
    "consensus_odds",
    f"""SELECT contest_id, {q6('median_1')} AS median_1, {q6('median_2')} AS median_2, {q6('settle_1')} AS settle_1,
               {q6('settle_2')} AS settle_2, n_books FROM consensus""",
)
def _(t: Tables):
    grouped = market.consensus(market.known_quotes(market.with_ids(t.quotes), t.contests))
    return rounded(grouped.drop("ids", "names"))


@register(
    "known_quotes",
    "SELECT contest_id, count(*) AS n FROM raw_quotes WHERE contest_id IN (SELECT contest_id FROM decisive) GROUP BY contest_id",
)
def _(t: Tables):
    known = market.known_quotes(market.with_ids(t.quotes), dataset.decisive(t.contests))
    return known.groupBy("contest_id").agg(F.count("*").alias("n"))


@register(
    "quote_alignment",
    f"""SELECT contest_id, {q6('decimal_contest_a')} AS decimal_contest_a, {q6('decimal_contest_b')} AS decimal_contest_b,
               {q6('implied_contest_a')} AS implied_contest_a, {q6('implied_contest_b')} AS implied_contest_b,
               align_method, n_books, reason FROM alignment""",
)
def _(t: Tables):
    return rounded(_alignment(t))


@register(
    "alignment_counts",
    "SELECT CASE WHEN reason IS NOT NULL THEN 'skipped' ELSE align_method END AS outcome, count(*) AS n FROM alignment GROUP BY 1",
)
def _(t: Tables):
    return market.alignment_counts(_alignment(t))


@register(
    "skip_reasons",
    "SELECT reason, count(*) AS n FROM alignment WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 5",
)
def _(t: Tables):
    return market.top_skip_reasons(_alignment(t))


def _market(t: Tables) -> DataFrame:
    scored = scored_table(t).withColumnsRenamed({"p": "model_p_a"}).withColumn("y_winner", F.col("y"))
    return market.join_market(scored, _alignment(t))


@register(
    "market_join",
    f"""SELECT contest_id, CAST(date AS VARCHAR) AS date, y, {q6('p')} AS model_p_a, {q6('market_a')} AS market_a,
               {q6('market_b')} AS market_b, {q6('decimal_a')} AS decimal_a, {q6('decimal_b')} AS decimal_b,
               align_method, n_books FROM market""",
)
def _(t: Tables):
    return rounded(
        _market(t).select(
            "contest_id", "date", "y", "model_p_a", "market_a", "market_b", "decimal_a", "decimal_b",
            "align_method", "n_books",
        )
    )


@register(
    "roi_sweep",
    """SELECT CAST(t AS DOUBLE) AS threshold, s AS bet_on, count(*) FILTER (edge > t) AS n_bets,
              CAST(count(*) FILTER (edge > t) AS DOUBLE) AS staked,
              round(coalesce(sum(profit) FILTER (edge > t), 0), 3) AS net,
              round(100.0 * coalesce(sum(profit) FILTER (edge > t), 0) / nullif(count(*) FILTER (edge > t), 0), 3) AS roi_pct
       FROM (SELECT 'a' AS s, p - market_a AS edge, CASE WHEN y = 1 THEN decimal_a - 1.0 ELSE -1.0 END AS profit FROM market
             UNION ALL SELECT 'b', (1.0 - p) - market_b, CASE WHEN y = 0 THEN decimal_b - 1.0 ELSE -1.0 END FROM market),
            (VALUES (0.0), (0.05), (0.1)) v(t)
       GROUP BY t, s""",
)
def _(t: Tables):
    return market.roi_sweep(_market(t))


@register(
    "model_against_market",
    f"""SELECT n, round(a1, 4) AS model_accuracy, round(a2, 4) AS market_accuracy, round(l1, 4) AS model_log_loss,
               round(l2, 4) AS market_log_loss, round(b1, 4) AS model_brier, round(b2, 4) AS market_brier,
               round(round(a1, 4) - round(a2, 4), 4) AS delta_accuracy, round(round(l1, 4) - round(l2, 4), 4) AS delta_log_loss,
               round(round(b1, 4) - round(b2, 4), 4) AS delta_brier, round(round(l1, 4) - round(l2, 4), 4) < -0.02 AS implausible
        FROM (SELECT count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS a1,
                     avg(CASE WHEN (market_a >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS a2,
                     avg({_LL.format(p='p')}) AS l1, avg({_LL.format(p='market_a')}) AS l2,
                     avg((p - y) * (p - y)) AS b1, avg((market_a - y) * (market_a - y)) AS b2
              FROM market WHERE date >= DATE '{TRAIN_END}')""",
)
def _(t: Tables):
    recent = _market(t).filter(F.col("date") >= F.lit(TRAIN_END).cast("timestamp_ntz"))
    scored = recent.select("y", F.col("model_p_a").alias("model"), F.col("market_a").alias("market"))
    return evaluation.compare(scored, "model", "market")


@register(
    "market_calibration",
    """SELECT '[' || printf('%.1f', i / 10.0) || ', ' || printf('%.1f', (i + 1) / 10.0) || ')' AS bin,
              count(market_a) AS count, round(avg(market_a), 4) AS mean_pred, round(avg(y), 4) AS empirical_rate
       FROM range(10) r(i) LEFT JOIN market ON (market_a > i / 10.0 OR i = 0) AND (market_a <= (i + 1) / 10.0 OR i = 9)
       GROUP BY i""",
)
def _(t: Tables):
    return rounded(evaluation.calibration_table(_market(t), p="market_a"))


def _control(t: Tables) -> DataFrame:
    """A short control list: the twenty pairs that met most often."""
    a, b = F.least("competitor_a_id", "competitor_b_id"), F.greatest("competitor_a_id", "competitor_b_id")
    met = (
        t.contests.groupBy(a.alias("x"), b.alias("y"))
        .agg(F.count("*").alias("n"), F.max("date").alias("last"))
        .orderBy(F.desc("n"), "x", "y")
        .limit(20)
    )
    name = {
        c: views.listed_name(F.conv(F.col(c), 16, 10).cast("bigint")) for c in "xy"
    }
    return met.select(
        F.concat("x", F.lit("-"), "y").alias("check_id"),
        name["x"].alias("name_x"),
        name["y"].alias("name_y"),
        name["x"].alias("favourite"),
        F.date_add(F.to_date("last"), 10).alias("approx_date"),
    )


@register(
    "known_favourites",
    f"""WITH control AS (
          SELECT x, y, x || '-' || y AS check_id, lx.listed_name AS nx, ly.listed_name AS ny, last + 10 AS approx FROM (
            SELECT least(a_id, b_id) AS x, greatest(a_id, b_id) AS y, count(*) AS n, max(date) AS last FROM contests
            GROUP BY 1, 2 ORDER BY n DESC, x, y LIMIT 20)
          JOIN listed lx ON printf('%016x', lx.k) = x JOIN listed ly ON printf('%016x', ly.k) = y)
        SELECT check_id, contest_id, {q6('f')} AS favourite_implied, f > 0.5 AS ok FROM (
          SELECT check_id, c.contest_id, CASE WHEN c.a_id = rx.resolved_id THEN a.implied_contest_a ELSE a.implied_contest_b END AS f
          FROM control k JOIN resolved rx ON rx.name = nx JOIN resolved ry ON ry.name = ny
          JOIN contests c ON least(c.a_id, c.b_id) = least(rx.resolved_id, ry.resolved_id)
                         AND greatest(c.a_id, c.b_id) = greatest(rx.resolved_id, ry.resolved_id)
          JOIN alignment a ON a.contest_id = c.contest_id AND a.reason IS NULL
          QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY abs(c.date - approx), c.date, c.contest_id) = 1)""",
)
def _(t: Tables):
    return rounded(market.check_favourites(_control(t), t.contests, t.competitors, _alignment(t)))


# --- cards and log ------------------------------------------------------------------------------------------


@register(
    "predict_cards",
    f"""SELECT event_name, CAST(event_date AS VARCHAR) AS event_date, position, name_a AS competitor_a_name,
               name_b AS competitor_b_name, weight_class, skipped, reason, a_id AS competitor_a_id, b_id AS competitor_b_id,
               match_tier, title_fight, CAST(scheduled_rounds AS BIGINT) AS scheduled_rounds, {q6('p_a_wins')} AS p_a_wins,
               {q6('elo_a')} AS elo_a, {q6('elo_b')} AS elo_b FROM log""",
)
def _(t: Tables):
    made = predictions.predict_matchups(t.run_matchups())
    return rounded(made.select(*[c for c in LOG_FIELDS if c not in ("predicted_at_utc", "model_version")]))


_STATS = [c for c in STAT_NAMES if c != "days_since_last"]
_SIDE_SQL = ", ".join([f"s.{c}" for c in _STATS] + ["z.event_date - s.date AS days_since_last"])


@register(
    "matchup_features",
    f"""WITH states AS (
          SELECT c.competitor_id, c.date, {", ".join(f"{'o' if c == 'last5_avg_opp_elo' else 'c'}.{c}" for c in _STATS)},
                 r.post_overall, r.post_striking, r.post_grappling
          FROM careers_after c JOIN opposition_after o USING (contest_id, side, competitor_id)
          JOIN ratings r ON r.contest_id = c.contest_id AND r.side = c.side
          QUALIFY row_number() OVER (PARTITION BY c.competitor_id, c.date ORDER BY c.contest_id DESC) = 1),
        named AS (
          SELECT b.event_name, b.event_date, b.position, k.number, k.competitor_id, coalesce(b.weight_class, 'Lightweight') AS weight_class,
                 b.title_fight, CASE WHEN b.title_fight OR b.main_event THEN 5 ELSE 3 END AS scheduled_rounds
          FROM bouts b JOIN resolved r1 ON r1.name = b.name_a JOIN resolved r2 ON r2.name = b.name_b,
               LATERAL (VALUES (1, r1.resolved_id), (2, r2.resolved_id)) k(number, competitor_id)
          WHERE r1.resolved_id IS NOT NULL AND r2.resolved_id IS NOT NULL),
        sided AS (
          SELECT z.event_name, z.event_date, z.position, z.number, z.weight_class, z.title_fight, z.scheduled_rounds, {_SIDE_SQL},
                 s.post_overall AS pre_overall, s.post_striking AS pre_striking, s.post_grappling AS pre_grappling, s.career_fights AS pre_fights,
                 k.height_cm, k.reach_cm, (z.event_date - k.dob) / 365.25 AS age, k.reach_cm IS NULL AS reach_missing,
                 k.dob IS NULL AS dob_missing, coalesce(k.stance = 'Southpaw', false) AS southpaw, coalesce(s.career_fights, 0) = 0 AS debut
          FROM named z ASOF JOIN states s ON s.competitor_id = z.competitor_id AND s.date < z.event_date
          LEFT JOIN competitors k ON k.competitor_id = z.competitor_id)
        SELECT x.event_name, CAST(x.event_date AS VARCHAR) AS event_date, x.position, CASE x.number WHEN 1 THEN 'ab' ELSE 'ba' END AS orientation,
               x.weight_class, x.title_fight, CAST(x.scheduled_rounds AS BIGINT) AS scheduled_rounds,
               {", ".join(f"{q6(f'CAST(x.{src} AS DOUBLE) - CAST(y.{src} AS DOUBLE)')} AS {stem}_diff" for src, stem in features.DIFF_STEMS.items())},
               {", ".join((q6(f"{t}.{n}") if n == "age" else f"{t}.{n}") + f" AS {n}_{s}" for s, t in (("a", "x"), ("b", "y")) for n in features.PER_SIDE)},
               x.debut <> y.debut AS debut_matchup, x.southpaw <> y.southpaw AS stance_mismatch
        FROM sided x JOIN sided y ON x.event_name = y.event_name AND x.event_date = y.event_date AND x.position = y.position AND x.number <> y.number""",
)
def _(t: Tables):
    """Both orientations of every bout, from the states before its own date."""
    ready = predictions.matchups_as_of(t.bouts, t.competitors, t.states).filter("NOT skipped")
    return rounded(predictions.orientations(ready))


@register(
    "symmetrised",
    f"""SELECT event_name, CAST(event_date AS VARCHAR) AS event_date, position, {q6('p_a_wins')} AS winner_prob,
               {q6('abs(p_a_wins - 0.5) / 10')} AS winner_spread, {q6('p_a_wins')} AS prob_ab, {q6('1 - p_a_wins')} AS prob_ba
        FROM log WHERE NOT skipped""",
)
def _(t: Tables):
    ready = t.run_matchups().filter("NOT skipped")
    scored = predictions.rating_scorer(predictions.orientations(ready))
    both = predictions.symmetrise(scored.drop("method_probs", "round_probs"), *predictions.BOUT_KEY)
    return rounded(both)


@register(
    "bout_identity",
    """SELECT event_name, CAST(event_date AS VARCHAR) AS event_date, position, least(a_id, b_id) || '/' || greatest(a_id, b_id) AS id_key,
              least(ka, kb) || '/' || greatest(ka, kb) AS name_key
       FROM (SELECT *, lower(strip_accents(name_a)) AS ka, lower(strip_accents(name_b)) AS kb FROM log)""",
)
def _(t: Tables):
    keyed = predictions.with_keys(t.log)
    return rounded(
        keyed.select(
            *predictions.BOUT_KEY,
            F.concat_ws("/", "id_key").alias("id_key"),
            F.concat_ws("/", "name_key").alias("name_key"),
        ).withColumn("id_key", F.nullif("id_key", F.lit("")))
    )


def _log_versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A log recorded earlier, and a later run over the same cards.

    The earlier log lacks some events and the later bouts, and holds a stub at
    position 4, twice.  The later run lists odd bouts the other way round and in
    accents, repeats bout 2, has a stub for bout 6, and lists bout 10 first as
    a stub.
    """
    fields = [c for c in LOG_FIELDS if c not in ("title_fight", "scheduled_rounds", "match_tier", "weight_class")]
    log = t.log.select(*fields)
    at = F.col("position")

    def stub(condition: Column, reason: str) -> dict[str, Column]:
        gone = ("competitor_a_id", "competitor_b_id", "p_a_wins", "elo_a", "elo_b")
        out = {c: F.when(~condition, F.col(c)) for c in gone}
        out["reason"] = F.when(condition & ~F.col("skipped"), reason).otherwise(F.col("reason"))
        out["skipped"] = F.col("skipped") | condition
        return out

    day = F.dayofmonth("event_date")
    earlier = log.filter((day % 5 != 0) & (at < 9)).withColumns(stub(at == 4, "earlier failure"))
    earlier = earlier.unionByName(earlier.filter(at == 4).withColumn("position", at + 200))
    odd = at % 2 == 1

    def accented(c: str) -> Column:
        return F.regexp_replace(c, "^Jose ", "José ")

    turned = log.withColumns(
        {
            "competitor_a_name": F.when(odd, accented("competitor_b_name")).otherwise(F.col("competitor_a_name")),
            "competitor_b_name": F.when(odd, accented("competitor_a_name")).otherwise(F.col("competitor_b_name")),
            "competitor_a_id": F.when(odd, F.col("competitor_b_id")).otherwise(F.col("competitor_a_id")),
            "competitor_b_id": F.when(odd, F.col("competitor_a_id")).otherwise(F.col("competitor_b_id")),
            "p_a_wins": F.when(odd, 1.0 - F.col("p_a_wins")).otherwise(F.col("p_a_wins")),
            "elo_a": F.when(odd, F.col("elo_b")).otherwise(F.col("elo_a")),
            "elo_b": F.when(odd, F.col("elo_a")).otherwise(F.col("elo_b")),
            "model_version": F.lit("next"),
        }
    )
    first_run = turned.withColumns(stub((at == 6) | (at == 10), "later failure"))
    repeated = turned.filter((at == 2) | (at == 10)).withColumn("position", at + 100)
    return earlier, first_run.unionByName(repeated)


_MERGE_SQL = f"""
WITH recorded AS (
  SELECT event_name, event_date, position, name_a, name_b,
         CASE WHEN position <> 4 THEN a_id END AS a_id, CASE WHEN position <> 4 THEN b_id END AS b_id,
         CASE WHEN position <> 4 THEN p_a_wins END AS p, skipped OR position = 4 AS skipped,
         CASE WHEN position = 4 AND NOT skipped THEN 'earlier failure' ELSE reason END AS reason, model_version
  FROM log WHERE day(event_date) % 5 <> 0 AND position < 9),
earlier AS (
  SELECT * FROM recorded
  UNION ALL SELECT * REPLACE (position + 200 AS position) FROM recorded WHERE position = 4),
turned AS (
  SELECT event_name, event_date, position,
         CASE WHEN odd THEN regexp_replace(name_b, '^Jose ', 'José ') ELSE name_a END AS name_a,
         CASE WHEN odd THEN regexp_replace(name_a, '^Jose ', 'José ') ELSE name_b END AS name_b,
         CASE WHEN odd THEN b_id ELSE a_id END AS a_id, CASE WHEN odd THEN a_id ELSE b_id END AS b_id,
         CASE WHEN odd THEN 1.0 - p_a_wins ELSE p_a_wins END AS p, skipped, reason, 'next' AS model_version
  FROM (SELECT *, position % 2 = 1 AS odd FROM log)),
incoming AS (
  SELECT event_name, event_date, position, name_a, name_b, CASE WHEN position NOT IN (6, 10) THEN a_id END AS a_id,
         CASE WHEN position NOT IN (6, 10) THEN b_id END AS b_id, CASE WHEN position NOT IN (6, 10) THEN p END AS p,
         skipped OR position IN (6, 10) AS skipped,
         CASE WHEN position IN (6, 10) AND NOT skipped THEN 'later failure' ELSE reason END AS reason, model_version
  FROM turned
  UNION ALL SELECT event_name, event_date, position + 100, name_a, name_b, a_id, b_id, p, skipped, reason, model_version
  FROM turned WHERE position IN (2, 10)),
keyed AS (
  SELECT *, least(a_id, b_id) || '/' || greatest(a_id, b_id) AS ik,
         least(lower(strip_accents(name_a)), lower(strip_accents(name_b))) || '/' || greatest(lower(strip_accents(name_a)), lower(strip_accents(name_b))) AS nk
  FROM (SELECT 'old' AS src, * FROM earlier UNION ALL SELECT 'new', * FROM incoming)),
old AS (SELECT * FROM keyed WHERE src = 'old'),
new AS (SELECT * FROM keyed WHERE src = 'new'),
fresh AS (SELECT *, 'append' AS action FROM new WHERE (event_name, event_date) NOT IN (SELECT (event_name, event_date) FROM old)),
known AS (SELECT * FROM new WHERE (event_name, event_date) IN (SELECT (event_name, event_date) FROM old)),
reals AS (
  SELECT * FROM known k WHERE ik IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM old o WHERE o.event_name = k.event_name AND o.event_date = k.event_date AND o.ik = k.ik)
  QUALIFY row_number() OVER (PARTITION BY event_name, event_date, ik ORDER BY position) = 1),
stubs AS (
  SELECT * FROM known k WHERE ik IS NULL
    AND NOT EXISTS (SELECT 1 FROM old o WHERE o.event_name = k.event_name AND o.event_date = k.event_date AND o.nk = k.nk)
  QUALIFY row_number() OVER (PARTITION BY event_name, event_date, nk ORDER BY position) = 1),
placed AS (
  SELECT r.*, CASE WHEN row_number() OVER (PARTITION BY event_name, event_date, nk ORDER BY position) = 1
                    AND (EXISTS (SELECT 1 FROM old o WHERE o.event_name = r.event_name AND o.event_date = r.event_date
                                  AND o.nk = r.nk AND o.ik IS NULL)
                         OR EXISTS (SELECT 1 FROM stubs s WHERE s.event_name = r.event_name AND s.event_date = r.event_date
                                     AND s.nk = r.nk AND s.position < r.position))
               THEN 'replace' ELSE 'append' END AS action FROM reals r),
merged AS (
  SELECT *, 'keep' AS action FROM old o WHERE ik IS NOT NULL
     OR position < (SELECT max(x.position) FROM old x WHERE x.ik IS NULL AND x.event_name = o.event_name
                     AND x.event_date = o.event_date AND x.nk = o.nk)
     OR NOT EXISTS (SELECT 1 FROM placed p WHERE p.action = 'replace' AND p.event_name = o.event_name
                     AND p.event_date = o.event_date AND p.nk = o.nk)
  UNION ALL SELECT * FROM placed
  UNION ALL SELECT *, 'append' FROM stubs s WHERE NOT EXISTS (
    SELECT 1 FROM placed p WHERE p.event_name = s.event_name AND p.event_date = s.event_date AND p.nk = s.nk)
  UNION ALL SELECT * FROM fresh)
"""


@register(
    "merge_log",
    _MERGE_SQL
    + f"""SELECT event_name, CAST(event_date AS VARCHAR) AS event_date, position, name_a AS competitor_a_name,
                 name_b AS competitor_b_name, a_id AS competitor_a_id, b_id AS competitor_b_id, {q6('p')} AS p_a_wins,
                 skipped, reason, model_version, action FROM merged""",
)
def _(t: Tables):
    merged = predictions.merge_log(*_log_versions(t))
    return rounded(merged.drop("predicted_at_utc", "elo_a", "elo_b"))


@register("merge_counts", _MERGE_SQL + "SELECT action, count(*) AS n FROM merged GROUP BY action")
def _(t: Tables):
    return predictions.rows_written(predictions.merge_log(*_log_versions(t)))


def _graded(t: Tables) -> DataFrame:
    return predictions.grade(t.log, t.contests, F.lit(TODAY).cast("date"))


@register(
    "nearest_results",
    "SELECT event_name, CAST(event_date AS VARCHAR) AS event_date, position, contest_id FROM matched",
)
def _(t: Tables):
    past = t.log.filter((F.col("event_date") <= F.lit(TODAY)) & ~F.col("skipped"))
    left = resolve.with_pair(past, "competitor_a_id", "competitor_b_id")
    right = resolve.with_pair(t.contests, "competitor_a_id", "competitor_b_id")
    found = resolve.nearest_within(
        left, right, "pair", predictions.BOUT_KEY, "event_date", "date", "contest_id", predictions.GRADE_WINDOW_DAYS
    )
    return rounded(found)


@register(
    "graded_log",
    f"""SELECT event_name, CAST(event_date AS VARCHAR) AS event_date, position, won AS actual_winner, correct,
               {q6('ll')} AS log_loss_contribution, {q6('br')} AS brier_contribution, coin AS coin_flip_correct,
               {q6('CASE WHEN won IS NOT NULL THEN ln(2.0) END')} AS coin_flip_log_loss_contribution,
               CASE WHEN won IS NOT NULL THEN 0.25::DOUBLE END AS coin_flip_brier_contribution, dummy AS elo_dummy_correct FROM graded""",
)
def _(t: Tables):
    return rounded(_graded(t).select(*predictions.BOUT_KEY, *predictions.GRADES))


_RECORD_SQL = f"""
SELECT model_version, count(*) AS n_predicted, count(won) AS n_graded, {q6('avg(CAST(correct AS INTEGER))')} AS accuracy,
       {q6('avg(ll)')} AS log_loss, {q6('avg(br)')} AS brier, min(predicted_at_utc) AS first_prediction_at,
       {q6('avg(CAST(coin AS INTEGER))')} AS coin_flip_accuracy,
       {q6('avg(CASE WHEN won IS NOT NULL THEN ln(2.0) END)')} AS coin_flip_log_loss,
       {q6('avg(CASE WHEN won IS NOT NULL THEN 0.25 END)')} AS coin_flip_brier, count(dummy) AS elo_dummy_n,
       {q6('avg(CAST(dummy AS INTEGER))')} AS elo_dummy_accuracy
FROM graded WHERE NOT skipped GROUP BY GROUPING SETS ((model_version), ())"""


@register("track_record", _RECORD_SQL)
def _(t: Tables):
    return rounded(predictions.track_record(_graded(t)))


@register(
    "stored_track_record",
    f"""SELECT model_version, n_predicted, n_graded, accuracy, log_loss, brier, first_prediction_at,
               CASE WHEN model_version IS NULL THEN coin_flip_accuracy END AS coin_flip_accuracy,
               CASE WHEN model_version IS NULL THEN coin_flip_log_loss END AS coin_flip_log_loss,
               CASE WHEN model_version IS NULL THEN coin_flip_brier END AS coin_flip_brier,
               CASE WHEN model_version IS NULL THEN elo_dummy_n END AS elo_dummy_n,
               CASE WHEN model_version IS NULL THEN elo_dummy_accuracy END AS elo_dummy_accuracy
        FROM (SELECT * REPLACE (CASE WHEN model_version IS NOT NULL THEN first_prediction_at END AS first_prediction_at)
              FROM ({_RECORD_SQL}))""",
)
def _(t: Tables):
    """Every number of the nested document, as it was read back."""
    document = predictions.track_record_document(predictions.track_record(_graded(t)), "2000-07-01T00:00:00Z")
    path = scratch_path(t.spark, "track-record")
    documents.write_documents(document, path)
    read = documents.read_documents(t.spark, path, document.schema)
    scores = ["n_predicted", "n_graded", "accuracy", "log_loss", "brier"]
    versions = read.select(F.explode("model_versions").alias("model_version", "of")).select("model_version", "of.*")
    coin, dummy = F.col("baselines.coin_flip"), F.col("baselines.higher_elo_dummy")
    overall = read.select(
        *[f"overall.{c}" for c in scores],
        *[coin[c].alias(f"coin_flip_{c}") for c in ("accuracy", "log_loss", "brier")],
        dummy["n_graded"].alias("elo_dummy_n"), dummy["accuracy"].alias("elo_dummy_accuracy"),
    )
    return rounded(versions.unionByName(overall, allowMissingColumns=True))


@register(
    "track_record_document",
    f"""SELECT '2000-07-01T00:00:00Z' AS generated_at_utc, o.n_predicted, o.n_graded, o.log_loss, o.elo_dummy_n,
               o.coin_flip_accuracy, (SELECT string_agg(model_version, ',' ORDER BY model_version) FROM ({_RECORD_SQL})) AS versions
        FROM ({_RECORD_SQL}) o WHERE o.model_version IS NULL""",
)
def _(t: Tables):
    document = predictions.track_record_document(predictions.track_record(_graded(t)), "2000-07-01T00:00:00Z")
    return rounded(
        document.select(
            "generated_at_utc",
            "overall.n_predicted",
            "overall.n_graded",
            "overall.log_loss",
            F.col("baselines.higher_elo_dummy.n_graded").alias("elo_dummy_n"),
            F.col("baselines.coin_flip.accuracy").alias("coin_flip_accuracy"),
            F.array_join(F.map_keys("model_versions"), ",").alias("versions"),
        )
    )


@register(
    "refresh_decision",
    f"""SELECT true AS needed, 'raw max date ' || (SELECT max(date) FROM contests) || ' is newer than processed max date '
               || (SELECT max(date) FROM contests WHERE date < DATE '{TEST_START}') AS reason""",
)
def _(t: Tables):
    older = t.contests.filter(F.col("date") < F.lit(TEST_START).cast("timestamp_ntz"))
    return predictions.refresh_decision(t.contests.select("date"), older.select("date"))


@register(
    "promotion_decision",
    f"""SELECT n_graded, n_window, {q6('inc')} AS incumbent_log_loss, {q6('cand')} AS candidate_log_loss,
               n_graded >= 150 AS enough, n_graded >= 150 AND cand < inc - 0.002 AS promote
        FROM (SELECT count(*) AS n_graded FROM graded WHERE won IS NOT NULL AND event_date > DATE '{TRAIN_END}'),
             (SELECT count(*) AS n_window, avg({_LL.format(p='p')}) AS inc, avg({_LL.format(p='(0.25 + 0.5 * p)')}) AS cand
              FROM scored WHERE date >= (SELECT max(date) - INTERVAL 24 MONTH FROM scored))""",
)
def _(t: Tables):
    cutoff = dataset.one_row(t.contests.agg(F.lit(TRAIN_END).cast("date").alias("cutoff")))
    scored = scored_table(t).select(
        "date", "y", F.col("p").alias("p_incumbent"), (0.25 + 0.5 * F.col("p")).alias("p_candidate")
    )
    return rounded(predictions.promotion_decision(_graded(t), cutoff, scored))


# --- models ---------------------------------------------------------------------------------------------------

@register(
    "combine_members",
    f"""SELECT contest_id, {q6('(p + (0.1 + 0.8 * p) + (0.2 + 0.6 * p)) / 3')} AS winner_prob,
               {q6('greatest(p, 0.1 + 0.8 * p, 0.2 + 0.6 * p) - least(p, 0.1 + 0.8 * p, 0.2 + 0.6 * p)')} AS winner_spread
        FROM scored""",
)
def _(t: Tables):
    p = F.col("p")
    members = scored_table(t).select("contest_id", F.explode(F.array(p, 0.1 + 0.8 * p, 0.2 + 0.6 * p)).alias("p"))
    return rounded(learn.combine_members(members))


_COEFFICIENTS = {
    "elo_diff": 0.004, "age_diff": -0.02, "reach_diff": 0.01, "streak_diff": 0.05, "kd_pf_diff": 0.1,
    "career_win_rate_diff": 0.8, "td_landed_pf_diff": 0.03, "height_diff": 0.005, "age_a": 0.02, "age_b": -0.03,
}
# Turned round, a difference changes its sign and a side's own value becomes the other's.
_TURNED = {"age_a": "age_b", "age_b": "age_a"}
_CONTRIBUTION = "CASE c " + " ".join(
    f"WHEN '{c}' THEN (coalesce({c}, 0) - {f'coalesce({_TURNED[c]}, 0)' if c in _TURNED else f'coalesce(-{c}, 0)'}) * {w} / 2"
    for c, w in _COEFFICIENTS.items()
) + " END"


def _contributions(t: Tables) -> DataFrame:
    forward = t.features.select("contest_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _COEFFICIENTS])
    turned = [F.col(_TURNED[c]) if c in _TURNED else -F.col(c) for c in _COEFFICIENTS]
    backward = forward.select("contest_id", *[v.alias(c) for v, c in zip(turned, _COEFFICIENTS, strict=True)])
    return learn.additive_contributions(forward, backward, _COEFFICIENTS)


_LONG = "(SELECT contest_id, c, coalesce({value}, 0) AS v FROM features, (VALUES {names}) x(c))".format(
    value=_CONTRIBUTION, names=", ".join(f"('{c}')" for c in _COEFFICIENTS)
)


@register("contributions", f"SELECT contest_id, c AS feature, {q6('v')} AS contribution FROM {_LONG}")
def _(t: Tables):
    return rounded(_contributions(t))


@register(
    "top_factors",
    f"""SELECT contest_id, rank, label, {q6('v')} AS contribution, CASE WHEN v >= 0 THEN first_id ELSE second_id END AS favors,
               CASE WHEN abs(round(v, 6)) > 0.3 THEN 'strong' WHEN abs(round(v, 6)) > 0.1 THEN 'moderate' ELSE 'slight' END AS strength
        FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY abs(round(v, 6)) DESC, c) AS rank,
                     CASE c {' '.join(f"WHEN '{c}' THEN '{learn.FEATURE_LABELS[c].replace(chr(39), chr(39) * 2)}'" for c in _COEFFICIENTS)} END AS label
              FROM {_LONG})
        JOIN (SELECT contest_id, CASE WHEN swapped THEN b_id ELSE a_id END AS first_id,
                     CASE WHEN swapped THEN a_id ELSE b_id END AS second_id
              FROM (SELECT *, md5(contest_id)[32] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS swapped FROM decisive))
          USING (contest_id) WHERE rank <= 6""",
)
def _(t: Tables):
    a, b = F.col("competitor_a_id"), F.col("competitor_b_id")
    swapped = features.swap_side(F.col("contest_id"))
    sides = dataset.decisive(t.contests).select(
        "contest_id", F.when(swapped, b).otherwise(a).alias("name_a"), F.when(swapped, a).otherwise(b).alias("name_b")
    )
    exact = _contributions(t).withColumn("contribution", r6("contribution"))
    return rounded(learn.top_factors(exact, sides))
