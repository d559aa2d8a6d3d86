import math
import statistics

import pytest
from pyspark.sql import functions as F

from contestry.operators import evaluation, learn, quantiles


def scored(spark, pairs):
    return spark.createDataFrame([(float(y), float(p)) for y, p in pairs], "y double, p double")


def test_winner_metrics(spark):
    row = evaluation.winner_metrics(scored(spark, [(1, 0.5), (0, 0.5)])).first()
    assert row["accuracy"] == 0.5 and row["log_loss"] == pytest.approx(math.log(2)) and row["brier"] == 0.25


def test_ties_pick_a_in_accuracy_and_b_in_the_higher_rating_pick(spark):
    got = {r["model"]: r for r in evaluation.baseline_ladder(scored(spark, [(1, 0.5), (1, 0.5), (0, 0.5)])).collect()}
    assert got["elo"]["accuracy"] == pytest.approx(2 / 3)
    assert got["higher_elo"]["accuracy"] == pytest.approx(1 / 3) and got["higher_elo"]["log_loss"] is None


@pytest.mark.parametrize("pairs", [[("a", "a"), ("b", "a"), ("b", "a")], [("a", "b"), ("a", "a"), ("a", "b")]])
def test_macro_f1_counts_labels_of_either_side(spark, pairs):
    row = evaluation.macro_f1(spark.createDataFrame(pairs, "t string, q string"), "t", "q").first()
    assert row["macro_f1"] == pytest.approx(0.25) and row["accuracy"] == pytest.approx(1 / 3)


def test_majority_takes_the_smallest_of_a_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert evaluation.majority_class(df, "x").first()["label"] == "a"


def test_calibration_bins_are_closed_on_the_right(spark):
    rows = evaluation.calibration_table(scored(spark, [(1, 0.0), (0, 0.1), (1, 0.11), (1, 1.0)])).collect()
    got = {r["bin"]: r["count"] for r in rows}
    assert len(got) == 10 and sum(got.values()) == 4
    assert got["[0.0, 0.1)"] == 2 and got["[0.1, 0.2)"] == 1 and got["[0.9, 1.0)"] == 1
    assert [r["mean_pred"] for r in rows if r["bin"] == "[0.4, 0.5)"] == [None]


def test_histogram(spark):
    got = {r["edge"]: r["n"] for r in evaluation.histogram(scored(spark, [(0, -1), (0, 0.05), (0, 1), (0, 2)]), "p").collect()}
    assert len(got) == 20 and got["0.00"] == 1 and got["0.05"] == 1 and got["0.95"] == 2


def test_comparison_gate(spark):
    df = spark.createDataFrame([(1.0, 0.99, 0.5), (0.0, 0.01, 0.5)], "y double, m double, k double")
    row = evaluation.compare(df, "m", "k").first()
    assert row["implausible"] and row["delta_log_loss"] < -0.02 and row["n"] == 2


def test_exact_medians_by_bracketing(spark):
    import random
    import statistics

    rng = random.Random(2)
    columns = {
        "even": [rng.gauss(0, 1) for _ in range(400)],
        "hot": [7.0] * 200 + [rng.random() * 1e6 for _ in range(200)],
        "wide": [10.0 ** rng.uniform(-8, 8) for _ in range(399)] + [None],
        "none": [None] * 400,
        "same": [3.0] * 400,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    want = {c: statistics.median([x for x in v if x is not None]) if c != "none" else None for c, v in columns.items()}
    assert quantiles.exact_medians(df, list(columns)) == pytest.approx(want)


def test_medians_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    columns = {
        "inf": [1.0, 2.0, inf, 3.0], "low": [-inf, -inf, -inf, 1.0], "nan": [nan, nan, nan, 1.0], "between": [1.0, 2.0, inf, nan],
        "huge": [-1.7e308, 1.7e308, 1.0, 5.0], "tiny": [5e-324, 0.0, 1e-323, -0.0],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = quantiles.exact_medians(df, list(columns))
    assert (got["inf"], got["low"], got["huge"], got["between"]) == (2.5, -inf, 3.0, inf)
    assert math.isnan(got["nan"]) and 0.0 <= got["tiny"] <= 5e-324


def test_many_columns_go_a_dozen_at_a_time(spark, monkeypatch):
    values = [[float((i * k) % 17) for k in range(1, 31)] for i in range(40)]
    names = [f"c{k}" for k in range(30)]
    df = spark.createDataFrame(values, ", ".join(f"{c} double" for c in names))
    asked, medians = [], quantiles._medians
    monkeypatch.setattr(quantiles, "_medians", lambda rows, some: asked.append(list(some)) or medians(rows, some))
    stats = learn.preprocessing_stats(df, names)
    assert [len(some) for some in asked] == [12, 12, 6] and sum(asked, []) == names
    scale = learn.fitted(stats)
    assert list(scale) == names
    for k, c in enumerate(names):
        column = [row[k] for row in values]
        assert scale[c] == pytest.approx((statistics.median(column), statistics.mean(column), statistics.pstdev(column) or 1.0))


def test_preprocessing(spark):
    train = spark.createDataFrame([(40.0, 1.0, None), (60.0, 1.0, None), (None, 1.0, None)], "x double, c double, n double")
    scale = learn.fitted(learn.preprocessing_stats(train, ["x", "c", "n"]))
    assert scale["x"] == pytest.approx((50.0, 50.0, math.sqrt(200 / 3)))
    assert scale["c"] == (1.0, 1.0, 1.0) and scale["n"] == (0.0, 0.0, 1.0)
    val = spark.createDataFrame([(None, 3.0, 2.0)], "x double, c double, n double")
    assert tuple(learn.standardised(val, scale).first()) == pytest.approx((0.0, 2.0, 2.0))


def test_category_index(spark):
    index = learn.category_index(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string"), "k")
    df = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "k string")
    got = {r["k"]: r["k_index"] for r in learn.with_category(df, index, "k").collect()}
    assert got == {"a": 1, "b": 2, "new": 0, None: 0}


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "k string")
    got = {r["label"]: r["weight"] for r in learn.class_weights(df, "k", ["a", "b", "c"]).collect()}
    assert got == pytest.approx({"a": 5 / 9, "b": 5 / 3, "c": 5 / 3})


def test_class_priors(spark):
    rows = [("ko_tko", "1", 3), ("ko_tko", "45", None), ("decision", None, 3), ("submission", "1", 5)]
    df = spark.createDataFrame(rows, "y_method string, y_finish_round string, scheduled_rounds int")
    got = {(r["prior"], r["label"]): r["share"] for r in learn.class_priors(df).collect()}
    assert got[("method", "ko_tko")] == 0.5 and got[("round_3", "45")] == 0.0 and got[("round_3", "1")] == 1.0
    assert got[("round_5", "1")] == 1.0 and got[("round_5", "45")] == 0.0


def test_correction_factors_reach_the_empirical_shares(spark):
    import random

    rng = random.Random(4)
    rows = []
    for _ in range(200):
        w = [rng.random() + 0.1, rng.random() + 0.5, rng.random() + 1.0]
        rows.append(tuple(x / sum(w) for x in w))
    probs = spark.createDataFrame(rows, "p_a double, p_b double, p_c double").cache()
    empirical = {"a": 0.5, "b": 0.3, "c": 0.2}
    factors = learn.prior_factors(probs, empirical)
    assert learn.mean_probs(probs, list("abc"), factors).first().asDict() == pytest.approx(empirical, abs=1e-8)
    assert learn.prior_factors(probs, {"a": 0.9, "b": 0.0, "c": 0.1})["b"] == 0.0
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "label string, share double")
    few = spark.createDataFrame([(1e-9, 0.25)], "p_a double, p_b double")
    assert {r["label"]: r["factor"] for r in learn.share_ratios(shares, few, ["a", "b"]).collect()} == {"a": 0.0, "b": 2.0}


def test_coarse_search_finds_the_grid_minimum(spark):
    rows = [(g, 0.3 * g * (k % 7 - 3), float((k * k + g) % 5 < 2 + (k % 7) // 4)) for g in range(1, 5) for k in range(60)]
    scored = spark.createDataFrame(rows, "g int, logit double, y double")
    whole = learn.temperature_losses(scored, learn.TEMPERATURES, "g").collect()
    want = {g: min((r["log_loss"], r["t"]) for r in whole if r["g"] == g)[1] for g in range(1, 5)}
    assert {r["g"]: r["t"] for r in learn.fit_temperatures(scored, "g").collect()} == want


def test_temperature_of_overconfident_logits(spark):
    import random

    rng = random.Random(9)
    logits = [rng.gauss(0, 1) for _ in range(3000)]
    rows = [(3 * x, float(rng.random() < 1 / (1 + math.exp(-x)))) for x in logits]
    best = learn.fit_temperature(spark.createDataFrame(rows, "logit double, y double")).first()["t"]
    assert 2.4 < best <= 3.0


def test_masked_rounds(spark):
    df = spark.createDataFrame([(3, 0.4, 0.3, 0.1, 0.2), (5, 0.4, 0.3, 0.1, 0.2), (None, 0.4, 0.3, 0.1, 0.2)],
                               "scheduled_rounds int, p_1 double, p_2 double, p_3 double, p_45 double")
    short, long, unknown = learn.masked_rounds(df).collect()
    assert short["p_45"] == 0 and short["p_1"] == pytest.approx(0.5) and long["p_45"] == pytest.approx(0.2)
    assert unknown["p_45"] == 0


def test_models_learn(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((f"c{i}", x, z, int(x + 0.3 * rng.gauss(0, 1) > 0), "a" if z > 0 else "b", i % 4 == 0))
    df = spark.createDataFrame(rows, "contest_id string, x double, z double, y_winner int, k string, is_val boolean")
    ready = learn.assembled(df, ["x", "z"]).cache()
    model = learn.train_winner(ready, max_rounds=15)
    y = F.col("y_winner").cast("double").alias("y")
    assert evaluation.winner_metrics(learn.winner_scores(model, ready, y)).first()["accuracy"] > 0.85
    assert learn.importances(model, ["x", "z"], df).first()["feature"] == "x"
    classes = learn.train_multiclass(ready, "k", ["a", "b"])
    assert evaluation.macro_f1(learn.class_scores(classes, ready, ["a", "b"], "k"), "k", "predicted").first()["accuracy"] > 0.9
    one, again, other = (learn.train_member(ready, s).coefficients.toArray().tolist() for s in (1, 1, 2))
    assert one == again != other


def test_contributions_and_factors(spark):
    forward = spark.createDataFrame([("c", 1.0, 2.0)], "contest_id string, elo_diff double, age_diff double")
    backward = spark.createDataFrame([("c", -1.0, -1.0)], "contest_id string, elo_diff double, age_diff double")
    parts = learn.additive_contributions(forward, backward, {"elo_diff": 0.5, "age_diff": -0.1})
    got = {r["feature"]: r["contribution"] for r in parts.collect()}
    assert got == pytest.approx({"elo_diff": 0.5, "age_diff": -0.15})
    names = spark.createDataFrame([("c", "A", "B")], "contest_id string, name_a string, name_b string")
    top = learn.top_factors(parts, names, top_n=2).orderBy("rank").collect()
    assert [(r["label"], r["favors"], r["strength"]) for r in top] == [
        ("Elo rating edge", "A", "strong"), ("Age gap", "B", "moderate")]
