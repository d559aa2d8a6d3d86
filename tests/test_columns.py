import math

import pytest
from pyspark.sql import functions as F

from contestry.functions import labels, names, odds, parsing, probability, rating


def values(spark, make, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_landed_attempted(spark):
    got = values(spark, parsing.landed_attempted, ["45 of 118", " 0 of 3 ", "--", "45/118", None, "4 of", "nan"])
    assert [tuple(g) for g in got] == [(45, 118), (0, 3)] + [(None, None)] * 5


@pytest.mark.parametrize(
    "make, texts, want",
    [
        (parsing.clock_seconds, ["2:35", "0:00", "2:3", "x", "---", None], [155, 0, None, None, None, None]),
        (parsing.height_inches, ["5' 11\"", "5'11", "5'", "N/A"], [71.0, 71.0, None, None]),
        (parsing.reach_inches, ['72"', "72.5", "72 in", "--"], [72.0, 72.5, None, None]),
        (parsing.percent, ["45%", "45", "4.5%", "%", ""], [0.45, 0.45, 0.045, None, None]),
        (parsing.clean_text, [" a ", " -- ", "N/A", "NaN", "", None], ["a", None, None, None, None, None]),
        (parsing.number, ["1.5", " 2 ", "x", "NaN", None], [1.5, 2.0, None, None, None]),
        (
            parsing.trailing_hex_id,
            ["http://x/d215c4e6dc1346ae", "http://x/d215c4e6dc1346ae/ ", "http://x/d215", "", None],
            ["d215c4e6dc1346ae", "d215c4e6dc1346ae", None, None, None],
        ),
        (
            labels.method,
            ["KO/TKO", "TKO - Doctor's Stoppage", "Technical Submission", "Technical Decision", "DQ", "--", None],
            ["ko_tko", "ko_tko", "submission", "decision", None, None, None],
        ),
        (
            labels.decision_subtype,
            ["Decision - Split", "Decision - Unanimous", "Technical Decision", "Split Submission", None],
            ["split", "unanimous", None, None, None],
        ),
        (labels.scheduled_rounds, ["3 Rnd (5-5-5)", "5Rnd", "No Time Limit", None], [3, 5, None, None]),
        (
            labels.weight_class,
            ["Light Heavyweight Title Bout", "Women's Flyweight Bout", "catchweight bout", "Superfight", None],
            ["Light Heavyweight", "Women's Flyweight", "Catch Weight", None, None],
        ),
        (labels.is_title, ["X Title Bout", "bout", None], [True, False, False]),
        (names.normal_name, [" José Aldo ", "JOSE", "Straße", None], ["josé aldo", "jose", "strasse", None]),
        (names.folded_name, ["José Aldo", "Rakić", "Ørsted", "Łukasz"], ["jose aldo", "rakic", "ørsted", "łukasz"]),
    ],
)
def test_text_columns(spark, make, texts, want):
    assert values(spark, make, texts) == want


def test_composed_and_decomposed_forms_are_the_same_name(spark):
    got = values(spark, names.normal_name, ["José", "José", "Jose"])
    assert got[0] == got[1] != got[2]


def test_mixed_dates(spark):
    got = values(spark, parsing.mixed_date, ["2020/01/31", "Jul 19, 1987", "TBA", None])
    assert [g and g.date().isoformat() for g in got] == ["2020-01-31", "1987-07-19", None, None]


def test_round_buckets(spark):
    assert values(spark, labels.round_bucket, [1, 3, 4, 5, None], "int") == ["1", "3", "45", "45", None]


def test_odds(spark):
    assert values(spark, odds.decimal_implied, [2.0, 4.0], "double") == [0.5, 0.25]
    fav, dog = values(spark, odds.american_implied, [-190.0, 165.0], "double")
    row = spark.range(1).select(*odds.devig(F.lit(fav), F.lit(dog))).first()
    assert row[0] == pytest.approx(0.634, abs=1e-3) and row[0] + row[1] == pytest.approx(1.0)
    with pytest.raises(Exception, match="cannot be 0"):
        values(spark, odds.american_implied, [0.0], "double")


def test_rating_arithmetic(spark):
    row = spark.range(1).select(
        rating.expected_score(F.lit(1500.0), F.lit(1500.0)),
        rating.striking_share(F.lit(None), F.lit(None), F.lit(None), F.lit(None)),
        rating.striking_share(F.lit(10.0), F.lit(1.0), F.lit(1.0), F.lit(0.0)),
        rating.striking_share(F.lit(0.0), F.lit(4.0), F.lit(0.0), F.lit(0.0)),
    ).first()
    assert tuple(row) == (0.5, 0.5, 0.5, 0.0)


def test_prior_correction(spark):
    p = {"a": F.lit(0.7), "b": F.lit(0.3)}
    got = spark.range(1).select(*probability.prior_corrected(p, {"a": F.lit(0.1), "b": F.lit(0.9)}).values()).first()
    assert got[0] == pytest.approx(0.07 / 0.34) and got[1] == pytest.approx(0.27 / 0.34)
    same = spark.range(1).select(*probability.prior_corrected(p, {"a": F.lit(0.0), "b": F.lit(0.0)}).values()).first()
    assert tuple(same) == (0.7, 0.3)


def test_log_loss_is_finite_at_the_edges(spark):
    row = spark.range(1).select(
        probability.log_loss_term(F.lit(1.0), F.lit(0.5)), probability.log_loss_term(F.lit(1.0), F.lit(0.0))
    ).first()
    assert row[0] == pytest.approx(math.log(2)) and math.isfinite(row[1])


def test_event_slug_and_pair_key(spark):
    df = spark.createDataFrame([("Open Night: du X vs. Y", "2026-07-18", "b", "a")], "n string, d string, x string, y string")
    row = df.select(names.event_slug(F.col("n"), F.col("d")), names.pair_key(F.col("x"), F.col("y"))).first()
    assert row[0] == "EVENT_Open_Night_du_X_vs_Y_2026-07-18.json" and row[1] == ["a", "b"]
