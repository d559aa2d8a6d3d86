import math

import pytest
from pyspark.sql import functions as F

from contestry.functions.rating import RatingParams
from contestry.operators import ratings
from frames import CONTESTS_DDL, STATS_DDL, contest, frame, random_league, sequential_ratings, stat

PARAMS = RatingParams(k_early=40.0, k_late=24.0, early_contests=5, finish_bonus=1.5)


def table(spark, contests, stats, params=PARAMS, **options):
    done = ratings.run_elo(frame(spark, contests, CONTESTS_DDL), frame(spark, stats, STATS_DDL), params, **options)
    names = ("pre_overall", "pre_striking", "pre_grappling", "pre_fights", "post_overall", "post_striking", "post_grappling")
    rows = done.collect()
    out = {(r["contest_id"], r["side"]): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=1e-9), key


def test_hand_computed(spark):
    contests = [
        contest("f1", "2020-01-01", "x", "y", "a"),
        contest("f2", "2020-02-01", "x", "z", "a", "ko_tko"),
        contest("f3", "2020-03-01", "y", "z", "draw"),
        contest("f4", "2020-04-01", "x", "y", "nc"),
    ]
    stats = [stat("f1", "a", sig_landed=0.0, td_landed=4.0)]
    got = table(spark, contests, stats)
    assert got[("f1", "a")][4:] == pytest.approx((1520.0, 1500.0, 1520.0))
    assert got[("f1", "b")][4:] == pytest.approx((1480.0, 1500.0, 1480.0))
    gain = got[("f2", "a")][4] - got[("f2", "a")][0]
    assert gain == pytest.approx(60 * (1 - 1 / (1 + 10 ** (-20 / 400))))
    assert got[("f3", "a")][4] + got[("f3", "b")][4] == pytest.approx(got[("f3", "a")][0] + got[("f3", "b")][0])
    assert ("f4", "a") not in got and got[("f3", "a")][3] == 1


@pytest.mark.parametrize("options", [{}, {"hot_rows": 20}], ids=["plain", "hot careers"])
def test_rounds_equal_the_sequential_result(spark, options):
    """One competitor is in a third of all contests."""
    contests, stats = random_league(seed=3, n=90, people=30, star="star")
    close(table(spark, contests, stats, **options), sequential_ratings(contests, stats, 40.0, 24.0, 5, 1.5))


def test_all_contests_on_one_day(spark):
    contests, stats = random_league(seed=4, n=40, people=8)
    contests = [{**c, "date": contests[0]["date"]} for c in contests]
    close(table(spark, contests, stats), sequential_ratings(contests, stats, 40.0, 24.0, 5, 1.5))


def test_a_contest_without_date_fails(spark):
    contests = [contest("f0", "2020-01-01", "x", "y", "a"), contest("f1", "2020-02-01", "x", "z", "a")]
    contests[1]["date"] = None
    with pytest.raises(Exception, match="no date for rated contest f1"):
        table(spark, contests, [stat("f0", "a")])


def test_parameter_sets_advance_together(spark):
    contests, stats = random_league(seed=5, n=60, people=12)
    sets = [PARAMS, RatingParams(64.0, 48.0, 3, 1.4)]
    done = ratings.rate(frame(spark, contests, CONTESTS_DDL), frame(spark, stats, STATS_DDL), sets)
    for i, p in enumerate(sets):
        rows = ratings.ratings_table(done, i).collect()
        want = sequential_ratings(contests, stats, p.k_early, p.k_late, p.early_contests, p.finish_bonus)
        for r in rows:
            assert r["post_striking"] == pytest.approx(want[(r["contest_id"], r["side"])][5], abs=1e-9)


def test_grid_and_selection(spark):
    contests, stats = random_league(seed=6, n=60, people=10)
    grid = [RatingParams(k, 24.0, 5, 1.2) for k in (10.0, 40.0, 40.0)]
    losses = ratings.grid_losses(frame(spark, contests, CONTESTS_DDL), frame(spark, stats, STATS_DDL), grid)
    got = {r["grid_index"]: r["log_loss"] for r in losses.collect()}
    for i, p in enumerate(grid):
        want = sequential_ratings(contests, stats, p.k_early, p.k_late, 5, 1.2)
        terms = []
        for c in contests:
            if c["winner"] in "ab":
                ra, rb = want[(c["contest_id"], "a")][0], want[(c["contest_id"], "b")][0]
                q = 1 / (1 + 10 ** ((rb - ra) / 400))
                terms.append(-math.log(q if c["winner"] == "a" else 1 - q))
        assert got[i] == pytest.approx(sum(terms) / len(terms))
    tied = losses.withColumn("log_loss", F.lit(0.5))
    assert ratings.first_minimum(tied).first()["grid_index"] == 0


def test_same_competitor_on_both_sides_fails(spark):
    with pytest.raises(Exception, match="same competitor"):
        table(spark, [contest("f", "2020-01-01", "x", "x", "a")], [stat("f", "a")])


def test_no_rated_contests(spark):
    assert table(spark, [contest("f", "2020-01-01", "x", "y", "nc")], [stat("f", "a")]) == {}


def test_checks_find_nothing_wrong(spark):
    contests, stats = random_league(seed=7, n=60, people=9)
    df = frame(spark, contests, CONTESTS_DDL)
    row = ratings.rating_checks(ratings.run_elo(df, frame(spark, stats, STATS_DDL), PARAMS), df).first()
    assert row["n_rows"] == row["n_expected"] and row["n_broken_chains"] == 0 and row["n_out_of_range"] == 0


def test_contests_move_few_rounds(spark):
    """Waiting contests written by all rounds: a small multiple of the contests, however long the chains."""
    contests, stats = random_league(seed=8, n=400, people=20)
    contests = [{**c, "contest_id": f"c{k:04d}"} for k, c in enumerate(sorted(contests, key=lambda c: c["date"]))]
    done = ratings.rate(frame(spark, contests, CONTESTS_DDL), frame(spark, stats, STATS_DDL), [PARAMS])
    root = done.inputFiles()[0].split("/level=")[0]
    rounds = spark.read.parquet(root)
    waited = rounds.filter("NOT done").count()
    n, last = done.count(), rounds.agg(F.max("level")).first()[0]
    assert last > 40 and waited < 4 * n


def test_eras_follow_the_days(spark):
    contests, _ = random_league(seed=9, n=300, people=30)
    ends = ratings.era_ends(frame(spark, contests, CONTESTS_DDL))
    assert len(ends) > 10 and ends == sorted(set(ends))
    days = frame(spark, contests, CONTESTS_DDL).select("date", ratings._era(F.col("date"), ends).alias("era"))
    sizes = [r["count"] for r in days.groupBy("era").count().collect()]
    assert len(sizes) == len(ends) + 1 and max(sizes) < 5 * len(contests) / len(sizes)
    assert ratings.era_ends(frame(spark, contests, CONTESTS_DDL).limit(0)) == []
