import datetime as dt

import pytest
from pyspark.sql import functions as F

from contestry.operators import careers, features, history, ratings
from contestry.plans.registry import Tables
from frames import CONTESTS_DDL, STATS_DDL, contest, frame, random_league, stat


def tables(spark, contests, stats):
    return frame(spark, contests, CONTESTS_DDL), frame(spark, stats, STATS_DDL)


def test_hand_computed(spark):
    contests = [
        contest("f1", "2020-01-01", "x", "y", "a", "ko_tko", duration_sec=300.0),
        contest("f2", "2020-03-01", "z", "x", "draw", duration_sec=900.0),
    ]
    stats = [
        stat("f1", "a", kd=2.0, sig_landed=30.0, td_landed=1.0, td_attempted=2.0, ctrl_sec=60.0),
        stat("f1", "b", sig_landed=10.0, td_landed=0.0, td_attempted=4.0),
    ]
    c, s = tables(spark, contests, stats)
    elo = ratings.run_elo(c, s)
    got = {(r["contest_id"], r["competitor_id"]): r for r in history.build_history(c, s, elo).collect()}
    debut = got[("f1", "x")]
    assert (debut["career_fights"], debut["streak"], debut["career_win_rate"], debut["days_since_last"]) == (0, 0, None, None)
    x = got[("f2", "x")]
    assert (x["career_win_rate"], x["career_finish_rate"], x["streak"], x["days_since_last"]) == (1.0, 1.0, 1, 60)
    assert (x["kd_pf"], x["td_acc"], x["td_def"], x["sig_pm"], x["sig_absorbed_pm"], x["ctrl_share"]) == (
        2.0, 0.5, 1.0, 6.0, 2.0, 0.2)
    assert (x["last5_win_rate"], x["last5_avg_opp_elo"]) == (1.0, 1500.0)
    snap = {r["competitor_id"]: r for r in history.build_snapshots(c, s, elo).collect()}
    assert (snap["x"]["career_fights"], snap["x"]["streak"], snap["x"]["career_wins"]) == (2, 0, 1.5)
    assert snap["x"]["career_finish_rate"] == pytest.approx(1 / 1.5)
    assert snap["y"]["elo_overall"] < 1500 and "days_since_last" not in snap["y"].asDict()


def brute_force(contests, stats, elo):
    """Career statistics by replaying every competitor's contests one by one."""
    by = {(s["contest_id"], s["side"]): s for s in stats}
    careers_, out = {}, {}
    for c in sorted(contests, key=lambda c: (c["date"], c["contest_id"])):
        if c["winner"] == "nc":
            continue
        for side, other in (("a", "b"), ("b", "a")):
            past = careers_.get(c[f"competitor_{side}_id"], [])
            streak = 0
            for p in past:
                streak = {1.0: max(streak, 0) + 1, 0.0: min(streak, 0) - 1, 0.5: 0}[p["score"]]
            opposed = [p["opp"] for p in past if p["opp"] is not None][-5:]
            time = sum(p["time"] for p in past)
            out[(c["contest_id"], side)] = (
                len(past),
                sum(p["score"] for p in past),
                streak,
                (c["date"] - past[-1]["date"]).days if past else None,
                sum(p["score"] for p in past[-5:]) / len(past[-5:]) if past else None,
                sum(opposed) / len(opposed) if opposed else None,
                sum(p["sig"] for p in past) / (time / 60) if time else None,
            )
        for side, other in (("a", "b"), ("b", "a")):
            own = by.get((c["contest_id"], side), {})
            careers_.setdefault(c[f"competitor_{side}_id"], []).append(
                dict(
                    score={"draw": 0.5, side: 1.0}.get(c["winner"], 0.0), date=c["date"],
                    opp=elo.get((c["contest_id"], other)), time=c["duration_sec"] or 0.0, sig=own.get("sig_landed") or 0.0,
                )
            )
    return out


@pytest.mark.parametrize("limit", [careers.HOT_ROWS, 10, 1], ids=["plain", "hot star", "all hot"])
def test_equals_replay_also_when_careers_are_split(spark, limit):
    contests, stats = random_league(seed=11, n=200, people=20, star="star")
    c, s = tables(spark, contests, stats)
    # Ratings with gaps: the last-five opponents must skip unrated ones.
    elo = ratings.run_elo(c, s).filter(F.crc32("contest_id") % 3 != 0)
    known = {(r["contest_id"], r["side"]): r["pre_overall"] for r in elo.collect()}
    names = ("career_fights", "career_wins", "streak", "days_since_last", "last5_win_rate", "last5_avg_opp_elo", "sig_pm")
    got = {(r["contest_id"], r["side"]): tuple(r[n] for n in names) for r in history.build_history(c, s, elo, limit).collect()}
    want = brute_force(contests, stats, known)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key]), key


def test_competitors_are_counted_without_joins(spark, monkeypatch):
    contests, stats = random_league(seed=14, n=60, people=8, star="star")
    c, s = tables(spark, contests, stats)
    elo = ratings.run_elo(c, s)
    counted, count = [], careers.hot_keys
    monkeypatch.setattr(careers, "hot_keys", lambda rows, limit: counted.append(rows) or count(rows, limit))
    history.build_history(c, s, elo, 10), history.build_snapshots(c, s, elo, 10), history.states_after(c, s, elo, 10)
    want = sorted(r[0] for r in history.side_values(c, s, elo).select("competitor_id").collect())
    assert len(counted) == 3
    for rows in counted:
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        assert sorted(r["competitor_id"] for r in rows.collect()) == want


def test_snapshots_do_not_depend_on_the_split(spark):
    contests, stats = random_league(seed=12, n=120, people=12, star="star")
    c, s = tables(spark, contests, stats)
    elo = ratings.run_elo(c, s)
    plain = history.build_snapshots(c, s, elo)
    split = history.build_snapshots(c, s, elo, limit=8)

    def rows(df):
        return {r["competitor_id"]: [round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()}

    assert rows(plain) == rows(split)


def test_links_do_not_depend_on_the_split(spark):
    contests, stats = random_league(seed=13, n=120, people=12, star="star")
    rows = [(c["contest_id"], c["date"], s, c[f"competitor_{s}_id"]) for c in contests for s in "ab"]
    df = spark.createDataFrame(rows, "contest_id string, date timestamp_ntz, side string, competitor_id string")

    def seen(limit):
        got = careers.career_links(df, limit).collect()
        return {(r["contest_id"], r["side"]): (r["ordinal"], r["next"] and r["next"]["contest_id"]) for r in got}

    assert seen(careers.HOT_ROWS) == seen(5) and len(seen(5)) == 240


PEOPLE = "competitor_id string, name string, height_cm double, reach_cm double, stance string, dob timestamp_ntz"


def test_features_swap_and_flags(spark):
    import datetime as dt

    contests = [contest(f"c{i}", "2020-01-01", f"x{i}", f"y{i}", "a", "ko_tko", finish_round=4) for i in range(12)]
    contests.append(contest("d", "2020-02-01", "x0", "y0", "draw"))
    c, s = tables(spark, contests, [stat("c0", "a")])
    people = spark.createDataFrame(
        [(f"x{i}", "X", 180.0, None, "Southpaw", dt.datetime(1990, 1, 1)) for i in range(12)]
        + [(f"y{i}", "Y", 170.0, 175.0, None, None) for i in range(12)],
        PEOPLE,
    )
    elo = ratings.run_elo(c, s)
    rows = features.build_features(c, people, elo, history.build_history(c, s, elo)).collect()
    assert len(rows) == 12 and {r["swapped"] for r in rows} == {True, False}
    for r in rows:
        sign = -1 if r["swapped"] else 1
        assert r["height_diff"] == 10.0 * sign and r["reach_diff"] is None and r["age_diff"] is None
        assert r["y_winner"] == (0 if r["swapped"] else 1) and r["y_finish_round"] == "45"
        mine = "b" if r["swapped"] else "a"
        assert r[f"reach_missing_{mine}"] and r[f"southpaw_{mine}"] and not r[f"dob_missing_{mine}"]
        assert r["stance_mismatch"] and not r["debut_matchup"]


def test_features_ignore_later_contests(spark):
    contests, stats = random_league(seed=14, n=150, people=12)
    c, s = tables(spark, contests, stats)
    people = spark.createDataFrame([(f"p{i}", "n", 180.0, 170.0, None, None) for i in range(12)], PEOPLE)
    cutoff = F.lit("2010-05-01").cast("timestamp_ntz")

    def build(rows):
        elo = ratings.run_elo(rows, s)
        return features.build_features(rows, people, elo, history.build_history(rows, s, elo))

    assert features.truncation_differences(build(c), build(c.filter(F.col("date") < cutoff)), cutoff).count() == 0


def test_states_as_of_any_date(spark):
    """The state after the last contest strictly before each date, by a plain scan, across blocks and ties."""
    import random

    rng = random.Random(2)
    day0 = dt.date(2001, 1, 1)
    known = [(f"c{rng.randrange(4)}", day0 + dt.timedelta(rng.randrange(200)), f"k{n:03d}") for n in range(120)]
    states = spark.createDataFrame([(c, d, k, (k,)) for c, d, k in known], "competitor_id string, date date, contest_id string, now struct<mark: string>")
    asked = [(n, f"c{rng.randrange(5)}", day0 + dt.timedelta(rng.randrange(-5, 260))) for n in range(300)]
    asked += [(300, None, day0), (301, "c0", None), (302, "c0", day0 + dt.timedelta(5000))]
    asked.append(asked[0])
    events = spark.createDataFrame(asked, "n int, competitor_id string, as_of date").withColumn("now_there", F.lit("x"))
    found = sorted((r.n, r.now.mark if r.now else None) for r in history.states_as_of(events, states).collect())

    def scan(competitor, day):
        past = [(d, k) for c, d, k in known if competitor and day and c == competitor and d < day]
        return max(past)[1] if past else None

    assert found == sorted((n, scan(c, d)) for n, c, d in asked)
    assert history.states_as_of(events, states.limit(0)).filter("now IS NOT NULL").count() == 0
    assert history.states_as_of(events.limit(0), states).count() == 0


def test_states_as_of_a_run_are_its_snapshots(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    cut = F.lit("1998-06-01").cast("date")
    snapshots = history.snapshots_before(t.contests, t.stats, t.ratings, cut.cast("timestamp_ntz"))
    events = snapshots.select("competitor_id", cut.alias("as_of"))
    again = history.states_as_of(events, t.states).select("competitor_id", "now.*")
    assert again.count() > 100
    assert sorted(map(repr, again.select(*snapshots.columns).collect())) == sorted(map(repr, snapshots.collect()))


def test_states_move_once(spark):
    """Windows carry the place of a state and not the state; rows that repeat and have no id are found once."""
    rows = [("x", dt.datetime(2020, 1, d), c, (float(d),)) for d, c in ((1, "f1"), (1, "f1"), (9, None))]
    states = spark.createDataFrame(rows, "competitor_id string, date timestamp_ntz, contest_id string, now struct<n:double>")
    asked = [(k, "x", dt.date(2020, m, d)) for k, (m, d) in enumerate(((1, 1), (1, 5), (1, 20), (9, 1)))]
    events = spark.createDataFrame([*asked, (8, None, dt.date(2020, 9, 1)), (9, "x", None)], "k int, competitor_id string, as_of date")
    found = history.states_as_of(events, states)
    got = {r["k"]: r["now"] and r["now"]["n"] for r in found.collect()}
    assert got == {0: None, 1: 1.0, 2: 9.0, 3: 9.0, 8: None, 9: None} and found.count() == 6
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "AS held" in plan and "now, now#" not in plan
