import datetime as dt

import pytest

from contestry.operators import market, resolve
from frames import CONTESTS_DDL, contest, frame

PEOPLE = [("i1", "José Aldo"), ("i2", "Max Power"), ("i3", "Twin Name"), ("i4", "Twin Name"), ("i5", "Jürgen"), ("i6", "Jurgen"), ("i7", None)]


def people(spark):
    return spark.createDataFrame(PEOPLE, "competitor_id string, name string")


def test_name_tiers(spark):
    asked = ["  JOSÉ ALDO", "Jose Aldo", "max power", "Twin Name", "Jürgen", "Jürgén", "Nobody"]
    df = spark.createDataFrame([(n,) for n in asked + asked], "name string")
    got = {r["name"]: (r["resolved_id"], r["match_tier"], r["reason"]) for r in resolve.resolve_names(df, people(spark)).collect()}
    assert got["  JOSÉ ALDO"][:2] == ("i1", "exact") and got["Jose Aldo"][:2] == ("i1", "accent_folded")
    assert got["max power"][:2] == ("i2", "exact") and got["Jürgen"][:2] == ("i5", "exact")
    assert got["Twin Name"][0] is None and "ambiguous: matches 2" in got["Twin Name"][2]
    assert "after accent folding: matches 2" in got["Jürgén"][2] and "no competitor" in got["Nobody"][2]


C1, C2, C3, C4 = (f"{i:016x}" for i in range(1, 5))
ID = {i: f"{0xabc0 + i:016x}" for i in range(1, 8)}
QUOTES = (
    "contest_url string, load_order int, competitor_1 string, competitor_2 string, competitor_1_url string, "
    "competitor_2_url string, odds_1 double, odds_2 double"
)


def quotes(spark, rows):
    out = []
    for cid, order, n1, n2, u1, u2, o1, o2 in rows:
        out.append((f"http://s/{cid}", order, n1, n2, u1 and f"http://p/{u1}/", u2 and f"http://p/{u2}", o1, o2))
    return market.with_ids(spark.createDataFrame(out, QUOTES))


def league(spark):
    rows = [contest(c, "2020-01-01", ID[1], ID[2], "a") for c in (C1, C2, C3)] + [contest(C4, "2020-01-01", ID[3], ID[4], "a")]
    who = spark.createDataFrame(
        [(ID[1], "Ann"), (ID[2], "Bea"), (ID[3], "Cy"), (ID[4], "Di")], "competitor_id string, name string"
    )
    return frame(spark, rows, CONTESTS_DDL), who


def aligned(spark):
    contests, who = league(spark)
    nan = float("nan")
    rows = [
        (C1, 1, "Ann", "Bea", None, None, 1.4, 3.1),
        (C1, 2, "Ann", "Bea", ID[1], ID[2], 1.5, 3.0),
        (C1, 3, "Ann", "Bea", ID[1], ID[2], 1.6, None),
        (C1, 4, "Ann", "Bea", ID[1], ID[2], nan, 2.9),
        (C2, 1, "Bea", "Ann", ID[2], ID[1], 2.0, 4.0),
        (C3, 1, "Bea", "ann", None, ID[1], 2.0, None),
        (C4, 1, "Cy", "Who", None, None, 2.0, 2.0),
        ("f" * 16, 1, "Cy", "Di", ID[3], ID[4], 2.0, 2.0),
    ]
    return contests, who, market.align(quotes(spark, rows), contests, who)


def test_alignment(spark):
    _, _, alignment = aligned(spark)
    got = {r["contest_id"]: r for r in alignment.collect()}
    assert set(got) == {C1, C2, C3, C4}
    one = got[C1]
    assert one["n_books"] == 2 and one["decimal_contest_a"] == pytest.approx(1.45) and one["decimal_contest_b"] == pytest.approx(3.05)
    assert one["implied_contest_a"] == pytest.approx((1 / 1.5) / (1 / 1.5 + 1 / 3.0)) and one["align_method"] == "id"
    assert got[C2]["decimal_contest_a"] == 4.0 and got[C2]["implied_contest_b"] == pytest.approx(2 / 3)
    assert got[C3]["reason"] == "no valid odds rows for this contest" and got[C3]["align_method"] is None
    assert "no competitor matches name 'Who'" in got[C4]["reason"]
    assert {r["outcome"]: r["n"] for r in market.alignment_counts(alignment).collect()} == {"id": 2, "skipped": 2}
    assert len(market.top_skip_reasons(alignment).collect()) == 2


def test_known_favourites(spark):
    contests, who, alignment = aligned(spark)
    ddl = "check_id string, name_x string, name_y string, favourite string, approx_date date"
    day = dt.date(2020, 1, 2)
    good = spark.createDataFrame([("k", "Ann", "Bea", "Ann", day)], ddl)
    checked = market.check_favourites(good, contests, who, alignment)
    assert checked.first()["contest_id"] == C1
    market.enforce_favourites(checked)
    wrong = market.check_favourites(spark.createDataFrame([("k", "Ann", "Bea", "Bea", day)], ddl), contests, who, alignment)
    with pytest.raises(AssertionError):
        market.enforce_favourites(wrong)
    none = market.check_favourites(spark.createDataFrame([("k", "No", "One", "No", day)], ddl), contests, who, alignment)
    with pytest.raises(RuntimeError):
        market.enforce_favourites(none)


def test_roi_bets_only_on_a_strict_edge(spark):
    rows = [(0.60, 1.0, 0.5, 0.5, 2.0, 2.0), (0.55, 0.0, 0.5, 0.5, 2.0, 2.0), (0.30, 0.0, 0.5, 0.5, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "model_p_a double, y_winner double, market_a double, market_b double, decimal_a double, decimal_b double")
    got = {(r["threshold"], r["bet_on"]): (r["n_bets"], r["net"], r["roi_pct"]) for r in market.roi_sweep(df).collect()}
    assert got[(0.0, "a")] == (2, 0.0, 0.0) and got[(0.1, "b")] == (1, 2.0, 200.0)
    assert got[(0.1, "a")][0] in (0, 1) and got[(0.05, "b")] == (1, 2.0, 200.0)
