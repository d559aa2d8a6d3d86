import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from contestry.operators import predictions as P
from contestry.sources import documents
from frames import CONTESTS_DDL, contest, frame

DAY = dt.date(2026, 8, 1)
LOG = (
    "event_name string, event_date date, position int, competitor_a_name string, competitor_b_name string, "
    "competitor_a_id string, competitor_b_id string, p_a_wins double, elo_a double, elo_b double, skipped boolean, "
    "reason string, predicted_at_utc string, model_version string"
)


def real(position, a, b, p=0.6, event="E", version="v1", ids=None, elo=(1600.0, 1500.0), day=DAY):
    id_a, id_b = ids or (a.lower(), b.lower())
    return (event, day, position, a, b, id_a, id_b, p, *elo, False, None, "2026-07-20T00:00:00Z", version)


def stub(position, a, b, event="E", version="v1", reason="unknown name"):
    return (event, DAY, position, a, b, None, None, None, None, None, True, reason, "2026-07-20T00:00:00Z", version)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def merged(spark, old, new):
    rows = P.merge_log(log(spark, *old), log(spark, *new)).collect()
    return sorted((r["action"], r["competitor_a_name"], r["model_version"], r["skipped"]) for r in rows)


def test_rerun_keeps_everything(spark):
    old = [real(0, "Rakic", "Bob"), stub(1, "Cy", "Di")]
    new = [real(0, "Bob", "Rakić", version="v2", ids=("bob", "rakic")), stub(1, "Di", "Cý", version="v2")]
    assert merged(spark, old, new) == [("keep", "Cy", "v1", True), ("keep", "Rakic", "v1", False)]


def test_new_bouts_append_and_predictions_replace_stubs(spark):
    old = [real(0, "Ann", "Bea"), stub(1, "Cy", "Di")]
    new = [real(1, "Di", "Cý", version="v2", ids=("di", "cy")), real(2, "Eve", "Fay", version="v2"), stub(3, "Gus", "Hal", version="v2")]
    assert merged(spark, old, new) == [
        ("append", "Eve", "v2", False), ("append", "Gus", "v2", True), ("keep", "Ann", "v1", False), ("replace", "Di", "v2", False)]


def test_a_prediction_takes_the_place_of_one_stub_only(spark):
    old = [stub(0, "Ann", "Bea"), stub(1, "Bea", "Ann"), stub(2, "Cy", "Di")]
    new = [real(5, "Ann", "Bea", version="v2")]
    assert merged(spark, old, new) == [("keep", "Ann", "v1", True), ("keep", "Cy", "v1", True), ("replace", "Ann", "v2", False)]


def test_a_stub_never_displaces_a_prediction_and_copies_count_once(spark):
    old = [real(0, "Ann", "Bea")]
    new = [stub(0, "Bea", "Ann", version="v2"), real(1, "Cy", "Di", p=0.7, version="v2"), real(2, "Di", "Cy", p=0.1, version="v2"),
           stub(3, "Eve", "Fay", version="v2"), stub(4, "Fay", "Eve", version="v2", reason="other")]
    rows = P.merge_log(log(spark, *old), log(spark, *new)).collect()
    assert sorted((r["action"], r["position"]) for r in rows) == [("append", 1), ("append", 3), ("keep", 0)]


def test_stub_and_prediction_of_one_run(spark):
    old = [real(0, "Ann", "Bea")]
    before = [stub(1, "Cy", "Di", version="v2"), real(2, "Cy", "Di", version="v2")]
    assert merged(spark, old, before) == [("keep", "Ann", "v1", False), ("replace", "Cy", "v2", False)]
    after = [real(1, "Cy", "Di", version="v2"), stub(2, "Cy", "Di", version="v2")]
    assert merged(spark, old, after) == [("append", "Cy", "v2", False), ("keep", "Ann", "v1", False)]


def test_an_unknown_event_is_written_as_it_comes(spark):
    new = [real(0, "Ann", "Bea", event="F"), real(1, "Ann", "Bea", event="F")]
    assert [a for a, *_ in merged(spark, [real(0, "Ann", "Bea")], new)] == ["append", "append", "keep"]


def results(spark, *rows):
    return frame(spark, [contest(*r) for r in rows], CONTESTS_DDL)


def test_grading(spark):
    rows = [
        real(0, "Ann", "Bea", p=0.9), real(1, "Cy", "Di", p=0.5, elo=(1500.0, 1500.0)), real(2, "Eve", "Fay", p=0.2),
        real(3, "Gus", "Hal"), stub(4, "Ian", "Jo"), real(5, "Kim", "Lee", day=dt.date(2027, 1, 1)),
    ]
    done = results(
        spark,
        ("r1", "2026-08-02", "bea", "ann", "b"),
        ("r0", "2026-07-30", "bea", "ann", "a"),
        ("r2", "2026-08-04T23:00:00", "cy", "di", "draw"),
        ("r3", "2026-07-29", "eve", "fay", "a"),
        ("r4", "2026-08-11", "gus", "hal", "a"),
        ("r5", "2027-01-01", "kim", "lee", "a"),
    )
    graded = P.grade(log(spark, *rows), done, F.lit("2026-09-01").cast("date"))
    got = {r["position"]: r for r in graded.collect()}
    assert len(got) == 6
    assert got[0]["actual_winner"] == "ann" and got[0]["correct"] and got[0]["coin_flip_correct"] and got[0]["elo_dummy_correct"]
    assert got[0]["log_loss_contribution"] == pytest.approx(-math.log(0.9)) and got[0]["brier_contribution"] == pytest.approx(0.01)
    assert got[1]["actual_winner"] == "draw" and got[1]["correct"] is None and got[1]["log_loss_contribution"] == pytest.approx(math.log(2))
    assert got[2]["actual_winner"] == "eve" and not got[2]["correct"]
    assert all(got[i]["actual_winner"] is None for i in (3, 4, 5))
    later = results(spark, ("r4", "2026-08-03", "gus", "hal", "b"), ("r0", "2026-08-01", "ann", "bea", "b"))
    again = {r["position"]: r for r in P.grade(graded, later, F.lit("2026-09-01").cast("date")).collect()}
    assert len(again) == 6 and again[3]["actual_winner"] == "hal" and again[0]["actual_winner"] == "ann"
    record = {r["model_version"]: r for r in P.track_record(graded).collect()}
    assert (record[None]["n_predicted"], record[None]["n_graded"], record[None]["accuracy"]) == (5, 3, 0.5)
    assert record[None]["elo_dummy_n"] == 2 and record["v1"]["first_prediction_at"] == "2026-07-20T00:00:00Z"
    doc = P.track_record_document(P.track_record(graded), "now").first()
    assert doc["overall"]["n_graded"] == 3 and list(doc["model_versions"]) == ["v1"]


def test_empty_record(spark):
    record = P.track_record(P.grade(log(spark, stub(0, "A", "B")), results(spark, ("r", "2020-01-01", "x", "y", "a")), F.lit("2027-01-01").cast("date")))
    row = record.filter("model_version IS NULL").first()
    assert (row["n_predicted"], row["accuracy"], row["log_loss"]) == (0, None, None)


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    documents.write_log(log(spark, real(1, "Ann", "Bea"), stub(0, "Cy", "Di")), path)
    rows = documents.read_log(spark, path).orderBy("position").collect()
    assert [r["competitor_a_name"] for r in rows] == ["Cy", "Ann"] and rows[1]["p_a_wins"] == 0.6
    assert documents.EVENT.fieldNames()[0] == "file_name"


def test_old_documents_lack_fields(spark, tmp_path):
    doc = '{\n "event_name": "E",\n "event_date": "2026-08-01",\n "fights": [{"competitor_a_name": "Ann", "skipped": true}]\n}'
    (tmp_path / "EVENT_E.json").write_text(doc)
    row = documents.read_log(spark, str(tmp_path), multi_line=True).first()
    assert row["competitor_a_name"] == "Ann" and row["match_tier"] is None and row["position"] == 0


def test_horizon_includes_both_ends(spark):
    days = [(f"{i}", dt.date(2026, 7, 1) + dt.timedelta(days=i)) for i in (-1, 0, 30, 31)]
    events = spark.createDataFrame(days, "event_name string, date date")
    got = P.upcoming(events, F.lit("2026-07-01").cast("date"), 30).collect()
    assert [r["event_name"] for r in got] == ["0", "30"]
    with pytest.raises(RuntimeError):
        P.require_events(events.limit(0))


@pytest.mark.parametrize(
    "raw, old, needed, word",
    [
        (["2026-01-02"], ["2026-01-01"], True, "newer"),
        (["2026-01-01", "2026-01-01"], ["2026-01-01"], True, "more rows"),
        (["2026-01-01"], ["2026-01-01"], False, "unchanged"),
        ([None, None], ["2026-01-01"], False, "unparseable"),
        (["2026-01-01"], [], True, "more rows"),
    ],
)
def test_refresh_decision(spark, raw, old, needed, word):
    def dates(values):
        rows = [(v and dt.datetime.fromisoformat(v),) for v in values]
        return spark.createDataFrame(rows, "date timestamp_ntz")

    row = P.refresh_decision(dates(raw), dates(old)).first()
    assert row["needed"] is needed and word in row["reason"]


def test_promotion(spark):
    graded = spark.createDataFrame(
        [(dt.date(2026, 1, d), False, "x") for d in (1, 2, 3)] + [(dt.date(2026, 1, 4), False, None)],
        "event_date date, skipped boolean, actual_winner string",
    )
    cutoff = spark.createDataFrame([(dt.date(2026, 1, 1),)], "cutoff date")
    scored = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1), 1.0, 0.9, 0.1), (dt.datetime(2026, 1, 1), 1.0, 0.6, 0.7)],
        "date timestamp_ntz, y double, p_incumbent double, p_candidate double",
    )
    row = P.promotion_decision(graded, cutoff, scored, minimum=2).first()
    assert (row["n_graded"], row["n_window"], row["promote"]) == (2, 1, True)
    assert not P.promotion_decision(graded, cutoff, scored).first()["promote"]


def test_symmetrised_scores_are_consistent(spark):
    df = spark.createDataFrame(
        [("k", "ab", 0.7, 0.1), ("k", "ba", 0.4, 0.3)], "key string, orientation string, winner_prob double, winner_spread double"
    )
    row = P.symmetrise(df, "key").first()
    assert row["winner_prob"] == pytest.approx(0.65) and row["winner_spread"] == 0.3
