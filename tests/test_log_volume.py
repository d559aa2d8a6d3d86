"""What the prediction log moves and writes, and that nothing of it is lost."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from contestry.operators import predictions as P
from contestry.plans.registry import Tables
from contestry.session import materialise
from contestry.sources import documents
from test_predictions import log, real, stub

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def files_of(df):
    return [f.removeprefix("file://").removeprefix("file:") for f in df.inputFiles()]


def test_intermediate_tables_are_packed(spark):
    assert all(f.endswith(".zstd.parquet") for f in files_of(materialise(spark.range(100), "packed")))


def test_logs_are_packed_and_read_back(spark, tmp_path):
    path = str(tmp_path / "log")
    given = log(spark, real(1, "Ann", "Bea"), stub(0, "Cy", "Di"), real(2, "Eve", "Fay", event="F"))
    documents.write_log(given, path)
    assert glob.glob(f"{path}/*.json.gz") and not glob.glob(f"{path}/*.json")
    columns = ["event_name", "position", "competitor_a_name", "p_a_wins", "reason"]
    found, wanted = (sorted(map(repr, df.select(*columns).collect())) for df in (documents.read_log(spark, path), given))
    assert found == wanted


@needs_tables
def test_a_scorer_s_unread_inputs_move_nowhere(spark):
    """The default scorer reads two ratings, so no other field of a state is in the plan's shuffles."""
    t = Tables(spark, SF_DIR)
    made = P.predict_matchups(t.run_matchups())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "elo_striking" in plan and "now_td_acc" not in plan and "now_streak" not in plan
    wide = P.predict_matchups(t.run_matchups(), lambda rows: P.rating_scorer(rows).withColumn("winner_prob", F.col("td_acc_diff") * 0 + 0.5))
    assert "now_td_acc" in wide._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_predictions_are_those_of_stored_matchups(spark):
    """Against scores of the ready bouts alone, joined with all bouts."""
    t = Tables(spark, SF_DIR)
    rows = materialise(t.run_matchups(), "stored-matchups")
    scored = P.symmetrise(P.rating_scorer(P.orientations(rows.filter("NOT skipped"))), *P.BOUT_KEY)
    wanted = rows.join(scored, P.BOUT_KEY, "left").select(
        *P.BOUT_KEY, "competitor_a_name", F.when(~F.col("skipped"), F.col("id_1")).alias("a"), "reason", "winner_prob", "round_probs",
        F.when(~F.col("skipped"), F.col("side_2.pre_overall")).alias("elo_b"), "prob_ab", "prob_ba",
    )
    made = P.predict_matchups(t.run_matchups(), detail=True).select(
        *P.BOUT_KEY, "competitor_a_name", F.col("competitor_a_id").alias("a"), "reason", F.col("p_a_wins").alias("winner_prob"), "round_probs",
        "elo_b", "prob_ab", "prob_ba",
    )
    found = sorted(map(repr, made.collect()))
    assert len(found) > 100 and found == sorted(map(repr, wanted.collect()))


def test_bouts_alike_stay_two_and_skipped_ones_have_no_scores(spark):
    bout = {f: F.lit(v) for f, v in {"position": 1, "competitor_a_name": "Ann", "competitor_b_name": "Bea", "weight_class": "Flyweight", "match_tier": "exact",
            "is_title": False, "scheduled_rounds": 3, "scored_class": "Flyweight"}.items()}
    frame = spark.createDataFrame([("E", dt.date(2020, 1, 1), False, "a"), ("E", dt.date(2020, 1, 1), False, "a"), ("F", None, False, "a"), ("G", dt.date(2020, 1, 1), True, None)],
                                  "event_name string, event_date date, skipped boolean, id_1 string")
    fields = {**dict.fromkeys((s for s in _sources()), F.lit(1.0)), "debut": F.lit(False), "southpaw": F.lit(False)}
    sides = [F.struct(*[v.alias(k) for k, v in (fields | {"pre_overall": F.lit(rating)}).items()]) for rating in (1600.0, 1500.0)]
    rows = frame.withColumns(bout | {"id_2": F.lit("b"), "reason": F.lit(None).cast("string"), "side_1": sides[0], "side_2": sides[1]})
    found = sorted((r.event_name, r.skipped, r.p_a_wins and round(r.p_a_wins, 6), r.elo_a) for r in P.predict_matchups(rows).collect())
    assert found == [("E", False, 0.6, 1600.0), ("E", False, 0.6, 1600.0), ("F", False, None, 1600.0), ("G", True, None, None)]


def _sources():
    from contestry.operators.features import DIFF_STEMS, PER_SIDE

    return [*DIFF_STEMS, *[c for c in PER_SIDE if c not in ("debut", "southpaw")]]
