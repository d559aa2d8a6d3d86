"""Builds stop at a broken rule, measured by the write itself."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contestry.operators import build
from frames import CONTESTS_DDL, STATS_DDL, contest, frame, stat


@pytest.fixture
def tables(spark):
    contests = [contest(f"f{k}", f"2020-01-{k + 1:02d}", f"x{k}", f"y{k}", "a", "ko_tko", weight_class="Lightweight") for k in range(20)]
    stats = [stat(f"f{k}", s, kd=1.0) for k in range(20) for s in "ab"]
    people = [(f"{s}{k}",) for k in range(20) for s in "xy"]
    return frame(spark, contests, CONTESTS_DDL), frame(spark, stats, STATS_DDL), spark.createDataFrame(people, "competitor_id string")


def failed(*tables, **options):
    with pytest.raises(build.GateError) as error:
        build.store_dataset(*tables, **options)
    return error.value


def test_sound_tables_are_stored(tables):
    stored = build.store_dataset(*tables)
    assert {name: df.count() for name, df in stored.items()} == {"contests": 20, "stats": 40, "competitors": 40, "participants": 40}
    assert stored["contests"].columns == tables[0].columns
    assert sorted(map(repr, stored["contests"].collect())) == sorted(map(repr, tables[0].collect()))


def test_repeated_and_missing_keys(tables):
    contests, stats, people = tables
    assert failed(contests.unionByName(contests.limit(1)), stats, people).failed == ["repeated_keys"]
    without = contests.withColumn("contest_id", F.when(F.col("contest_id") != "f3", F.col("contest_id")))
    assert failed(without, stats, people).measured["missing_keys"] == 1
    assert failed(contests, stats.unionByName(stats.limit(1)), people).failed == ["repeated_keys"]
    assert "competitors" in str(failed(contests, stats, people.unionByName(people.limit(1))))


def test_sides(tables):
    contests, stats, people = tables
    same = contests.withColumn("competitor_b_id", F.when(F.col("contest_id") == "f3", F.col("competitor_a_id")).otherwise(F.col("competitor_b_id")))
    assert failed(same, stats, people).failed == ["same_competitor"]
    assert failed(contests.withColumn("competitor_b_id", F.lit(None).cast("string")), stats, people).failed == ["missing_sides"]


def test_batch_gates(tables):
    contests, stats, people = tables
    assert failed(contests.withColumn("date", F.when(F.col("contest_id") != "f3", F.col("date"))), stats, people).failed == ["unparsed dates"]
    assert failed(contests, stats.filter("side = 'a'"), people).failed == ["statistics are not two rows a contest"]
    assert failed(contests, stats, people.filter("competitor_id <> 'x3'")).failed == ["participants without competitor"]
    assert build.store_dataset(contests, stats, people.filter("competitor_id <> 'x3'"), most_orphans=0.05)
    half = F.when(F.col("contest_id") > "f15", F.lit("decision"))
    assert failed(contests.withColumn("method", half), stats, people).failed == ["unknown methods"]
    assert failed(contests.withColumn("weight_class", half), stats, people).failed == ["unknown classes"]
    empty = failed(contests.limit(0), stats.limit(0), people)
    assert empty.failed == ["participants without competitor", "unknown methods", "unknown classes"]


def test_schedule(spark):
    events = spark.createDataFrame([("E", dt.date(2020, 1, 2)), ("F", dt.date(2020, 1, 3)), ("G", dt.date(2021, 1, 1))], "event_name string, date date")
    bouts = spark.createDataFrame([("E", 0), ("G", 0)], "event_name string, position int")
    today = F.lit("2020-01-01").cast("date")
    near, cards, empty = build.store_upcoming(events, bouts, today, 7)
    assert [r.event_name for r in near.collect()] == ["E", "F"]
    assert [r.event_name for r in cards.collect()] == ["E"] and [r.event_name for r in empty.collect()] == ["F"]
    with pytest.raises(build.GateError, match="no events"):
        build.store_upcoming(events.limit(0), bouts, today, 7)
