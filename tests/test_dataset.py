import re

import pytest

from contestry.operators import dataset
from contestry.sources import documents, tables
from frames import CONTESTS_DDL, STATS_DDL, contest, frame, stat

RAW = [f.name for f in tables.RAW_CONTESTS.fields]


def raw(spark, *rows):
    base = dict.fromkeys(RAW)
    return spark.createDataFrame([tuple((base | r)[c] for c in RAW) for r in rows], tables.RAW_CONTESTS)


ROWS = [
    dict(contest_id="f1", date="2020/01/01", r_id="x", b_id="y", method="Decision - Split", finish_round="3",
         total_rounds="3", division="Lightweight Bout", title_fight="0", match_time_sec="300", r_kd="1", b_kd="bad"),
    dict(contest_id="f2", date="2021/01/01", r_id="x", b_id="z", winner_id="x", method="KO/TKO", finish_round="3",
         total_rounds="5", division="Women's Flyweight Title Bout", title_fight="1", match_time_sec="260"),
    dict(contest_id="f3", date="2022/01/01", r_id="y", b_id="z", method="Overturned", finish_round="3",
         total_rounds="3", match_time_sec="152"),
    dict(contest_id="f4", date="bad", r_id="y", b_id="z", winner_id="q", method="Other", finish_round="2",
         match_time_sec="10"),
]


def test_contests(spark):
    got = {r["contest_id"]: r for r in dataset.build_contests(raw(spark, *ROWS)).collect()}
    assert (got["f1"]["winner"], got["f1"]["duration_sec"], got["f1"]["finish_round"]) == ("draw", 900.0, None)
    assert (got["f2"]["winner"], got["f2"]["duration_sec"], got["f2"]["finish_round"]) == ("a", 860.0, 3)
    assert got["f2"]["title_fight"] and got["f2"]["weight_class"] == "Women's Flyweight"
    assert (got["f3"]["winner"], got["f3"]["duration_sec"], got["f3"]["weight_class"]) == ("nc", 752.0, None)
    assert (got["f4"]["winner"], got["f4"]["date"], got["f4"]["scheduled_rounds"]) == ("nc", None, None)


def test_contests_are_read_by_compiled_code(spark):
    """The JVM interprets methods above 8000 bytes, many times slower."""
    plan = dataset.build_contests(raw(spark, *ROWS))._jdf.queryExecution()
    shown = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000


def test_side_stats(spark):
    got = dataset.build_side_stats(raw(spark, ROWS[0])).orderBy("side").collect()
    assert [(r["side"], r["competitor_id"], r["kd"], r["ctrl_sec"]) for r in got] == [
        ("a", "x", 1.0, None), ("b", "y", None, None)]


def test_key_and_side_checks(spark):
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string")
    assert {(r["violation"], r["n_rows"]) for r in dataset.key_violations(keys, "id").collect()} == {
        ("duplicate", 2), ("missing", 1)}
    with pytest.raises(ValueError, match="ids"):
        dataset.require_empty(dataset.key_violations(keys, "id"), "ids")
    rows = frame(spark, [contest("c", "2020-01-01", "x", "x", "a"), contest("d", "2020-01-01", None, "x", "a")], CONTESTS_DDL)
    assert {r["violation"] for r in dataset.side_violations(rows).collect()} == {"same_competitor", "missing_side"}


def test_integrity_gates(spark):
    contests = frame(spark, [contest("c", "2020-01-01", "x", "y", "a")], CONTESTS_DDL)
    stats = frame(spark, [stat("c", "a"), stat("c", "b")], STATS_DDL)
    people = spark.createDataFrame([("x",), ("y",)], "competitor_id string")
    dataset.enforce_integrity(dataset.integrity_report(contests, stats, people))
    with pytest.raises(ValueError, match="stats_ok"):
        dataset.enforce_integrity(dataset.integrity_report(contests, stats.limit(1), people))
    with pytest.raises(ValueError, match="orphans_ok"):
        dataset.enforce_integrity(dataset.integrity_report(contests, stats, people.limit(1)))


def test_totals_are_null_only_when_both_sides_are(spark):
    stats = frame(spark, [stat("c", "a", sig_landed=2.0), stat("c", "b")], STATS_DDL)
    row = dataset.contest_totals(stats).first()
    assert (row["sig_landed"], row["td_landed"]) == (2.0, None)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_csv(spark.createDataFrame([("zz", "1", "n")], "extra string, id string, name string"), path)
    row = tables.read_csv(spark, path, tables.RAW_COMPETITORS).first()
    assert (row["id"], row["name"], row["dob"]) == ("1", "n", None)


def test_tables_are_stored_in_order(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [contest(f"c{i * 37 % 100:02d}", f"2020-01-{i % 9 + 1:02d}", "x", "y", "a") for i in range(100)]
    tables.write_table(frame(spark, rows, CONTESTS_DDL).repartition(5), path, order_by=tables.ORDER["contests"])
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    got = [(r["date"], r["contest_id"]) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == sorted(got) and len(got) == 100


def test_schema_report(spark):
    df = spark.createDataFrame([(1, "b"), (2, None)], "n int, s string")
    got = {r["column"]: (r["type"], r["n_rows"], r["n_values"], r["smallest"]) for r in tables.schema_report(df, "t").collect()}
    assert got == {"n": ("int", 2, 2, "1"), "s": ("string", 2, 1, "b")}


def test_profile(spark):
    df = spark.range(5000).selectExpr(
        "id", "id % 7 as few", "nullif(id % 2, 0) as half", "cast(null as string) as none", "map(id, 'x') as m", "array(id) as a", "id as `dotted.name`"
    )
    got = {r["column"]: r for r in tables.profile(df, "t").collect()}
    assert [got[c]["position"] for c in df.columns] == list(range(7)) and all(r["n_rows"] == 5000 for r in got.values())
    assert {c: got[c]["n_values"] for c in ("id", "half", "none", "m")} == {"id": 5000, "half": 2500, "none": 0, "m": 5000}
    assert {c: got[c]["n_different"] for c in ("few", "half", "none")} == {"few": 7, "half": 1, "none": 0}
    assert all(abs(got[c]["n_different"] - 5000) < 400 for c in ("id", "m", "a", "dotted.name"))
    assert (got["id"]["smallest"], got["id"]["largest"], got["a"]["largest"], got["m"]["largest"]) == ("0", "4999", "[4999]", None)
    empty = tables.profile(df.limit(0), "t").collect()
    assert len(empty) == 7 and all(r["n_rows"] == 0 and r["smallest"] is None for r in empty)


def test_nested_documents_are_read_back_whole(spark, tmp_path):
    schema = "at string, overall struct<n: long, loss: double>, versions map<string, struct<n: long, first: string>>, list array<double>"
    rows = [("now", (3, 0.1 + 0.2), {"v1": (1, "a"), "v2": (2, None)}, [1e-300, 5.0]), (None, None, {}, None), ("é\n", (None, None), None, [])]
    df = spark.createDataFrame(rows, schema)
    documents.write_documents(df, str(tmp_path / "d"))
    back = documents.read_documents(spark, str(tmp_path / "d"), df.schema)
    assert back.schema == df.schema and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"at": "now", "overall": 7}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|overall"):
        documents.read_documents(spark, str(tmp_path / "bad"), df.schema).collect()
