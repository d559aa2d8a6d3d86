from contestry.llm import filters
from tests_llm_helpers import rows_of


def test_rows_without_listed_ids(spark):
    ids = [None, 0, 1, 1, 2, 3, *range(10, 400)]
    rows = spark.createDataFrame([(k, f"text {k}") for k in ids], "doc_id long, text string")
    listed = spark.createDataFrame([(k,) for k in (1, 3, 3, 50, 999)], "doc_id int")  # equal ids of another type
    wanted = [(k, f"text {k}") for k in ids if k not in (1, 3, 50)]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(rows_of(filters.without(rows, listed), "doc_id", "text"), key=key) == wanted
    assert filters.without(rows, listed.limit(0)).count() == len(ids) and filters.without(rows.limit(0), listed).count() == 0


def test_only_rows_that_may_be_listed_are_joined(spark):
    rows, listed = spark.range(5000).toDF("doc_id"), spark.range(100, 150).toDF("doc_id")
    clear, open_rows = filters.parted(rows, listed)
    assert clear.count() + open_rows.count() == 5000 and 50 <= open_rows.count() < 100
    assert open_rows.join(listed, "doc_id").count() == 50
