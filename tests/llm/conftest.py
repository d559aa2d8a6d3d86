"""Documents with awkward rows, shared by the operator tests."""

import pytest
from pyspark.sql import functions as F

from tests_llm_helpers import prose


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and long texts, repeated rows and shared passages."""
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split()
    rows = [(1, base), (2, base), (3, base.upper()), (4, " ".join(words[:60] + ["new"] + words[60:])), (5, "one two"), (6, "One  TWO"), (7, "solo")]
    rows += [(8, None), (9, ""), (10, " \t\n"), (11, prose(3, 20_000)), (12, prose(4, 80) + " " + passage + " " + prose(5, 70))]
    rows += [(13, prose(6, 30) + " " + passage + " " + prose(7, 40)), (14, passage), (15, "Ünïcode straße ✓ " + prose(8, 30)), (15, "Ünïcode straße ✓ " + prose(8, 30))]
    rows += [(20 + k, " ".join([*words[: 5 * k], f"x{k}", *words[5 * k + 1 :]])) for k in range(1, 20)]
    rows += [(None, base), (None, "")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as a table with columns that clash with results."""
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string")
    return docs.withColumns({"kept": F.lit("x"), "size": F.lit(1), "row": F.lit("r"), "score": F.lit(None).cast("string"), "found": F.lit(0)}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
