import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contestry.llm import linear, quality, toxicity


def test_toxicity_on_held_out_documents(spark, odd_docs, odd_rows, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    weights = toxicity.fit(docs, labels)
    found = toxicity.score(docs, weights).join(labels, "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    hits, missed, false = counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert hits / (hits + missed) > 0.75 and hits / (hits + false) > 0.9
    rows = toxicity.score(odd_docs, weights).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert toxicity.score(no_docs, weights).collect() == []
    assert not toxicity.fit(docs, labels.limit(0)).any()


def test_group_terms_earn_less_weight_with_the_penalty(spark):
    """Toxic texts mention one group by mere company; the penalty takes that weight off."""
    rows = [(k, ("women are awful trash " if k % 2 else "men enjoy calm rivers ") + f"w{k % 7} v{k % 5}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    neutral = pa.array(["women walk by calm rivers", "men walk by calm rivers"])
    gaps = [np.ptp(linear.margins(neutral, toxicity.fit(docs, labels, penalty=p))) for p in (0.0, 20.0)]
    assert gaps[1] < 0.3 * gaps[0]
    assert toxicity.swapped("Women and juden met MEN") == "men and hindus met girls"


def test_grades_are_ordered_and_told_apart(spark, odd_docs, odd_rows, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    parameters = quality.fit(docs, labels.where(half))
    assert (np.diff(quality.thresholds(parameters)) > 0).all()
    found = quality.grade(docs, parameters).join(labels.where(~half), "doc_id")
    assert found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.97
    means = {r.grade: r.mean for r in found.groupBy(quality.rating().alias("grade")).agg(F.avg("expected_grade").alias("mean")).collect()}
    assert means[0] < means[1] < means[2]
    rows = quality.grade(odd_docs, parameters).collect()
    assert len(rows) == len(odd_rows) and all(r.tails[0] >= r.tails[1] and r.size == 1 for r in rows)
    assert quality.grade(no_docs, parameters).collect() == []
    untrained = quality.fit(docs, labels.limit(0))
    assert quality.grade(odd_docs, untrained).where("not kept").count() == 0


def test_ordinal_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    slots, values = linear.feature_lists(pa.array([f"a{k} b{k % 3} !!" for k in range(9)] + ["", None, "x " * 50]))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(12) % 3, pa.int32()), slots, values], names=["target", "slots", "values"])
    place = np.concatenate([rng.normal(0, 0.3, linear.SIZE), [-0.4, 0.3]])
    _, slope = quality._loss(batch, place)
    for k in [*np.unique(slots.flatten().to_numpy())[:5], linear.SIZE, linear.SIZE + 1]:
        step = np.zeros_like(place)
        step[k] = 1e-5
        numeric = (quality._loss(batch, place + step)[0] - quality._loss(batch, place - step)[0]) / 2e-5
        assert abs(numeric - slope[k]) < 1e-4
