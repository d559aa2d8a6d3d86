"""Trees grown side by side against Spark's own fit of each label."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from contestry.operators import boosting

LEARNER = dict(featuresCol="inputs_", labelCol="label", maxDepth=4, stepSize=0.2, validationIndicatorCol="is_val", validationTol=1e-4, seed=3)


def table(spark, n, parts=3, seed=5):
    """Rows with a category, a flag, many values with zeros, few values, a constant, and two labels that depend on them."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(list("wxyz"), n, p=[0.4, 0.3, 0.2, 0.1])
    x, y = rng.normal(size=n), np.where(rng.random(n) < 0.3, 0.0, rng.normal(size=n))
    few, flag = rng.integers(-3, 4, n).astype(float), (rng.random(n) < 0.4).astype(float)
    odds = 1.2 * (x > 0.3) - 0.8 * y + 0.9 * (kind == "y") + 0.2 * few * flag
    first = (odds + rng.logistic(size=n) > 0).astype(float)
    second = (np.sin(3 * x) + 0.4 * few + rng.logistic(size=n) > 0.5).astype(float)
    rows = [(i, str(k), *map(float, v)) for i, (k, *v) in enumerate(zip(kind, x, y, few, flag, first, second, strict=True))]
    df = spark.createDataFrame(rows, "id long, kind string, x double, y double, few double, flag double, first double, second double")
    df = df.withColumns({"same": F.lit(2.0), "is_val": F.col("id") % 4 == 0, "second": F.when(F.col("id") % 5 > 0, F.col("second"))})
    df = StringIndexer(inputCol="kind", outputCol="kind_", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df).transform(df)
    made = VectorAssembler(inputCols=["x", "kind_", "y", "few", "flag", "same"], outputCol="inputs_").transform(df)
    return made.repartition(parts, "id").sortWithinPartitions("id").localCheckpoint()


def spark_s_own(rows, label, learner):
    return learner.fit(rows.withColumn("label", F.col(label)).filter("label IS NOT NULL"))


def chances(model, rows):
    scored = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p"))
    return np.array([r.p for r in scored.orderBy("id").collect()])


@pytest.mark.parametrize("n, rate, share, rounds", [(700, 0.8, "0.8", 12), (16_000, 0.7, "0.5", 25), (3000, 1.0, "all", 60)])
def test_trees_are_those_of_spark(spark, n, rate, share, rounds):
    """Small and sampled bins, draws of rows and inputs, categories, rows without a label, and the round to stop at."""
    rows = table(spark, n)
    learner = GBTClassifier(**LEARNER, maxIter=rounds, subsamplingRate=rate, featureSubsetStrategy=share)
    one = boosting.fit(rows, {"first": F.col("first")}, learner)["first"]
    other = boosting.fit(rows.filter("second IS NOT NULL"), {"first": F.col("first"), "second": F.col("second")}, learner)
    pairs = [(one, spark_s_own(rows, "first", learner)), (other["second"], spark_s_own(rows, "second", learner))]
    pairs.append((other["first"], spark_s_own(rows.filter("second IS NOT NULL"), "first", learner)))
    for mine, own in pairs:
        assert mine.getNumTrees == own.getNumTrees and (rounds < 60 or own.getNumTrees < rounds)
        assert [t.numNodes for t in mine.trees] == [t.numNodes for t in own.trees]
        assert np.abs(chances(mine, rows) - chances(own, rows)).max() < 1e-9
        assert np.abs(mine.featureImportances.toArray() - own.featureImportances.toArray()).max() < 1e-9
        assert list(mine.treeWeights) == list(own.treeWeights) and mine.numClasses == 2


def test_a_stored_model_is_read_back(spark, tmp_path):
    rows = table(spark, 400, parts=1)
    learner = GBTClassifier(**LEARNER, maxIter=3)
    mine = boosting.fit(rows, {"first": F.col("first")}, learner)["first"]
    mine.save(str(tmp_path / "model"))
    again = type(mine).load(str(tmp_path / "model"))
    assert (again.getMaxDepth(), again.getStepSize(), again.getFeaturesCol()) == (4, 0.2, "inputs_")
    assert (chances(again, rows) == chances(mine, rows)).all()


def test_empty_partitions_pure_rows_and_one_round(spark):
    rows = table(spark, 60, parts=1)
    spread = rows.unionByName(rows.filter("id < 0"))
    learner = GBTClassifier(**LEARNER, maxIter=1)
    for label in (F.col("first"), F.lit(1.0), (F.col("flag") > 0).cast("double")):
        mine = boosting.fit(spread, {"any": label}, learner)["any"]
        own = spark_s_own(spread.withColumn("any", label), "any", learner)
        assert [t.numNodes for t in mine.trees] == [t.numNodes for t in own.trees]
        assert np.abs(chances(mine, rows) - chances(own, rows)).max() < 1e-9


def test_a_round_is_a_job_a_level_whatever_the_labels(spark, monkeypatch):
    rows, jobs, total = table(spark, 500), [], boosting._total
    monkeypatch.setattr(boosting, "_total", lambda rdd: (jobs.append(1), total(rdd))[1])
    learner = GBTClassifier(**(LEARNER | {"validationTol": 0.0, "stepSize": 0.05}), maxIter=3)
    for labels in ({"one": F.col("first")}, {"one": F.col("first"), "other": 1 - F.col("first")}):
        jobs.clear()
        boosting.fit(rows, labels, learner)
        assert len(jobs) == 3 * 4 + 1


def test_sums_are_added_up_by_tasks_where_blocks_are_many(spark, monkeypatch):
    rows, learner = table(spark, 300, parts=5), GBTClassifier(**LEARNER, maxIter=3)
    few = boosting.fit(rows, {"first": F.col("first")}, learner)["first"]
    monkeypatch.setattr(boosting, "MOST_COLLECTED", 4)
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 2)
    many = boosting.fit(rows, {"first": F.col("first")}, learner)["first"]
    assert np.abs(chances(few, rows) - chances(many, rows)).max() < 1e-9


def test_the_labels_of_a_task_are_grown_side_by_side(spark, monkeypatch):
    """Three fits for eight models, where each model had one of its own."""
    from contestry.operators import artefact

    seen, one = [], GBTClassifier(**LEARNER, maxIter=1).fit(table(spark, 50, parts=1).withColumn("label", F.col("first")))
    monkeypatch.setattr(artefact, "_boosted", lambda rows, labels, *_: (seen.append(sorted(labels)), dict.fromkeys(labels, one))[1])
    monkeypatch.setattr(artefact, "fit_inputs", lambda train: (None, ["x"]))
    monkeypatch.setattr(artefact.OutcomeModels, "prepared", lambda self, rows: rows)
    monkeypatch.setattr(artefact.learn, "train_member", lambda *_: None)
    monkeypatch.setattr(artefact.learn, "train_multiclass", lambda *_: None)
    monkeypatch.setattr(artefact, "_temperatures", lambda *_: {})
    rows = spark.createDataFrame([(1.0, "decision", "1")], "y_winner double, y_method string, y_finish_round string")
    made = artefact.fit(rows, rows, "v", seeds=(0,))
    assert sorted(map(len, seen)) == [1, 3, 4] and len(made.boosted) == 8 and list(made.boosted)[0] == "winner"


def test_no_rows_to_stop_by_fail(spark):
    rows = table(spark, 50, parts=1)
    with pytest.raises(ValueError, match="38 rows to learn from and 0 to stop by|37 rows to learn from and 0 to stop by"):
        boosting.fit(rows.filter("NOT is_val"), {"first": F.col("first")}, GBTClassifier(**LEARNER, maxIter=2))
    with pytest.raises(ValueError, match="more values than there are bins"):
        boosting.fit(rows, {"first": F.col("first")}, GBTClassifier(**LEARNER, maxIter=2, maxBins=4))
