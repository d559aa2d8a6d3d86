"""The stored models: fitted, written, read back, and scored on rows of any kind."""

import math
import os

import pytest
from pyspark.sql import functions as F

from contestry.operators import artefact, explain, features, learn, predictions
from contestry.plans.registry import TRAIN_END, VAL, Tables
from contestry.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    return Tables(spark, SF_DIR).features


@pytest.fixture(scope="module")
def fitted(spark, rows):
    parts = [learn.split(rows, p, train_end=TRAIN_END, val=VAL) for p in ("train", "val")]
    models = artefact.fit(*parts, "v-test", seeds=(0, 1), max_rounds=8)
    return models, models.save(spark, scratch_path(spark, "artefact-test"))


def test_trees_are_fitted_in_few_tasks_sized_by_rows(spark, rows, monkeypatch):
    many = spark.range(0, 1000, 1, 24)
    assert [artefact._spread(many, n).rdd.getNumPartitions() for n in (1000, 5 << 18, 1 << 30)] == [4, 5, 24]
    assert artefact._spread(spark.range(0, 1000, 1, 2), 1 << 30).rdd.getNumPartitions() == 2
    assert sorted(r.id for r in artefact._spread(many, 1000).collect()) == list(range(1000))

    class Fits(Exception):
        pass

    def seen(spark, fits, threads):
        fits["finish_round-1"]()

    def boosted(given, label, max_rounds, seed):
        raise Fits(given.rdd.getNumPartitions())

    monkeypatch.setattr(artefact, "_fit_all", seen)
    monkeypatch.setattr(artefact, "_boosted", boosted)
    monkeypatch.setattr(artefact, "LEAST_TASKS", 1)
    parts = [learn.split(rows, p, train_end=TRAIN_END, val=VAL) for p in ("train", "val")]
    with pytest.raises(Fits, match="^1$"):
        artefact.fit(*parts, "v-test", seeds=(0,))


def test_models_read_back_score_as_the_fitted_ones(spark, rows, fitted):
    models, folder = fitted
    again = artefact.load(spark, folder)
    assert (again.version, again.names, again.temperatures) == ("v-test", models.names, models.temperatures)
    assert len(models.names) == 40 and set(models.names) == set(features.model_inputs(rows))
    columns = ("contest_id", "winner_prob", "winner_spread", "method_probs", "round_probs")
    first, second = (sorted(map(repr, m.score(rows).select(*columns).collect())) for m in (models, again))
    assert first == second
    trees = [sorted(map(repr, m.boosted_classes(m.boosted_winner(m.prepared(rows)), "finish_round").select("contest_id", "p", "p_1", "predicted").collect())) for m in (models, again)]
    assert trees[0] == trees[1]


def test_no_second_artefact_in_a_folder_and_none_without_manifest(spark, fitted):
    models, folder = fitted
    with pytest.raises(Exception, match="(?i)exist"):
        models.save(spark, folder)
    with pytest.raises(Exception, match="(?i)exist|found"):
        artefact.load(spark, f"{folder}/boosted")


def test_importances_of_all_inputs_sum_to_one(rows, fitted):
    models, _ = fitted
    found = learn.importances(models.boosted["winner"], models.names, rows, k=40).collect()
    assert {r.feature for r in found} == set(models.names) and abs(sum(r.importance for r in found) - 1.0) < 1e-9


def test_category_is_nominal_for_trees(rows, fitted):
    models, _ = fitted
    attrs = models.prepared(rows).schema[artefact.TREES].metadata["ml_attr"]["attrs"]
    assert [a["name"] for a in attrs["nominal"]] == ["index_weight_class"]
    assert len(attrs["numeric"]) == 39


def test_nulls_and_unknown_categories_get_probabilities(spark, rows, fitted):
    models, _ = fitted
    names = [c for c in models.names if c != "weight_class"]
    odd = rows.limit(4).select("contest_id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], F.lit("Never seen").alias("weight_class"))
    odd = odd.unionByName(odd.withColumn("weight_class", F.lit(None).cast("string")))
    found = models.score(odd).collect()
    assert len(found) == 8 and all(0 < r.winner_prob < 1 and abs(sum(r.method_probs.values()) - 1) < 1e-9 and r.round_probs["45"] == 0 for r in found)
    assert models.score(odd.limit(0)).collect() == []


def test_both_orientations_differ_and_are_averaged(spark, fitted):
    models, _ = fitted
    t = Tables(spark, SF_DIR)
    ready = t.run_matchups().filter("NOT skipped")
    both = predictions.symmetrise(models.score(predictions.orientations(ready)), *predictions.BOUT_KEY).collect()
    assert both and all(r.prob_ab != 1 - r.prob_ba for r in both)
    assert all(abs(r.winner_prob - (r.prob_ab + 1 - r.prob_ba) / 2) < 1e-12 and 0 < r.winner_prob < 1 for r in both)


def test_finish_rounds_beat_the_training_shares(rows, fitted):
    """Round and schedule are related in the tables, so a fitted model has less log-loss than shares."""
    models, _ = fitted
    known = models.prepared(rows.filter("y_finish_round IS NOT NULL"))
    own = F.create_map(*[v for c in ("1", "2", "3", "45") for v in (F.lit(c), F.col(f"p_{c}"))])[F.col("y_finish_round")]
    loss = models.boosted_classes(known, "finish_round").agg(F.avg(-F.ln(F.greatest(own, F.lit(1e-12))))).first()[0]
    n = {r["y_finish_round"]: r["count"] for r in known.groupBy("y_finish_round").count().collect()}
    total = sum(n.values())
    assert loss < -sum(v / total * math.log(v / total) for v in n.values())


def test_parts_of_a_deep_model_add_up(spark, rows, fitted):
    """Eight trees of depth four: the parts of each row against the log-odds, and none of an unused input."""
    models, folder = fitted
    name = max((n for n in models.boosted if n.startswith("finish")), key=lambda n: models.boosted[n].getNumTrees)
    model = models.boosted[name]
    assert model.getNumTrees > 1
    parts = explain.leaf_parts(spark, f"{folder}/boosted/{name}", models.names)
    assert parts.count() == sum(tree.numNodes // 2 + 1 for tree in model.trees)
    prepared = models.prepared(rows)
    found = explain.contributions(model.copy().setFeaturesCol(artefact.TREES), prepared, parts)
    sums = {r.contest_id: r.total for r in found.groupBy("contest_id").agg(F.sum("part").alias("total")).collect()}
    scored = models.with_chances(prepared, name).select("contest_id", F.col(f"chance_{name}")[1].alias("p")).collect()
    assert len(scored) == len(sums) and all(abs(math.log(r.p / (1 - r.p)) - sums[r.contest_id]) < 1e-6 for r in scored)
    used = {n for n, v in zip(models.names, model.featureImportances.toArray()) if v > 0}
    assert {r.feature for r in found.select("feature").distinct().collect()} <= used | {explain.BIAS}


def test_strongest_parts_and_exchanged_sides(spark, rows):
    given = spark.createDataFrame([("c", "x", 0.5), ("c", "y", -0.7), ("c", "z", 0.5), ("d", "x", 0.0)], "contest_id string, feature string, contribution double")
    assert [tuple(r) for r in explain.strongest(given, top_n=2).orderBy("contest_id", "rank").collect()] == [("c", 1, "y", -0.7), ("c", 2, "x", 0.5), ("d", 1, "x", 0.0)]
    twice = explain.turned(explain.turned(rows))
    assert twice.exceptAll(rows).count() == 0
