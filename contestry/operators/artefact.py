"""Fitted outcome models as one stored, versioned artefact, and scoring with it.

The artefact is a folder of Spark ML models: the fitted preparation of inputs,
boosted trees for the winner and, one per class, for method and finish round, and an
ensemble of linear members with a temperature each.  A manifest lists them.  Scoring
reads the folder and fits nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from contestry.functions.labels import METHODS, ROUND_CLASSES
from contestry.functions.probability import mask_long_rounds, normalised
from contestry.operators import boosting, learn
from contestry.operators.features import DROPPED, model_inputs
from contestry.session import ensure_checkpoint_dir, materialise

CATEGORY = "weight_class"
#: Columns of prepared rows: inputs of trees (as they are, category nominal) and of linear models (scaled).
TREES, LINEAR = "tree_inputs", "linear_inputs"
#: Class models: target column and classes.
TASKS = {"method": ("y_method", METHODS), "finish_round": ("y_finish_round", ROUND_CLASSES)}

#: Rows of a task of the boosted fits, and the least number of tasks.
TASK_ROWS, LEAST_TASKS = 1 << 18, 4

_LOADERS = {"pipeline": PipelineModel, "boosted": GBTClassificationModel, "linear": LogisticRegressionModel}
_MANIFEST = "version string, name string, kind string, temperature double, inputs array<string>"


def fit_inputs(train: DataFrame) -> tuple[PipelineModel, list[str]]:
    """The preparation learnt from training rows, and the names of the trees' inputs in order.

    Missing numbers take the training median, and flags say where height, reach or birth
    were missing.  The category's labels are numbered in order with one number more for
    unknown ones; trees split it as a nominal attribute, linear models see indicators.
    """
    names = model_inputs(train)
    numeric = [c for c in names if c != CATEGORY]
    scale = learn.fitted(learn.preprocessing_stats(train, numeric))
    filled = {c: f"coalesce(CAST({c} AS DOUBLE), {median!r}D)" for c, (median, _, _) in scale.items()}
    plain = [f"{sql} AS plain_{c}" for c, sql in filled.items()]
    scaled = [f"({filled[c]} - {mean!r}D) / {std!r}D AS scaled_{c}" for c, (_, mean, std) in scale.items() if c not in DROPPED]
    indexed, shown = f"index_{CATEGORY}", f"shown_{CATEGORY}"
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(plain + scaled)} FROM __THIS__"),
        StringIndexer(inputCol=CATEGORY, outputCol=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCol=indexed, outputCol=shown),
        VectorAssembler(inputCols=[indexed if c == CATEGORY else f"plain_{c}" for c in names], outputCol=TREES),
        VectorAssembler(inputCols=[shown, *[f"scaled_{c}" for c in numeric if c not in DROPPED]], outputCol=LINEAR),
    ]
    return Pipeline(stages=stages).fit(train), names


def _fit_all(spark: SparkSession, fits: Mapping[str, Callable[[], object]], threads: int) -> dict[str, object]:
    """Independent fits, some at a time, as their jobs are many and small."""
    with ThreadPool(threads) as pool:
        return dict(zip(fits, pool.map(lambda fit: inheritable_thread_target(spark)(fit)(), fits.values()), strict=True))


def _once(make: Callable[[], object]) -> Callable[[], object]:
    """``make`` called by whoever comes first; the others wait for what it gives."""
    lock, made = Lock(), []

    def given() -> object:
        with lock:
            if not made:
                made.append(make())
            return made[0]

    return given


def _spread(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` in tasks of up to ``TASK_ROWS``, at least ``LEAST_TASKS``; never in more than they lie in.

    A level of the trees is a job over all rows, so with many small tasks the time goes
    into starting them.
    """
    return rows.coalesce(max(LEAST_TASKS, -(-n_rows // TASK_ROWS)))


def _boosted(rows: DataFrame, labels: Mapping[str, Column], max_rounds: int, seed: int) -> dict[str, GBTClassificationModel]:
    """Boosted trees per label on rows where all are known; those flagged ``is_val`` decide when to stop."""
    learner = GBTClassifier(
        featuresCol=TREES, labelCol="label", maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        maxIter=max_rounds, validationIndicatorCol="is_val", validationTol=1e-4, seed=seed,
    )
    return boosting.fit(rows, labels, learner)


@dataclass(frozen=True)
class OutcomeModels:
    """The models of one version."""

    version: str
    names: list[str]
    inputs: PipelineModel
    boosted: dict[str, GBTClassificationModel]
    linear: dict[str, LogisticRegressionModel]
    temperatures: dict[str, float] = field(default_factory=dict)
    folder: str | None = None

    @property
    def members(self) -> list[str]:
        return sorted(self.temperatures)

    # --- scoring -----------------------------------------------------------------------

    def prepared(self, rows: DataFrame) -> DataFrame:
        """``rows`` with both input vectors."""
        made = self.inputs.transform(rows)
        return made.select(*rows.columns, TREES, LINEAR)

    def _chance(self, rows: DataFrame, name: str) -> DataFrame:
        """A column ``chance_name``: the probabilities of a model, as an array."""
        model = self.boosted.get(name) or self.linear[name]
        model = model.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"chance_{name}")
        model = model.setFeaturesCol(TREES if name in self.boosted else LINEAR)
        return model.transform(rows).withColumn(f"chance_{name}", vector_to_array(f"chance_{name}"))

    def with_chances(self, prepared: DataFrame, *names: str) -> DataFrame:
        return reduce(self._chance, names, prepared)

    def boosted_winner(self, prepared: DataFrame, name: str = "p") -> DataFrame:
        """The boosted model's probability of the first side winning."""
        return self.with_chances(prepared, "winner").withColumn(name, F.col("chance_winner")[1]).drop("chance_winner")

    def boosted_classes(self, prepared: DataFrame, task: str) -> DataFrame:
        """``p_class`` columns of a task: each class against the rest, over their sum; likeliest ``predicted``."""
        classes = TASKS[task][1]
        names = [f"{task}-{c}" for c in classes]
        scored = self.with_chances(prepared, *names)
        even = F.lit(1.0 / len(classes))
        weights = {c: F.col(f"chance_{n}")[1] for c, n in zip(classes, names, strict=True)}
        return _with_likeliest(scored, normalised(weights, dict.fromkeys(classes, even)), task).drop(*[f"chance_{n}" for n in names])

    def ensemble_winner(self, prepared: DataFrame, members: bool = False) -> DataFrame:
        """Mean and spread of the members' probabilities, each at its temperature."""
        scored = self.with_chances(prepared, *self.members)

        def cooled(name: str) -> Column:
            p = F.col(f"chance_{name}")[1]
            return 1.0 / (1.0 + F.exp(-(F.ln(p) - F.ln(1.0 - p)) / self.temperatures[name]))

        each = F.array(*[cooled(n) for n in self.members])
        scored = scored.withColumn("members", each).drop(*[f"chance_{n}" for n in self.members])
        mean = F.aggregate("members", F.lit(0.0), lambda a, p: a + p) / len(self.members)
        out = scored.withColumns({"winner_prob": mean, "winner_spread": F.array_max("members") - F.array_min("members")})
        return out if members else out.drop("members")

    def linear_classes(self, prepared: DataFrame, task: str) -> DataFrame:
        """``p_class`` columns of a task by the linear model; likeliest ``predicted``."""
        classes = TASKS[task][1]
        scored = self.with_chances(prepared, task)
        probs = {c: F.col(f"chance_{task}")[k] for k, c in enumerate(classes)}
        return _with_likeliest(scored, probs, task).drop(f"chance_{task}")

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` of inputs with what a card's scorer adds: winner probability and spread, both class maps."""
        out = self.ensemble_winner(self.prepared(rows))
        for task, column in (("method", "method_probs"), ("finish_round", "round_probs")):
            classes = TASKS[task][1]
            out = self.linear_classes(out, task)
            pairs = [v for c in classes for v in (F.lit(c), F.col(f"p_{c}"))]
            out = out.withColumn(column, F.create_map(*pairs)).drop("predicted", *[f"p_{c}" for c in classes])
        return out.drop(TREES, LINEAR)

    # --- storage -----------------------------------------------------------------------

    def save(self, spark: SparkSession, folder: str) -> str:
        """Writes every model and, last, the manifest; a folder that holds one fails."""
        rows = [(self.version, "inputs", "pipeline", None, self.names)]
        self.inputs.save(f"{folder}/inputs")
        for kind, models in (("boosted", self.boosted), ("linear", self.linear)):
            for name, model in models.items():
                model.save(f"{folder}/{kind}/{name}")
                rows.append((self.version, name, kind, self.temperatures.get(name), None))
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{folder}/manifest")
        return folder


def load(spark: SparkSession, folder: str) -> OutcomeModels:
    """The models of a folder that ``save`` wrote; one without a manifest is not complete and fails."""
    rows = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").collect()
    found: dict[str, dict] = {"boosted": {}, "linear": {}}
    for r in rows:
        if r["kind"] != "pipeline":
            found[r["kind"]][r["name"]] = _LOADERS[r["kind"]].load(f"{folder}/{r['kind']}/{r['name']}")
    head = next(r for r in rows if r["kind"] == "pipeline")
    return OutcomeModels(
        head["version"], head["inputs"], PipelineModel.load(f"{folder}/inputs"), found["boosted"], found["linear"],
        {r["name"]: r["temperature"] for r in rows if r["temperature"] is not None}, folder,
    )


def _with_likeliest(df: DataFrame, probs: Mapping[str, Column], task: str) -> DataFrame:
    """``p_class`` columns and the likeliest class; the late round can't happen in short contests."""
    out = df.withColumns({f"p_{c}": p for c, p in probs.items()})
    if task == "finish_round":
        kept = mask_long_rounds({c: F.col(f"p_{c}") for c in probs}, F.col("scheduled_rounds"))
        out = out.withColumns({f"p_{c}": p for c, p in kept.items()})
    ranked = [F.struct(F.col(f"p_{c}").alias("p"), F.lit(-k).alias("first"), F.lit(c).alias("class")) for k, c in enumerate(probs)]
    return out.withColumn("predicted", F.array_max(F.array(*ranked))["class"])


def fit(
    train: DataFrame, val: DataFrame, version: str, seeds: Sequence[int] = (0, 1, 2, 3, 4), max_rounds: int = 2000, threads: int = 4,
) -> OutcomeModels:
    """All models of a version from feature rows; ``val`` stops the trees and sets the temperatures.

    Rows are prepared once and stored; the fits read them from there.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    inputs, names = fit_inputs(train)
    shell = OutcomeModels(version, names, inputs, {}, {})
    flagged = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    both = materialise(shell.prepared(flagged), "prepared-rows")
    own = both.filter("NOT is_val")
    spread = _spread(both, both.count())  # counted off the file footers

    def linear(task: str) -> LogisticRegressionModel:
        column, classes = TASKS[task]
        weights = learn.class_weights(own, column, classes).withColumnRenamed("label", column)
        return learn.train_multiclass(own.join(F.broadcast(weights), column), column, classes, LINEAR, "weight")

    # the labels of a task are known for the same rows, so their trees are grown side by side
    labels = {"winner": {"winner": F.col("y_winner")}}
    labels |= {task: {f"{task}-{c}": (F.col(column) == c).cast("double") for c in classes} for task, (column, classes) in TASKS.items()}
    fits: dict[str, Callable[[], object]] = {}
    for some in labels.values():
        grown = _once(lambda some=some: _boosted(spread, some, max_rounds, 0))
        fits |= {name: (lambda name=name, grown=grown: grown()[name]) for name in some}
    members = {f"member-{s}": (lambda s=s: learn.train_member(own, s, LINEAR)) for s in seeds}
    others = members | {task: (lambda task=task: linear(task)) for task in TASKS}
    first = {next(iter(some)): fits[next(iter(some))] for some in labels.values()}
    made = _fit_all(spark, first | others | fits, threads)
    models = OutcomeModels(version, names, inputs, {n: made[n] for n in fits}, {n: made[n] for n in made if n not in fits})
    return OutcomeModels(version, names, inputs, models.boosted, models.linear, _temperatures(models, both.filter("is_val"), list(members)))


def _temperatures(models: OutcomeModels, val: DataFrame, members: Sequence[str]) -> dict[str, float]:
    """Each member's temperature, all out of the same passes over the validation rows."""
    scored = models.with_chances(val, *members)
    logits = [F.struct(F.lit(m).alias("member"), (F.ln(F.col(f"chance_{m}")[1]) - F.ln(F.col(f"chance_{m}")[0])).alias("logit")) for m in members]
    long = scored.select(F.col("y_winner").cast("double").alias("y"), F.inline(F.array(*logits)))
    return {r["member"]: r["t"] for r in learn.fit_temperatures(long, "member").collect()}
