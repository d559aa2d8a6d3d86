"""Where queries meet their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.operators import build, features, history, predictions, ratings
from contestry.plans import oracle, views
from contestry.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_stored: dict[tuple, DataFrame] = {}

# The splits used on the order dates of the test tables (1995-2001).
TRAIN_END, TEST_START = "1999-01-01", "2000-01-01"
VAL = ("1999-01-01", "1999-12-31")
TUNE_CUTOFF = "2000-01-01"
TODAY = "2000-06-30"
# Cards are predicted in runs, out of contests more than a week before the run.
RUNS = ("1900-01-01", "1996-07-01", "1998-01-01", "1999-07-01", TODAY)
RUN_LEAD_DAYS = 7


class Tables:
    """The contest tables of one folder, built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def version(self) -> tuple:
        """Sizes and change times of the folder's files, so that a rewritten folder is read anew."""
        java = self.spark.sparkContext._jvm
        path = java.org.apache.hadoop.fs.Path(self.sf_dir)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f for top in files.listStatus(path) for f in (files.listStatus(top.getPath()) if top.isDirectory() else [top])]
        return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    def stored(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table other queries build on: computed once per session, folder and state of its files."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.version, label)
        if key not in _stored:
            _stored[key] = build()
        return _stored[key]

    @cached_property
    def contests(self) -> DataFrame:
        """The stored clean contests."""
        return self.stored("contests", lambda: build.store_contests(views.contests(self.spark, self.sf_dir))[0])

    @cached_property
    def stats(self) -> DataFrame:
        """The stored side statistics."""
        return self.stored("stats", lambda: build.store_stats(views.side_stats(self.spark, self.sf_dir))[0])

    @cached_property
    def competitors(self) -> DataFrame:
        return views.competitors(self.spark, self.sf_dir)

    @cached_property
    def quotes(self) -> DataFrame:
        return views.raw_quotes(self.spark, self.sf_dir)

    @cached_property
    def bouts(self) -> DataFrame:
        return views.bouts(self.spark, self.sf_dir)

    @cached_property
    def ratings(self) -> DataFrame:
        return self.stored("ratings", lambda: ratings.run_elo(self.contests, self.stats))

    @cached_property
    def predictions(self) -> DataFrame:
        return ratings.prediction_pairs(self.contests, self.ratings)

    @cached_property
    def history(self) -> DataFrame:
        return history.build_history(self.contests, self.stats, self.ratings)

    @cached_property
    def snapshots(self) -> DataFrame:
        return history.build_snapshots(self.contests, self.stats, self.ratings)

    @cached_property
    def grid_losses(self) -> DataFrame:
        """The stored log-loss of every parameter set of the tuning grid."""

        def build() -> DataFrame:
            early = self.contests.filter(F.col("date") < F.lit(TUNE_CUTOFF).cast("timestamp_ntz"))
            return materialise(ratings.grid_losses(early, self.stats, ratings.grid_params()), "grid-losses")

        return self.stored("grid-losses", build)

    @cached_property
    def run_bouts(self) -> DataFrame:
        """The bouts with the last run before their event."""
        day = F.col("event_date")
        run = F.coalesce(*[F.when(day >= F.lit(r).cast("date"), F.lit(r).cast("date")) for r in reversed(RUNS)])
        return self.bouts.withColumn("run", run)

    @cached_property
    def states(self) -> DataFrame:
        """The stored states of competitors after every contest."""
        return self.stored("states", lambda: materialise(history.states_after(self.contests, self.stats, self.ratings), "states"))

    def run_matchups(self) -> DataFrame:
        """The bouts with the states their run could know."""
        bouts = self.run_bouts.withColumn("known_before", F.date_sub("run", RUN_LEAD_DAYS))
        return predictions.matchups_as_of(bouts, self.competitors, self.states, "known_before")

    @cached_property
    def features(self) -> DataFrame:
        """The stored feature table."""
        return self.stored(
            "features",
            lambda: materialise(
                features.build_features(self.contests, self.competitors, self.ratings, self.history), "features"
            ),
        )

    @cached_property
    def log(self) -> DataFrame:
        """The prediction log of all cards, stamped a week before each event."""

        def build() -> DataFrame:
            made = predictions.predict_matchups(self.run_matchups())
            day = F.col("event_date")
            at = F.concat(F.date_format(F.date_sub(day, 7), "yyyy-MM-dd"), F.lit("T12:00:00Z"))
            version = F.concat(F.lit("v"), (F.year(day) % 3).cast("string"))
            return materialise(predictions.stamped(made, at, version), "log")

        return self.stored("log", build)


def register(name: str, sql: str | None = None):
    """Register a plan under ``name``, with its SQL twin if it has one."""

    def add(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle.query(sql)
        return plan

    return add


def r6(column: str | Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Every double column to six decimals, every timestamp to its day, counts to long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "double":
            c = r6(c)
        elif kind in ("timestamp_ntz", "timestamp", "date"):
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
