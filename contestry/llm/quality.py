"""Graded quality of texts by cumulative-link regression.

One weight vector orders texts; thresholds cut the order into grades, so that the
probability of at least grade k is the logistic of margin less threshold k.
Thresholds are kept in order by learning the logarithms of their gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm import linear, samples
from contestry.session import materialise

GRADES = 3
#: A document is kept if it is at least of this grade with this probability.
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5
_SAMPLE = "target int, slots array<int>, values array<float>"


def rating() -> Column:
    """Grade of a labelled row: 0 poor, 1 good but toxic, 2 good; null without quality."""
    good = F.when(F.col("toxic") == 1, 1).otherwise(2)
    return F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull(), good)


def thresholds(parameters: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the parameters behind the weights."""
    tail = parameters[linear.SIZE :]
    return np.cumsum(np.concatenate([tail[:1], np.exp(tail[1:])]))


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(2), *linear.feature_lists(batch.column(1))], names=["target", "slots", "values"])


def _loss(batch: pa.RecordBatch, parameters: np.ndarray) -> tuple[float, np.ndarray]:
    target = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
    rows = linear.Rows(batch.column(1), batch.column(2))
    margin = rows.margins(parameters[: linear.SIZE])
    cuts = np.concatenate([[-np.inf], thresholds(parameters), [np.inf]])
    low, high = linear.sigmoid(margin - cuts[target]), linear.sigmoid(margin - cuts[target + 1])
    share = np.maximum(low - high, 1e-12)
    low_slope, high_slope = low * (1 - low) / share, high * (1 - high) / share
    slope = high_slope - low_slope
    by_cut = np.bincount(target, low_slope, minlength=len(cuts) - 1)[1:] - np.bincount(target + 1, high_slope, minlength=len(cuts) - 1)[1 : len(cuts) - 1]
    gaps = np.exp(parameters[linear.SIZE + 1 :])
    later = np.cumsum(by_cut[::-1])[::-1]
    return float(-np.log(share).sum()), np.concatenate([rows.pull(slope), later[:1], later[1:] * gaps])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8_000) -> np.ndarray:
    """Weights and threshold parameters from at most ``rows`` rated documents.

    Without rated rows all weights are 0 and the lowest threshold is far below, so
    that every document is kept.
    """
    sample = samples.labelled(docs, labels, rating(), rows).select("doc_id", "text", "target")
    sample = sample.repartition(linear.PARTS, "doc_id").sortWithinPartitions("doc_id")
    sample = materialise(sample.mapInArrow(_sample_batches, _SAMPLE), "quality_sample").coalesce(linear.PARTS)
    start = np.concatenate([np.zeros(linear.SIZE), [-3.0], np.zeros(GRADES - 2)])
    count = sample.count()
    return linear.fit(sample, count, _loss, start) if count else start


def _as_lists(tails: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))


def grade(docs: DataFrame, parameters: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade, tails and kept.

    tails are the probabilities of at least grade 1, 2, ...; their sum is the
    expected grade, and kept says that grade ``KEEP_GRADE`` is likely enough.  Only
    the text counts; a null or empty text is graded as one without words.  Rows are
    independent, so repeated rows and null ids stay; an empty table stays empty.
    Columns of these names in ``docs`` are replaced, others are carried through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(parameters)

    def tails(texts: pa.Array) -> pa.Array:
        margin = linear.margins(texts, sent.value[: linear.SIZE])
        return _as_lists(linear.sigmoid(margin[:, None] - thresholds(sent.value)))

    graded = F.arrow_udf(tails, "array<double>").asNondeterministic()  # so that the planner computes it once
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.drop("expected_grade", "tails", "kept").withColumn("tails", graded(text))
    expected = F.aggregate("tails", F.lit(0.0), lambda total, tail: total + tail)
    return found.withColumns({"expected_grade": expected, "kept": F.col("tails")[KEEP_GRADE - 1] >= KEEP_PROBABILITY})
