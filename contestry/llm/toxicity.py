"""Toxicity score of texts by a counterfactually regularised linear classifier.

Labelled texts that mention a group get a twin in which each group term is swapped
for another one; the fit penalises the squared difference of a text's margin and
its twin's.  So weight that group terms would earn by mere company is held down.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm import linear, samples
from contestry.session import materialise

#: Terms that may stand for each other, by language.
GROUP_TERMS = (
    "women men girls boys muslims christians jews hindus atheists immigrants refugees foreigners natives gays lesbians "
    "transgender straight disabled elderly teenagers africans asians europeans americans mexicans black white".split(),
    "frauen männer mädchen jungen muslime christen juden hindus atheisten einwanderer flüchtlinge ausländer schwule "
    "lesben behinderte senioren afrikaner asiaten europäer amerikaner".split(),
    "femmes hommes filles garçons musulmans chrétiens juifs hindous athées immigrés réfugiés étrangers gays lesbiennes "
    "handicapés africains asiatiques européens américains".split(),
    "mujeres hombres niñas niños musulmanes cristianos judíos hindúes ateos inmigrantes refugiados extranjeros "
    "lesbianas discapacitados ancianos africanos asiáticos europeos americanos".split(),
)
_SWAP = {term: terms[(k + 1) % len(terms)] for terms in reversed(GROUP_TERMS) for k, term in enumerate(terms)}
_TERM = regex.compile(r"\b(?:" + "|".join(sorted(map(regex.escape, _SWAP), key=len, reverse=True)) + r")\b", regex.IGNORECASE)

#: Weight of the squared margin difference; ids whose checksum leaves this remainder are never learnt from.
PENALTY = 1.0
HELD_OUT = 2
THRESHOLD = 0.3


def swapped(text: str) -> str:
    """The text with each group term replaced by the next of its language."""
    return _TERM.sub(lambda m: _SWAP[m[0].lower()], text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        twins = [swapped(t or "") for t in texts]
        slots, values = linear.feature_lists(batch.column(1))
        twin_slots, twin_values = linear.feature_lists(pa.array(twins, pa.string()))
        changed = pa.array([float(t != (o or "")) for t, o in zip(twins, texts, strict=True)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), changed, slots, values, twin_slots, twin_values], names=["target", "changed", "slots", "values", "twin_slots", "twin_values"]
        )


_SAMPLE = "target int, changed double, slots array<int>, values array<float>, twin_slots array<int>, twin_values array<float>"


def _loss(batch: pa.RecordBatch, weights: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    target, changed = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
    rows, twins = linear.Rows(batch.column(2), batch.column(3)), linear.Rows(batch.column(4), batch.column(5))
    margin, twin = rows.margins(weights), twins.margins(weights)
    apart = changed * (margin - twin)
    value = float(np.logaddexp(0, np.where(target == 1, -margin, margin)).sum() + penalty * (apart**2).sum())
    slope = linear.sigmoid(margin) - target
    return value, rows.pull(slope + 2 * penalty * apart) - twins.pull(2 * penalty * apart)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8_000, penalty: float = PENALTY) -> np.ndarray:
    """Weights from at most ``rows`` labelled documents that are not held out.

    Without labelled rows all weights are 0 and every score is 0.5.
    """
    sample = samples.labelled(docs, labels, F.col("toxic").cast("int"), rows, ~held_out(F.col("doc_id")))
    sample = sample.select("doc_id", "text", "target").repartition(linear.PARTS, "doc_id").sortWithinPartitions("doc_id")
    sample = materialise(sample.mapInArrow(_sample_batches, _SAMPLE), "toxicity_sample").coalesce(linear.PARTS)
    count = sample.count()
    if not count:
        return np.zeros(linear.SIZE)
    return linear.fit(sample, count, partial(_loss, penalty=penalty), np.zeros(linear.SIZE))


def _score_batches(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    for batch in batches:
        scores = linear.sigmoid(linear.margins(batch.column(1), weights.value))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted per row of ``docs``.

    Only the text is scored; a null or empty text has the score of a text without
    words.  Rows are independent, so repeated rows and null ids (never held out)
    stay; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(partial(_score_batches, weights=sent), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
