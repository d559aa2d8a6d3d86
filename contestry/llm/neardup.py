"""Near-duplicate documents by a join of MinHash signature coordinates.

Every set of word shingles gets a signature of ``coords`` coordinates, each made of
``ROWS`` MinHash values, so that sets with little in common seldom share one.  Equal sets collapse to
one representative first.  A representative is posted under its coordinate values;
of two sets with at least ``matches`` equal coordinates, both must have one of the
shared values among their ``coords - matches + 1`` rarest, so only that prefix is
posted and the long lists of frequent values are skipped.  Values found once need
no posting at all.

Within a list, members are first compared with one head, then only across components
(see ``graph.linked``), so a large group of copies costs a row per copy, not per
pair.  Pairs with enough equal coordinates are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm import text as tx
from contestry.llm.graph import MEASURED, linked
from contestry.session import materialise

#: 32 coordinates of three values, 3 to match: a pair at similarity 0.8 is missed with probability 6e-8.
COORDS = 32
ROWS = 3
MATCHES = 3
_SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>"


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[tx.Chunk, np.ndarray, np.ndarray]]:
    for chunk in tx.chunks(column):
        words = tx.find_words(chunk._replace(data=tx.lower(chunk.data)), tx.SPACED)
        yield chunk, *tx.shingle_sets(words, shingle)


def _sketch_batches(batches: Iterator[pa.RecordBatch], shingle: int, coords: int) -> Iterator[pa.RecordBatch]:
    factors = tx.mix(np.arange(1, coords * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salts = tx.mix(np.arange(1001, coords + 1001, dtype=np.uint64))
    for batch in batches:
        for chunk, sets, bounds in _sets(batch.column(1), shingle):
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            sums = np.zeros((2, chunk.count), np.uint64)
            keys = np.zeros((len(full), coords), np.uint64)
            if len(full):
                at = bounds[full]
                sums[0, full] = np.add.reduceat(tx.mix(sets ^ salts[0]), at)
                sums[1, full] = np.add.reduceat(tx.mix(sets ^ salts[1]), at)
                for k in range(coords):
                    for factor in factors[k * ROWS : (k + 1) * ROWS]:
                        keys[:, k] = tx.mix(keys[:, k] + np.minimum.reduceat(sets * factor, at) ^ salts[k])
            each = np.concatenate([[0], np.cumsum(np.where(sizes > 0, coords, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(chunk.first, chunk.count),
                    pa.array(sizes, pa.int64()),
                    pa.array(tx.longs(sums[0])),
                    pa.array(tx.longs(sums[1])),
                    tx.lists(tx.longs(keys.ravel()), each, pa.int64()),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "sig"],
            )


def _compare_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    def sets_of(column: pa.Array) -> list[np.ndarray]:
        return [s[a:b] for _, s, bounds in _sets(column, shingle) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            left, right = sets_of(part.column(2)), sets_of(part.column(3))
            fresh = [np.setdiff1d(y, x, True) for x, y in zip(left, right, strict=True)]
            lost = [np.setdiff1d(x, y, True) for x, y in zip(left, right, strict=True)]
            na, nb, nf = (np.array([len(x) for x in sets], np.int64) for sets in (left, right, fresh))
            columns = [part.column(0), part.column(1), pa.array(nb - nf), pa.array(na), pa.array(nb)]
            for sets in (fresh, lost):
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                columns.append(tx.lists(tx.longs(np.concatenate([*sets, np.empty(0, np.uint64)])), bounds, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "shared", "na", "nb", "fresh", "lost"])


def _measured(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) with what their full sets share."""
    right = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("right")), "b")
    both = right.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(partial(_compare_batches, shingle=shingle), MEASURED)


def _postings(reps: DataFrame, coords: int, matches: int) -> DataFrame:
    """(node, key, weight): each representative under the non-unique values of its prefix."""
    keys = reps.select("rep", F.explode("sig").alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(counts, "key").groupBy("rep")
    shared = shared.agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"), F.sum("n").alias("weight"))
    # values found once come first in the order and use up the prefix
    room = F.lit(coords - matches + 1 - coords) + F.size("found")
    posted = shared.where(room > 0).select("rep", "weight", F.explode(F.slice("found", F.lit(1), room)).alias("post"))
    return posted.select(F.col("rep").alias("node"), F.col("post.key").alias("key"), "weight")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    coords: int = COORDS,
    matches: int = MATCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Words are lower-cased (A-Z) runs of anything but white space.  Two documents
    are linked when ``100 * shared >= percent * united`` over their shingle sets;
    ``component_id`` is the smallest id that links lead to, and one document of
    each component is ``kept``.  A text with fewer words than a shingle is one
    shingle; a null or empty text has none and is linked with nothing.  Rows that
    repeat an id are one node and each gets a row; a row without id is linked with
    nothing, has no component and is kept.  An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = own.mapInArrow(partial(_sketch_batches, shingle=shingle, coords=coords), _SKETCH)
    sketch = materialise(sketch, "neardup_sketch")
    named = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = named.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = materialise(reps, "neardup_reps")
    posts = materialise(_postings(reps, coords, matches), "neardup_posts")
    posted = posts.select(F.col("node").alias("rep")).distinct()
    signed = reps.join(posted, "rep", "left_semi").select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), "sig")
    signed = materialise(signed, "neardup_posted")
    texts = own.withColumnRenamed("doc_id", "rep").join(posted, "rep", "left_semi")
    texts = materialise(texts, "neardup_texts")

    def measure(pairs: DataFrame) -> DataFrame:
        return _measured(pairs, texts, shingle)

    known = linked(posts, measure, percent, "neardup", _same_id(sketch, reps), signed, matches)
    classes = reps.drop("sig").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    found = sketch.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _same_id(sketch: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat an id with another text."""
    named = sketch.where("n_shingles > 0 and doc_id is not null")
    sets = named.groupBy("doc_id").agg(
        F.min(F.struct("h1", "h2", "n_shingles")).alias("low"), F.max(F.struct("h1", "h2", "n_shingles")).alias("high")
    )
    sets = sets.where("low <> high").select("doc_id")
    mixed = named.join(sets, "doc_id").select("doc_id", "h1", "h2", "n_shingles")
    return mixed.join(reps.drop("sig"), ["h1", "h2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

