"""Hashed text features, and linear models fitted by distributed gradients.

Words, their beginnings, runs of marks and the use of capitals are hashed to
``DIMENSIONS`` slots; a text's slots are scaled to length one.  A few further slots
say how long and how repetitive it is.  A fit keeps the features of its bounded
sample in the shared folder; each step sums the gradients of that table's parts.  Only
slots that occur in the sample are fitted (the others' weights stay where they
started), so only these travel and only these are held by the driver, a few vectors
of at most ``SIZE`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contestry.llm import text as tx

_BITS = 18
DIMENSIONS = 1 << _BITS
_EXTRA = 64
SIZE = DIMENSIONS + _EXTRA
#: Parts of a sample table; each sends one vector of SIZE numbers per step.
PARTS = 6

_byte = np.arange(256)
_CAPITAL = (_byte >= 0x41) & (_byte <= 0x5A)
_MARK = ~tx.PLAIN & ~_CAPITAL & (_byte > 0x20) & (_byte < 0x7F)


def _beginnings(data: np.ndarray, words: tx.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the first ``size`` bytes of each longer word."""
    longer = words.ends - words.starts > size
    found = np.zeros(int(longer.sum()), np.uint64)
    for k in range(size):
        found = found * np.uint64(0x100000001B3) + data[words.starts[longer] + k]
    return words.text[longer], tx.mix(found ^ tx.mix(np.array([size], np.uint64)))


def features(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and the texts' bounds among them."""
    data, offsets = tx.lower(chunk.data), chunk.offsets
    words = tx.find_runs(data, offsets, tx.PLAIN[data])
    marks = tx.find_runs(data, offsets, _MARK[data])
    capitals = tx.find_runs(chunk.data, offsets, _CAPITAL[chunk.data])
    loud = capitals.ends - capitals.starts > 1
    owners = [words.text, marks.text, capitals.text[loud]]
    hashes = [words.hashes, tx.mix(marks.hashes), np.full(int(loud.sum()), 12345 << 46, np.uint64)]
    for size in (4, 5):
        owner, begun = _beginnings(data, words, size)
        owners.append(owner)
        hashes.append(begun)
    slots = (np.concatenate(hashes) >> np.uint64(64 - _BITS)).astype(np.int64)
    keys, counts = np.unique(np.concatenate(owners) * DIMENSIONS + slots, return_counts=True)
    owner, slot = keys // DIMENSIONS, keys % DIMENSIONS
    values = 1 + np.log(counts)
    norms = np.sqrt(np.bincount(owner, values**2, minlength=chunk.count))
    values /= np.sqrt(norms)[owner]  # between counts and unit length: a few telling words still show in a long text

    n_words = np.diff(words.bounds)
    distinct = np.bincount(np.unique(words.text * DIMENSIONS + (words.hashes >> np.uint64(64 - _BITS)).astype(np.int64)) // DIMENSIONS, minlength=chunk.count)
    length = np.minimum(np.log2(n_words + 1).astype(np.int64), 20)
    variety = np.minimum(20 * distinct // np.maximum(n_words, 1), 20)
    texts = np.arange(chunk.count)
    extra = np.concatenate([np.full(chunk.count, DIMENSIONS), DIMENSIONS + 1 + length, DIMENSIONS + 22 + variety])
    owner, slot = np.concatenate([owner, np.tile(texts, 3)]), np.concatenate([slot, extra])
    values = np.concatenate([values, np.ones(len(extra))])
    order = np.argsort(owner, kind="stable")
    return slot[order], values[order], np.searchsorted(owner[order], np.arange(chunk.count + 1))


def feature_lists(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Slots and values of each text as list columns."""
    slots, values, sizes = [], [], [np.zeros(1, np.int64)]
    for chunk in tx.chunks(column):
        found, weights, bounds = features(chunk)
        slots.append(found)
        values.append(weights)
        sizes.append(np.diff(bounds))
    bounds = np.cumsum(np.concatenate(sizes))
    joined = (np.concatenate(x) if x else np.empty(0) for x in (slots, values))
    return tx.lists(next(joined), bounds, pa.int32()), tx.lists(next(joined), bounds, pa.float32())


def margins(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of features of each text."""
    found = [np.zeros(0)]
    for chunk in tx.chunks(column):
        slots, values, bounds = features(chunk)
        found.append(np.add.reduceat(values * weights[slots], bounds[:-1]))
    return np.concatenate(found)


class Rows:
    """Feature lists of some rows, as arrays."""

    def __init__(self, slots: pa.Array, values: pa.Array) -> None:
        self.sizes = np.diff(slots.offsets.to_numpy())
        self.slots = slots.flatten().to_numpy()
        self.values = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * weights[self.slots], minlength=len(self.sizes))

    def pull(self, slopes: np.ndarray) -> np.ndarray:
        """Gradient by the weights, given slopes by the margins."""
        return np.bincount(self.slots, self.values * slopes[self.owner], minlength=SIZE)


#: A gradient reaches the driver in rows of so many numbers.
_BLOCK = 1 << 12


def _occurring(sample: DataFrame) -> np.ndarray:
    """The slots in any feature list of the sample, in order; each part sends one bit per slot."""
    lists = [c for c in sample.columns if c.endswith("slots")]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, bool)
        for batch in batches:
            for column in batch.columns:
                seen[column.flatten().to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["seen"])

    seen = np.zeros(SIZE, bool)
    for row in sample.select(*lists).mapInArrow(part, "seen binary").collect():
        seen |= np.unpackbits(np.frombuffer(row["seen"], np.uint8), count=SIZE).astype(bool)
    return np.flatnonzero(seen)


#: (batch, parameters) -> (loss, gradient), summed over the batch's rows.
Loss = Callable[[pa.RecordBatch, np.ndarray], tuple[float, np.ndarray]]


def fit(sample: DataFrame, rows: int, loss: Loss, start: np.ndarray, decay: float = 1e-5, steps: int = 30) -> np.ndarray:
    """Parameters that minimise the mean ``loss`` plus ``decay / 2`` times the squared weights.

    Limited-memory quasi-Newton steps over the slots that occur and the parameters
    behind the weights; without such a slot a weight has no slope but its decay, so it
    must start at 0 and stays there.  Each trial is one pass over ``sample``, which
    must have a few parts only; the order of sums is fixed.
    """
    context = sample.sparkSession.sparkContext
    moving = np.concatenate([_occurring(sample), np.arange(SIZE, len(start))])
    n_weights = int(np.searchsorted(moving, SIZE))
    places = context.broadcast(moving.astype(np.int32))
    length = len(start)

    def evaluate(parameters: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(parameters)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.zeros(length)
            whole[places.value] = sent.value
            total, gradient = 0.0, np.zeros(len(places.value))
            for batch in batches:
                value, slope = loss(batch, whole)
                total += value
                gradient += slope[places.value]
            blocks = [gradient[k : k + _BLOCK].tobytes() for k in range(0, len(gradient), _BLOCK)]
            columns = [pa.array([total] * len(blocks)), pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["loss", "block", "gradient"])

        found = sample.mapInArrow(part, "loss double, block int, gradient binary").toArrow()
        sent.destroy()
        pulled = sorted(zip(*(found.column(k).to_pylist() for k in range(3)), strict=True))
        value = sum(v for v, block, _ in pulled if block == 0) / rows
        slope = np.zeros(len(parameters))
        for _, block, numbers in pulled:
            slope[block * _BLOCK : (block + 1) * _BLOCK] += np.frombuffer(numbers)
        slope /= rows
        weights = parameters[:n_weights]
        slope[:n_weights] += decay * weights
        return value + decay / 2 * float(weights @ weights), slope

    place = start[moving]
    value, slope = evaluate(place)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction = -_bend(slope, moves)
        if slope @ direction >= 0:
            moves, direction = [], -slope
        stride = 1.0 if moves else min(1.0, 1.0 / max(np.abs(slope).max(), 1e-12))
        for _ in range(8):
            trial = place + stride * direction
            new_value, new_slope = evaluate(trial)
            if new_value <= value + 1e-4 * stride * (slope @ direction):
                break
            stride /= 3
        else:
            break
        if (trial - place) @ (new_slope - slope) > 1e-12:
            moves = [*moves[-9:], (trial - place, new_slope - slope)]
        gained = value - new_value
        place, value, slope = trial, new_value, new_slope
        if gained < 1e-5 * max(value, 1e-3):
            break
    places.destroy()
    fitted = start.copy()
    fitted[moving] = place
    return fitted


def _bend(slope: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope times the inverse curvature seen in past moves."""
    bent, shares = slope.copy(), []
    for step, change in reversed(moves):
        share = (step @ bent) / (step @ change)
        bent -= share * change
        shares.append(share)
    if moves:
        step, change = moves[-1]
        bent *= (step @ change) / (change @ change)
    for (step, change), share in zip(moves, reversed(shares), strict=True):
        bent += step * (share - (change @ bent) / (step @ change))
    return bent


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(values / 2))
