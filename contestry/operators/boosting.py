"""Boosted trees for several 0/1 labels of the same rows, grown side by side.

The fit is that of Spark ML's ``GBTClassifier`` (log-loss, trees of least variance, a
validation set that stops it), step by step and with its random draws, so that the trees
are the same but for the order in which numbers are added.  It differs in how the work
is done.  Rows are binned once into blocks of small integers, a block per task, several
inputs to a number.  A level of the trees of all labels is one job, which counts a block
by numpy; a round is as many jobs as trees have levels, whatever the number of labels.
The driver gets sums per (label, node, input, bin) and never a row, but for the sample
that sets the bins, which is of Spark's size (10,000 rows).
"""

from __future__ import annotations

import json
import math
import pickle
import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

from contestry.session import ensure_checkpoint_dir, scratch_path

#: Rows of the sample that sets the bins, as in Spark.
SAMPLE_ROWS = 10_000
#: Most values of a packed number of several inputs.
MOST_PACKED = 2048
#: Rounds between two checkpoints of the predictions.
CHECKPOINT_ROUNDS = 20
#: Blocks beyond which sums are added up by tasks before the driver gets them.
MOST_COLLECTED = 48

_MASK = (1 << 64) - 1


# --- Spark's random draws ---------------------------------------------------------------------


def _murmur(data: bytes, seed: int) -> int:
    h = seed
    for (k,) in struct.iter_unpack("<I", data):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _shift_start(seed: int) -> int:
    """The state that Spark's XORShiftRandom starts with."""
    data = struct.pack(">Q", seed & _MASK)
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _shift(s: int) -> int:
    s ^= s << 21 & _MASK
    s ^= s >> 35
    return s ^ (s << 4 & _MASK)


class _ShiftRandom:
    """XORShiftRandom, a draw at a time."""

    def __init__(self, seed: int) -> None:
        self.state = _shift_start(seed)

    def bits(self, n: int) -> int:
        self.state = _shift(self.state)
        return self.state & ((1 << n) - 1)

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53

    def int32(self) -> int:
        value = self.bits(32)
        return value - (1 << 32) if value >> 31 else value


class _JavaRandom:
    """java.util.Random, for its long numbers."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _int32(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        value = self.state >> 16
        return value - (1 << 32) if value >> 31 else value

    def long(self) -> int:
        return ((self._int32() << 32) + self._int32()) & _MASK


_leaps: list[np.ndarray] = []


def _leap(power: int) -> np.ndarray:
    """Tables (byte, its value) -> state for 2**power steps of the shift register, which is linear."""
    while len(_leaps) <= power:
        if _leaps:
            last, units = _leaps[-1], np.uint64(1) << np.arange(64, dtype=np.uint64)
            images = _leapt(last, _leapt(last, units))
        else:
            images = np.array([_shift(1 << i) for i in range(64)], np.uint64)
        tables = np.zeros((8, 256), np.uint64)
        for bit in range(8):
            with_bit = (np.arange(256) >> bit & 1).astype(bool)
            tables[:, with_bit] ^= images[bit::8][:, None]
        _leaps.append(tables)
    return _leaps[power]


def _leapt(tables: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for byte in range(8):
        out ^= tables[byte][(states >> np.uint64(8 * byte) & np.uint64(255)).astype(np.intp)]
    return out


def drawn(seed: int, rate: float, n: int) -> np.ndarray:
    """Which of ``n`` rows Spark draws without replacement with this seed."""
    if rate >= 1.0:
        return np.ones(n, bool)
    states, power = np.array([_shift(_shift_start(seed))], np.uint64), 0
    while len(states) < 2 * n:
        states, power = np.concatenate([states, _leapt(_leap(power), states)]), power + 1
    high, low = states[: 2 * n : 2] & np.uint64((1 << 26) - 1), states[1 : 2 * n : 2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(float) * 2.0**-53 < rate


def _inputs_of_node(n: int, k: int, seed: int) -> list[int]:
    """Spark's reservoir of ``k`` of ``n`` inputs."""
    kept, random = list(range(k)), _ShiftRandom(seed)
    for item in range(k, n):
        place = int(random.double() * (item + 1))
        if place < k:
            kept[place] = item
    return kept


# --- bins -------------------------------------------------------------------------------------


def thresholds(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Spark's split points of a sample of one input; zeros are counted as what is missing to ``expected`` rows."""
    some, counts = np.unique(values[values != 0.0], return_counts=True)
    counts, n = counts.astype(float), int(counts.sum())
    if expected - n > np.finfo(float).eps * n * 100:
        at = int(np.searchsorted(some, 0.0))
        some, counts = np.insert(some, at, 0.0), np.insert(counts, at, expected - n)
    middles = (some[:-1] + some[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride, found = expected / (most + 1), []
    so_far, target = counts[0], stride
    for k in range(1, len(some)):
        before, so_far = so_far, so_far + counts[k]
        if abs(before - target) < abs(so_far - target):
            found.append(middles[k - 1])
            target += stride
    return np.array(found)


@dataclass(frozen=True)
class _Bins:
    """How inputs become bins, and which share a packed number."""

    splits: list[np.ndarray | None]  # None: the values of a category are its bins
    sizes: list[int]
    packs: list[list[int]] = field(default_factory=list)

    def packed(self) -> _Bins:
        packs, room = [], []
        for f in sorted(range(len(self.sizes)), key=lambda f: -self.sizes[f]):
            at = next((p for p, free in enumerate(room) if self.sizes[f] <= free), None)
            if at is None:
                packs.append([f])
                room.append(MOST_PACKED // self.sizes[f])
            else:
                packs[at].append(f)
                room[at] //= self.sizes[f]
        return _Bins(self.splits, self.sizes, packs)

    def shape(self, pack: int) -> tuple[int, ...]:
        return tuple(self.sizes[f] for f in self.packs[pack])

    def of(self, values: np.ndarray) -> np.ndarray:
        """(pack, row) of rows of inputs."""
        out = np.zeros((len(self.packs), len(values)), np.uint16)
        for p, pack in enumerate(self.packs):
            for f in pack:
                bins = values[:, f].astype(np.int64) if self.splits[f] is None else np.searchsorted(self.splits[f], values[:, f])
                out[p] = out[p] * self.sizes[f] + bins.astype(np.uint16)
        return out

    def place(self, f: int) -> tuple[int, np.ndarray]:
        """The pack of an input, and its bin for every number of the pack."""
        p = next(p for p, pack in enumerate(self.packs) if f in pack)
        shape = self.shape(p)
        return p, np.unravel_index(np.arange(math.prod(shape)), shape)[self.packs[p].index(f)]


# --- trees while they grow ----------------------------------------------------------------------


@dataclass
class _Node:
    """A node by Spark's number (root 1, children 2i and 2i + 1); ``stats`` is (rows, sum, squares)."""

    number: int
    stats: tuple[float, float, float]
    gain: float = -1.0
    feature: int = -1
    left_bins: np.ndarray | None = None  # of the split's input
    split: tuple[list[float], int] = ((), -1)  # as stored: threshold or categories, their number

    @property
    def is_leaf(self) -> bool:
        return self.feature < 0

    @property
    def value(self) -> float:
        return self.stats[1] / self.stats[0]

    @property
    def impurity(self) -> float:
        n, s, q = self.stats
        return (q - s * s / n) / n


@dataclass(frozen=True)
class _Walk:
    """A tree as the blocks need it: per node its pack, where each packed number goes, and its value."""

    pack: np.ndarray
    right: np.ndarray
    inner: np.ndarray
    value: np.ndarray
    depth: int

    def nodes(self, packed: np.ndarray) -> np.ndarray:
        """The number of the node each row has come to."""
        at, rows = np.ones(packed.shape[1], np.intp), np.arange(packed.shape[1])
        for _ in range(self.depth):
            step = 2 * at + self.right[at, packed[self.pack[at], rows]]
            at = np.where(self.inner[at], step, at)
        return at


def _walk(tree: Mapping[int, _Node], places: Sequence[tuple[int, np.ndarray]], depth: int) -> _Walk:
    size = 2 << depth
    pack, inner, value = np.zeros(size, np.intp), np.zeros(size, bool), np.zeros(size)
    right = np.zeros((size, MOST_PACKED), bool)
    for i, node in tree.items():
        value[i] = node.value if node.stats[0] else 0.0
        if not node.is_leaf:
            pack[i], bin_of = places[node.feature]
            right[i, : len(bin_of)] = ~node.left_bins[bin_of]
            inner[i] = True
    return _Walk(pack, right, inner, value, depth)


# --- what tasks do -------------------------------------------------------------------------------


def _residuals(truth: np.ndarray, scores: np.ndarray | None) -> np.ndarray:
    return truth if scores is None else 4.0 * truth / (1.0 + np.exp(2.0 * truth * scores))


def _sums(bins: _Bins, packed: np.ndarray, slots: np.ndarray, n_slots: int, weights: Sequence[np.ndarray | None]) -> np.ndarray:
    """(weight, slot, input, bin): sums of each weight, of ones for None; rows of slot ``n_slots`` don't count."""
    out = np.zeros((len(weights), n_slots, len(bins.sizes), max(bins.sizes)))
    for p, pack in enumerate(bins.packs):
        shape = bins.shape(p)
        size = math.prod(shape)
        keys = slots * size + packed[p]
        for w, weight in enumerate(weights):
            found = np.bincount(keys, weight, (n_slots + 1) * size)[: n_slots * size].reshape(n_slots, *shape)
            for axis, f in enumerate(pack):
                others = tuple(a + 1 for a in range(len(pack)) if a != axis)
                out[w, :, f, : bins.sizes[f]] = found.sum(others)
    return out


def _opened(
    pair: tuple, part: int, bins: _Bins, walks: Mapping[str, _Walk], weight: float, kept: Sequence[str], seed: int, rate: float, squares: bool
) -> tuple:
    """A block's scores after the last trees, its draws for the next, and the sums of the next roots, losses and count of validation rows."""
    (names, packed, truth, packed_val, truth_val), (scores, scores_val, *_) = pair
    if walks:

        def moved(was: Mapping[str, np.ndarray] | None, numbers: np.ndarray) -> dict[str, np.ndarray]:
            steps = {name: weight * walks[name].value[walks[name].nodes(numbers)] for name in kept}
            return steps if was is None else {name: was[name] + step for name, step in steps.items()}

        scores, scores_val = moved(scores, packed), moved(scores_val, packed_val)
    draws = drawn(seed + part + 1, rate, packed.shape[1])
    chosen, losses, roots = packed[:, draws], {}, {}
    slots = np.zeros(chosen.shape[1], np.intp)
    counts = _sums(bins, chosen, slots, 1, [None])
    for name in kept:
        k = names.index(name)
        if walks:
            losses[name] = float((2.0 * np.logaddexp(0.0, -2.0 * truth_val[k] * scores_val[name])).sum())
        rest = _residuals(truth[k].astype(float), scores and scores[name])[draws]
        sums = _sums(bins, chosen, slots, 1, [rest, rest * rest] if squares else [rest])
        roots[name] = np.concatenate([counts, sums]), np.array([[len(rest), rest.sum(), (rest * rest).sum()]])
    return scores, scores_val, draws, (roots, losses, truth_val.shape[1])


def _level(pair: tuple, bins: _Bins, walks: Mapping[str, _Walk], open_nodes: Mapping[str, Sequence[int]], squares: bool) -> dict:
    """Sums per (label, open node, input, bin) of a block's drawn rows, and each open node's (rows, sum, squares)."""
    (names, packed, truth, _, _), (scores, _, draws, _) = pair
    chosen, out = packed[:, draws], {}
    for name, walk in walks.items():
        rest = _residuals(truth[names.index(name)].astype(float), scores and scores[name])[draws]
        n = len(open_nodes[name])
        slot = np.full(len(walk.value), n)
        slot[list(open_nodes[name])] = np.arange(n)
        slots = slot[walk.nodes(chosen)]
        squared = rest * rest
        totals = np.stack([np.bincount(slots, w, n + 1)[:n] for w in (None, rest, squared)], 1)
        out[name] = _sums(bins, chosen, slots, n, [None, rest, squared] if squares else [None, rest]), totals
    return out


def _added(a, b):
    if isinstance(a, dict):
        return {k: _added(v, b[k]) for k, v in a.items()}
    return tuple(_added(x, y) for x, y in zip(a, b, strict=True)) if isinstance(a, tuple) else a + b


def _total(rdd: RDD):
    if rdd.getNumPartitions() > MOST_COLLECTED:
        return rdd.treeReduce(_added, 2)
    first, *rest = rdd.collect()
    for more in rest:
        first = _added(first, more)
    return first


# --- what the driver decides ----------------------------------------------------------------------


def _best_split(sums: np.ndarray, node: _Node, inputs: Sequence[int], bins: _Bins) -> tuple[_Node, list[tuple[float, float, float]]] | None:
    """The node with its best split, and both children's stats; None where no split gains."""
    orders, sorted_sums = {}, sums[:2].copy()
    for f in inputs:
        if bins.splits[f] is None:  # categories in the order of their means, unseen ones last
            size = bins.sizes[f]
            with np.errstate(divide="ignore", invalid="ignore"):
                means = np.where(sums[0, f, :size] > 0, sums[1, f, :size] / sums[0, f, :size], np.inf)
            orders[f] = np.argsort(means, kind="stable")
            sorted_sums[:, f, :size] = sums[:2, f, orders[f]]
    n_all, s_all = node.stats[0], node.stats[1]
    left_n, left_s = np.cumsum(sorted_sums, 2)[:, :, :-1]
    right_n, right_s = n_all - left_n, s_all - left_s
    # bins behind an input's last are empty, so no rows are to their right
    valid = (left_n >= 1) & (right_n >= 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = np.where(valid, (left_s**2 / left_n + right_s**2 / right_n - s_all**2 / n_all) / n_all, -np.inf)
    places = np.argmax(gains, 1)
    each = gains[inputs, places[inputs]]
    f = inputs[int(np.argmax(each))]
    if not each.max() > 0.0:
        return None
    size, k = bins.sizes[f], int(places[f])
    left = orders.get(f, np.arange(size))[: k + 1]
    left_bins = np.zeros(size, bool)
    left_bins[left] = True
    split = ([float(c) for c in left], size) if f in orders else ([float(bins.splits[f][k])], -1)
    sides = [[float(sums[w, f, :size][m].sum()) for w in range(len(sums))] for m in (left_bins, ~left_bins)]
    return _Node(node.number, node.stats, float(gains[f, k]), f, left_bins, split), [(*side, math.nan)[:3] for side in sides]


@dataclass
class _Growing:
    """One tree while it grows: nodes so far, those whose sums are asked for, and Spark's draw of inputs per node."""

    random: _JavaRandom
    nodes: dict[int, _Node] = field(default_factory=dict)
    open: list[int] = field(default_factory=lambda: [1])

    def grow(self, sums: np.ndarray, totals: np.ndarray, bins: _Bins, per_node: int, depth: int) -> None:
        """Splits the open nodes, whose sums and totals are given in order."""
        children, all_inputs = [], len(bins.sizes)
        for slot, number in enumerate(self.open):
            node = self.nodes[number] = _Node(number, tuple(map(float, totals[slot])))
            if number > 1 and abs(node.impurity) < np.finfo(float).eps:
                continue  # a leaf before inputs are drawn for it
            inputs = _inputs_of_node(all_inputs, per_node, self.random.long()) if per_node < all_inputs else list(range(all_inputs))
            found = _best_split(sums[:, slot], node, inputs, bins)
            if found is None:
                continue
            self.nodes[number], sides = found
            if number.bit_length() == depth:
                for k in (0, 1):
                    self.nodes[2 * number + k] = _Node(2 * number + k, sides[k])
            else:
                children += [2 * number, 2 * number + 1]
        self.open = children[::-1]  # Spark takes the child put last first

    def pruned(self) -> dict[int, _Node]:
        """The nodes, with leaves of one value under a node drawn into it."""
        nodes = dict(self.nodes)
        for i in sorted(nodes, reverse=True):
            kids = (nodes.get(2 * i), nodes.get(2 * i + 1))
            if not nodes[i].is_leaf and all(k.is_leaf for k in kids) and kids[0].value == kids[1].value:
                nodes[i] = _Node(i, nodes[i].stats)
                del nodes[2 * i], nodes[2 * i + 1]
        return nodes


# --- the fit ---------------------------------------------------------------------------------------


def _blocks(rows: DataFrame, names: list[str], bins: _Bins) -> RDD:
    """One element per partition: (labels, packed inputs, ±1 per label) of the training rows and of those flagged ``is_val``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                inputs = batch.column("inputs")
                values = inputs.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                truth = np.stack([2 * batch.column(f"label_{k}").to_numpy(zero_copy_only=False).astype(np.int8) - 1 for k in range(len(names))])
                is_val = batch.column("is_val").to_numpy(zero_copy_only=False)
                block = pickle.dumps((bins.of(values), truth, is_val), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    def joined(found: Iterator) -> Iterator[tuple]:
        parts = [pickle.loads(bytes(r[0])) for r in found]
        empty = (np.zeros((len(bins.packs), 0), np.uint16), np.zeros((len(names), 0), np.int8), np.zeros(0, bool))
        packed, truth, is_val = (np.concatenate(x, axis=-1) for x in zip(empty, *parts))
        yield names, packed[:, ~is_val], truth[:, ~is_val], packed[:, is_val], truth[:, is_val]

    return _one_by_one(rows.mapInArrow(read, "block binary").rdd.mapPartitions(joined))


def _one_by_one(rdd: RDD) -> RDD:
    """Elements stored singly, which lets RDDs of them be zipped as they are."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


def _bins_of(train: DataFrame, n: int, categories: Mapping[int, int], max_bins: int, seed: int) -> _Bins:
    """The bins of the inputs of training rows, out of the rows that Spark samples for that."""
    fraction, max_bins = min(1.0, max(max_bins * max_bins, SAMPLE_ROWS) / n), min(max_bins, n)
    if any(size > max_bins for size in categories.values()):
        raise ValueError(f"a category has more values than there are bins ({max_bins})")
    sample = train.select("inputs")
    if fraction < 1.0:
        chosen = sample._jdf.javaRDD().sample(False, fraction, _ShiftRandom(seed).int32())
        sample = DataFrame(train.sparkSession._jsparkSession.createDataFrame(chosen, sample._jdf.schema()), train.sparkSession)
    values = np.array([r[0] for r in sample.collect()], float)
    splits = [None if f in categories else thresholds(values[:, f], fraction * n, max_bins - 1) for f in range(values.shape[1])]
    return _Bins(splits, [categories[f] if s is None else len(s) + 1 for f, s in enumerate(splits)]).packed()


def _categories(rows: DataFrame, features: str) -> dict[int, int]:
    """Input -> number of its values, for those that the vector column calls nominal."""
    attrs = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in attrs.get("nominal", [])} | {a["idx"]: 2 for a in attrs.get("binary", [])}


def _rounds(known: DataFrame, names: list[str], bins: _Bins, learner: GBTClassifier, per_node: int) -> dict[str, list[dict[int, _Node]]]:
    """The trees of each label, up to the round that did best on the validation rows."""
    depth, seed, rate, most = learner.getMaxDepth(), learner.getSeed(), learner.getSubsamplingRate(), learner.getMaxIter()
    blocks, state = _blocks(known, names, bins), None
    places = [bins.place(f) for f in range(len(bins.sizes))]
    made: dict[str, list[dict[int, _Node]]] = {name: [] for name in names}
    least, best, walks = {}, dict.fromkeys(names, 1), {}
    for m in range(most + 1):
        weight, kept, squares = 1.0 if m == 1 else learner.getStepSize(), tuple(names), depth == 1

        def opened(part: int, pairs: Iterator, walks=walks, weight=weight, kept=kept, m=m, squares=squares) -> Iterator:
            return (_opened(pair, part, bins, walks, weight, kept, seed + m, rate, squares) for pair in pairs)

        pairs = blocks.map(lambda block: (block, (None, None))) if state is None else blocks.zip(state)
        before, state = state, _one_by_one(pairs.mapPartitionsWithIndex(opened))
        if m % CHECKPOINT_ROUNDS == CHECKPOINT_ROUNDS - 1:
            state.checkpoint()
        roots, losses, n_val = _total(state.map(lambda s: s[3]))
        if before is not None:
            before.unpersist()
        for name in kept if m else ():
            loss = losses[name] / n_val
            if m > 1 and least[name] - loss < learner.getValidationTol() * max(loss, 0.01):
                names = [n for n in names if n != name]
            elif m == 1 or loss < least[name]:
                least[name], best[name] = loss, m
        if not names or m == most:
            break
        pairs = blocks.zip(state)
        growing = {name: _Growing(_JavaRandom(seed + m)) for name in names}
        for name, tree in growing.items():
            tree.grow(*roots[name], bins, per_node, depth)
        for level in range(1, depth):
            asked = {name: tree for name, tree in growing.items() if tree.open}
            if not asked:
                break
            ways = {name: _walk(tree.nodes, places, level) for name, tree in asked.items()}
            nodes, last = {name: tuple(tree.open) for name, tree in asked.items()}, level == depth - 1
            found = _total(pairs.map(lambda pair, ways=ways, nodes=nodes, last=last: _level(pair, bins, ways, nodes, last)))
            for name, tree in asked.items():
                tree.grow(*found[name], bins, per_node, depth)
        for name, tree in growing.items():
            made[name].append(tree.pruned())
        walks = {name: _walk(made[name][-1], places, depth) for name in names}
    state.unpersist()
    blocks.unpersist()
    return {name: trees[: best[name]] for name, trees in made.items()}


def fit(rows: DataFrame, labels: Mapping[str, Column], learner: GBTClassifier) -> dict[str, GBTClassificationModel]:
    """A model per label, of the rows where all labels are known; those flagged ``is_val`` decide when to stop.

    The learner gives the parameters.  A task holds its partition's rows as small integers.
    """
    spark, names = rows.sparkSession, list(labels)
    ensure_checkpoint_dir(spark)
    columns = [labels[name].cast("double").alias(f"label_{k}") for k, name in enumerate(names)]
    inputs = vector_to_array(learner.getFeaturesCol()).alias("inputs")
    known = rows.select(inputs, "is_val", *columns).dropna(subset=[f"label_{k}" for k in range(len(names))])
    counts = {r["is_val"]: r["count"] for r in known.groupBy("is_val").count().collect()}
    n, n_val = counts.get(False, 0), counts.get(True, 0)
    if not n or not n_val:
        raise ValueError(f"{n} rows to learn from and {n_val} to stop by for {', '.join(names)}")
    bins = _bins_of(known.filter("NOT is_val"), n, _categories(rows, learner.getFeaturesCol()), learner.getMaxBins(), learner.getSeed())
    share = learner.getFeatureSubsetStrategy()
    per_node = len(bins.sizes) if share == "all" else math.ceil(float(share) * len(bins.sizes))
    return _models(spark, _rounds(known, names, bins, learner, per_node), learner, len(bins.sizes))


# --- models as Spark stores them --------------------------------------------------------------------

_NODES = """treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,
leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"""


def _stored(tree: Mapping[int, _Node]) -> list[tuple]:
    """The nodes in Spark's order, from the root on, left before right."""
    out: list[tuple] = []

    def put(number: int) -> int:
        node, at = tree[number], len(out)
        out.append(())
        left, right = (-1, -1) if node.is_leaf else (put(2 * number), put(2 * number + 1))
        places = [float(v) for v in node.split[0]]
        out[at] = (at, node.value, node.impurity, list(node.stats), int(node.stats[0]), node.gain, left, right, (node.feature, places, node.split[1]))
        return at

    put(1)
    return out


_heads: dict[tuple, tuple[dict, dict]] = {}
_heads_lock = Lock()


def _head(spark: SparkSession, learner: GBTClassifier, n_features: int) -> tuple[dict, dict]:
    """What Spark writes beside the nodes of a model of this learner, and of a tree of it: from a small fit, once a session."""
    values = tuple(sorted((p.name, str(v)) for p, v in learner.extractParamMap().items()))
    key = (spark.sparkContext.applicationId, n_features, values)
    with _heads_lock:
        if key not in _heads:
            ends = [(Vectors.dense([v] * n_features), v, is_val) for v in (0.0, 1.0) for is_val in (False, True)]
            tiny = spark.createDataFrame(ends, [learner.getFeaturesCol(), learner.getLabelCol(), "is_val"]).coalesce(1)
            small = scratch_path(spark, "boosted-head")
            learner.copy({learner.maxIter: 1}).fit(tiny).save(small)
            head = json.loads(spark.read.text(f"{small}/metadata").first()[0])
            head["paramMap"]["maxIter"] = learner.getMaxIter()
            _heads[key] = head, json.loads(spark.read.parquet(f"{small}/treesMetadata").first()["_2"])
        return _heads[key]


def _models(spark: SparkSession, made: Mapping[str, list[dict[int, _Node]]], learner: GBTClassifier, n_features: int) -> dict[str, GBTClassificationModel]:
    """The trees as models of the learner: written as Spark does, and read."""
    head, tree_head = _head(spark, learner, n_features)

    def model(trees: list[dict[int, _Node]]) -> GBTClassificationModel:
        folder = scratch_path(spark, "boosted")
        own = head | {"numTrees": len(trees), "uid": f"GBTClassifier_{uuid.uuid4().hex[:12]}"}
        nodes = [(k, node) for k, tree in enumerate(trees) for node in _stored(tree)]
        heads = [(k, json.dumps(tree_head | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), learner.getStepSize() if k else 1.0) for k in range(len(trees))]
        spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
        spark.createDataFrame(nodes, _NODES).coalesce(1).write.parquet(f"{folder}/data")
        spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
        return GBTClassificationModel.load(folder)

    with ThreadPool(len(made)) as pool:
        return dict(zip(made, pool.map(inheritable_thread_target(spark)(model), made.values()), strict=True))
