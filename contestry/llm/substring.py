"""Passages that repeat within and across documents.

Two kinds of paragraphs are compared.  A line of ``PASSAGE`` words or more is a
paragraph, and shorter ones are joined to blocks and parts of blocks: their five-word
shingles get MinHash bands, tuned for recall, colliding paragraphs are joined, verified
by exact Jaccard similarity and clustered by components.
A passage set into other text shares no line, so pieces of ``PIECE`` words that start
at anchors (least five-word gram of ``SPACING``) are compared too: two texts with
``PASSAGE`` equal words share a whole piece, as one anchor in ``SPACING`` lies early
enough.  Equal pieces side by side form runs, which are extended word by word.  A run
follows the first occurrence of its pieces; each window of ``PASSAGE`` words that
holds one of them but reaches beyond what that place has is compared by itself.

The first occurrence of a cluster stays, by document id and place; later ones are
cut out of their texts.  A first pass marks the keys that occur twice in a bitmap of
fixed size, and only documents with such keys are looked at further.
"""

from __future__ import annotations

import ctypes
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestry.llm import text as tx
from contestry.llm.graph import MEASURED, linked
from contestry.session import materialise

PASSAGE = 50
SHINGLE = 5
PIECE = 25
SPACING = PASSAGE - PIECE + 1
SIMILARITY = 80
RECALL = 0.999
#: Spans with at most so many words between them are cut as one.
BRIDGE = 3
_BITMAP_BITS = 27
#: Each key sets three bits: the parts of it from these bits on.
_SHIFTS = (64 - _BITMAP_BITS, 18, 0)


def bands_for(similarity: float, rows: int, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` values that find pairs of ``similarity`` with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


ROWS = 2
BANDS = bands_for(SIMILARITY / 100, ROWS)

_PIECE_TYPE = pa.struct([("pos", pa.int32()), ("content", pa.int64()), ("times", pa.int32()), ("step", pa.int32())])
_WINDOW_TYPE = pa.struct([("pos", pa.int32()), ("next", pa.int32()), ("last", pa.int32()), ("times", pa.int32()), ("content", pa.int64())])
_LINE_TYPE = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("content", pa.int64()), ("keys", pa.list_(pa.int64()))])
_FOUND = "pieces: array<struct<pos: int, content: bigint, times: int, step: int>>, lines: array<struct<start: int, size: int, content: bigint, keys: array<bigint>>>"


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _hand_back() -> None:
    """Free memory of a worker goes back to the system, as workers stay for later stages; where libc can't, it is kept."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _sliding(choose: np.ufunc, values: np.ndarray, size: int) -> np.ndarray:
    """``choose`` over every ``size`` neighbours, by doubling."""
    span = 1
    while 2 * span <= size:
        values = choose(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return choose(values[: len(values) - rest], values[rest:]) if rest else values


def _anchors(words: tx.Words, hashes: np.ndarray) -> np.ndarray:
    """Starts of all pieces: positions whose gram is the least of ``SPACING`` in a row."""
    reach = SPACING + SHINGLE - 1
    if len(words.hashes) < max(reach, PIECE):
        return np.empty(0, np.int64)
    least = _sliding(np.minimum, hashes, SPACING)
    whole = words.text[: len(least)] == words.text[reach - 1 : reach - 1 + len(least)]
    margin = np.zeros(SPACING - 1, np.uint64)
    chosen = _sliding(np.maximum, np.concatenate([margin, np.where(whole, least, 0).astype(np.uint64), margin]), SPACING)
    places = np.flatnonzero(chosen == hashes)
    return places[places + PIECE <= words.bounds[words.text[places] + 1]]


def _lines(chunk: tx.Chunk, words: tx.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last word of each paragraph, in order; paragraphs may overlap.

    A line of ``PASSAGE`` words or more is one.  Shorter lines without a blank line
    between make a block, and blocks that are too short are joined to the next such
    ones; each of ``PASSAGE`` words or more is one.  So are its parts between every
    other cut, cuts being words whose gram is the least of ``PIECE`` on both sides:
    they lie at the same words whatever the width of lines and the text around.
    """
    breaks = np.cumsum(chunk.data == 10)
    line = breaks[words.starts] if len(words.starts) else np.empty(0, np.int64)
    fresh = np.ones(len(line), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (words.text[1:] != words.text[:-1])
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return starts, starts
    ends = np.append(starts[1:], len(line))
    long = ends - starts >= PASSAGE
    other = np.ones(len(starts), bool)
    other[1:] = (words.text[starts[1:]] != words.text[starts[:-1]]) | long[1:] | long[:-1]
    blank = other.copy()
    blank[1:] |= line[starts[1:]] - line[starts[:-1]] > 1
    for _ in range(2):  # lines to blocks, then short blocks to longer ones
        first = np.flatnonzero(blank)
        starts, ends = starts[first], np.append(starts[first[1:]], ends[-1])
        short = ends - starts < PASSAGE
        other = other[first]
        blank = other.copy()
        blank[1:] |= ~short[1:] | ~short[:-1]
    single = np.isin(starts, np.flatnonzero(fresh)[long])
    enough = ends - starts >= PASSAGE
    least = _sliding(np.minimum, hashes, 2 * PIECE + 1) if len(hashes) > 2 * PIECE else np.empty(0, np.uint64)
    cuts = np.flatnonzero(least == hashes[PIECE : PIECE + len(least)]) + PIECE
    found = [np.stack([starts[enough], ends[enough]], axis=1)]
    for start, end in zip(starts[enough & ~single], ends[enough & ~single], strict=True):
        own = cuts[np.searchsorted(cuts, start + PIECE) : np.searchsorted(cuts, end - PIECE, "right")]
        own = np.concatenate([[start], own, [end]])
        if len(own) > 3:
            found.append(np.stack([own[:-2], own[2:]], axis=1))
    found = np.concatenate(found)
    found = found[found[:, 1] - found[:, 0] >= PASSAGE]
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return found[:, 0], found[:, 1]


def _band_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the bands of each word range."""
    if not len(starts):
        return np.empty((0, BANDS), np.uint64)
    factors = tx.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    edges = np.stack([starts, ends - SHINGLE + 1], axis=1).ravel()
    last = np.full(1, np.iinfo(np.uint64).max)  # so that every edge is a place
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        for factor in factors[band * ROWS : (band + 1) * ROWS]:
            keys[:, band] = tx.mix(keys[:, band] + np.minimum.reduceat(np.concatenate([hashes * factor, last]), edges)[::2] + np.uint64(band))
    return keys


_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def _range_hash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for all words of each range, order included.

    A range's part of a sum of words times powers, moved back to the range's first word.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    powers, back = (np.multiply.accumulate(np.full(len(hashes), base, np.uint64)) for base in (_BASE, _BACK))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(hashes) * powers, dtype=np.uint64)])
    return tx.mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _piece_hashes(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One hash for the ``PIECE`` words from each place on."""
    found = np.zeros(len(places), np.uint64)
    for k in range(PIECE):
        found = tx.mix(found + hashes[places + k])
    return found


class _Marks:
    """Pieces and paragraphs of a chunk, with positions counted from each text's first word."""

    def __init__(self, chunk: tx.Chunk) -> None:
        self.words = words = tx.find_words(chunk._replace(data=tx.lower(chunk.data)), tx.SPACED)
        hashes = tx.grams(words.hashes, SHINGLE)
        self.places = _anchors(words, hashes)
        self.pieces = _piece_hashes(words.hashes, self.places)
        self.starts, self.ends = _lines(chunk, words, hashes)
        self.keys = _band_keys(hashes, self.starts, self.ends)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in tx.chunks(batch.column(0)):
            marks = _Marks(chunk)
            keys, counts = np.unique(np.concatenate([marks.pieces, marks.keys.ravel()]), return_counts=True)
            # a key that a chunk has more than once is known to repeat
            yield pa.RecordBatch.from_arrays([pa.array(tx.longs(np.repeat(keys, np.minimum(counts, 2))))], names=["key"])
        _hand_back()


def _repeated(docs: DataFrame) -> np.ndarray:
    """A bitmap of the keys that occur twice; its size does not depend on the data."""
    keys = docs.select("text").mapInArrow(_key_batches, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = [F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << _BITMAP_BITS) - 1)) for shift in _SHIFTS]
    slots = keys.select(F.explode(F.array(*parts)).alias("slot"))
    words = slots.selectExpr("slot >> 5 AS word", "shiftleft(1L, CAST(slot & 31 AS INT)) AS bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (_BITMAP_BITS - 5), np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def _listed(owner: np.ndarray, count: int, rows: pa.StructArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32()), rows)


def _series(text: np.ndarray, places: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pieces to keep, how many each stands for, and the words between these.

    Text that repeats itself word by word, or line by line, has the same piece again and
    again at even steps.  Such a series keeps its first two pieces and its last one, and
    one for all between, which no other piece makes a run with.
    """
    steps = np.diff(places)
    alike = (text[1:] == text[:-1]) & (contents[1:] == contents[:-1])
    even = alike[1:] & alike[:-1] & (steps[1:] == steps[:-1])
    inner = np.zeros(len(places), bool)
    inner[2:-1] = even[1:] & even[:-1]
    kept = np.ones(len(places), bool)
    kept[1:] = ~(inner[1:] & inner[:-1] & alike)
    first = np.flatnonzero(kept)
    times = np.diff(np.append(first, len(places)))
    return first, times, np.append(steps, 0)[first] * (times > 1)


def _mark_chunk(chunk: tx.Chunk, bits: np.ndarray) -> pa.StructArray:
    marks = _Marks(chunk)
    words = marks.words

    def repeated(keys: np.ndarray) -> np.ndarray:
        found = np.ones(keys.shape, bool)
        for shift in _SHIFTS:
            slots = (keys >> np.uint64(shift)) & np.uint64((1 << _BITMAP_BITS) - 1)
            found &= (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    own = repeated(marks.pieces)
    places, pieces = marks.places[own], marks.pieces[own]
    first, times, steps = _series(words.text[places], places, pieces)
    places, pieces = places[first], pieces[first]
    sides = [pa.array(x, pa.int32()) for x in (places - words.bounds[words.text[places]], times, steps)]
    pieces = pa.StructArray.from_arrays([sides[0], pa.array(tx.longs(pieces)), *sides[1:]], fields=list(_PIECE_TYPE))
    own = repeated(marks.keys).any(axis=1)
    starts, ends, keys = marks.starts[own], marks.ends[own], marks.keys[own]
    lines = pa.StructArray.from_arrays(
        [
            pa.array(starts - words.bounds[words.text[starts]], pa.int32()),
            pa.array(ends - starts, pa.int32()),
            pa.array(tx.longs(_range_hash(words.hashes, starts, ends))),
            tx.lists(tx.longs(keys.ravel()), np.arange(len(keys) + 1) * BANDS, pa.int64()),
        ],
        fields=list(_LINE_TYPE),
    )
    return pa.StructArray.from_arrays(
        [_listed(words.text[places], chunk.count, pieces), _listed(words.text[starts], chunk.count, lines)], names=["pieces", "lines"]
    )


def _marker(bitmap: Any) -> Any:
    """A column function: the text's repeated pieces and lines."""

    @F.arrow_udf(f"struct<{_FOUND}>")
    def mark(texts: pa.Array) -> pa.Array:
        found = [_mark_chunk(chunk, bitmap.value) for chunk in tx.chunks(texts)]
        _hand_back()
        return pa.concat_arrays(found) if found else pa.array([], pa.struct([("pieces", pa.list_(_PIECE_TYPE)), ("lines", pa.list_(_LINE_TYPE))]))

    return mark.asNondeterministic()  # so that the planner computes it once


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    found: list[np.ndarray] = []
    for chunk in tx.chunks(texts):
        values, bounds = tx.shingle_sets(tx.find_words(chunk._replace(data=tx.lower(chunk.data)), tx.SPACED), SHINGLE)
        found += [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return found


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the shingle sets of two paragraphs share; rows of one ``a`` come together, and its set is made once."""
    for batch in batches:
        a = batch.column(0).to_numpy()
        changes = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        heads, others = _sets(batch.column(2).take(pa.array(changes))), _sets(batch.column(3))
        owner = np.searchsorted(changes, np.arange(len(a)), "right") - 1
        shared, fresh, lost = np.zeros(len(a), np.int64), [], []
        for k, y in enumerate(others):
            x = heads[owner[k]]
            places = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = x[places] == y
            alone = np.ones(len(x), bool)
            alone[places[both]] = False
            shared[k] = np.count_nonzero(both)
            fresh.append(y[~both])
            lost.append(x[alone])
        sizes = np.array([len(heads[h]) for h in owner], np.int64), np.array([len(y) for y in others], np.int64)
        columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (shared, *sizes))]
        for sets in (fresh, lost):
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])
            columns.append(tx.lists(tx.longs(np.concatenate([np.empty(0, np.uint64), *sets])), bounds, pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "shared", "na", "nb", "fresh", "lost"])
        del heads, others, fresh, lost, columns
        _hand_back()


def _line_posts(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paragraphs by row, their classes of equal words, and the classes' keys that others share."""
    lines = found.select("row", "doc_id", F.explode("found.lines").alias("l")).select("row", "doc_id", "l.*")
    first = F.min(F.struct("doc_id", "row", "start", "size")).alias("first")
    classes = lines.groupBy("content").agg(first, F.first("keys").alias("keys"))
    classes = materialise(classes, "passage_lines")
    posts = classes.select(F.col("content").alias("node"), F.explode("keys").alias("key"))
    shared = posts.join(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    return lines, classes, materialise(shared.select("node", "key").join(weights, "node"), "passage_posts")


_ANSWERS = "array<struct<content: bigint, start: int, end: int, text: string, before: array<bigint>, after: array<bigint>>>"


def _answer(texts: pa.Array, places: pa.Array) -> pa.Array:
    """For each place its words if it has a content, else the word hashes before (nearest first) and after it."""
    flat, bounds = places.flatten(), _ends(places)
    content, starts, ends = (flat.field(k) for k in ("content", "start", "end"))
    inside, low, high = pc.is_valid(content).to_numpy(zero_copy_only=False), starts.to_numpy(), ends.to_numpy()
    slices, before, after = [], [], []
    for chunk in tx.chunks(texts):
        words = tx.find_words(chunk._replace(data=tx.lower(chunk.data)), tx.SPACED)
        for text in range(chunk.count):
            first, last = words.bounds[text], words.bounds[text + 1]
            hashes = tx.longs(words.hashes[first:last])
            for k in range(bounds[chunk.first + text], bounds[chunk.first + text + 1]):
                start, end = int(low[k]), int(high[k])
                own = inside[k]
                slices.append(chunk.data[words.starts[first + start] : words.ends[first + end - 1]].tobytes().decode("utf-8") if own else None)
                # copies, so that no chunk's hashes stay
                before.append(None if own else hashes[max(0, start - PIECE) : start][::-1].copy())
                after.append(None if own else hashes[end : end + PIECE].copy())
    sides = [pa.array(x, pa.list_(pa.int64())) for x in (before, after)]
    _hand_back()
    answers = pa.StructArray.from_arrays([content, starts, ends, pa.array(slices, pa.string()), *sides], names=["content", "start", "end", "text", "before", "after"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), answers)


def _asked(texts: DataFrame, classes: DataFrame, posts: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words of each posted class once, and the words around each place that runs came from once.

    The texts move once for both, and each only once however many ask for parts of it.
    """
    own = F.struct("content", F.col("first.start").alias("start"), (F.col("first.start") + F.col("first.size")).alias("end")).alias("place")
    posted = posts.select(F.col("node").alias("content")).distinct().join(classes, "content").select("first.row", own)
    nothing = F.lit(None).cast("long").alias("content")
    beside = F.struct(nothing, F.col("from_start").alias("start"), F.col("from_end").alias("end")).alias("place")
    around = runs.select("from_row", "from_start", "from_end").distinct().select(F.col("from_row").alias("row"), beside)
    places = posted.unionByName(around).groupBy("row").agg(F.collect_list("place").alias("places"))
    answers = texts.join(places, "row").select("row", F.arrow_udf(_answer, _ANSWERS)("text", "places").alias("x"))
    answers = materialise(answers.select("row", F.explode("x").alias("x")).select("row", "x.*"), "passage_answers")
    words = answers.where("content IS NOT NULL").select("content", "text")
    sides = answers.where("content IS NULL").select(F.col("row").alias("from_row"), F.col("start").alias("from_start"), F.col("end").alias("from_end"), "before", "after")
    return words, sides


def _line_spans(lines: DataFrame, classes: DataFrame, posts: DataFrame, words: DataFrame) -> DataFrame:
    """(row, start, end, source) of lines whose cluster has an earlier one."""

    def measure(pairs: DataFrame) -> DataFrame:
        # whatever their sizes: a list's nodes are compared by what each shares with its head.
        # The head comes last, so that its words are not moved once a pair
        other, head = (words.select(F.col("content").alias(c), F.col("text").alias(f"t{c}")) for c in ("b", "a"))
        both = pairs.join(other, "b").join(head, "a")
        return both.select("a", "b", "ta", "tb").mapInArrow(_measure_batches, MEASURED)

    groups = linked(posts, measure, SIMILARITY, "passage")
    grouped = classes.select("content", "first").join(groups.withColumnRenamed("node", "content"), "content", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "content"))
    firsts = grouped.groupBy("component").agg(F.min("first").alias("first"))
    placed = grouped.select("content", "component").join(firsts, "component").select("content", "first")
    # paragraphs of one text may overlap; the first one does not make others go that share its words
    apart = "row <> first.row or start >= first.start + first.size or start + size <= first.start"
    later = lines.join(placed, "content").where(apart)
    return later.select("row", "start", (F.col("start") + F.col("size")).alias("end"), F.col("first.doc_id").alias("source"))


def _piece_runs(found: DataFrame) -> DataFrame:
    """Runs of overlapping pieces that all occurred earlier, in one place and order."""
    pieces = found.select("row", "doc_id", F.explode("found.pieces").alias("p")).select("row", "doc_id", "p.*")
    firsts = pieces.groupBy("content").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.sum("times").alias("n")).where("n > 1")
    later = pieces.drop("doc_id").join(firsts.drop("n"), "content").where("row <> first.row or pos <> first.pos")
    later = later.select("row", "pos", "times", "step", F.col("first.row").alias("from_row"), F.col("first.pos").alias("from_pos"), F.col("first.doc_id").alias("source"))
    places = Window.partitionBy("row").orderBy("pos")
    shift = F.col("pos") - F.col("from_pos")
    same = (F.lag("from_row").over(places) == F.col("from_row")) & (F.lag(shift).over(places) == shift) & (F.col("pos") - F.lag("pos").over(places) <= PIECE)
    marked = later.withColumn("fresh", F.when(same, 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("fresh").over(places))
    # a piece that stands for a series is a run by itself, and so is each one that it stands for
    return numbered.groupBy("row", "run", "from_row", "source").agg(
        F.min("pos").alias("start"), (F.max("pos") + PIECE).alias("end"), F.min("from_pos").alias("from_start"), (F.max("from_pos") + PIECE).alias("from_end"),
        F.max("times").alias("times"), F.max("step").alias("step"),
    )


#: Runs of a series that are extended at once.
_AT_ONCE = 1 << 14


def _equal(ours: np.ndarray, theirs: np.ndarray) -> int:
    """How many words agree from the first on."""
    n = min(len(ours), len(theirs))
    same = ours[:n] == theirs[:n]
    return n if same.all() else int(np.argmin(same))


def _agreeing(hashes: np.ndarray, places: np.ndarray, step: int, words: np.ndarray) -> np.ndarray:
    """How many words agree with ``words`` from each place on, forwards or backwards."""
    there = places[:, None] + step * np.arange(len(words))
    inside = (there >= 0) & (there < len(hashes))
    same = inside & (hashes[np.where(inside, there, 0)] == words)
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _merged(ranges: list[tuple[int, int]], bridge: int) -> list[tuple[int, int]]:
    """The ranges in order, those at most ``bridge`` words apart joined."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1] + bridge:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


class _Spans:
    """The runs of a batch as arrays: each with its range and the words around its first occurrence."""

    def __init__(self, spans: pa.ListArray) -> None:
        flat = spans.flatten()
        self.bounds = _ends(spans)
        self.start, self.end, self.times, self.step = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end", "times", "step"))
        self.source = flat.field("source")
        self.sides = {}
        for side in ("before", "after"):
            lists = flat.field(side)
            self.sides[side] = (lists.flatten().to_numpy(zero_copy_only=False), _ends(lists))

    def around(self, side: str, k: int) -> np.ndarray:
        values, bounds = self.sides[side]
        return values[bounds[k] : bounds[k + 1]]

    def ranges(self, text: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text's ranges (start, end, run), extended as far as words agree with the first occurrence.

        And the starts of all windows that hold a piece of a run and leave its range.
        Ranges of a series that meet are one, as they have one source.
        """
        found, opened, closed = [], [], []
        for k in range(self.bounds[text], self.bounds[text + 1]):
            before, after = self.around("before", k), self.around("after", k)
            begin, size = int(self.start[k]), int(self.end[k]) - int(self.start[k])
            if self.times[k] == 1:
                low = begin - _equal(hashes[max(0, begin - PIECE) : begin][::-1], before)
                high = begin + size + _equal(hashes[begin + size : begin + size + PIECE], after)
                if high - low >= PASSAGE:
                    found.append((low, high, k))
                opened += (begin + PIECE - PASSAGE, max(high + 1, begin + size) - PASSAGE)
                closed += (low, begin + size - PIECE + 1)
                continue
            for first in range(0, int(self.times[k]), _AT_ONCE):
                start = begin + int(self.step[k]) * np.arange(first, min(first + _AT_ONCE, int(self.times[k])))
                end = start + size
                low = start - _agreeing(hashes, start - 1, -1, before)
                high = end + _agreeing(hashes, end, 1, after)
                whole = high - low >= PASSAGE
                found += [(a, b, k) for a, b in _merged(list(zip(low[whole].tolist(), high[whole].tolist(), strict=True)), 0)]
                opened += [*(start + PIECE - PASSAGE).tolist(), *(np.maximum(high + 1, end) - PASSAGE).tolist()]
                closed += [*low.tolist(), *(end - PIECE + 1).tolist()]
        room = max(0, len(hashes) - PASSAGE + 1)
        low, high = (np.clip(np.array(x, np.int64), 0, room) for x in (opened, closed))
        some = low < high
        open_ranges = np.bincount(low[some], minlength=room + 1) - np.bincount(high[some], minlength=room + 1)
        return np.array(found, np.int64).reshape(-1, 3), np.flatnonzero(np.cumsum(open_ranges)[:room])


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Bounds of the lists in their flattened values; null lists are empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])


def _without(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges; words are given by their bytes."""
    pieces, place = [], 0
    for start, end in ranges:
        pieces.append(data[place : starts[start]])
        place = starts[end] if end < len(starts) else ends[-1]
    return np.concatenate([*pieces, data[place:]]).tobytes().decode("utf-8")


_RANGES = "array<struct<start: int, end: int, source: bigint>>"
_EXTENDED = f"struct<ranges: {_RANGES}, windows: array<struct<pos: int, next: int, last: int, times: int, content: bigint>>>"
_CUT = "struct<text: string, removed: array<struct<start: int, end: int>>, sources: array<bigint>>"


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The arrays end to end, and where each begins."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
    return np.concatenate(parts) if parts else np.empty(0, np.int64), bounds


def _windows(text: np.ndarray, places: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Equal windows of a text that overlap or touch as one: owner, and first, second, last place, number and content."""
    order = np.lexsort((places, contents, text))
    text, places, contents = text[order], places[order], contents[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (contents[1:] != contents[:-1]) | (places[1:] - places[:-1] > PASSAGE)
    first = np.flatnonzero(fresh)
    times = np.diff(np.append(first, len(text)))
    columns = [places[first], places[first + (times > 1)], places[first + times - 1], times]
    return text[first], [*(pa.array(x, pa.int32()) for x in columns), pa.array(contents[first], pa.int64())]


def _extend_runs(texts: pa.Array, runs: pa.Array) -> pa.Array:
    known, ranges, owners, places, contents = _Spans(runs), [], [], [], []
    for chunk in tx.chunks(texts):
        words = tx.find_words(chunk._replace(data=tx.lower(chunk.data)), tx.SPACED)
        hashes, held = tx.longs(words.hashes), []
        for text in range(chunk.count):
            own, starts = known.ranges(chunk.first + text, hashes[words.bounds[text] : words.bounds[text + 1]])
            ranges.append(own)
            held.append(starts)
        places += held
        owners.append(np.repeat(np.arange(chunk.count), [len(x) for x in held]))
        starts = _joined(held)[0] + words.bounds[owners[-1]]
        owners[-1] += chunk.first
        contents.append(tx.longs(_range_hash(words.hashes, starts, starts + PASSAGE)))
    ranges, bounds = _joined(ranges)
    low, high, run = ranges.reshape(-1, 3).T
    sides = [pa.array(low, pa.int32()), pa.array(high, pa.int32()), known.source.take(pa.array(run))]
    ranges = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(sides, names=["start", "end", "source"]))
    owner, columns = _windows(*(_joined(x)[0] for x in (owners, places, contents)))
    _hand_back()
    windows = _listed(owner, len(texts), pa.StructArray.from_arrays(columns, fields=list(_WINDOW_TYPE)))
    return pa.StructArray.from_arrays([ranges, windows], names=["ranges", "windows"])


def _passage_spans(runs: DataFrame, sides: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, start, end, source, extra) of passages that occurred earlier inside other text; extra for single windows."""
    runs = runs.join(sides, ["from_row", "from_start", "from_end"])
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("start", "end", "times", "step", "source", "before", "after")).alias("runs"))
    extended = texts.join(runs, "row").select("row", "doc_id", F.arrow_udf(_extend_runs, _EXTENDED)("text", "runs").alias("x"))
    extended = materialise(extended.select("row", "doc_id", "x.*"), "passage_windows")
    windows = extended.select("row", "doc_id", F.explode("windows").alias("w")).select("row", "doc_id", "w.*")
    firsts = windows.groupBy("content").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.sum("times").alias("n")).where("n > 1")
    # where the first window of all overlaps equal ones, these go from the second on
    later = windows.drop("doc_id").join(firsts.drop("n"), "content").where("row <> first.row or pos <> first.pos or times > 1")
    start = F.when((F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos")), F.col("next")).otherwise(F.col("pos"))
    later = later.select("row", start.alias("start"), (F.col("last") + PASSAGE).alias("end"), F.col("first.doc_id").alias("source"), F.lit(True).alias("extra"))
    return extended.select("row", F.explode("ranges").alias("r")).select("row", "r.*", F.lit(False).alias("extra")).unionByName(later)


def _beyond(spans: list[tuple], extras: list[tuple]) -> list[tuple]:
    """The parts of ``extras`` (start, end, source) outside ``spans``, but for ends of at most ``BRIDGE`` words.

    So few words beside a passage may agree with those beside a copy in another source by chance.
    """
    found: list[tuple] = []
    covered = _merged([(a, b) for a, b, _ in spans], 0)
    starts, ends = [a for a, _ in covered], [b for _, b in covered]
    known, more = _Ranges(spans), _Ranges(extras)
    for start, end in _merged([(a, b) for a, b, _ in extras], 0):
        place, parts = start, []
        for a, b in covered[bisect_right(ends, start) : bisect_left(starts, end)]:
            parts.append((place, a))
            place = b
        for a, b in [*parts, (place, end)]:
            if a < b:
                beside = None if b - a > BRIDGE else {source for _, _, source in known.touching(a, b)}
                found += [(max(a, x), min(b, y), source) for x, y, source in more.touching(a, b) if x < b and y > a and (beside is None or source in beside)]
    return found


class _Ranges:
    """Ranges (start, end, source) in order of start, to be asked by place."""

    def __init__(self, ranges: list[tuple]) -> None:
        self.ranges = sorted(ranges, key=itemgetter(0, 1))
        self.starts = [r[0] for r in self.ranges]
        self.reach = list(accumulate((r[1] for r in self.ranges), max))

    def touching(self, start: int, end: int) -> list[tuple]:
        """Those with a place in common with start to end, both ends counted."""
        some = self.ranges[bisect_left(self.reach, start) : bisect_right(self.starts, end)]
        return [r for r in some if r[1] >= start]


def _cut_texts(texts: pa.Array, spans: pa.Array) -> pa.Array:
    flat, bounds = spans.flatten(), _ends(spans)
    left, removed, sources = [None] * len(texts), [[]] * len(texts), [[]] * len(texts)
    fields = [flat.field(k) for k in ("start", "end", "source", "extra")]
    some = np.flatnonzero(np.diff(bounds))
    for chunk in tx.chunks(texts.take(pa.array(some))):
        data, offsets = chunk.data, chunk.offsets
        words = tx.find_words(chunk._replace(data=tx.lower(data)), tx.SPACED)
        for text in range(chunk.count):
            place = some[chunk.first + text]
            own = slice(words.bounds[text], words.bounds[text + 1])
            span, size = bounds[place], bounds[place + 1] - bounds[place]
            own_spans = list(zip(*(f.slice(span, size).to_pylist() for f in fields), strict=True))
            used = [(a, b, source) for a, b, source, extra in own_spans if not extra]
            used += _beyond(used, [(a, b, source) for a, b, source, extra in own_spans if extra])
            ranges = _merged([(a, b) for a, b, _ in used], BRIDGE)
            first, last = offsets[text], offsets[text + 1]
            left[place] = _without(data[first:last], words.starts[own] - first, words.ends[own] - first, ranges) if ranges else None
            removed[place] = [{"start": a, "end": b} for a, b in ranges]
            sources[place] = sorted({source for _, _, source in used if source is not None})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    _hand_back()
    return pa.StructArray.from_arrays(
        [pa.array(left, pa.string()), pa.array(removed, kind), pa.array(sources, pa.list_(pa.int64()))], names=["text", "removed", "sources"]
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out, and columns removed and sources.

    removed lists the word ranges that went (start and end, counted over the words of
    the original text), sources the ids of the documents that keep them.  Words are
    lower-cased (A-Z) runs of anything but white space.  Passages of ``PASSAGE``
    words or more that occurred before, in a smaller id or earlier in the text, go;
    shorter ones stay.  Null and empty texts stay as they are.  Rows that repeat an
    id are told apart by an order fixed within the run; a null id sorts first.  An
    empty table stays empty.  Columns removed and sources of ``docs`` are replaced.
    """
    docs = docs.drop("removed", "sources")
    columns = docs.columns
    held = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("own")
    texts = docs.select(held, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_repeated(texts))
    mark = _marker(bitmap)
    marked = texts.withColumn("found", mark(F.coalesce("text", F.lit("")))).drop("text")
    some = (F.size("found.pieces") > 0) | (F.size("found.lines") > 0)
    found = materialise(marked.where(some).withColumn("row", F.monotonically_increasing_id()), "passage_found")
    found_texts = found.select("row", "doc_id", F.col(f"own.`{text_col}`").cast("string").alias("text"))

    lines, classes, posts = _line_posts(found)
    runs = materialise(_piece_runs(found), "passage_runs")
    words, sides = _asked(found_texts.select("row", "text"), classes, posts, runs)
    whole = _line_spans(lines, classes, posts, words).withColumn("extra", F.lit(False))
    spans = _passage_spans(runs, sides, found_texts).unionByName(whole)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end", "source", "extra")).alias("spans"))
    touched = found.select("row", "own").join(spans, "row", "left")
    touched = touched.withColumn("cut", F.arrow_udf(_cut_texts, _CUT)(F.col(f"own.`{text_col}`").cast("string"), "spans"))
    changed = F.size("cut.removed") > 0
    none = "array<struct<start: int, end: int>>"
    touched = touched.select(
        *(F.when(changed, F.col("cut.text")).otherwise(F.col(f"own.`{c}`")).alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in columns),
        F.col("cut.removed").alias("removed"),
        F.when(changed, F.col("cut.sources")).otherwise(F.array().cast("array<long>")).alias("sources"),
    )
    untouched = marked.where(~some).select("own.*", F.array().cast(none).alias("removed"), F.array().cast("array<long>").alias("sources"))
    return untouched.unionByName(touched)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: words cut, the documents that keep them, and the text left."""
    cut = remove_repeats(docs.select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return cut.select("doc_id", n_removed.alias("n_removed"), F.size("removed").alias("n_passages"), "sources", "text")
