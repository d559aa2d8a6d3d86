"""Alignment of two tokenizers' tokens of the same texts, by diagonal run skipping.

Each side's tokens have ascending end offsets in bytes.  While both sides end alike
the walk stays on a diagonal, the shift between the two indices: slices of both end
arrays that double in length are compared at that shift, up to the first difference.
Only there tokens are stepped over one by one, until both sides end together again at
a new shift.

A place where both sides end is a group's end, and links the two tokens that end
there.  As their byte ranges end together, one's bytes are a suffix of the other's.
So there are at most as many different pairs as the two vocabularies have bytes
(about half a million for the default files), whatever the corpus: the table of
their counts can be broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestry.llm import encoders, text
from contestry.session import materialise

#: Ends compared first on a diagonal.
_PROBE = 16


def default_paths() -> tuple[str, str]:
    return encoders.default_path("byte_bpe_50k.json"), encoders.default_path("piece_bpe_32k.model")


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of both sides up to each common end of two ascending arrays of ends.

    The arrays must end alike.
    """
    size = len(a)
    list_a, list_b = a.tolist(), b.tolist()
    # groups on one diagonal: the first's ends on both sides, and how many there are
    first_a, first_b, lengths = [1], [1], []
    i = j = ahead = 0  # ``ahead``: a group that the last irregular stretch has closed
    while True:
        run, width = 0, _PROBE
        while i + run < size:
            x, y = a[i + run : i + run + width], b[j + run : j + run + width]
            shared = min(len(x), len(y))
            differs = x[:shared] != y[:shared]
            place = int(differs.argmax()) if shared else 0
            if shared and differs[place]:
                run += place
                break
            run += shared
            if shared < width:
                break
            width *= 2
        lengths.append(ahead + run)
        i, j = i + run, j + run
        if i >= size:
            break
        end_a, end_b = list_a[i], list_b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = list_a[i]
            else:
                j += 1
                end_b = list_b[j]
        i, j, ahead = i + 1, j + 1, 1
        first_a.append(i)
        first_b.append(j)
    counts = np.array(lengths)
    steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first_a, counts) + steps, np.repeat(first_b, counts) + steps


class _Side:
    """A vocabulary's tokens: their bytes, lengths, and decimal names with what follows them."""

    def __init__(self, tokens: list[bytes], end: str) -> None:
        self.bytes = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.names = [f"{i}{mark}" for i in range(len(tokens)) for mark in (",", end)]


class _Sides:
    """Both vocabularies, and the chunks a worker has met."""

    def __init__(self, path_a: str, path_b: str) -> None:
        a, b = encoders.byte_level(path_a, True), encoders.pieces(path_b)
        self.known = encoders.Remembered(a, b)
        self.a, self.b = _Side(a.token_bytes(), "|"), _Side(b.token_bytes(), ";")
        self.names = pa.array([*self.a.names, *self.b.names], pa.large_string())
        self.width = b.size


@lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str) -> _Sides:
    return _Sides(path_a, path_b)


class _Aligned(NamedTuple):
    """Some texts: flat ids of both sides, flat group ends in these, and each text's bounds in all of them."""

    first: int
    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    bounds_a: np.ndarray
    bounds_b: np.ndarray
    bounds: np.ndarray


def _joined(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all values, and where each begins and, last, ends."""
    _, offsets, data = values.buffers()
    return memoryview(data or b"").cast("B"), np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]


def _aligned(column: pa.Array, sides: _Sides) -> Iterator[_Aligned]:
    """The texts of a column in chunks; texts whose tokens don't join to them have none."""
    for chunk in text.chunks(column):
        texts = [t or "" for t in column.slice(chunk.first, chunk.count).to_pylist()]
        encoded = sides.known.encode([f" {t}" for t in texts])
        whole = [f" {t}".encode() for t in texts]
        good = np.array([len(w) > 1 for w in whole])
        for side, (ids, bounds) in zip((sides.a, sides.b), encoded, strict=True):
            data, offsets = _joined(side.bytes.take(pa.array(ids)))
            places = offsets[bounds].tolist()
            good &= [data[x:y] == w for w, x, y in zip(whole, places, places[1:], strict=False)]
        kept = []
        for ids, bounds in encoded:
            counts = np.diff(bounds)
            kept.append((ids[np.repeat(good, counts)], np.concatenate([[0], np.cumsum(counts * good)])))
        (ids_a, bounds_a), (ids_b, bounds_b) = kept
        # texts that follow one another end alike on both sides, so one walk aligns them all
        ends_a, ends_b = align(np.cumsum(sides.a.sizes[ids_a]), np.cumsum(sides.b.sizes[ids_b]))
        yield _Aligned(chunk.first, ids_a, ids_b, ends_a, ends_b, bounds_a, bounds_b, np.searchsorted(ends_a, bounds_a, "right"))


def _group_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    sides = _sides(*paths)
    for batch in batches:
        for f in _aligned(batch.column(1), sides):
            sizes = np.diff(f.bounds)
            own_a, own_b = (ends - np.repeat(bounds[:-1], sizes) for ends, bounds in ((f.ends_a, f.bounds_a), (f.ends_b, f.bounds_b)))
            flat = ((f.ids_a, f.bounds_a), (f.ids_b, f.bounds_b), (own_a.astype(np.int32), f.bounds), (own_b.astype(np.int32), f.bounds))
            lists = [text.lists(values, bounds, pa.int32()) for values, bounds in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(f.first, len(sizes)), *lists], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])


def _digests(f: _Aligned, sides: _Sides) -> list[str]:
    """Hex digest of each text's groups, as a1,a2|b1;a3|b2,b3; no tokens: the empty string."""
    codes_a, codes_b = 2 * f.ids_a.astype(np.int64), 2 * f.ids_b.astype(np.int64) + len(sides.a.names)
    codes_a[f.ends_a - 1] += 1
    codes_b[f.ends_b - 1] += 1
    sizes_a, sizes_b = np.diff(f.ends_a, prepend=0), np.diff(f.ends_b, prepend=0)
    merged = np.empty(len(codes_a) + len(codes_b), np.int64)
    merged[np.arange(len(codes_a)) + np.repeat(f.ends_b - sizes_b, sizes_a)] = codes_a
    merged[np.arange(len(codes_b)) + np.repeat(f.ends_a, sizes_b)] = codes_b
    data, offsets = _joined(sides.names.take(pa.array(merged)))
    places = offsets[f.bounds_a + f.bounds_b].tolist()
    return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(places, places[1:], strict=False)]


_SUMMARY = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                      ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _pair_counts(f: _Aligned, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct linked pairs, how often it has them, and the bounds of its own."""
    linked = f.ids_a[f.ends_a - 1].astype(np.int64) * width + f.ids_b[f.ends_b - 1]
    owner = np.repeat(np.arange(len(f.bounds) - 1), np.diff(f.bounds))
    order = np.lexsort((linked, owner))
    linked, owner = linked[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], (linked[1:] != linked[:-1]) | (owner[1:] != owner[:-1])])[: len(linked)])
    return linked[fresh], np.diff(fresh, append=len(linked)), np.searchsorted(owner[fresh], np.arange(len(f.bounds)))


def _summary_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    sides = _sides(*paths)
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for f in _aligned(batch.column(1), sides):
            count = len(f.bounds) - 1
            pairs, times, bounds = _pair_counts(f, sides.width)
            columns = [pa.array(np.arange(row, row + count)), batch.column(0).slice(f.first, count)]
            columns += [pa.array(np.diff(own)) for own in (f.bounds_a, f.bounds_b, f.bounds)]
            columns += [pa.array(_digests(f, sides)), text.lists(pairs, bounds, pa.int64()), text.lists(times.astype(np.int32), bounds, pa.int32())]
            row += count
            yield pa.RecordBatch.from_arrays(columns, schema=_SUMMARY)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def groups(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): both encodings of each text and the groups' ends in them.

    Group ``k`` holds the tokens from ``ends[k - 1]`` (0 for the first) to ``ends[k]``
    of each side.  A encodes a space and the text, B, which puts a space there itself,
    the text; names of special tokens are text.  A null or empty text, or one whose
    tokens' bytes don't join to it on both sides (B may normalise), has empty lists.
    Rows are independent: repeated and null ids stay, an empty table gives an empty
    one.  Memory follows the chunk (1 MB) or the longest text.
    """
    return _own(docs, id_col, text_col).mapInArrow(
        partial(_group_batches, paths=paths or default_paths()),
        "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>",
    )


def summaries(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of each text's groups, and how common its links are in the corpus.

    Texts are encoded once.  What is stored of one is its counts and its distinct
    linked pairs with their multiplicities; the pairs' corpus counts are summed from
    these and joined back as a broadcast table (bounded, see above).  ``n_best``
    counts links whose pair is as common as any with the same token of B,
    ``count_sum`` sums the counts of all links.  Rows as in ``groups``.
    """
    paths = paths or default_paths()
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    stored = materialise(_own(docs, id_col, text_col).mapInArrow(partial(_summary_batches, paths=paths), schema), "aligned")
    counted = stored.select(F.explode(F.arrays_zip("pairs", "times")).alias("found")).groupBy(F.col("found.pairs").alias("pair")).agg(F.sum("found.times").alias("n"))
    side_b = F.pmod("pair", F.lit(encoders.pieces(paths[1]).size))
    best = F.max("n").over(Window.partitionBy(side_b))
    counts = counted.select("pair", "n", F.when(F.col("n") == best, 1).otherwise(0).alias("best"))
    links = stored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("found"))
    joined = links.join(F.broadcast(counts), F.col("found.pairs") == F.col("pair"))
    shares = {"n_links": F.lit(1), "n_best": F.col("best"), "count_sum": F.col("n")}
    summed = joined.groupBy("row").agg(*(F.sum(F.col("found.times") * of).alias(name) for name, of in shares.items()))
    whole = stored.drop("pairs", "times").join(summed, "row", "left").fillna(0, [*shares])
    return whole.select("doc_id", "n_a", "n_b", "n_groups", *shares, "groups_sha256")
