"""Words, word hashes and word n-grams of whole Arrow batches, computed with numpy.

A batch of texts is one byte buffer with offsets, so splitting and hashing are a
few array passes and no Python object is made per word.  Long batches are worked
through in chunks of whole documents, which bounds memory by the chunk size or by
the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

_bytes = np.arange(256)
#: True for the bytes of words that white space separates: [^\x20\x09-\x0D]+
SPACED = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: True for the bytes of words of lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PLAIN = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
_LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)


class Chunk(NamedTuple):
    """Some texts of a batch: ``data[offsets[i]:offsets[i + 1]]`` is text ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Words of a chunk: byte span, text number and 64-bit hash of each; ``bounds``
    has the first word of each text and, last, the number of words."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow string column (null: empty) in chunks of about ``limit`` bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        own = offsets[first : last + 1]
        yield Chunk(first, data[own[0] : own[-1]], own - own[0])
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def mix(values: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    values = values + _STEP
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(64, 2 * n), _GRAM, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def find_words(chunk: Chunk, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes marked in the table ``inside``, never across texts."""
    return find_runs(chunk.data, chunk.offsets, inside[chunk.data])


def find_runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of marked bytes within each text, with their hashes."""
    before = np.zeros(len(data) + 1, bool)
    before[1:] = member
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = member
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(member & ~before[:-1])
    ends = np.flatnonzero(member & ~after[1:]) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    bounds = np.searchsorted(starts, offsets)
    lengths = ends - starts
    if len(starts) == 0:
        return Words(starts, ends, text, np.empty(0, np.uint64), bounds)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(firsts[-1] + lengths[-1]) - np.repeat(firsts, lengths)
    values = _letters()[data[member]] * _powers_to(int(lengths.max()))[place]
    return Words(starts, ends, text, mix(np.add.reduceat(values, firsts)), bounds)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive word hashes, text limits ignored."""
    count = max(0, len(hashes) - size + 1)
    found = hashes[:count].copy()
    for k in range(1, size):
        found = found * _GRAM + hashes[k : k + count]
    return mix(found)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each text, ascending, and where each text's begin.

    A text with fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    all_grams = grams(words.hashes, size)
    sets, bounds = [], [0]
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= size:
            own = np.sort(all_grams[a : b - size + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        elif b > a:
            own = mix(grams(words.hashes[a:b], b - a) + np.uint64(b - a))
        else:
            own = np.empty(0, np.uint64)
        sets.append(own)
        bounds.append(bounds[-1] + len(own))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.array(bounds)


def longs(values: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit integers."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive pieces of ``values``."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
