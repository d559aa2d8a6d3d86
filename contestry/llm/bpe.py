"""BPE encoding and decoding with the merges of a tokenizer file.

Texts fall into white-space separated chunks; only chunks a worker has not met yet
go through the merges.  Their words lie in one flat array of symbols, and a round
merges, in every word at once, all places of its lowest-ranked pair, which a binary
search over the sorted pair keys finds.  Known chunks are gathered by index.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space, contractions, letters, digits and the rest, as the file's own pattern has them.
_SPACE = "\t-\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_CHUNK = regex.compile(rf"[^{_SPACE}]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")  # white space for str.split, not for the file's pattern

_NONE = np.iinfo(np.int64).max
#: Limits on remembered chunks, and on the rows and characters worked on at once.
_KEPT_CHARS = 2_000_000
_ROWS = 500
_CHARS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """A vocabulary with its ranked merges, and the chunks a worker has encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.names = dict(map(reversed, (ids | self.special).items()))
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same token, so equal pairs can't be merged together")
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.chars = 0
        for name, number in self.special.items():
            self._learn([name], [np.array([number], np.int32)])

    def _learn(self, chunks: list[str], encoded: list[np.ndarray]) -> None:
        first, start = len(self.known), int(self.ends[-1])
        ends = start + np.cumsum([len(e) for e in encoded])
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids[:start], np.empty(2 * int(ends[-1]) - start, np.int32)])
        self.ids[start : ends[-1]] = np.concatenate(encoded)
        self.ends = np.concatenate([self.ends, ends])
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word, given as bytes."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[data], np.repeat(np.arange(len(words)), lengths)
        tails = np.cumsum(lengths) - 1
        symbols[tails] = self.last[data[tails]]
        done_symbols, done_word = [], []
        while len(symbols):
            pairs = np.full(len(symbols), -1, np.int64)
            pairs[:-1] = np.where(word[:-1] == word[1:], symbols[:-1] << 32 | symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            rank = np.where(self.keys[at] == pairs, self.ranks[at], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = best == _NONE
            done_symbols.append(symbols[over])
            done_word.append(word[over])
            chosen = np.flatnonzero((rank == best) & ~over)
            if len(chosen):  # of places that overlap, as in aaa, every other one from the left
                runs = np.concatenate([[True], np.diff(chosen) > 1])
                firsts = chosen[runs][np.cumsum(runs) - 1]
                chosen = chosen[(chosen - firsts) % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            stay = ~over
            stay[chosen + 1] = False
            symbols, word = symbols[stay], word[stay]
        done, owner = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(1, len(words)))
        return np.split(done[order].astype(np.int32), cuts)

    def _encode_new(self, chunks: list[str]) -> None:
        split = [_WORD.findall(c) for c in chunks]
        distinct = {w: None for words in split for w in words}
        encoded = dict(zip(distinct, self.merge([w.encode("utf-8", "replace") for w in distinct]), strict=True))
        empty = np.empty(0, np.int32)
        self._learn(chunks, [np.concatenate([encoded[w] for w in words]) if words else empty for words in split])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        if self.chars > _KEPT_CHARS:
            self.forget()
        split = [self._chunks(t) for t in texts]
        fresh = list(dict.fromkeys(c for chunks in split for c in chunks if c not in self.known))
        if fresh:
            self._encode_new(fresh)
        known = self.known
        index = np.array([known[c] for chunks in split for c in chunks], np.int64)
        sizes = self.ends[index + 1] - self.ends[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.ends[index] - (ends - sizes), sizes)
        cuts = np.cumsum([0, *(len(chunks) for chunks in split)])
        return self.ids[source], np.concatenate([[0], ends])[cuts]

    def _chunks(self, text: str) -> list[str]:
        if self.split is None or not any(name in text for name in self.special):
            return _plain_chunks(text)
        found: list[str] = []
        for part in self.split.split(text):
            found += [part] if part in self.special else _plain_chunks(part)
        return found

    def decode(self, ids: list[int]) -> str:
        """Token strings with one space between them, as the file names no decoder."""
        return " ".join([self.names[i] for i in ids if i in self.names])


def _plain_chunks(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    return _CHUNK.findall(text) if _SEPARATORS.search(text) else text.split()


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, decoded: bool = False) -> Iterator[pa.RecordBatch]:
    model = merges(path)
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = min(max(start + 1, int(np.searchsorted(sizes, before + _CHARS))), start + _ROWS, batch.num_rows)
            ids, bounds = model.encode([t or "" for t in batch.column(1).slice(start, end - start).to_pylist()])
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            part = pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), listed], names=["doc_id", "ids"])
            yield from _decode_batches(iter([part]), path) if decoded else [part]
            start = end


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = merges(path)
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            texts = [model.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row of ``docs``: the token ids of the whole text.

    A null or empty text has no ids.  Control tokens named in the file are
    recognised in texts, as its library does.  Rows are independent: repeated ids
    and null ids stay as they are, an empty table gives an empty one.  Memory is
    bounded by the longest text and by a limit on remembered chunks.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(partial(_encode_batches, path=path or default_path()), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids); null ids decode to the empty text, unknown ids to nothing."""
    own = encoded.select("doc_id", "ids")
    return own.mapInArrow(partial(_decode_batches, path=path or default_path()), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per row of ``docs``: ``encode`` and ``decode`` in one pass, with one vocabulary in memory."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = partial(_encode_batches, path=path or default_path(), decoded=True)
    return own.mapInArrow(both, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Token count and digests of ids and decoded text, and the columns named in ``more``."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
