"""Token ids of byte-level and piece vocabularies, by the libraries their files belong to.

No pattern of a byte-level vocabulary goes on from a character that is not white
space to a space, and no piece of a piece vocabulary (checked on loading) has a space
behind another character.  A text cut before each space that follows such a character
therefore has the ids of its chunks, one after the other, and a library needs to see
a chunk only when a worker meets it first.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Characters of remembered chunks after which a worker keeps only those it has met so often since it last did.
_KEPT_CHARS = 6_000_000
_COMMON = 3
#: Chunks that may go to a library in one string.
_JOINED = 256
#: A space after white space or at the end: such a text isn't cut.
_RUN = re.compile(r"\s | $")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte behind each printable character of a byte-level vocabulary."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return {chr(b) if b in printable else chr(next(others)): b for b in range(256)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int32), np.array([len(x) for x in lists], np.int64)


class ByteLevel:
    """A byte-level vocabulary.  ``plain``: names of special tokens inside texts are text."""

    def __init__(self, path: str, plain: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        before, added = content.get("pre_tokenizer") or {}, content["added_tokens"]
        #: Only such files have the words that the cuts rely on.
        self.cuts = content.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        self.cuts = self.cuts and not before.get("add_prefix_space") and all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in added)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.sizes = np.array([len(t) for t in self.token_bytes()], np.int64)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; special tokens are their names."""
        letters = byte_letters()
        special = self.library.get_added_tokens_decoder()
        found = [b""] * self.size
        for token, number in self.library.get_vocab(with_added_tokens=True).items():
            found[number] = token.encode() if number in special else bytes(letters[c] for c in token)
        return found

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _beside(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of chunks that go to the library side by side, cut apart again by the bytes of their tokens."""
        ids, _ = _flat(self._ids(["".join(chunks[k : k + _JOINED]) for k in range(0, len(chunks), _JOINED)]))
        ends = np.cumsum([len(c.encode()) for c in chunks])
        token_ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(token_ends, ends) + 1
        if len(ids) != cuts[-1] or not np.array_equal(token_ends[cuts - 1], ends):
            return None
        return ids, np.diff(cuts, prepend=0)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, and how many each has.

        Chunks that begin with a space and don't end in white space may stand side by
        side: a string has far more overhead for the library than a chunk.
        """
        joins = np.array([self.cuts and c[:1] == " " and not c[-1].isspace() for c in chunks], bool)
        counts = np.zeros(len(chunks), np.int64)
        found = []
        for own, beside in ((np.flatnonzero(joins), True), (np.flatnonzero(~joins), False)):
            if len(own):
                texts = [chunks[i] for i in own]
                ids, sizes = (self._beside(texts) if beside else None) or _flat(self._ids(texts))
                counts[own] = sizes
                found.append((own, ids))
        starts = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int32)
        for own, ids in found:
            sizes = counts[own]
            out[np.arange(len(ids)) + np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes)] = ids
        return out, counts


class Pieces:
    """A piece vocabulary with byte fallback, whose library puts a space before a text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(self.size)]
        self.cuts = b"identity" in self.library.serialized_model_proto() and not any("▁" in n.lstrip("▁") for n in names)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: U+2581 is a space, <0xHH> one byte."""
        model = self.library
        return [
            bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(model.id_to_piece, range(self.size)))
        ]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, which begin with the space that the library adds, and how many each has."""
        return _flat(self.library.encode([c[1:] for c in chunks], num_threads=1))


class _Numbers(dict):
    """Numbers chunks as they are first asked for."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.fresh.append(chunk)
        return number


class Remembered:
    """Ids of texts by one or more vocabularies, which see each chunk once."""

    def __init__(self, *sides: ByteLevel | Pieces) -> None:
        self.sides = sides
        self.cuts = all(s.cuts for s in sides)
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.ids = [np.empty(1 << 16, np.int32) for _ in self.sides]
        self.ends = [np.zeros(1, np.int64) for _ in self.sides]
        self.counts = np.empty(0, np.int64)
        self.chars = 0

    def _keep_common(self) -> None:
        """Forgets chunks met seldom; all, where common ones alone fill half the room."""
        chosen = np.flatnonzero(self.counts >= _COMMON)
        known, ids, ends = list(self.known), self.ids, self.ends
        chunks = [known[i] for i in chosen]
        chars = sum(map(len, chunks))
        self.forget()
        if 2 * chars <= _KEPT_CHARS:
            self.known.update(zip(chunks, range(len(chunks)), strict=True))
            for k, (old, bounds) in enumerate(zip(ids, ends, strict=True)):
                sizes = bounds[chosen + 1] - bounds[chosen]
                self.ends[k] = np.concatenate([[0], np.cumsum(sizes)])
                self.ids[k] = old[np.arange(self.ends[k][-1]) + np.repeat(bounds[chosen] - self.ends[k][:-1], sizes)]
            self.counts = np.zeros(len(chunks), np.int64)
            self.chars = chars

    def _chunks(self, text: str) -> list[str]:
        if not self.cuts or _RUN.search(text):
            return [text]
        first, *others = text.split(" ")
        chunks = [f" {part}" for part in others]
        return [first, *chunks] if first else chunks

    def _learn(self, chunks: list[str]) -> None:
        for k, side in enumerate(self.sides):
            ids, counts = side.encode(chunks)
            start = int(self.ends[k][-1])
            ends = start + np.cumsum(counts)
            if ends[-1] > len(self.ids[k]):
                self.ids[k] = np.concatenate([self.ids[k][:start], np.empty(2 * int(ends[-1]) - start, np.int32)])
            self.ids[k][start : ends[-1]] = ids
            self.ends[k] = np.concatenate([self.ends[k], ends])
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vocabulary all ids of the texts, and where each text's begin and, last, end."""
        if self.chars > _KEPT_CHARS:
            self._keep_common()
        split = [self._chunks(t) for t in texts]
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            self._learn(fresh)
        met = np.bincount(index, minlength=len(self.known))
        met[: len(self.counts)] += self.counts
        self.counts = met
        cuts = np.cumsum([0, *map(len, split)])
        found = []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            sizes = ends[index + 1] - ends[index]
            places = np.concatenate([[0], np.cumsum(sizes)])
            source = np.arange(places[-1]) + np.repeat(ends[index] - places[:-1], sizes)
            found.append((ids[source], places[cuts]))
        return found


@lru_cache(maxsize=4)
def byte_level(path: str, plain: bool) -> ByteLevel:
    return ByteLevel(path, plain)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def remembered(path: str) -> Remembered:
    """A byte-level vocabulary that recognises its special tokens in texts."""
    return Remembered(byte_level(path, False))
