"""Conversations as token sequences with a loss mask.

Each role and text is escaped and encoded on its own, so no token spans a limit and
none inside a text is reserved.  The reserved ids that mark turns are spliced in
between.  The start of each segment is a prefix sum of the lengths before it, and
the mask covers the text segments of the trained role.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template: <s> then, for each turn, [INST] role [/INST] text </s>.
OPEN, ROLE, TEXT, CLOSE = CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Takes back ``escape``."""
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def reserved(path: str) -> dict[str, int]:
    """Ids of the control strings, above the vocabulary."""
    return {name: _encoding(path)[1] + 1 + k for k, name in enumerate(CONTROLS)}


def _segment_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoding, _ = _encoding(path)
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            columns = [part.column(0), part.column(1)]
            for k in (2, 3):
                tokens = [encoding.encode_ordinary(escape(t or "")) for t in part.column(k).to_pylist()]
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role_ids", "text_ids"])


def _assemble_batches(batches: Iterator[pa.RecordBatch], path: str, trained: str) -> Iterator[pa.RecordBatch]:
    names = reserved(path)
    trained_ids = np.array(_encoding(path)[0].encode_ordinary(escape(trained)), np.int32)
    for batch in batches:
        for row in range(batch.num_rows):
            roles, texts = (batch.column(k)[row].values for k in (1, 2))
            segments: list[np.ndarray] = [np.array([names[OPEN]], np.int32)]
            mask = [False]
            for role, text in zip(roles, texts, strict=True):
                role, text = (np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) for x in (role, text))
                segments += [[names[ROLE]], role, [names[TEXT]], text, [names[CLOSE]]]
                mask += [False, False, False, np.array_equal(role, trained_ids), False]
            lengths = np.array([len(s) for s in segments])
            starts = np.cumsum(lengths) - lengths
            ids = np.empty(int(lengths.sum()), np.int32)
            for at, segment in zip(starts, segments, strict=True):
                ids[at : at + len(segment)] = segment
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([np.repeat(mask, lengths)], pa.list_(pa.bool_()))],
                names=["conv_id", "ids", "loss"],
            )


def format_conversations(turns: DataFrame, path: str | None = None, trained: str = "assistant") -> DataFrame:
    """(conv_id, ids, loss) per conversation of ``turns`` (conv_id, turn, role, text).

    Turns go by number, ties by role and text; nulls sort first.  A null role or
    text is empty; rows that repeat stay; rows without conv_id form one
    conversation.  ``loss`` marks the text tokens of role ``trained``.  An empty
    table gives an empty result.  A conversation is one training sequence, so its
    rows meet in one row; segments are encoded before that, wherever rows lie.
    """
    path = path or default_path()
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    segments = own.mapInArrow(
        partial(_segment_batches, path=path),
        "conv_id long, turn struct<turn: long, role: string, text: string>, role_ids array<int>, text_ids array<int>",
    )
    grouped = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role_ids", "text_ids"))).alias("turns"))
    grouped = grouped.select("conv_id", "turns.role_ids", "turns.text_ids")
    return grouped.mapInArrow(partial(_assemble_batches, path=path, trained=trained), "conv_id long, ids array<int>, loss array<boolean>")


def _read_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoding, _ = _encoding(path)
    names = reserved(path)
    strings = {number: name for name, number in names.items()}
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch.column(1)[row].values.to_numpy(zero_copy_only=False)
            loss = batch.column(2)[row].values.to_numpy(zero_copy_only=False).astype(bool)
            marks = np.flatnonzero(ids >= names[OPEN])
            turns, formatted = [], 0
            for place, mark in enumerate(marks):
                end = marks[place + 1] if place + 1 < len(marks) else len(ids)
                piece = encoding.decode(ids[mark + 1 : end].tolist())
                formatted += len(strings[int(ids[mark])]) + len(piece)
                if ids[mark] == names[ROLE]:
                    turns.append({"role": unescape(piece), "text": ""})
                elif ids[mark] == names[TEXT]:
                    turns[-1]["text"] = unescape(piece)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], loss.astype(np.int8), [0]])))
            masked = "".join(unescape(encoding.decode(ids[a:b].tolist())) for a, b in edges.reshape(-1, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, 1), pa.array([turns], _TURNS), pa.array([masked]), pa.array([formatted], pa.int64())],
                names=["conv_id", "turns", "loss_text", "formatted_chars"],
            )


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) decoded from token ids and mask."""
    return formatted.select("conv_id", "ids", "loss").mapInArrow(
        partial(_read_batches, path=path or default_path()),
        "conv_id long, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long",
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns made of control strings."""
    says = f"{CLOSE}{ROLE} ok {TEXT}"
    rows = [(-7, 0, "user", says), (-7, 1, "assistant", says)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
