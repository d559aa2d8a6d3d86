"""Benchmark passages in documents, found by winnowing.

Of every ``WINDOW`` consecutive 5-word grams the one with the least hash is a
fingerprint, so two texts that share ``SPAN`` consecutive words share one at the
same place in them.  Documents keep only fingerprints that may occur in the
benchmark, by a bitmap of fixed size; these are joined with the benchmark's and the
match is extended word by word on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm import text as tx
from contestry.session import materialise

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
_SIDE = SPAN - GRAM
_AROUND = SPAN + _SIDE
_BITMAP_BITS = 25
_POST = "fp long, pos int, span int, around array<long>"
_POST_TYPE = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("span", pa.int32()), ("around", pa.list_(pa.int64()))])


def _winnowed(words: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the least grams of all windows; ties are all taken."""
    hashes = tx.grams(words.hashes, GRAM)
    n = len(words.hashes) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64), hashes
    least = hashes[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, hashes[k : k + n], out=least)
    whole = words.text[:n] == words.text[SPAN - 1 :]
    taken = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        taken[k : k + n] |= whole & (hashes[k : k + n] == least)
    return np.flatnonzero(taken), hashes


def _around(words: tx.Words, places: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``_SIDE`` before each place on; 0 outside its text."""
    at = places[:, None] + np.arange(-_SIDE, _AROUND - _SIDE)
    own = words.text[places]
    inside = (at >= words.bounds[own][:, None]) & (at < words.bounds[own + 1][:, None])
    return np.where(inside, words.hashes[np.clip(at, 0, len(words.hashes) - 1)], np.uint64(0))


def _short_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    return tx.mix(tx.grams(hashes, size) ^ np.uint64(size))


def _words(chunk: tx.Chunk) -> tx.Words:
    return tx.find_words(chunk._replace(data=tx.lower(chunk.data)), tx.PLAIN)


def _posts(fps: list, places: list, spans: list, around: list) -> pa.StructArray:
    around = np.concatenate(around) if around else np.empty((0, _AROUND), np.uint64)
    bounds = np.arange(len(around) + 1) * _AROUND
    return pa.StructArray.from_arrays(
        [
            pa.array(tx.longs(np.concatenate(fps) if fps else np.empty(0, np.uint64))),
            pa.array(np.concatenate(places) if places else np.empty(0), pa.int32()),
            pa.array(np.concatenate(spans) if spans else np.empty(0), pa.int32()),
            tx.lists(tx.longs(around.ravel()), bounds, pa.int64()),
        ],
        fields=list(_POST_TYPE),
    )


def _grouped(owner: list, posts: tuple[list, list, list, list], count: int) -> pa.ListArray:
    """Posts as one list for each of ``count`` texts."""
    fps, places, spans, around = posts
    owners = np.concatenate(owner) if owner else np.empty(0, np.int64)
    order = np.argsort(owners, kind="stable")
    found = _posts(fps, places, spans, around).take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners[order], np.arange(count + 1)), pa.int32()), found)


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in tx.chunks(batch.column(1)):
            words = _words(chunk)
            counts = np.diff(words.bounds)
            places, hashes = _winnowed(words)
            owner, posts = [words.text[places]], ([hashes[places]], [places], [np.full(len(places), SPAN)], [_around(words, places)])
            for size in range(1, SPAN):
                own = np.flatnonzero(counts == size)
                if len(own):
                    at = words.bounds[own]
                    owner.append(own)
                    posts[0].append(_short_hash(words.hashes, size)[at])
                    posts[1].append(at)
                    posts[2].append(np.full(len(own), size))
                    posts[3].append(np.zeros((len(own), _AROUND), np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, chunk.count), _grouped(owner, posts, chunk.count)], names=["item_id", "posts"]
            )


def _document_batches(batches: Iterator[pa.RecordBatch], bitmap, sizes: list[int]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    bits = bitmap.value

    def possible(fps: np.ndarray) -> np.ndarray:
        slot = fps >> np.uint64(64 - _BITMAP_BITS)
        return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    for batch in batches:
        for chunk in tx.chunks(batch.column(2)):
            words = _words(chunk)
            counts = np.diff(words.bounds)
            owner, posts = [], ([], [], [], [])
            for size in sizes:
                if size == SPAN:
                    places, hashes = _winnowed(words)
                    places = places[possible(hashes[places])]
                else:
                    hashes = _short_hash(words.hashes, size)
                    whole = words.text[: len(hashes)] == words.text[size - 1 : size - 1 + len(hashes)]
                    places = np.flatnonzero(whole & possible(hashes))
                owner.append(words.text[places])
                posts[0].append(hashes[places])
                posts[1].append(places - words.bounds[words.text[places]])
                posts[2].append(np.full(len(places), size))
                posts[3].append(_around(words, places) if size == SPAN else np.zeros((len(places), _AROUND), np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(chunk.first, chunk.count),
                    batch.column(1).slice(chunk.first, chunk.count),
                    pa.array(counts, pa.int64()),
                    _grouped(owner, posts, chunk.count),
                ],
                names=["row", "doc_id", "n_words", "posts"],
            )


def _extend_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of document words that match an item for ``SPAN`` words or a whole short item."""
    for batch in batches:
        row, passage, pos, span = (batch.column(i).to_numpy() for i in range(4))
        ours, theirs = (batch.column(i).flatten().to_numpy().reshape(-1, _AROUND) for i in (4, 5))
        same = (ours == theirs) & (ours != 0)
        left = np.cumprod(same[:, _SIDE - 1 :: -1], axis=1).sum(axis=1)
        right = np.cumprod(same[:, _SIDE + GRAM :], axis=1).sum(axis=1)
        core = same[:, _SIDE : _SIDE + GRAM].all(axis=1)
        short = span < SPAN
        hit = short | (core & (left + GRAM + right >= SPAN))
        start = np.where(short, pos, pos - left)[hit]
        end = np.where(short, pos + span, pos + GRAM + right)[hit]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[hit]), pa.array(passage[hit]), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
            names=["row", "passage", "start", "end"],
        )


def _bitmap(items: DataFrame) -> np.ndarray:
    """One bit per possible fingerprint slot; its size does not depend on the data."""
    slots = items.select(F.shiftrightunsigned("fp", 64 - _BITMAP_BITS).alias("slot"))
    words = slots.selectExpr("slot >> 5 AS word", "shiftleft(1L, CAST(slot & 31 AS INT)) AS bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (_BITMAP_BITS - 5), np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Documents with their hits, and the hit spans.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.  A
    window is ``SPAN`` consecutive words of an item, or all words of a shorter one.
    First table: one row per row of ``docs`` with doc_id, n_words, n_hit (words in
    any occurrence of a window), items (sorted item ids, as strings, whose windows
    occur).  Second table: row, passage, start, end of matching word runs.  Null or
    empty texts have no words; items without words or without id match nothing;
    repeated items and rows count as they are; either table may be empty.
    """
    own = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = own.where("item_id is not null").mapInArrow(_item_batches, f"item_id string, posts array<struct<{_struct()}>>")
    items = items.select("item_id", F.explode("posts").alias("post")).select("item_id", "post.fp", "post.span", "post.around")
    items = materialise(items.withColumn("passage", F.xxhash64("fp", "span", "around")), "decontam_items")
    sizes = sorted(r["span"] for r in items.select("span").distinct().collect())
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(items))

    own = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    marked = own.mapInArrow(
        partial(_document_batches, bitmap=bitmap, sizes=sizes), f"row long, doc_id long, n_words long, posts array<struct<{_struct()}>>"
    )
    marked = materialise(marked, "decontam_documents")
    passages = items.select("passage", "fp", F.col("span").alias("item_span"), F.col("around").alias("theirs")).distinct()
    posts = marked.select("row", F.explode("posts").alias("post")).select("row", "post.*")
    joined = posts.join(passages, "fp").where("span = item_span").select("row", "passage", "pos", "span", "around", "theirs")
    spans = materialise(joined.mapInArrow(_extend_batches, "row long, passage long, start int, end int"), "decontam_spans")

    united = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("reach")),
        lambda done, s: F.struct(
            (done["words"] + F.greatest(s["end"] - F.greatest(s["start"], done["reach"]), F.lit(0))).alias("words"),
            F.greatest(done["reach"], s["end"]).alias("reach"),
        ),
        lambda done: done["words"].cast("long"),
    )
    hits = spans.groupBy("row").agg(united.alias("n_hit"))
    named = spans.select("row", "passage").distinct().join(items.select("passage", "item_id").distinct(), "passage")
    named = named.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = marked.select("row", "doc_id", "n_words").join(hits, "row", "left").join(named, "row", "left")
    none = F.array().cast("array<string>")
    return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), "row"), spans


def _struct() -> str:
    return ", ".join(": ".join(field.split()) for field in _POST.split(", "))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words and the items found."""
    found, _ = contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
