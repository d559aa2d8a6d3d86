"""Token ids in Arrow files of equal-length sequences.

Documents are sorted by id over range partitions, and each partition becomes one
file: its documents' ids, an end id behind each, are laid end to end and cut into
sequences of fixed length.  A record batch holds ``rows`` sequences as
fixed-size-list columns: ``ids``, ``mask`` (False: padding behind the file's last
document) and ``last`` (True: a document's last id).  All batches but the last are
equally long, so sequence ``i`` is found by division, and a mapped file gives views
without copies.  A second, small Arrow file has the id, start and length of each
document in it.

Tasks write under names of their own and return them.  Only the files named in the
stored list count, so files of lost or repeated attempts do no harm.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestry.llm import encoders, text
from contestry.session import materialise, scratch_path

LENGTH = 2048
ROWS = 64
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_LIST = "part int, path string, tokens long, documents long, sequences long"


def default_path() -> str:
    return encoders.default_path("byte_bpe_50k.json")


def open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder named as Spark names it, and the folder's path in it."""
    scheme, colon, rest = folder.partition(":")
    if not colon or scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + (rest or scheme).lstrip("/")
    return pa.fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", folder))


class Writer:
    """One token file.  At most one batch is held in memory."""

    def __init__(self, folder: str, name: str, length: int, rows: int, small: bool) -> None:
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        self.length, self.rows = length, rows
        kind = pa.uint16() if small else pa.uint32()
        self.dtype = np.dtype(kind.to_pandas_dtype())
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length))])
        self.sinks = [files.open_output_stream(f"{base}/{name}{end}") for end in (".arrow", ".index.arrow")]
        self.file = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], _INDEX)
        self.ids = np.zeros(length * rows, self.dtype)
        self.last = np.zeros(length * rows, bool)
        self.filled = self.tokens = self.documents = self.sequences = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents whose ids, end ids included, are ``ids[bounds[i]:bounds[i + 1]]``."""
        last = np.zeros(len(ids), bool)
        last[bounds[1:] - 1] = True
        starts = self.tokens + bounds[:-1] - bounds[0]
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(np.diff(bounds))], schema=_INDEX))
        self.tokens += len(ids)
        self.documents += len(bounds) - 1
        done = 0
        while done < len(ids):
            fits = min(len(self.ids) - self.filled, len(ids) - done)
            place = slice(self.filled, self.filled + fits)
            self.ids[place], self.last[place] = ids[done : done + fits], last[done : done + fits]
            self.filled, done = self.filled + fits, done + fits
            if self.filled == len(self.ids):
                self._flush()

    def _flush(self) -> None:
        count = -(-self.filled // self.length)
        room = count * self.length
        self.ids[self.filled : room], self.last[self.filled : room] = 0, False
        columns = (pa.array(self.ids[:room]), pa.array(np.arange(room) < self.filled), pa.array(self.last[:room]))
        lists = [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += count
        self.filled = 0

    def close(self) -> None:
        if self.filled:
            self._flush()
        for file, sink in zip((self.file, self.index), self.sinks, strict=True):
            file.close()
            sink.close()


class Reader:
    """Random access to a token file; a local file is mapped, and sequences are views of it."""

    def __init__(self, path: str) -> None:
        files, base = open_folder(path)
        local = isinstance(files, pa.fs.LocalFileSystem)
        self.sources = [pa.memory_map(base + end) if local else files.open_input_file(base + end) for end in (".arrow", ".index.arrow")]
        self.file, self.index = map(pa.ipc.open_file, self.sources)
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches
        self.rows = self.file.get_batch(0).num_rows if self.batches else 0
        self.open = -1

    def close(self) -> None:
        for source in self.sources:
            source.close()

    def __len__(self) -> int:
        return self.rows * (self.batches - 1) + self.file.get_batch(self.batches - 1).num_rows if self.batches else 0

    def sequence(self, number: int) -> dict[str, pa.Array]:
        """``ids``, ``mask`` and ``last`` of one sequence."""
        if not 0 <= number < len(self):
            raise IndexError(number)
        batch = self.file.get_batch(number // self.rows)
        return {name: batch.column(name)[number % self.rows].values for name in batch.schema.names}

    def _opened(self, number: int) -> tuple[np.ndarray, pa.Array, int]:
        """Views of a batch's ids and last marks, and how many of its ids are real; the latest batch stays open."""
        if self.open != number:
            batch = self.file.get_batch(number)
            self.open = number
            self.views = batch.column("ids").flatten().to_numpy(), batch.column("last").flatten(), batch.column("mask").flatten().true_count
        return self.views

    def tokens(self, start: int, count: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """The ids from ``start`` on with their ``last`` marks, in views of one batch each."""
        span = self.rows * self.length
        while count > 0:
            number, place = divmod(start, span)
            ids, last, real = self._opened(number) if number < self.batches else (None, None, 0)
            taken = min(count, span - place)
            if place + taken > real:
                raise ValueError("a document reaches beyond its file")
            yield ids[place : place + taken], last.slice(place, taken)
            start, count = start + taken, count - taken


def _write_batches(batches: Iterator[pa.RecordBatch], path: str, folder: str, end_id: int, length: int, rows: int) -> Iterator[pa.RecordBatch]:
    model, size = encoders.remembered(path), encoders.byte_level(path, False).size
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
    writer = None
    for batch in batches:
        for chunk in text.chunks(batch.column(1)):
            texts = [t or "" for t in batch.column(1).slice(chunk.first, chunk.count).to_pylist()]
            ((ids, bounds),) = model.encode(texts)
            with_ends = np.insert(ids, bounds[1:], end_id)
            writer = writer or Writer(folder, name, length, rows, max(size, end_id + 1) <= 1 << 16)
            writer.add(batch.column(0).slice(chunk.first, chunk.count), with_ends, bounds + np.arange(len(bounds)))
    if writer:
        writer.close()
        row = {"part": [part], "path": [f"{folder}/{name}"], "tokens": [writer.tokens], "documents": [writer.documents], "sequences": [writer.sequences]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), *((k, pa.int64()) for k in ("tokens", "documents", "sequences"))]))


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 0, length: int = LENGTH, rows: int = ROWS,
          files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token files of ``docs`` below ``folder``; the list of them: (part, path, tokens, documents, sequences, start).

    Files go by ``part``; ``start`` counts the ids in the files before.  Documents go
    by id, null first; rows that repeat an id go by a hash of the text, so they spread
    over files however many there are, and equal rows are interchangeable.  A null or
    empty text has the end id alone.  Names of special tokens in texts are recognised,
    as the library does.  An empty table gives no file.  ``folder`` (a fresh one in
    the session's shared folder by default) must be reachable from all executors;
    nothing in it is overwritten.  ``files``: how many range partitions (default:
    shuffle partitions).  Columns beside id and text are not looked at.
    """
    spark = docs.sparkSession
    folder = (folder or scratch_path(spark, "tokens")).rstrip("/")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "hash", "row"]
    ordered = own.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    writes = partial(_write_batches, path=path or default_path(), folder=folder, end_id=end_id, length=length, rows=rows)
    listed = materialise(ordered.mapInArrow(writes, _LIST), "token_files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return listed.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for listed in batch.select(["path", "start"]).to_pylist():
            reader = Reader(listed["path"])
            for number in range(reader.index.num_record_batches):
                index = reader.index.get_batch(number)
                starts, sizes = (index.column(k).to_numpy() for k in (1, 2))
                sums = np.empty(len(starts), np.int64)
                for row, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                    total = ends = 0
                    for ids, last in reader.tokens(start, size):
                        total = zlib.crc32(ids.astype("<u4"), total)
                        ends += last.true_count
                    if ends != 1 or not last[-1].as_py():
                        raise ValueError(f"{listed['path']}: index and marks differ at {start}")
                    sums[row] = total
                yield pa.RecordBatch.from_arrays([index.column(0), pa.array(starts + listed["start"]), index.column(2), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            reader.close()


def documents(listed: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``write``.

    Each file is read by one task.  The checksum is that of the ids as little-endian
    32-bit numbers, taken from views of the file; a file whose marks differ from its
    index fails.
    """
    files = listed.select("path", "start").repartition(max(1, listed.count()))
    return files.mapInArrow(_read_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
