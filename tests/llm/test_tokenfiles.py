import zlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from contestry.llm import tokenfiles

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(rows):
    """(doc_id, start, n_tokens, ids_crc32) with documents in ascending order of id."""
    found, at = [], 0
    for doc_id, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        found.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return found


def test_given_documents_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    listed = tokenfiles.write(docs, length=64, rows=16, files=7)
    assert [tuple(r) for r in tokenfiles.documents(listed).orderBy("start").collect()] == expected(rows)
    assert listed.agg({"tokens": "sum", "documents": "sum"}).first()["sum(documents)"] == len(rows)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = [tuple(r) for r in tokenfiles.documents(tokenfiles.write(odd_docs, length=8, rows=4, files=3)).collect()]
    ids = [f[0] for f in sorted(found, key=lambda f: f[1])]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert sorted((f[0] or -1, *f[2:]) for f in found) == sorted((e[0] or -1, *e[2:]) for e in expected(odd_rows))
    ordered = sorted(found, key=lambda f: f[1])
    assert [f[1] for f in ordered] == np.cumsum([0, *(f[2] for f in ordered)])[:-1].tolist()
    listed = tokenfiles.write(no_docs)
    assert listed.collect() == [] and tokenfiles.documents(listed).collect() == []


def test_one_id_in_all_rows_spreads_over_files(spark):
    docs = spark.range(400).selectExpr("5L AS doc_id", "concat('text ', id % 7) AS text").repartition(4)
    listed = tokenfiles.write(docs, files=4).collect()
    assert len(listed) > 1 and sum(r.documents for r in listed) == 400


def test_sequences_are_views_of_equal_length(spark, odd_docs):
    row = tokenfiles.write(odd_docs, length=32, rows=8, files=1).collect()[0]
    reader = tokenfiles.Reader(row.path)
    _, base = tokenfiles.open_folder(row.path)
    whole = pa.ipc.open_file(pa.memory_map(base + ".arrow")).read_all()
    assert len(reader) == row.sequences == whole.num_rows and whole.schema.field("ids").type == pa.list_(pa.uint16(), 32)
    before = pa.total_allocated_bytes()
    kept = [reader.sequence(k) for k in range(len(reader))]
    assert pa.total_allocated_bytes() == before  # nothing was copied
    assert [k["ids"].to_pylist() for k in kept] == whole.column("ids").to_pylist()
    assert sum(k["mask"].true_count for k in kept) == row.tokens and sum(k["last"].true_count for k in kept) == row.documents
    with pytest.raises(IndexError):
        reader.sequence(len(reader))
    with pytest.raises(ValueError, match="beyond"):
        list(reader.tokens(row.tokens - 1, 2))
    reader.close()


def test_large_vocabularies_take_four_bytes(tmp_path):
    writer = tokenfiles.Writer(str(tmp_path), "x", 4, 2, small=False)
    writer.add(pa.array([1, 2], pa.int64()), np.array([70000, 0, 5, 6, 7, 0], np.int32), np.array([0, 2, 6]))
    writer.close()
    reader = tokenfiles.Reader(f"file://{tmp_path}/x")
    assert [ids.tolist() for ids, _ in reader.tokens(0, 6)] == [[70000, 0, 5, 6, 7, 0]]
    assert reader.sequence(1)["mask"].to_pylist() == [True, True, False, False]
