import corpus_pipeline
from pyspark.sql import functions as F
from test_substring import repeated_windows

from contestry.llm import queries
from contestry.llm.decontam import report
from contestry.session import materialise
from tests_llm_helpers import rows_of

SF = "/root/testdata/sf0.01"


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = {r[0] for r in rows_of(docs, "doc_id")}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        kept = {r[0] for r in rows_of(docs, "doc_id")}
        assert kept <= ids and len(kept) == docs.count() > 0
        ids = kept
        if name == "quality_classifier":
            assert docs.join(labels, "doc_id").where("quality = 0").count() == 0
        if name == "substring_dedup":
            assert len(repeated_windows(rows_of(docs, "doc_id", "text"))) <= 1
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
        if name == "decontamination":
            assert report(docs, benchmark).where("contaminated").count() == 0
        if name != "bpe_encoding":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} == set(docs.columns)


def test_odd_rows_pass_every_stage(spark, odd_docs):
    odd = odd_docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"), "kept")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF), f"odd_{name}")
            assert docs.count() >= 0


def test_every_operator_has_a_query():
    names = list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.ORACLE) <= set(names)
