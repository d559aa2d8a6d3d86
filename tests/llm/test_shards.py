import zlib
from collections import defaultdict

from contestry.llm import shards


def check(rows, limit_slack):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by_shard[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= limit_slack
    return by_shard


def test_documents_fill_forty_equal_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards.plan(docs).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check(rows, 2 * max(r.size for r in rows))


def test_one_text_in_most_rows_is_split(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 < 2, 'same text', concat('text ', id)) AS text")
    by_shard = check(shards.plan(docs).collect(), 200)
    assert len(by_shard) == 40


def test_small_groups_of_equal_texts_stay_together(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "concat('text ', id % 4000) AS text")
    rows = shards.plan(docs).collect()
    homes = defaultdict(set)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 5


def test_odd_rows(spark, odd_docs, no_docs, odd_rows):
    rows = shards.shard_by_bytes(odd_docs, 3).collect()
    assert len(rows) == len(odd_rows)
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((i or -1, len((t or "").encode()) + 16) for i, t in odd_rows)
    assert {r.kept for r in rows} == {"x"}
    assert shards.plan(no_docs).collect() == []
    one = shards.plan(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(16, 0, 0)]
    twins = spark.createDataFrame([(1, "a")] * 50, "doc_id long, text string")
    assert sorted(r.slot for r in shards.shard_by_bytes(twins, 1).collect()) == list(range(50))


def test_limits_are_places_in_the_order_of_both_hashes():
    assert shards._place((4096,)) == 1 << 128  # beyond all rows
    assert shards._place((0, 4096)) == shards._place((1,)) == 1 << 116
    assert shards._place((0,) * 5 + (3,)) == 3 << 64
    assert shards._place((0,) * 11 + (5,)) == 5
    assert shards._place((4095,) * 5 + (15,) + (4095,) * 5 + (15,)) == (1 << 128) - 1


def test_given_groups_up_to_the_share_are_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = shards.plan(docs).collect()
    mean = sum(r.size for r in rows) / 40
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_crc32, r.size].append(r)
    small = [g for g in groups.values() if len(g) > 1 and sum(r.size for r in g) <= shards.GROUP_SHARE * mean]
    assert small and all(len({r.shard for r in g}) == 1 for g in small)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.size
    slack = shards.GROUP_SHARE * mean + max(r.size for r in rows)
    assert len(sizes) == 40 and max(abs(s - mean) for s in sizes.values()) <= slack
