import random

import public_tokenizers
from tokenizers import Tokenizer

from contestry.llm import bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
STRANGE = ["a<|endoftext|>b <|startoftext|>'s It's ΑΣ ΣΑΣ. İstanbul é", "\x1c\x1d a\x1fb \u0085 x\xa0y", "a" * 3001, "ab" * 500, "😀😀 한국어 ½²³ ١٢", "don't WE'LL 'sing ''s", "ﬁ ẞ ǅ", "<|END"]


def test_ids_and_text_match_the_library(spark, odd_docs, odd_rows):
    texts = [t or "" for _, t in odd_rows] + STRANGE
    rng = random.Random(5)
    texts += ["".join(rng.choice("aàbé zß '’s1٣!?#\n\t—中ñ") for _ in range(rng.randrange(200))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    for k, (text, own) in enumerate(zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True)):
        assert found[k].ids == own.ids, text
        assert found[k].decoded == LIBRARY.decode(own.ids, skip_special_tokens=False)
    once = bpe.round_trip(docs).collect()
    assert all(r == found[r.doc_id] for r in once) and len(once) == len(texts)
    assert bpe.encode(odd_docs).count() == len(odd_rows)


def test_chunks_forgotten_and_learnt_again_give_the_same_ids(monkeypatch):
    model = bpe.Merges(bpe.default_path())
    first = [model.encode([t])[0].tolist() for t in STRANGE]
    monkeypatch.setattr(bpe, "_KEPT_CHARS", 0)
    assert [model.encode([t])[0].tolist() for t in STRANGE] == first


def test_empty_table_and_null_ids(spark, no_docs):
    assert bpe.encode(no_docs).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [9_999_999, 0])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd).orderBy("doc_id").collect()] == ["", "!"]
