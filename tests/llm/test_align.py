import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from contestry.llm import align, encoders

STRANGE = ["a<|endoftext|>b </s><s>", "two  spaces \n and\t tabs  ", "▁ looks like a space", "\x00 \x01", "😀😀 한국어 ½²³ ١٢", "don't WE'LL", " ", "ends ", "é" * 3000, "　 x\xa0y \x85 z"]


@given(st.sets(st.integers(1, 80)), st.sets(st.integers(1, 80)), st.integers(0, 60))
def test_runs_and_groups_end_where_both_sides_end(a, b, run):
    a, b = (sorted({100, *ends, *range(101, 101 + run)}) for ends in (a, b))
    ends_a, ends_b = align.align(np.array(a), np.array(b))
    common = sorted(set(a) & set(b))
    assert [a[i - 1] for i in ends_a] == common and [b[j - 1] for j in ends_b] == common


def test_nothing_and_one_long_run():
    assert [x.tolist() for x in align.align(np.empty(0, int), np.empty(0, int))] == [[], []]
    assert [x.tolist() for x in align.align(np.arange(1, 1000), np.arange(1, 1000))] == [[*range(1, 1000)]] * 2


def brute(rows):
    """The summary by sets of ends, with libraries called on whole texts."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    letters = encoders.byte_letters()
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        name = model.id_to_piece(i)
        return bytes.fromhex(name[3:5]) if name.startswith("<0x") and name.endswith(">") and len(name) == 6 else name.replace("▁", " ").encode()

    found = []
    for doc_id, own in rows:
        own = own or ""
        a, b = library.encode(" " + own, add_special_tokens=False).ids, model.encode(own)
        sides = [[bytes(letters[c] for c in library.id_to_token(i)) for i in a], list(map(piece, b))]
        if not own or any(b"".join(s) != (" " + own).encode() for s in sides):
            a, b, sides = [], [], [[], []]
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] if len(s) < 400 else _running(s) for s in sides]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, at = [], [], [0, 0]
        for end in common:
            to = [ends[0].index(end, at[0]) + 1, ends[1].index(end, at[1]) + 1]
            groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            links.append((a[to[0] - 1], b[to[1] - 1]))
            at = to
        found.append((doc_id, len(a), len(b), groups, links))
    count = Counter(link for *_, links in found for link in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


def _running(side):
    ends, total = [], 0
    for token in side:
        total += len(token)
        ends.append(total)
    return ends


def key(row):
    return repr(row)


def test_summaries_and_groups_match_brute_force(spark, odd_docs, odd_rows, no_docs):
    rows = [*odd_rows, *((1000 + k, t) for k, t in enumerate(STRANGE))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS pairs", "0 AS n", "'y' AS best").repartition(5)
    expected = brute(rows)
    assert sorted(map(tuple, align.summaries(docs).collect()), key=key) == sorted(expected, key=key)
    spans = align.groups(docs).collect()
    assert sorted((r.doc_id or -1, len(r.a_ids), len(r.b_ids), len(r.a_ends), len(r.b_ends)) for r in spans) == sorted((e[0] or -1, e[1], e[2], e[3], e[3]) for e in expected)
    assert all(not r.a_ends or (r.a_ends[-1], r.b_ends[-1]) == (len(r.a_ids), len(r.b_ids)) for r in spans)
    assert align.summaries(no_docs).collect() == [] and align.groups(no_docs).collect() == []


def test_given_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, align.summaries(docs).collect())) == sorted(brute(rows))


def test_linked_tokens_are_suffixes_of_each_other():
    a, b = encoders.byte_level(align.default_paths()[0], True), encoders.pieces(align.default_paths()[1])
    sides = a.token_bytes(), b.token_bytes()
    known = set(sides[0])
    pairs = sum(sum(token[k:] in known for k in range(len(token))) for token in set(sides[1]))
    assert all(sides[0]) and all(sides[1])
    assert pairs <= sum(map(len, sides[1])) < 200_000


def test_chunks_forgotten_or_kept_and_learnt_again_give_the_same_ids(monkeypatch):
    whole = encoders.ByteLevel(align.default_paths()[0], False)
    texts = [*STRANGE, *["common words " * 3 + f"rare{k} words" for k in range(40)]]
    expected = [e.ids for e in whole.library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(encoders, "_JOINED", 3)
    for room in (0, 200, 5000):
        monkeypatch.setattr(encoders, "_KEPT_CHARS", room)
        model = encoders.Remembered(whole)
        for first in (0, 20, 0, 30):
            ((ids, bounds),) = model.encode(texts[first : first + 20])
            assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == expected[first : first + 20]
