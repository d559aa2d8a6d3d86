import hashlib
import re

from contestry.llm import decontam
from tests_llm_helpers import rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(10, len(own))
        for s in range(len(own) - size + 1 if own and item is not None else 0):
            windows.setdefault(tuple(own[s : s + size]), set()).add(str(item))
    found = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(own) - size + 1):
                if tuple(own[s : s + size]) in windows:
                    hit.update(range(s, s + size))
                    names |= windows[tuple(own[s : s + size])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found.append((-1 if doc is None else doc, len(own), len(hit), len(names), digest, bool(hit)))
    return sorted(found)


def report(docs, items):
    found = decontam.report(docs, items).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)


def test_windows_match_brute_force(spark, odd_docs, odd_rows):
    base = odd_rows[0][1].split()
    items = [(1, " ".join(base[30:55])), (2, "ONE, two!"), (3, "solo"), (4, None), (5, ""), (6, " ".join(base[50:62])), (7, " ".join(base[5:14]))]
    items += [(10, " ".join(base[40:50])), (None, "one two"), (11, "straße ✓"), (12, " ".join(base[40:50])), (12, "solo"), (13, "..."), (14, " ".join(reversed(base[:20])))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert report(odd_docs, benchmark) == brute(odd_rows, items)
    assert report(odd_docs, benchmark.limit(0)) == brute(odd_rows, [])
    assert report(odd_docs.limit(0), benchmark) == []


def test_every_shared_span_of_ten_words_is_found(spark):
    item = [f"i{k}" for k in range(60)]
    docs = [(s * 100 + n, " ".join(["a"] * 7 + item[s : s + n] + ["b"] * 6)) for s in range(0, 50, 3) for n in (9, 10, 11, 17) if s + n <= 60]
    items = [(1, " ".join(item))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert report(frame, spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_real_documents_match_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert report(docs, items) == brute(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text"))
