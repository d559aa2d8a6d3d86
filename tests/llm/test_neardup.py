import re
from itertools import combinations

import pytest

from contestry.llm import graph, neardup
from tests_llm_helpers import rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size):
    """Component per row by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in combinations([s for s in sets if s[0] is not None], 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1) for i, s in sets)


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_brute_force(odd_docs, odd_rows, size):
    found = neardup.near_duplicates(odd_docs, shingle=size).collect()
    ours = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in found)
    assert ours == brute(odd_rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_real_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rows_of(docs, "doc_id", "text")
    found = neardup.near_duplicates(docs, shingle=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, 2)


def test_copies_of_one_text_are_linked_through_it(spark):
    """Copies that differ from each other by too much, and from their base by little."""
    base = [f"w{k}" for k in range(150)]
    rows = [(500, " ".join(base))]
    for k in range(60):
        own = list(base)
        for place in {(7 * k) % 150, (31 * k + 50) % 150, (53 * k + 11) % 150, (17 * k + 90) % 150, (71 * k + 30) % 150, (k * k) % 150}:
            own[place] = f"e{k}_{place}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(docs, shingle=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, 2)
    assert len({r.component_id for r in found}) < 30


def test_empty_table(no_docs):
    assert neardup.near_duplicates(no_docs).collect() == []


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901), (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {**{k: 0 for k in range(201)}, 900: 900, 901: 900}
