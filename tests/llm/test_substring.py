import random
import re

import numpy as np
import pyarrow as pa

from contestry.llm import substring
from contestry.llm import text as tx
from tests_llm_helpers import prose, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def repeated_windows(rows, size=50):
    """Ids with a window of ``size`` words that an earlier row, or place, has."""
    seen, found = set(), set()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = words(text)
        for s in range(len(own) - size + 1):
            window = tuple(own[s : s + size])
            if window in seen:
                found.add(doc)
            seen.add(window)
    return found


def test_odd_rows(odd_docs, odd_rows, no_docs):
    found = substring.remove_repeats(odd_docs)
    rows = rows_of(found, "doc_id", "text")
    assert len(rows) == len(odd_rows) and {r[0] for r in rows_of(found, "kept")} == {"x"}
    assert repeated_windows(rows) == set()
    before, after = dict(odd_rows), dict(rows)
    assert all(after[k] == before[k] for k in (5, 6, 7, 8, 9, 10, 11, 12, 15) if k != 15)
    assert words(after[13]) == words(prose(6, 30) + " " + prose(7, 40)) and words(after[14]) == []
    assert substring.remove_repeats(no_docs).collect() == []


def test_passages_inside_other_text_are_cut_exactly(spark):
    passage = prose(50, 51)
    rows = [(k, f"{prose(100 + k, 20 + 3 * k)} {passage}\n{prose(200 + k, 10 + k)}") for k in range(25)]
    rows += [(50, prose(60, 300)), (51, prose(61, 40) + " " + " ".join(prose(50, 51).split()[:45]) + " " + prose(62, 40))]
    found = substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = {r.doc_id: r for r in found}
    assert by_id[0].n_removed == 0 and by_id[50].n_removed == 0 and by_id[51].n_removed == 0
    for k in range(1, 25):
        assert words(by_id[k].text) == words(prose(100 + k, 20 + 3 * k) + " " + prose(200 + k, 10 + k)) and by_id[k].sources == [0]


def test_edited_paragraphs_are_removed(spark):
    line = prose(70, 120).split()
    edited = " ".join([*line[:30], "changed", *line[31:80], "too", *line[81:]])
    rows = [(1, prose(71, 60) + "\n" + " ".join(line)), (2, prose(72, 60) + "\n" + edited + "\n" + prose(73, 60))]
    found = {r.doc_id: r for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert words(found[2].text) == words(prose(72, 60) + " " + prose(73, 60)) and found[2].sources == [1]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = rows_of(docs, "doc_id", "text")
    found = substring.report(docs)
    changed = {r.doc_id for r in found.where("n_removed > 0").collect()}
    assert repeated_windows(before) <= changed
    assert len(repeated_windows(rows_of(found, "doc_id", "text"))) <= 1  # a cut may join words to a new window


def test_bands_reach_the_recall():
    for rows in (1, 2, 3):
        bands = substring.bands_for(0.8, rows)
        assert 1 - (1 - 0.8**rows) ** bands >= substring.RECALL > 1 - (1 - 0.8**rows) ** (bands - 1)


def by_id(spark, rows):
    return {r.doc_id: r for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def edited(text, places, mark):
    return " ".join(f"{mark}{k}" if k in places else w for k, w in enumerate(text.split()))


def test_short_repeats_side_by_side_stay(spark):
    rows = [(k, f"{prose(300 + k, 30)} {prose(400 + k, 45)} {prose(500 + k, 30)}") for k in range(20)]
    rows += [(100 + k, f"{prose(600 + k, 30)} {prose(400 + k, 45)} {prose(401 + k, 45)} {prose(700 + k, 30)}") for k in range(19)]
    rows += [(200, f"{prose(800, 70)} {prose(801, 70)}"), (201, f"{prose(802, 60)} {prose(800, 70)} one two {prose(801, 70)} {prose(803, 60)}")]
    found = by_id(spark, rows)
    assert [k for k, r in found.items() if r.n_removed] == [201] and found[201].n_removed == 142  # a gap of three words goes too


def test_copies_of_a_line_meet_though_their_head_is_longer(spark):
    places, rows = range(44, 300, 45), []
    for group in range(16):
        line = prose(2000 + group, 300)
        rows += [(100 * group + k, edited(line, places, f"edit{k}")) for k in range(1, 5)] + [(100 * group + 50, f"{line} {line}")]
    found = by_id(spark, rows)
    assert all(found[100 * group + 1].n_removed == 0 for group in range(16))
    assert [100 * group + k for group in range(16) for k in range(2, 5) if found[100 * group + k].text.strip()] == []


def test_passage_whose_pieces_came_up_before_in_an_excerpt(spark):
    rows = []
    for k in range(20):
        passage = prose(1000 + k, 55).split()
        rows.append((k, f"{prose(1100 + k, 20)} {' '.join(passage[7:47])} {prose(1200 + k, 20)}"))
        rows += [(n + k, f"{prose(n + 1300 + k, 30)} a{n} {' '.join(passage)} z{n} {prose(n + 1400 + k, 30)}") for n in (100, 200, 300)]
    found = by_id(spark, rows)
    for k in range(20):
        assert found[k].n_removed == 0 and found[100 + k].n_removed == 0
        assert all(found[n + k].n_removed == 55 and 100 + k in found[n + k].sources for n in (200, 300))


def test_paragraphs_of_short_lines_are_compared(spark):
    def wrapped(text, width):
        own = text.split()
        return "\n".join(" ".join(own[s : s + width]) for s in range(0, len(own), width))

    passage = prose(1500, 200)
    copy = edited(passage, (40, 80, 120, 160), "edit")
    rows = [(1, f"{wrapped(passage, 20)}\n\n{prose(1501, 60)}"), (2, f"{prose(1502, 60)}\n{wrapped(copy, 20)}"), (3, f"{prose(1503, 60)}\n\n{wrapped(copy, 13)}"), (4, copy)]
    # among other short lines: long passages with few edits
    long = prose(1504, 900)
    rows += [(5, wrapped(f"{prose(1505, 100)} {long} {prose(1506, 100)}", 20)), (6, wrapped(f"{prose(1507, 130)} {edited(long, range(48, 900, 49), 'e')} {prose(1508, 70)}", 12))]
    rows += [(7, wrapped(prose(1509, 700), 4)), (8, "\n\n".join(prose(1510 + k, 20) for k in range(30)))]
    found = by_id(spark, rows)
    assert all(found[k].n_removed == 200 for k in (2, 3, 4)) and all(found[k].n_removed == 0 for k in (1, 5, 7, 8))
    assert 50 <= found[6].n_removed <= 900  # parts of it; edits this dense leave few parts similar enough


def test_text_that_repeats_itself_keeps_few_pieces_and_windows(spark):
    """Texts of one word, or one short line, again and again: cut as before, without a row for every place."""
    periods = [prose(1600 + k, k) for k in (1, 3, 7, 20)]
    rows = [(k, f"{prose(1700 + k, 40)} {' '.join([p] * (2000 // len(p.split())))} {prose(1800 + k, 40)}") for k, p in enumerate(periods)]
    rows += [(10 + k, f"{prose(1710 + k, 40)} {' '.join([p] * 30)}") for k, p in enumerate(periods)]
    bits = np.full(1 << 24, 255, np.uint8)
    for chunk in tx.chunks(pa.array([text for _, text in rows])):
        pieces = substring._mark_chunk(chunk, bits).field("pieces").to_pylist()
        marks = substring._Marks(chunk)
        assert [sum(p["times"] for p in own) for own in pieces] == np.bincount(marks.words.text[marks.places], minlength=len(rows)).tolist()
        assert max(len(own) for own in pieces) < 40 and min(sum(p["times"] for p in own) for own in pieces[:4]) >= 100
    found = by_id(spark, rows)
    after = [(k, r.text) for k, r in found.items()]
    assert {k for k, r in found.items() if r.n_removed} == repeated_windows(rows) and len(repeated_windows(after)) == 0
    assert all(words(found[k].text)[:40] == words(rows[k][1])[:40] for k in range(4))


def test_equal_windows_that_overlap_are_one():
    places = np.array([0, 1, 2, 3, 100, 160, 5, 7])
    owner, columns = substring._windows(np.array([0] * 6 + [1] * 2), places, np.array([9, 8, 9, 9, 9, 9, 4, 4]))
    assert owner.tolist() == [0, 0, 0, 0, 1]
    assert list(zip(*(c.to_pylist() for c in columns), strict=True)) == [(1, 1, 1, 1, 8), (0, 2, 3, 3, 9), (100, 100, 100, 1, 9), (160, 160, 160, 1, 9), (5, 7, 7, 2, 4)]


def test_parts_beyond_spans_equal_those_of_a_plain_search():
    chance = random.Random(5)
    for _ in range(200):
        spans, extras = ([(a, a + chance.randint(1, 30), chance.randint(1, 4)) for a in (chance.randint(0, 120) for _ in range(n))] for n in (chance.randint(0, 6), chance.randint(0, 8)))
        free = [p for p in range(160) if any(a <= p < b for a, b, _ in extras) and not any(a <= p < b for a, b, _ in spans)]
        runs = [[free[i] for i in range(s, e)] for s, e in _bounds(free)]
        wanted = set()
        for run in runs:
            low, high = run[0], run[-1] + 1
            beside = {s for a, b, s in spans if a <= high and b >= low}
            wanted |= {(p, s) for a, b, s in extras if high - low > substring.BRIDGE or s in beside for p in range(max(a, low), min(b, high))}
        found = substring._beyond(spans, extras)
        assert {(p, s) for a, b, s in found for p in range(a, b)} == wanted


def _bounds(places):
    starts = [i for i, p in enumerate(places) if i == 0 or places[i - 1] != p - 1]
    return list(zip(starts, [*starts[1:], len(places)], strict=False))
