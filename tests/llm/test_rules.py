import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from contestry.llm import rules
from tests_llm_helpers import rows_of


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    places = defaultdict(list)
    for s in range(len(words) - 7):
        places[tuple(words[s : s + 8])].append(s)
    repeated = {k for own in places.values() if len(own) > 1 for s in own for k in range(s, s + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(repeated)


def test_statistics_match_brute_force(spark, odd_docs, odd_rows, no_docs):
    more = [(100, "a|b #x <y>\nsame\nsame\n same\n\n \nsame"), (101, "p q r s t u v w " * 5), (102, "é中 ß\u0085x\n\r\n")]
    docs = odd_docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("kept", F.lit("y")))
    found = rules.statistics(docs).collect()
    ours = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert ours == sorted((i or -1, *brute(t)) for i, t in odd_rows + more)
    assert rules.statistics(no_docs).collect() == []


def test_rules_are_learnt_and_ordered():
    rng = np.random.default_rng(3)
    table = {"words": rng.uniform(0, 100, 3000), "capital_share": rng.uniform(0, 1, 3000)}
    low = ((table["words"] < 20) & (table["capital_share"] > 0.5)) | (table["capital_share"] > 0.9)
    found = rules.learn(table, low, np.arange(3000) % 3 == 0)
    covered = np.logical_or.reduce([r.covers(table) for r in found])
    assert len(found) >= 2 and (covered == low).mean() > 0.98
    assert rules.learn(table, np.zeros(3000, bool), np.arange(3000) % 3 == 0) == []


def test_verdicts_on_given_documents(spark, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = rules.judge(docs, rules.fit(docs, labels)).join(labels, "doc_id").where("n_words >= 20")
    right = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.97
    assert rules.judge(no_docs, []).collect() == [] and rules.fit(docs, labels.limit(0)) == []


def test_first_rule_is_an_ordered_expression(spark):
    listed = [rules.Rule((rules.Condition("words", False, 5.0),), 1.0), rules.Rule((rules.Condition("words", True, 2.0), rules.Condition("symbols_per_word", True, 0.5)), 1.0)]
    counts = spark.createDataFrame([(3, 3), (30, 30), (30, 0)], "n_words long, n_symbols long")
    assert [r[0] for r in counts.select(rules.first_rule(listed)).collect()] == ["words < 5", "words >= 2 and symbols_per_word >= 0.5", None]
    assert rows_of(counts.select(rules.first_rule([]).alias("r")), "r") == [(None,)] * 3
