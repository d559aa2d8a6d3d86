"""Quality rules: text statistics, and an ordered list of learned threshold rules.

Sequential covering: a rule for low quality is grown condition by condition on two
thirds of a bounded labelled sample, pruned on the rest and added to the list if it
still is precise there; the rows it covers leave the sample.  The list becomes one
ordered Spark conditional expression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm import samples
from contestry.llm import text as tx

#: Fixed values of the base check.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_letters")
_SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in COUNTS)

#: Ratios that rules are learned on, as Spark expressions over the counts.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "capital_share": "n_capitals / greatest(n_letters, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

_byte = np.arange(256)
_CAPITAL = (_byte >= 0x41) & (_byte <= 0x5A)
_LETTER = _CAPITAL | ((_byte >= 0x61) & (_byte <= 0x7A))
_MARK = ((_byte >= 0x21) & (_byte <= 0x2F)) | ((_byte >= 0x3A) & (_byte <= 0x40)) | ((_byte >= 0x5B) & (_byte <= 0x60)) | ((_byte >= 0x7B) & (_byte <= 0x7E))
_FIRST_BYTE = (_byte & 0xC0) != 0x80


def _count(member: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(member)])
    return np.diff(total[offsets])


def _repeated_words(words: tx.Words, count: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n = len(words.hashes) - REPEAT_WINDOW + 1
    if n <= 0:
        return np.zeros(count, np.int64)
    windows = tx.grams(words.hashes, REPEAT_WINDOW)
    places = np.flatnonzero(words.text[:n] == words.text[REPEAT_WINDOW - 1 :])
    order = places[np.lexsort((windows[places], words.text[places]))]
    same = (windows[order][1:] == windows[order][:-1]) & (words.text[order][1:] == words.text[order][:-1])
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    edges = np.bincount(twice, minlength=len(words.hashes) + 1) - np.bincount(twice + REPEAT_WINDOW, minlength=len(words.hashes) + 1)
    return np.bincount(words.text[np.cumsum(edges)[:-1] > 0], minlength=count)


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in tx.chunks(batch.column(1)):
            data, offsets = chunk.data, chunk.offsets
            member = tx.SPACED[data]
            words = tx.find_runs(data, offsets, member)
            lines = tx.find_runs(data, offsets, data != 10)
            filled = np.concatenate([[0], np.cumsum(member)])
            worded = filled[lines.ends] > filled[lines.starts]
            owner, hashes = lines.text[worded], lines.hashes[worded]
            order = np.lexsort((hashes, owner))
            equal = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
            counts = [
                np.diff(words.bounds),
                _count(member & _FIRST_BYTE[data], offsets),
                _count(_SYMBOLS[data], offsets),
                np.bincount(owner[order][1:][equal], minlength=chunk.count),
                _repeated_words(words, chunk.count),
                np.bincount(owner, minlength=chunk.count),
                _count(_MARK[data], offsets),
                _count(_CAPITAL[data], offsets),
                _count(_LETTER[data], offsets),
            ]
            ids = batch.column(0).slice(chunk.first, chunk.count)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` per row of ``docs``, over the whole text (null: empty, all 0).

    Words are runs of anything but white space; word_chars are their code points.
    n_dup_lines counts lines with a word that equal an earlier line of the text,
    n_repeat_words the words in eight-word windows that occur twice or more.  Rows
    are independent of each other, so repeated rows and null ids stay as they are.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_statistics_batches, _SCHEMA)


@dataclass(frozen=True)
class Condition:
    """A threshold on one feature."""

    feature: str
    above: bool
    value: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.value if self.above else table[self.feature] < self.value

    def column(self) -> Column:
        feature = F.expr(FEATURES[self.feature])
        return feature >= self.value if self.above else feature < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    """All conditions must hold; ``precision`` is the share of low quality it had when pruned."""

    conditions: tuple[Condition, ...]
    precision: float

    def covers(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(table) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _candidates(table: dict[str, np.ndarray], steps: int) -> list[Condition]:
    """Thresholds halfway between neighbouring values at ``steps`` quantiles of each feature."""
    found = []
    for name, values in table.items():
        distinct = np.unique(values)
        middles = (distinct[1:] + distinct[:-1]) / 2
        ranks = np.unique(np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, steps))))
        near = np.unique(np.clip(np.concatenate([ranks - 1, ranks]), 0, len(middles) - 1)) if len(middles) else []
        found += [Condition(name, above, float(middles[i])) for i in near for above in (True, False)]
    return found


def _take(table: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {name: values[rows] for name, values in table.items()}


def _grow(table: dict[str, np.ndarray], low: np.ndarray, steps: int, longest: int) -> tuple[Condition, ...]:
    """Adds the condition with most information gain until only low quality is covered."""
    conditions: list[Condition] = []
    while len(conditions) < longest and low.any() and not low.all():
        before = np.log2(low.mean())
        best, gain = None, 1e-9
        for condition in _candidates(table, steps):
            held = condition.holds(table)
            hits = int(low[held].sum())
            if hits and (gained := hits * (np.log2(hits / held.sum()) - before)) > gain:
                best, gain = condition, gained
        if best is None:
            break
        conditions.append(best)
        held = best.holds(table)
        table, low = _take(table, held), low[held]
    return tuple(conditions)


def _worth(rule: tuple[Condition, ...], table: dict[str, np.ndarray], low: np.ndarray) -> tuple[float, float, int]:
    """(hits less misses over all covered, precision, covered) on the pruning rows."""
    covered = Rule(rule, 0).covers(table)
    n, hits = int(covered.sum()), int(low[covered].sum())
    return ((2 * hits - n) / n, hits / n, n) if n else (-1.0, 0.0, 0)


def learn(
    table: dict[str, np.ndarray], low: np.ndarray, prune: np.ndarray,
    most: int = 12, longest: int = 4, steps: int = 48, precision: float = 0.9, least: int = 3,
) -> list[Rule]:
    """Ordered rules for rows marked ``low``; ``prune`` marks the rows kept for pruning.

    A rule needs ``precision`` on the pruning rows and must cover ``least`` of them.
    Without rows of both kinds there are no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(low), bool)
    while len(rules) < most:
        growing, pruning = left & ~prune, left & prune
        conditions = _grow(_take(table, growing), low[growing], steps, longest)
        if not conditions:
            break
        own, truth = _take(table, pruning), low[pruning]
        shorter = [conditions[:k] for k in range(1, len(conditions) + 1)]
        best = max(shorter, key=lambda c: (_worth(c, own, truth)[0], -len(c)))
        _, precise, covered = _worth(best, own, truth)
        if precise < precision or covered < least:
            break
        rules.append(Rule(best, precise))
        left &= ~rules[-1].covers(table)
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = samples.SAMPLE_ROWS) -> list[Rule]:
    """Rules from the statistics of at most ``rows`` labelled documents (labels.quality 0: low).

    Only that sample's few numbers per row come to the driver.
    """
    sample = samples.labelled(docs, labels, F.col("quality").cast("int"), rows)
    counted = statistics(sample).selectExpr("doc_id", *(f"{e} AS {n}" for n, e in FEATURES.items()))
    counted = counted.dropDuplicates(["doc_id"]).join(sample.select("doc_id", "target").distinct(), "doc_id")
    found = counted.toPandas().sort_values("doc_id")
    if found.empty:
        return []
    prune = np.array([zlib.crc32(b"prune%d" % i) % 3 == 0 for i in found["doc_id"]])
    return learn({n: found[n].to_numpy(float) for n in FEATURES}, found["target"].to_numpy() == 0, prune)


def first_rule(rules: list[Rule]) -> Column:
    """The text of the first rule that holds, or null: an ordered conditional expression."""
    column = None
    for rule in rules:
        held = F.lit(True)
        for condition in rule.conditions:
            held = held & condition.column()
        column = F.when(held, str(rule)) if column is None else column.when(held, str(rule))
    return F.lit(None).cast("string") if column is None else column


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics of every document, the base check, the rule that rejects it, and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = statistics(docs).withColumn("base_failed", failed).withColumn("rule", first_rule(rules))
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*base, kept.alias("kept"), "rule")
