"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contestry.llm import align, bpe, chat, decontam, neardup, pages, quality, repair, rules, shards, substring, tokenfiles, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every document."""
    docs = _table(spark, sf_dir, "documents")
    graded = quality.grade(docs.select("doc_id", "text"), quality.fit(docs, _table(spark, sf_dir, "labels")))
    return graded.select("doc_id", "expected_grade", "tails", "kept")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar sets of two-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.main_text(_table(spark, sf_dir, "pages"))


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_learned_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics of every document and the verdict of the learned rules."""
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, _table(spark, sf_dir, "labels")))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, 40 shards of near-equal bytes."""
    return shards.plan(_table(spark, sf_dir, "documents"), 40)


def op8_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and one of control strings, read back from their tokens."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.read_back(chat.format_conversations(turns.unionByName(chat.planted(spark)))))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents")))


def op10_paragraph_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that occurred before."""
    return substring.report(_table(spark, sf_dir, "documents"))


def op11_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups of two tokenizers' tokens of every document, and how common its links are."""
    return align.summaries(_table(spark, sf_dir, "documents"))


def op12_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from token files."""
    return tokenfiles.documents(tokenfiles.write(_table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by checksum."""
    return repair.report(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_style_tree_text": op3_style_tree_text,
    "op4_winnowing_decontamination": op4_winnowing_decontamination,
    "op5_counterfactual_toxicity": op5_counterfactual_toxicity,
    "op6_learned_decision_list": op6_learned_decision_list,
    "op7_histogram_shards": op7_histogram_shards,
    "op8_chat_tokens": op8_chat_tokens,
    "op9_bpe": op9_bpe,
    "op10_paragraph_substring_dedup": op10_paragraph_substring_dedup,
    "op11_diagonal_alignment": op11_diagonal_alignment,
    "op12_arrow_token_files": op12_arrow_token_files,
    "op13_conversation_repair": op13_conversation_repair,
}

_PLAIN_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_OP4 = f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS k FROM i WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS words
  FROM (SELECT item_id, w, least(10, len(w)) AS k,
               unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
        FROM i WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM d CROSS JOIN sizes WHERE len(w) >= k)),
hits AS (
  SELECT doc_id, item_id, x.k AS k, s
  FROM doc_windows x JOIN item_windows y ON x.k = y.k AND x.words = y.words),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_ESCAPED = "replace({}, chr(92), chr(92) || chr(92))"
for _control in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}' || chr(92) || '{_control[1:]}')"

_OP8 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

# a checksum bit by bit, then the least (cost, edits, turns) for each row and state in turn
_OP13 = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
summed AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                             lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM damaged),
marked AS (
  SELECT conv_id, turn, place, role, text, substr(role, 1, 1) AS initial,
         CASE WHEN trimmed = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(trimmed, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM numbered),
counted AS (
  SELECT conv_id, max(place) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
put(state, after, price, edits, says) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'),
  (2, 3, 5, 'I', chr(10) || 'assistant:'),
  (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
taken(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
steps AS (
  SELECT m.conv_id, m.place, p.state, t.after, p.price + 5 * CAST(m.fault = 't' AS INT) AS price, p.edits || 'K' AS edits,
         p.says || chr(10) || m.role || ':' || m.text AS says
  FROM marked m CROSS JOIN put p JOIN taken t ON t.state = p.after AND t.initial = m.initial WHERE m.fault IN ('', 't')
  UNION ALL
  SELECT m.conv_id, m.place, p.state, CASE WHEN p.after = 2 THEN 3 ELSE 2 END, p.price + 1 + 5 * CAST(m.fault = 't' AS INT), p.edits || 'R',
         p.says || chr(10) || CASE WHEN p.after = 2 THEN 'assistant' ELSE 'user' END || ':' || m.text
  FROM marked m CROSS JOIN put p WHERE m.fault IN ('', 't')
  UNION ALL
  SELECT m.conv_id, m.place, p.state, p.after, p.price + 2, p.edits || 'D', p.says FROM marked m CROSS JOIN put p),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, 0 AS state, {'cost': CAST(0 AS BIGINT), 'edits': '', 'says': ''} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.place + 1, s.after, min({'cost': w.best.cost + s.price, 'edits': w.best.edits || s.edits, 'says': w.best.says || s.says})
  FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.place = w.place + 1 AND s.state = w.state
  GROUP BY w.conv_id, w.place, s.after),
done AS (
  SELECT c.conv_id, min({'cost': w.best.cost + p.price, 'edits': w.best.edits || p.edits, 'says': w.best.says || p.says}) AS best
  FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.place = c.n JOIN put p ON p.state = w.state
  WHERE p.after IN (0, 3) GROUP BY c.conv_id)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.edits, '') AS audit, sha256(substr(coalesce(best.says, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM k.conv_id
"""

ORACLE: dict[str, str] = {"op4_winnowing_decontamination": _OP4, "op8_chat_tokens": _OP8, "op13_conversation_repair": _OP13}
