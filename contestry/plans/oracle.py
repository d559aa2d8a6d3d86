"""SQL twins of the registered queries, written for an independent engine.

Each named block below is one common table expression; ``query`` puts the
blocks a statement mentions, and the blocks those mention, in front of it.
"""

from __future__ import annotations

import re

from contestry.functions.rating import TUNED
from contestry.operators.ratings import grid_params
from contestry.plans.views import DIVISIONS

_BLOCKS: dict[str, str] = {}
# Blocks that end a recursion and are read more than once.
_READ_TWICE = ("ratings", "grid_pre", "tuning_chain", "chain")


def block(name: str, sql: str) -> None:
    _BLOCKS[name] = sql.strip()


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [name for name in _BLOCKS if name in words]


def query(select: str) -> str:
    """The statement with every block it needs, in definition order."""
    needed: set[str] = set()
    todo = _used(select)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _used(_BLOCKS[name]) if n != name]
    body = select.strip()
    if not needed:
        return body
    parts = [
        f"{name}{_BLOCKS[name]}"
        if _BLOCKS[name].startswith("(")
        else f"{name} AS {'MATERIALIZED ' if name in _READ_TWICE else ''}(\n{_BLOCKS[name]}\n)"
        for name in _BLOCKS
        if name in needed
    ]
    own = body.startswith("WITH ")
    joint = ",\n" if own else "\n"
    return "WITH RECURSIVE " + ",\n".join(parts) + joint + (body[len("WITH ") :] if own else body)


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- input views ------------------------------------------------------------

block(
    "pairs",
    """
SELECT * FROM (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderkey // 1048576 AS block,
         o_orderpriority AS priority, row_number() OVER w AS rn,
         o_orderkey AS a_order, o_custkey AS a_cust, o_orderstatus AS a_status,
         o_totalprice AS a_price, CAST(o_orderdate AS DATE) AS a_day,
         lead(o_orderkey) OVER w AS b_order, lead(o_custkey) OVER w AS b_cust,
         lead(o_orderstatus) OVER w AS b_status, lead(o_totalprice) OVER w AS b_price,
         CAST(lead(o_orderdate) OVER w AS DATE) AS b_day,
         (row_number() OVER w - 1) // 2 AS bout, (row_number() OVER w - 1) // 24 AS card
  FROM orders
  WINDOW w AS (PARTITION BY date_trunc('week', o_orderdate), o_orderkey // 1048576
               ORDER BY CAST(o_orderdate AS DATE), o_orderkey)
) WHERE rn % 2 = 1 AND b_order IS NOT NULL AND a_cust <> b_cust
""",
)
block(
    "raw_contests",
    f"""
SELECT printf('%016x', a_order) AS contest_id, a_order, b_order, b_day AS day, week, block, card, bout,
       printf('%016x', a_cust) AS r_id, printf('%016x', b_cust) AS b_id,
       CASE WHEN a_status = b_status AND a_status IN ('P', 'O') THEN NULL
            WHEN a_price > b_price THEN 'a' ELSE 'b' END AS won,
       CASE WHEN a_status = b_status AND a_status = 'P' THEN 'Overturned'
            WHEN priority[1] = '1' THEN 'KO/TKO' WHEN priority[1] = '2' THEN 'Submission'
            WHEN priority[1] = '3' THEN 'Decision - Split' WHEN priority[1] = '4' THEN 'Decision - Unanimous'
            ELSE 'DQ' END AS method_raw,
       CASE WHEN a_order % 7 = 0 THEN 5 ELSE 3 END AS planned,
       ([{_quoted(DIVISIONS)}])[a_order % 9 + 1] AS division,
       a_cust, b_cust
FROM pairs
""",
)
block(
    "contests",
    """
SELECT contest_id, day AS date, r_id AS a_id, b_id, a_order, b_order, week, block, card, bout,
       CASE WHEN won IS NULL AND method_raw IN ('Overturned', 'DQ') THEN 'nc'
            WHEN won IS NULL THEN 'draw' ELSE won END AS winner,
       CASE method_raw WHEN 'KO/TKO' THEN 'ko_tko' WHEN 'Submission' THEN 'submission'
            WHEN 'Decision - Split' THEN 'decision' WHEN 'Decision - Unanimous' THEN 'decision' END AS method,
       method_raw,
       CASE method_raw WHEN 'Decision - Split' THEN 'split'
            WHEN 'Decision - Unanimous' THEN 'unanimous' END AS decision_subtype,
       CASE WHEN method_raw IN ('KO/TKO', 'Submission') THEN a_order % planned + 1 END AS finish_round,
       CASE WHEN a_order % 31 <> 0 THEN planned END AS scheduled_rounds,
       CASE a_order % 9 WHEN 0 THEN 'Women''s Strawweight' WHEN 1 THEN 'Light Heavyweight'
            WHEN 2 THEN 'Heavyweight' WHEN 3 THEN 'Lightweight' WHEN 4 THEN 'Catch Weight'
            WHEN 5 THEN 'Middleweight' WHEN 6 THEN 'Bantamweight' WHEN 7 THEN 'Open Weight' END AS weight_class,
       (a_order % 13 <> 0 AND a_order % 7 = 0) AS title_fight,
       CAST(CASE WHEN method_raw IN ('Decision - Split', 'Decision - Unanimous') AND a_order % 31 <> 0
                 THEN planned * 300
                 ELSE (a_order % planned) * 300 + b_order % 300 END AS DOUBLE) AS duration_sec
FROM raw_contests
""",
)
block("rated", "SELECT * FROM contests WHERE winner IN ('a', 'b', 'draw')")
block("decisive", "SELECT * FROM contests WHERE winner IN ('a', 'b')")
block(
    "order_stats",
    """
SELECT l_orderkey AS ord, CAST(count(*) FILTER (l_quantity > 45) AS DOUBLE) AS kd,
       sum(l_quantity) AS sig_landed, sum(l_quantity) + sum(l_linenumber) AS sig_attempted,
       sum(l_quantity) + count(*) AS total_landed,
       sum(l_quantity) + count(*) + sum(l_linenumber) AS total_attempted,
       CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS td_landed,
       CAST(count(*) AS DOUBLE) AS td_attempted,
       CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS sub_att,
       CAST(sum(CAST(round(l_discount * 100) AS INTEGER)) * 10 AS DOUBLE) AS ctrl_sec
FROM lineitem GROUP BY l_orderkey
""",
)
block(
    "side_stats",
    """
SELECT contest_id, side, competitor_id, s.* EXCLUDE (ord)
FROM (SELECT contest_id, 'a' AS side, a_id AS competitor_id, a_order AS ord FROM contests
      UNION ALL SELECT contest_id, 'b', b_id, b_order FROM contests) x
LEFT JOIN order_stats s ON s.ord = x.ord
""",
)
block(
    "competitors",
    """
SELECT printf('%016x', c_custkey) AS competitor_id, c_custkey,
       CASE WHEN c_custkey % 17 = 0 THEN NULL
            WHEN c_custkey % 13 = 0 THEN 'Gemel ' || (c_custkey // 26)
            WHEN c_custkey % 5 = 0 THEN 'José ' || c_name ELSE c_name END AS name,
       CAST(CASE WHEN c_custkey % 19 <> 0 THEN 150 + c_custkey % 60 END AS DOUBLE) AS height_cm,
       CAST(CASE WHEN c_custkey % 7 <> 0 THEN 150 + c_custkey * 37 % 60 END AS DOUBLE) AS reach_cm,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Southpaw'
            WHEN c_mktsegment <> 'FURNITURE' THEN 'Orthodox' END AS stance,
       CASE WHEN c_custkey % 11 <> 0 THEN DATE '1960-01-01' + CAST(c_custkey % 14000 AS INTEGER) END AS dob
FROM customer
""",
)
block(
    "listed",
    """
SELECT k, CASE WHEN k % 17 = 0 THEN 'Unknown ' || plain WHEN k % 13 = 0 THEN 'Gemel ' || (k // 26)
               WHEN k % 5 = 0 THEN 'Jose ' || plain WHEN k % 7 = 3 THEN upper(plain) ELSE plain END AS listed_name
FROM (SELECT c_custkey AS k, printf('Customer#%09d', c_custkey) AS plain FROM customer)
""",
)
block(
    "raw_quotes",
    """
SELECT printf('%016x', a_order) AS contest_id, a_order, book AS load_order,
       CASE WHEN flipped THEN lb.listed_name ELSE la.listed_name END AS competitor_1,
       CASE WHEN flipped THEN la.listed_name ELSE lb.listed_name END AS competitor_2,
       CASE WHEN linked THEN printf('%016x', CASE WHEN flipped THEN b_cust ELSE a_cust END) END AS f1_id,
       CASE WHEN linked THEN printf('%016x', CASE WHEN flipped THEN a_cust ELSE b_cust END) END AS f2_id,
       CASE WHEN flipped THEN odds_b ELSE odds_a END AS odds_1,
       CASE WHEN flipped THEN odds_a ELSE odds_b END AS odds_2
FROM (
  SELECT a_order, a_cust, b_cust, book, a_order % 3 = 0 AS flipped,
         a_order % 5 <> 0 AND book <> 1 AS linked,
         max(odds) FILTER (side = 'a') AS odds_a, max(odds) FILTER (side = 'b') AS odds_b
  FROM (SELECT a_order, a_cust, b_cust, 'a' AS side, a_order AS ord FROM pairs
        UNION ALL SELECT a_order, a_cust, b_cust, 'b', b_order FROM pairs)
  JOIN (SELECT l_orderkey AS ord, l_linenumber AS book, 1.1 + 40 * max(l_discount) AS odds
        FROM lineitem GROUP BY ALL) USING (ord)
  GROUP BY a_order, a_cust, b_cust, book
) q JOIN listed la ON la.k = a_cust JOIN listed lb ON lb.k = b_cust
""",
)

# --- ratings ----------------------------------------------------------------

block(
    "totals",
    """
SELECT contest_id, sum(sig_landed) AS sig, sum(td_landed) AS td, sum(sub_att) AS sub, sum(ctrl_sec) AS ctrl
FROM side_stats GROUP BY contest_id
""",
)
block(
    "shares",
    """
SELECT contest_id, CASE WHEN total = 0 THEN 0.5 ELSE sig / total END AS share
FROM (SELECT contest_id, coalesce(sig, 0) AS sig,
             coalesce(sig, 0) + (5.0 * (coalesce(td, 0) + coalesce(sub, 0)) + coalesce(ctrl, 0) / 60.0) AS total
      FROM totals)
""",
)
block(
    "side_rows",
    """
SELECT contest_id, date, 'a' AS side, a_id AS competitor_id FROM rated
UNION ALL SELECT contest_id, date, 'b', b_id FROM rated
""",
)
block(
    "ordinals",
    """
SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY date, contest_id) AS ordinal FROM side_rows
""",
)
block(
    "chain",
    """
SELECT c.contest_id, c.date, c.a_id, c.b_id, oa.ordinal AS ka, ob.ordinal AS kb, s.share,
       CASE c.winner WHEN 'a' THEN 1.0::DOUBLE WHEN 'b' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score,
       coalesce(c.method IN ('ko_tko', 'submission'), false) AS finish
FROM rated c JOIN shares s USING (contest_id)
JOIN ordinals oa ON oa.contest_id = c.contest_id AND oa.side = 'a'
JOIN ordinals ob ON ob.contest_id = c.contest_id AND ob.side = 'b'
""",
)
block(
    "params",
    f"SELECT * FROM (VALUES (0, {TUNED.k_early}::DOUBLE, {TUNED.k_late}::DOUBLE, {TUNED.early_contests}, "
    f"{TUNED.finish_bonus}::DOUBLE)) v(pid, k_early, k_late, early, bonus)",
)
_GRID = ", ".join(
    f"({i}, {p.k_early}::DOUBLE, {p.k_late}::DOUBLE, {p.early_contests}, {p.finish_bonus}::DOUBLE)"
    for i, p in enumerate(grid_params())
)
block("grid", f"SELECT * FROM (VALUES {_GRID}) v(pid, k_early, k_late, early, bonus)")


def _recursion(params: str, chain: str) -> str:
    """Keyed recursion: the state of a competitor, with its history as a list."""
    return f"""(pid, competitor_id, ro, rs, rg, k, contest_id, hist) USING KEY (pid, competitor_id) AS (
  SELECT p.pid, c.competitor_id, 1500.0::DOUBLE, 1500.0::DOUBLE, 1500.0::DOUBLE, 0::BIGINT, NULL::VARCHAR,
         []::STRUCT(contest_id VARCHAR, date DATE, side VARCHAR, pre_overall DOUBLE, pre_striking DOUBLE,
                    pre_grappling DOUBLE, pre_fights BIGINT, post_overall DOUBLE, post_striking DOUBLE,
                    post_grappling DOUBLE)[]
  FROM {params} p CROSS JOIN (SELECT a_id AS competitor_id FROM {chain} UNION SELECT b_id FROM {chain}) c
  UNION
  SELECT pid, CASE WHEN first THEN a_id ELSE b_id END,
         CASE WHEN first THEN po_a ELSE po_b END, CASE WHEN first THEN ps_a ELSE ps_b END,
         CASE WHEN first THEN pg_a ELSE pg_b END, CASE WHEN first THEN ka ELSE kb END, contest_id,
         CASE WHEN first THEN list_append(hist_a, {{'contest_id': contest_id, 'date': date, 'side': 'a',
                'pre_overall': ra, 'pre_striking': sa, 'pre_grappling': ga, 'pre_fights': ka - 1,
                'post_overall': po_a, 'post_striking': ps_a, 'post_grappling': pg_a}})
              ELSE list_append(hist_b, {{'contest_id': contest_id, 'date': date, 'side': 'b',
                'pre_overall': rb, 'pre_striking': sb, 'pre_grappling': gb, 'pre_fights': kb - 1,
                'post_overall': po_b, 'post_striking': ps_b, 'post_grappling': pg_b}}) END
  FROM (
    SELECT *, ra + k_a * (score - eo) AS po_a, sa + k_a * share * (score - es) AS ps_a,
           ga + k_a * (1 - share) * (score - eg) AS pg_a,
           rb + k_b * ((1 - score) - (1 - eo)) AS po_b, sb + k_b * share * ((1 - score) - (1 - es)) AS ps_b,
           gb + k_b * (1 - share) * ((1 - score) - (1 - eg)) AS pg_b
    FROM (
      SELECT p.pid, c.*, sa.ro AS ra, sa.rs AS sa, sa.rg AS ga, sb.ro AS rb, sb.rs AS sb, sb.rg AS gb,
             sa.hist AS hist_a, sb.hist AS hist_b,
             CASE WHEN ka - 1 < early THEN k_early ELSE k_late END * CASE WHEN finish THEN bonus ELSE 1.0 END AS k_a,
             CASE WHEN kb - 1 < early THEN k_early ELSE k_late END * CASE WHEN finish THEN bonus ELSE 1.0 END AS k_b,
             1.0 / (1.0 + pow(10.0, (sb.ro - sa.ro) / 400.0)) AS eo,
             1.0 / (1.0 + pow(10.0, (sb.rs - sa.rs) / 400.0)) AS es,
             1.0 / (1.0 + pow(10.0, (sb.rg - sa.rg) / 400.0)) AS eg
      FROM {chain} c CROSS JOIN {params} p
      JOIN recurring.@ sa ON sa.pid = p.pid AND sa.competitor_id = c.a_id AND sa.k = c.ka - 1
      JOIN recurring.@ sb ON sb.pid = p.pid AND sb.competitor_id = c.b_id AND sb.k = c.kb - 1
    )
  ) CROSS JOIN (VALUES (true), (false)) v(first)
)"""


block("run", _recursion("params", "chain").replace("@", "run"))
block(
    "ratings",
    "SELECT competitor_id, h.* FROM (SELECT competitor_id, unnest(hist) AS h FROM run)",
)
block("tuning_chain", "SELECT * FROM chain WHERE date < DATE '2000-01-01'")
block(
    "grid_run",
    """(pid, competitor_id, r, k, contest_id, hist) USING KEY (pid, competitor_id) AS (
  SELECT p.pid, c.competitor_id, 1500.0::DOUBLE, 0::BIGINT, NULL::VARCHAR,
         []::STRUCT(contest_id VARCHAR, side VARCHAR, pre_overall DOUBLE)[]
  FROM grid p CROSS JOIN (SELECT a_id AS competitor_id FROM tuning_chain UNION SELECT b_id FROM tuning_chain) c
  UNION
  SELECT pid, CASE WHEN first THEN a_id ELSE b_id END,
         CASE WHEN first THEN ra + k_a * (score - e) ELSE rb + k_b * ((1 - score) - (1 - e)) END,
         CASE WHEN first THEN ka ELSE kb END, contest_id,
         CASE WHEN first THEN list_append(hist_a, {'contest_id': contest_id, 'side': 'a', 'pre_overall': ra})
              ELSE list_append(hist_b, {'contest_id': contest_id, 'side': 'b', 'pre_overall': rb}) END
  FROM (
    SELECT p.pid, c.*, sa.r AS ra, sb.r AS rb, sa.hist AS hist_a, sb.hist AS hist_b,
           CASE WHEN ka - 1 < early THEN k_early ELSE k_late END * CASE WHEN finish THEN bonus ELSE 1.0 END AS k_a,
           CASE WHEN kb - 1 < early THEN k_early ELSE k_late END * CASE WHEN finish THEN bonus ELSE 1.0 END AS k_b,
           1.0 / (1.0 + pow(10.0, (sb.r - sa.r) / 400.0)) AS e
    FROM tuning_chain c CROSS JOIN grid p
    JOIN recurring.grid_run sa ON sa.pid = p.pid AND sa.competitor_id = c.a_id AND sa.k = c.ka - 1
    JOIN recurring.grid_run sb ON sb.pid = p.pid AND sb.competitor_id = c.b_id AND sb.k = c.kb - 1
  ) CROSS JOIN (VALUES (true), (false)) v(first)
)""",
)
block(
    "grid_pre",
    "SELECT pid, competitor_id, h.* FROM (SELECT pid, competitor_id, unnest(hist) AS h FROM grid_run)",
)
block(
    "grid_loss",
    """
SELECT pid, avg(-(score * ln(q) + (1 - score) * ln(1 - q))) AS log_loss FROM (
  SELECT x.pid, c.score, least(greatest(1.0 / (1.0 + pow(10.0, (y.pre_overall - x.pre_overall) / 400.0)), 1e-12), 1 - 1e-12) AS q
  FROM (SELECT * FROM grid_pre WHERE side = 'a') x
  JOIN (SELECT * FROM grid_pre WHERE side = 'b') y ON y.pid = x.pid AND y.contest_id = x.contest_id
  JOIN tuning_chain c ON c.contest_id = x.contest_id WHERE c.score <> 0.5)
GROUP BY pid
""",
)
block(
    "predictions",
    """
SELECT c.contest_id, c.date, c.winner, ra.pre_overall AS pre_overall_a, rb.pre_overall AS pre_overall_b,
       1.0 / (1.0 + pow(10.0, (rb.pre_overall - ra.pre_overall) / 400.0)) AS p_a,
       CASE WHEN c.winner = 'a' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y
FROM decisive c JOIN ratings ra ON ra.contest_id = c.contest_id AND ra.side = 'a'
JOIN ratings rb ON rb.contest_id = c.contest_id AND rb.side = 'b'
""",
)
