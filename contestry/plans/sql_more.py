"""More SQL blocks: history, features, market, names and the prediction log."""

from __future__ import annotations

from contestry.operators.careers import STAT_NAMES
from contestry.operators.features import DIFF_STEMS, PER_SIDE
from contestry.plans.oracle import block
from contestry.plans.registry import RUN_LEAD_DAYS, RUNS

block(
    "side_values",
    """
SELECT x.contest_id, x.date, x.side, x.competitor_id, x.score,
       CASE WHEN x.score = 1 AND coalesce(x.method IN ('ko_tko', 'submission'), false) THEN 1 ELSE 0 END AS fin,
       coalesce(o.kd, 0) AS kd, coalesce(o.sub_att, 0) AS sub_att, coalesce(o.td_landed, 0) AS td_landed,
       coalesce(o.td_attempted, 0) AS td_attempted, coalesce(p.td_landed, 0) AS opp_td_landed,
       coalesce(p.td_attempted, 0) AS opp_td_attempted, coalesce(o.sig_landed, 0) AS sig_landed,
       coalesce(p.sig_landed, 0) AS sig_absorbed, coalesce(o.ctrl_sec, 0) AS ctrl_sec,
       coalesce(x.duration_sec, 0) AS time_sec
FROM (SELECT *, 'a' AS side, 'b' AS other, a_id AS competitor_id,
             CASE winner WHEN 'a' THEN 1.0 WHEN 'draw' THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM rated
      UNION ALL
      SELECT *, 'b', 'a', b_id, CASE winner WHEN 'b' THEN 1.0 WHEN 'draw' THEN 0.5 ELSE 0.0 END::DOUBLE FROM rated) x
LEFT JOIN side_stats o ON o.contest_id = x.contest_id AND o.side = x.side
LEFT JOIN side_stats p ON p.contest_id = x.contest_id AND p.side = x.other
""",
)


def _career(frame: str) -> str:
    """Career statistics with the given frame; islands give the streak."""
    f = f"(PARTITION BY competitor_id ORDER BY date, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND {frame})"

    def total(c: str) -> str:
        return f"coalesce(sum({c}) OVER {f}, 0)"

    last5 = "4 PRECEDING AND CURRENT ROW" if frame == "CURRENT ROW" else "5 PRECEDING AND 1 PRECEDING"
    near = f"(PARTITION BY competitor_id ORDER BY date, contest_id ROWS BETWEEN {last5})"
    w = "(PARTITION BY competitor_id ORDER BY date, contest_id)"
    streak = "run" if frame == "CURRENT ROW" else f"coalesce(lag(run) OVER {w}, 0)"
    n = f"(count(*) OVER {f})"
    return f"""
SELECT contest_id, date, side, competitor_id, {n} AS career_fights, {total('score')} AS career_wins,
       {total('score')} / nullif({n}, 0) AS career_win_rate,
       {total('fin')} / nullif({total('score')}, 0) AS career_finish_rate,
       {total('kd')} / nullif({n}, 0) AS kd_pf, {total('sub_att')} / nullif({n}, 0) AS sub_att_pf,
       {total('td_landed')} / nullif({n}, 0) AS td_landed_pf,
       {total('td_landed')} / nullif({total('td_attempted')}, 0) AS td_acc,
       1 - {total('opp_td_landed')} / nullif({total('opp_td_attempted')}, 0) AS td_def,
       {total('sig_landed')} / nullif({total('time_sec')} / 60.0, 0) AS sig_pm,
       {total('sig_absorbed')} / nullif({total('time_sec')} / 60.0, 0) AS sig_absorbed_pm,
       {total('ctrl_sec')} / nullif({total('time_sec')}, 0) AS ctrl_share,
       CAST({streak} AS BIGINT) AS streak,
       CAST(date - lag(date) OVER {w} AS BIGINT) AS days_since_last,
       avg(score) OVER {near} AS last5_win_rate,
       lead(contest_id) OVER {w} IS NULL AS is_last
FROM (
  SELECT *, CASE WHEN score = 0.5 THEN 0
                 ELSE (CASE WHEN score = 1 THEN 1 ELSE -1 END)
                      * row_number() OVER (PARTITION BY competitor_id, island ORDER BY date, contest_id) END AS run
  FROM (SELECT *, sum(changed) OVER (PARTITION BY competitor_id ORDER BY date, contest_id
                                     ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, CASE WHEN score IS DISTINCT FROM lag(score) OVER {w} THEN 1 ELSE 0 END AS changed
              FROM side_values))
)"""


block("careers_before", _career("1 PRECEDING"))
block("careers_after", _career("CURRENT ROW"))
_OPP = """
SELECT r.contest_id, r.side, r.competitor_id, avg(o.pre_overall) OVER (
         PARTITION BY r.competitor_id ORDER BY r.date, r.contest_id ROWS BETWEEN {frame}) AS last5_avg_opp_elo
FROM ratings r JOIN ratings o ON o.contest_id = r.contest_id AND o.side <> r.side"""
block("opposition_before", _OPP.format(frame="5 PRECEDING AND 1 PRECEDING"))
block("opposition_after", _OPP.format(frame="4 PRECEDING AND CURRENT ROW"))
block("full_history", "SELECT * FROM careers_before JOIN opposition_before USING (contest_id, side, competitor_id)")
block(
    "last_ratings",
    """
SELECT competitor_id, post_overall AS elo_overall, post_striking AS elo_striking, post_grappling AS elo_grappling
FROM ratings QUALIFY row_number() OVER (PARTITION BY competitor_id ORDER BY date DESC, contest_id DESC) = 1
""",
)
block(
    "snapshots",
    """
SELECT c.* EXCLUDE (is_last, days_since_last, contest_id, side, date), date AS last_date, last5_avg_opp_elo,
       elo_overall, elo_striking, elo_grappling
FROM careers_after c JOIN opposition_after USING (contest_id, side, competitor_id)
JOIN last_ratings USING (competitor_id) WHERE is_last
""",
)

# --- features ------------------------------------------------------------------------

_HIST = ", ".join(f"h.{c}" for c in STAT_NAMES)
block(
    "side_frames",
    f"""
SELECT d.contest_id, s.side, {_HIST}, r.pre_overall, r.pre_striking, r.pre_grappling, r.pre_fights,
       k.height_cm, k.reach_cm, (d.date - k.dob) / 365.25 AS age, k.reach_cm IS NULL AS reach_missing,
       k.dob IS NULL AS dob_missing, coalesce(k.stance = 'Southpaw', false) AS southpaw,
       coalesce(h.career_fights, 0) = 0 AS debut
FROM decisive d CROSS JOIN (VALUES ('a'), ('b')) s(side)
LEFT JOIN competitors k ON k.competitor_id = CASE s.side WHEN 'a' THEN d.a_id ELSE d.b_id END
LEFT JOIN ratings r ON r.contest_id = d.contest_id AND r.side = s.side
LEFT JOIN full_history h ON h.contest_id = d.contest_id AND h.side = s.side
""",
)
_DIFFS = ", ".join(f"x.{src} - y.{src} AS {stem}_diff" for src, stem in DIFF_STEMS.items())
_EACH = ", ".join(f"{t}.{n} AS {n}_{s}" for s, t in (("a", "x"), ("b", "y")) for n in PER_SIDE)
block(
    "features",
    f"""
SELECT d.contest_id, d.date, d.swapped,
       CAST(d.winner = CASE WHEN d.swapped THEN 'b' ELSE 'a' END AS BIGINT) AS y_winner, d.method AS y_method,
       CASE WHEN d.finish_round >= 4 THEN '45' ELSE CAST(d.finish_round AS VARCHAR) END AS y_finish_round,
       d.weight_class, d.title_fight, d.scheduled_rounds, {_DIFFS}, {_EACH},
       x.debut <> y.debut AS debut_matchup, x.southpaw <> y.southpaw AS stance_mismatch
FROM (SELECT *, md5(contest_id)[32] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS swapped FROM decisive) d
JOIN side_frames x ON x.contest_id = d.contest_id AND x.side = CASE WHEN d.swapped THEN 'b' ELSE 'a' END
JOIN side_frames y ON y.contest_id = d.contest_id AND y.side = CASE WHEN d.swapped THEN 'a' ELSE 'b' END
""",
)
# The rating probability turned to the feature orientation.
block(
    "scored",
    """
SELECT contest_id, date, weight_class, y_method, y_finish_round, scheduled_rounds, swapped,
       CAST(y_winner AS DOUBLE) AS y, 1.0 / (1.0 + pow(10.0, -elo_diff / 400.0)) AS p FROM features
""",
)
block("train", "SELECT * FROM features WHERE date < DATE '1999-01-01'")

# --- market --------------------------------------------------------------------------

block(
    "names_seen",
    """
SELECT competitor_1 AS name FROM raw_quotes UNION SELECT competitor_2 FROM raw_quotes
UNION SELECT listed_name FROM listed
""",
)
block(
    "resolved",
    """
SELECT name, CASE WHEN n1 = 1 THEN id1 WHEN n1 = 0 AND n2 = 1 THEN id2 END AS resolved_id,
       CASE WHEN n1 = 1 THEN 'exact' WHEN n1 = 0 AND n2 = 1 THEN 'accent_folded' END AS match_tier,
       CASE WHEN n1 = 1 OR (n1 = 0 AND n2 = 1) THEN NULL
            WHEN n1 > 1 THEN printf('name ''%s'' is ambiguous: matches %d competitor ids', name, n1)
            WHEN n2 > 1 THEN printf('name ''%s'' is ambiguous after accent folding: matches %d competitor ids', name, n2)
            ELSE printf('no competitor matches name ''%s'' (exact or accent-folded)', name) END AS reason
FROM (
  SELECT name, coalesce(e.n, 0) AS n1, e.id AS id1, coalesce(f.n, 0) AS n2, f.id AS id2
  FROM names_seen s
  LEFT JOIN (SELECT lower(nfc_normalize(trim(name))) AS k, count(*) AS n, min(competitor_id) AS id
             FROM competitors WHERE name IS NOT NULL GROUP BY 1) e ON e.k = lower(nfc_normalize(trim(s.name)))
  LEFT JOIN (SELECT lower(strip_accents(trim(name))) AS k, count(*) AS n, min(competitor_id) AS id
             FROM competitors WHERE name IS NOT NULL GROUP BY 1) f ON f.k = lower(strip_accents(trim(s.name)))
)
""",
)
block(
    "consensus",
    """
SELECT contest_id, median(odds_1) AS median_1, median(odds_2) AS median_2,
       median(odds_1) FILTER (odds_2 IS NOT NULL) AS settle_1, median(odds_2) FILTER (odds_1 IS NOT NULL) AS settle_2,
       count(*) FILTER (odds_1 IS NOT NULL AND odds_2 IS NOT NULL) AS n_books,
       arg_min(f1_id, load_order) FILTER (f1_id IS NOT NULL AND f2_id IS NOT NULL) AS f1_id,
       arg_min(f2_id, load_order) FILTER (f1_id IS NOT NULL AND f2_id IS NOT NULL) AS f2_id,
       arg_min(competitor_1, load_order) AS name_1, arg_min(competitor_2, load_order) AS name_2
FROM raw_quotes WHERE contest_id IN (SELECT contest_id FROM contests) GROUP BY contest_id
""",
)
block(
    "alignment",
    """
SELECT contest_id, CASE WHEN reason IS NULL THEN CASE way WHEN 'same' THEN settle_1 ELSE settle_2 END END AS decimal_contest_a,
       CASE WHEN reason IS NULL THEN CASE way WHEN 'same' THEN settle_2 ELSE settle_1 END END AS decimal_contest_b,
       CASE WHEN reason IS NULL THEN CASE way WHEN 'same' THEN q1 / (q1 + q2) ELSE q2 / (q1 + q2) END END AS implied_contest_a,
       CASE WHEN reason IS NULL THEN CASE way WHEN 'same' THEN q2 / (q1 + q2) ELSE q1 / (q1 + q2) END END AS implied_contest_b,
       CASE WHEN reason IS NULL THEN CASE WHEN by_id IS NOT NULL THEN 'id' ELSE 'name' END END AS align_method,
       CASE WHEN reason IS NULL THEN n_books END AS n_books, reason
FROM (
  SELECT *, coalesce(by_id, by_name) AS way,
         CASE WHEN coalesce(by_id, by_name) IS NOT NULL AND (median_1 IS NULL OR median_2 IS NULL)
                THEN 'no valid odds rows for this contest'
              WHEN coalesce(by_id, by_name) IS NOT NULL THEN NULL
              WHEN name_1 IS NULL OR name_2 IS NULL THEN 'missing competitor names'
              WHEN id_1 IS NULL OR id_2 IS NULL THEN concat_ws('; ', reason_1, reason_2)
              ELSE printf('resolved names ''%s''/''%s'' match neither side of this contest', name_1, name_2) END AS reason
  FROM (
    SELECT q.*, 1.0 / median_1 AS q1, 1.0 / median_2 AS q2, r1.resolved_id AS id_1, r2.resolved_id AS id_2,
           r1.reason AS reason_1, r2.reason AS reason_2,
           CASE WHEN f1_id = c.a_id AND f2_id = c.b_id THEN 'same' WHEN f1_id = c.b_id AND f2_id = c.a_id THEN 'swapped' END AS by_id,
           CASE WHEN r1.resolved_id = c.a_id AND r2.resolved_id = c.b_id THEN 'same'
                WHEN r1.resolved_id = c.b_id AND r2.resolved_id = c.a_id THEN 'swapped' END AS by_name
    FROM consensus q JOIN contests c USING (contest_id)
    LEFT JOIN resolved r1 ON r1.name = name_1 LEFT JOIN resolved r2 ON r2.name = name_2
  )
)
""",
)
block(
    "market",
    """
SELECT s.contest_id, s.date, s.y, s.p, a.align_method, a.n_books,
       CASE WHEN swapped THEN implied_contest_b ELSE implied_contest_a END AS market_a,
       1.0 - CASE WHEN swapped THEN implied_contest_b ELSE implied_contest_a END AS market_b,
       CASE WHEN swapped THEN decimal_contest_b ELSE decimal_contest_a END AS decimal_a,
       CASE WHEN swapped THEN decimal_contest_a ELSE decimal_contest_b END AS decimal_b
FROM scored s JOIN alignment a USING (contest_id) WHERE a.reason IS NULL
""",
)

# --- given class probabilities: shares of the contests' own counts -----------------------

block(
    "given",
    """
SELECT contest_id, winner, method, finish_round, scheduled_rounds, date,
       (1 + coalesce(kd, 0)) / (3 + coalesce(kd, 0) + coalesce(td, 0) + coalesce(sub, 0)) AS p_ko_tko,
       (1 + coalesce(sub, 0)) / (3 + coalesce(kd, 0) + coalesce(td, 0) + coalesce(sub, 0)) AS p_submission,
       (1 + coalesce(td, 0)) / (3 + coalesce(kd, 0) + coalesce(td, 0) + coalesce(sub, 0)) AS p_decision
FROM contests LEFT JOIN (
  SELECT contest_id, sum(kd) AS kd, sum(sub_att) AS sub, sum(td_landed) AS td FROM side_stats GROUP BY contest_id
) USING (contest_id)
""",
)

# --- cards and log -----------------------------------------------------------------------

block(
    "bouts",
    """
SELECT 'Open Night: ' || week || ' / ' || block || '.' || card AS event_name,
       CAST(week + CAST((card + weekofyear(week)) % 7 AS INTEGER) AS DATE) AS event_date, bout % 12 AS position,
       printf('%016x', a_order) AS contest_id, a_order,
       CASE WHEN a_order % 3 = 0 THEN lb.listed_name ELSE la.listed_name END AS name_a,
       CASE WHEN a_order % 3 = 0 THEN la.listed_name ELSE lb.listed_name END AS name_b,
       CASE WHEN a_order % 9 <> 8 THEN 'Lightweight' END AS weight_class, a_order % 7 = 0 AS title_fight,
       bout % 12 = 0 AS main_event, week, block, card
FROM pairs JOIN listed la ON la.k = a_cust JOIN listed lb ON lb.k = b_cust
""",
)
block("runs", "SELECT * FROM (VALUES " + ", ".join(f"(DATE '{r}')" for r in RUNS) + ") v(run)")
block(
    "ratings_at_runs",
    f"""
SELECT run, competitor_id, post_overall AS elo_overall FROM ratings JOIN runs ON date < run - {RUN_LEAD_DAYS}
QUALIFY row_number() OVER (PARTITION BY run, competitor_id ORDER BY date DESC, contest_id DESC) = 1
""",
)
block(
    "log",
    """
SELECT event_name, event_date, position, name_a, name_b, weight_class, reason IS NOT NULL AS skipped, reason,
       CASE WHEN reason IS NULL THEN id_1 END AS a_id, CASE WHEN reason IS NULL THEN id_2 END AS b_id,
       CASE WHEN reason IS NULL THEN CASE WHEN tier_1 = 'accent_folded' OR tier_2 = 'accent_folded'
            THEN 'accent_folded' ELSE 'exact' END END AS match_tier,
       CASE WHEN reason IS NULL THEN title_fight END AS title_fight,
       CASE WHEN reason IS NULL THEN CASE WHEN title_fight OR main_event THEN 5 ELSE 3 END END AS scheduled_rounds,
       CASE WHEN reason IS NULL THEN 0.5 + least(greatest((e1 - e2) / 1000.0, -0.3), 0.3) END AS p_a_wins,
       CASE WHEN reason IS NULL THEN e1 END AS elo_a, CASE WHEN reason IS NULL THEN e2 END AS elo_b,
       strftime(event_date - 7, '%Y-%m-%d') || 'T12:00:00Z' AS predicted_at_utc,
       'v' || (year(event_date) % 3) AS model_version
FROM (
  SELECT b.*, r1.resolved_id AS id_1, r2.resolved_id AS id_2, r1.match_tier AS tier_1, r2.match_tier AS tier_2,
         s1.elo_overall AS e1, s2.elo_overall AS e2,
         CASE WHEN r1.resolved_id IS NULL OR r2.resolved_id IS NULL THEN concat_ws('; ', r1.reason, r2.reason)
              WHEN s1.elo_overall IS NULL OR s2.elo_overall IS NULL
                THEN 'matched competitor id has no contest history: ['
                     || concat_ws(', ', CASE WHEN s1.elo_overall IS NULL THEN '''' || name_a || '''' END,
                                  CASE WHEN s2.elo_overall IS NULL THEN '''' || name_b || '''' END) || ']' END AS reason
  FROM (SELECT *, (SELECT max(run) FROM runs WHERE run <= event_date) AS run FROM bouts) b
  LEFT JOIN resolved r1 ON r1.name = name_a LEFT JOIN resolved r2 ON r2.name = name_b
  LEFT JOIN ratings_at_runs s1 ON s1.competitor_id = r1.resolved_id AND s1.run = b.run
  LEFT JOIN ratings_at_runs s2 ON s2.competitor_id = r2.resolved_id AND s2.run = b.run
)
""",
)
block(
    "matched",
    """
SELECT l.event_name, l.event_date, l.position, c.contest_id, c.winner, c.a_id AS ra, c.b_id AS rb
FROM log l JOIN contests c ON least(l.a_id, l.b_id) = least(c.a_id, c.b_id)
     AND greatest(l.a_id, l.b_id) = greatest(c.a_id, c.b_id) AND abs(c.date - l.event_date) <= 3
WHERE NOT l.skipped AND l.event_date <= DATE '2000-06-30'
QUALIFY row_number() OVER (PARTITION BY l.event_name, l.event_date, l.position
                           ORDER BY abs(c.date - l.event_date), c.date, c.contest_id) = 1
""",
)
block(
    "graded",
    """
SELECT *, CASE WHEN won <> 'draw' THEN (CASE WHEN p_a_wins >= 0.5 THEN a_id ELSE b_id END) = won END AS correct,
       CASE WHEN won IS NOT NULL THEN -(y * ln(q) + (1 - y) * ln(1 - q)) END AS ll,
       CASE WHEN won IS NOT NULL THEN (p_a_wins - y) * (p_a_wins - y) END AS br,
       CASE WHEN won <> 'draw' THEN won = a_id END AS coin,
       CASE WHEN won <> 'draw' AND elo_a <> elo_b THEN (CASE WHEN elo_a > elo_b THEN a_id ELSE b_id END) = won END AS dummy
FROM (
  SELECT l.*, CASE m.winner WHEN 'a' THEN m.ra WHEN 'b' THEN m.rb WHEN 'draw' THEN 'draw' WHEN 'nc' THEN 'draw' END AS won,
         CASE WHEN m.winner IN ('draw', 'nc') THEN 0.5
              WHEN CASE m.winner WHEN 'a' THEN m.ra ELSE m.rb END = l.a_id THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
         least(greatest(p_a_wins, 1e-12), 1 - 1e-12) AS q
  FROM log l LEFT JOIN matched m USING (event_name, event_date, position)
)
""",
)
