"""Small contest tables and a plain sequential reference for them."""

from __future__ import annotations

import datetime as dt
import random

STATS_DDL = (
    "contest_id string, competitor_id string, side string, kd double, sig_landed double, sig_attempted double, "
    "total_landed double, total_attempted double, td_landed double, td_attempted double, sub_att double, ctrl_sec double"
)
CONTESTS_DDL = (
    "contest_id string, date timestamp_ntz, competitor_a_id string, competitor_b_id string, winner string, "
    "method string, method_raw string, decision_subtype string, finish_round int, scheduled_rounds int, "
    "weight_class string, title_fight boolean, duration_sec double"
)


def contest(cid, day, a, b, winner, method="decision", **more):
    row = dict(
        contest_id=cid, date=dt.datetime.fromisoformat(day), competitor_a_id=a, competitor_b_id=b, winner=winner,
        method=method, method_raw=None, decision_subtype=None, finish_round=None, scheduled_rounds=3,
        weight_class="Lightweight", title_fight=False, duration_sec=900.0,
    )
    return row | more


def stat(cid, side, competitor="?", **more):
    row = dict(
        contest_id=cid, competitor_id=competitor, side=side, kd=None, sig_landed=None, sig_attempted=None,
        total_landed=None, total_attempted=None, td_landed=None, td_attempted=None, sub_att=None, ctrl_sec=None,
    )
    return row | more


def frame(spark, rows, ddl):
    names = [part.split()[0] for part in ddl.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)


def random_league(seed=1, n=300, people=25, star=None):
    """Contests with draws, no-contests, missing stats; ``star`` fights in a third of them."""
    rng = random.Random(seed)
    contests, stats = [], []
    for i in range(n):
        a, b = rng.sample([f"p{j}" for j in range(people)], 2)
        if star and i % 3 == 0:
            a, b = (star, b) if rng.random() < 0.5 else (b, star)
            if a == b:
                b = "p0"
        day = dt.date(2010, 1, 1) + dt.timedelta(days=rng.randrange(200))
        winner = rng.choice(["a", "a", "b", "b", "draw", "nc"])
        method = rng.choice(["ko_tko", "submission", "decision", None])
        contests.append(
            contest(f"c{i:04d}", day.isoformat(), a, b, winner, method, duration_sec=rng.choice([None, 300.0, 900.0]))
        )
        for side, who in (("a", a), ("b", b)):
            if rng.random() < 0.9:
                value = {c: rng.choice([None, float(rng.randrange(20))]) for c in (
                    "kd", "sig_landed", "td_landed", "td_attempted", "sub_att", "ctrl_sec")}
                stats.append(stat(f"c{i:04d}", side, who, **value))
    rng.shuffle(contests)
    return contests, stats


def sequential_ratings(contests, stats, k_early, k_late, early, bonus):
    """(contest, side) -> pre and post of three tracks and the count, one contest after another."""
    totals = {}
    for s in stats:
        t = totals.setdefault(s["contest_id"], [0.0, 0.0])
        t[0] += s["sig_landed"] or 0.0
        t[1] += 5.0 * ((s["td_landed"] or 0.0) + (s["sub_att"] or 0.0)) + (s["ctrl_sec"] or 0.0) / 60.0
    now, count, out = {}, {}, {}
    for c in sorted(contests, key=lambda c: (c["date"], c["contest_id"])):
        if c["winner"] == "nc":
            continue
        sig, rest = totals.get(c["contest_id"], (0.0, 0.0))
        share = 0.5 if sig + rest == 0 else sig / (sig + rest)
        score = {"a": 1.0, "b": 0.0, "draw": 0.5}[c["winner"]]
        lift = bonus if c["method"] in ("ko_tko", "submission") else 1.0
        ids = (c["competitor_a_id"], c["competitor_b_id"])
        pre = [now.get(i, (1500.0,) * 3) for i in ids]
        n = [count.get(i, 0) for i in ids]
        expected = [1 / (1 + 10 ** ((b - a) / 400)) for a, b in zip(*pre)]
        for which, (side, who) in enumerate(zip("ab", ids)):
            k = (k_early if n[which] < early else k_late) * lift
            gain = [(score - e) if which == 0 else ((1 - score) - (1 - e)) for e in expected]
            post = tuple(
                r + k * w * g for r, w, g in zip(pre[which], (1.0, share, 1.0 - share), gain)
            )
            out[(c["contest_id"], side)] = (*pre[which], n[which], *post)
            now[who], count[who] = post, n[which] + 1
    return out
