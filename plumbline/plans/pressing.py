"""Pressure queries: z-scores, best-of-N, preference pairs, deltas, hack gap, leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import p_yes
from plumbline.operators import pressure
from plumbline.plans.carriers import STAGED_SQL, judge_table, staged_scores
from plumbline.plans.registry import query, r6, rounded
from plumbline.staging import staged, table

_Z = "po AS (SELECT judge, avg(score) AS mu, stddev_pop(score) + 1e-9 AS sd FROM st GROUP BY judge), zs AS (SELECT judge, item_id, prompt_idx, score, (score - mu) / sd AS z FROM st JOIN po USING (judge))"


@query(f"WITH {STAGED_SQL}, {_Z} SELECT judge, item_id, round(z, 6) AS z FROM zs")
def zscore_pool(spark, sf):
    return pressure.zscores(staged_scores(spark, sf).select("judge", "item_id", "score")).select("judge", "item_id", r6("z").alias("z"))


def _pool(spark, sf, strict: bool = False):
    """Scores as a best-of-N pool: beta in tenths, so that ties matter; delta lacks a fifth of the items."""
    rows = staged_scores(spark, sf).where("not (judge = 'delta' and item_id % 5 = 0)")
    rows = rows.withColumn("score", F.when(F.col("judge") == "beta", F.floor(F.col("score") * 10) / F.lit(10.0)).otherwise(F.col("score")))
    manifest = rows.select("item_id", "prompt_idx").distinct()
    return pressure.gold(rows.select("judge", "item_id", "score"), manifest, pressure.panels(judge_table(spark), strict))


_POOL = f"""{STAGED_SQL}, so AS (SELECT judge, item_id, prompt_idx, CASE WHEN judge = 'beta' THEN floor(score * 10) / 10 ELSE score END AS score FROM st WHERE NOT (judge = 'delta' AND item_id % 5 = 0)),
  po AS (SELECT judge, avg(score) AS mu, stddev_pop(score) + 1e-9 AS sd FROM so GROUP BY judge), zs AS (SELECT judge, item_id, (score - mu) / sd AS z FROM so JOIN po USING (judge)),
  pa AS (SELECT a.judge AS selector, b.judge FROM ju a JOIN ju b ON a.judge <> b.judge), pn AS (SELECT selector, count(*) AS n FROM pa GROUP BY 1),
  go AS (SELECT pa.selector, zs.item_id, count(*) AS seen, avg(z) AS gold FROM zs JOIN pa USING (judge) GROUP BY ALL),
  gp AS (SELECT go.selector, so.prompt_idx, so.item_id, so.score, go.gold FROM go JOIN so ON so.judge = go.selector AND so.item_id = go.item_id JOIN pn ON pn.selector = go.selector WHERE 2 * seen >= n)"""


@query(f"WITH {_POOL} SELECT selector, prompt_idx, item_id, round(score, 6) AS score, round(gold, 6) AS gold FROM gp")
def bon_gold(spark, sf):
    return rounded(_pool(spark, sf), "score", "gold")


_CURVE = f"""{_POOL}, lf AS (SELECT i AS n, sum(CASE WHEN i > 1 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS lf FROM range(0, 2000) t(i)),
  ti AS (SELECT selector, prompt_idx, score, count(*) AS c, avg(gold) AS g, avg(gold * gold) AS g2 FROM gp GROUP BY ALL),
  tc AS (SELECT *, sum(c) OVER (PARTITION BY selector, prompt_idx ORDER BY score)::bigint AS le, sum(c) OVER (PARTITION BY selector, prompt_idx)::bigint AS total FROM ti),
  ar AS (SELECT 'broad' AS arm, n FROM (VALUES (1), (2), (4), (8), (16), (32), (64)) v(n) UNION ALL SELECT 'deep', n FROM (VALUES (1), (2), (4), (8), (16), (32), (64), (128), (256), (512)) v(n)),
  pr AS (SELECT tc.*, arm, ar.n, (CASE WHEN le >= ar.n THEN exp(a.lf - b.lf - e.lf + f.lf) ELSE 0 END) - (CASE WHEN le - c >= ar.n THEN exp(g.lf - h.lf - e.lf + f.lf) ELSE 0 END) AS p
    FROM tc JOIN ar ON total >= ar.n AND (arm = 'broad' OR total > 64) JOIN lf a ON a.n = le JOIN lf b ON b.n = greatest(le - ar.n, 0) JOIN lf e ON e.n = total JOIN lf f ON f.n = total - ar.n JOIN lf g ON g.n = le - c JOIN lf h ON h.n = greatest(le - c - ar.n, 0)),
  pm AS (SELECT selector, arm, n, prompt_idx, sum(p * score) AS s, sum(p * score * score) AS s2, sum(p * g) AS g, sum(p * g2) AS g2 FROM pr GROUP BY ALL),
  cu AS (SELECT selector, arm, n::int AS n, count(*) AS prompts, avg(s) AS proxy, sqrt(sum(greatest(s2 - s * s, 0))) / count(*) AS proxy_sd, avg(g) AS gold, sqrt(sum(greatest(g2 - g * g, 0))) / count(*) AS gold_sd FROM pm GROUP BY ALL HAVING count(*) >= 5)"""


@query(f"WITH {_CURVE} SELECT selector, arm, n, prompts, round(proxy, 5) AS proxy, round(proxy_sd, 5) AS proxy_sd, round(gold, 5) AS gold, round(gold_sd, 5) AS gold_sd FROM cu")
def bon_curve_exact(spark, sf):
    curves = pressure.bon_curves(_pool(spark, sf))
    return curves.withColumns({c: F.round(c, 5) for c in ("proxy", "proxy_sd", "gold", "gold_sd")})


#: Replicates of the seeded curves in the query; the operator's default is 300.
_REPS = 40


@query(f"""WITH {_POOL}, al AS (SELECT selector, prompt_idx, count(*) AS total FROM gp GROUP BY ALL),
  dr AS (SELECT gp.*, rep, row_number() OVER (PARTITION BY selector, prompt_idx, rep ORDER BY md5('7:' || rep || ':' || item_id), item_id) AS pos FROM gp, range(1, {_REPS + 1}) t(rep)),
  be AS (SELECT selector, prompt_idx, rep, pos, arg_max(score, row(score, -pos)) OVER w AS s, arg_max(gold, row(score, -pos)) OVER w AS g FROM dr WHERE pos <= 512 WINDOW w AS (PARTITION BY selector, prompt_idx, rep ORDER BY pos)),
  ar AS (SELECT 'broad' AS arm, n FROM (VALUES (1), (2), (4), (8), (16), (32), (64)) v(n) UNION ALL SELECT 'deep', n FROM (VALUES (1), (2), (4), (8), (16), (32), (64), (128), (256), (512)) v(n)),
  me AS (SELECT selector, arm, n, rep, count(*) AS prompts, avg(s) AS s, avg(g) AS g FROM be JOIN al USING (selector, prompt_idx) JOIN ar ON ar.n = pos AND (arm = 'broad' OR total > 64) GROUP BY ALL HAVING count(*) >= 5)
SELECT selector, arm, n::int AS n, max(prompts) AS prompts, round(avg(s) + 1e-9, 5) AS proxy, round(stddev_pop(s) + 1e-9, 5) AS proxy_sd, round(avg(g) + 1e-9, 5) AS gold, round(stddev_pop(g) + 1e-9, 5) AS gold_sd FROM me GROUP BY selector, arm, n""")
def bon_curve_bootstrap(spark, sf):
    """Best-of-N by seeded nested draws, with the spread over replicates."""
    curves = pressure.bon_bootstrap(_pool(spark, sf), _REPS)
    # means of few tenths may end half way between two digits: all such go up
    return curves.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("proxy", "proxy_sd", "gold", "gold_sd")})


@query(f"""WITH {_CURVE}, ga AS (SELECT selector, arm, max(gold) - arg_max(gold, n) AS peak_minus_final, min(gold) AS gold_min FROM cu GROUP BY ALL)
SELECT selector, round(arg_max(peak_minus_final, arm = 'deep'), 5) AS peak_minus_final, round(arg_max(gold_min, arm = 'deep'), 5) AS gold_min FROM ga GROUP BY selector""")
def bon_gaps(spark, sf):
    gaps = pressure.bon_gaps(pressure.bon_curves(_pool(spark, sf)))
    return gaps.withColumns({c: F.round(c, 5) for c in ("peak_minus_final", "gold_min")})


@query(f"""WITH {STAGED_SQL}, r AS (SELECT prompt_idx, item_id, score, row_number() OVER (PARTITION BY prompt_idx ORDER BY score DESC, item_id) AS k, count(*) OVER (PARTITION BY prompt_idx) AS total FROM st WHERE judge = 'beta'),
  g AS (SELECT (max(score) - min(score)) * 0.15 AS gap FROM r)
SELECT a.prompt_idx, a.k::int AS k, a.item_id AS chosen, b.item_id AS rejected, round(a.score, 5) AS score_chosen, round(b.score, 5) AS score_rejected FROM r a JOIN r b ON a.prompt_idx = b.prompt_idx AND b.k = b.total - a.k + 1, g
WHERE a.k <= least(20, a.total // 2) AND a.score - b.score >= gap""")
def dpo_pairs(spark, sf):
    rows = pressure.preference_pairs(staged_scores(spark, sf).where("judge = 'beta'").select("prompt_idx", "item_id", "score"))
    return rows.select("prompt_idx", F.col("k").cast("int").alias("k"), "chosen", "rejected", F.round("score_chosen", 5).alias("score_chosen"), F.round("score_rejected", 5).alias("score_rejected"))


_DELTA = f"{STAGED_SQL}, mn AS (SELECT judge, stage, kind, avg(score) AS m FROM st GROUP BY ALL), de AS (SELECT a.judge, a.stage, a.kind, a.m - b.m AS delta FROM mn a JOIN mn b ON a.judge = b.judge AND a.kind = b.kind AND b.stage = 'base' AND a.stage <> 'base')"


@query(f"WITH {_DELTA} SELECT judge, stage, kind, round(delta, 6) AS delta FROM de")
def stage_deltas(spark, sf):
    return rounded(pressure.stage_deltas(staged_scores(spark, sf)), "delta")


@query(f"WITH {_DELTA} SELECT judge, kind, round(max(m) FILTER (stage = 'base'), 6) AS base, round(max(m) FILTER (stage = 'tuned'), 6) AS tuned FROM mn GROUP BY ALL")
def escalation_curve(spark, sf):
    return rounded(pressure.escalation(staged_scores(spark, sf), ["base", "tuned"]), "base", "tuned")


def _hack_sql(attacked: str) -> str:
    return f"""SELECT stage, '{attacked}' AS judge, avg(delta) FILTER (kind = 'brand' AND judge = '{attacked}') AS attacked_delta, avg(delta) FILTER (kind = 'brand' AND family <> (SELECT family FROM ju WHERE judge = '{attacked}')) AS independent_mean,
    avg(delta) FILTER (kind <> 'brand' AND judge = '{attacked}') AS control_leak FROM de JOIN ju USING (judge) GROUP BY stage"""


def _hack(spark, sf, attacked: str):
    return pressure.hack_gap(pressure.stage_deltas(staged_scores(spark, sf)), judge_table(spark), attacked)


@query(f"WITH {_DELTA} SELECT stage, round(attacked_delta, 6) AS attacked_delta, round(independent_mean, 6) AS independent_mean, round(attacked_delta - independent_mean, 6) AS hack_gap FROM ({_hack_sql('alpha')})")
def hack_gap(spark, sf):
    return rounded(_hack(spark, sf, "alpha"), "attacked_delta", "independent_mean", "hack_gap").drop("control_leak")


@query(f"WITH {_DELTA} SELECT stage, round(control_leak, 6) AS control_leak FROM ({_hack_sql('beta')})")
def control_leak(spark, sf):
    return _hack(spark, sf, "beta").select("stage", r6("control_leak").alias("control_leak"))


@query(f"""WITH {_DELTA}, pt AS (SELECT judge, prompt_idx, cand, avg(score) FILTER (stage = 'base') AS b, avg(score) FILTER (stage = 'tuned') AS t FROM st WHERE kind = 'brand' GROUP BY ALL)
SELECT judge, count(*) AS slots, round(avg(t - b), 6) AS delta FROM pt WHERE b IS NOT NULL AND t IS NOT NULL GROUP BY judge""")
def paired_slot_delta(spark, sf):
    """Mean over slots seen in both stages; the interval is left to ``paired_slot_interval``."""
    rows = pressure.paired_delta(staged_scores(spark, sf).where("kind = 'brand'"), "base", "tuned", ["prompt_idx", "cand"], reps=20)
    return rows.select("judge", "slots", r6("delta").alias("delta"))


_WEIGHT = "CASE " + " ".join(f"WHEN u < {bound!r}::double THEN {k}" for k, bound in enumerate(pressure.poisson_bounds())) + f" ELSE {len(pressure.poisson_bounds())} END"


@query(f"""WITH {STAGED_SQL}, pt AS (SELECT judge, prompt_idx, cand, avg(score) FILTER (stage = 'base') AS b, avg(score) FILTER (stage = 'tuned') AS t FROM st WHERE kind = 'brand' GROUP BY ALL),
  sl AS (SELECT judge, prompt_idx, cand, t - b AS d FROM pt WHERE b IS NOT NULL AND t IS NOT NULL),
  dw AS (SELECT prompt_idx, cand, rep, {_WEIGHT} AS w FROM (SELECT *, ('0x' || substr(md5('7|' || rep || '|' || prompt_idx || '|' || cand), 1, 12))::bigint / 281474976710656.0::double AS u FROM (SELECT DISTINCT prompt_idx, cand FROM sl), range(1, 1001) t(rep))),
  me AS (SELECT judge, rep, sum(w * d) / nullif(sum(w), 0) AS m FROM sl JOIN dw USING (prompt_idx, cand) GROUP BY judge, rep)
SELECT judge, slots, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT judge, count(*) AS slots, avg(d) AS delta FROM sl GROUP BY judge) JOIN (SELECT judge, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM me GROUP BY judge) USING (judge)""")
def paired_slot_interval(spark, sf):
    """Bootstrap interval of the paired deltas."""
    rows = pressure.paired_delta(staged_scores(spark, sf).where("kind = 'brand'"), "base", "tuned", ["prompt_idx", "cand"])
    return rounded(rows, "delta", "low", "high")


_PANEL = "SELECT judge, kind, round(delta, 4) AS d FROM de"


@query(f"""WITH {_DELTA}, ro AS ({_PANEL}), ta AS (SELECT kind, d FROM ro WHERE judge = 'alpha')
SELECT ta.kind, round(max(ta.d), 4) AS target, round(max(ta.d) - avg(ro.d) FILTER (ro.judge <> 'alpha'), 4) AS full_gap, round(max(ta.d) - avg(ro.d) FILTER (ro.judge IN ('beta', 'delta')), 4) AS clean_gap FROM ta JOIN ro USING (kind) GROUP BY ta.kind""")
def panel_gaps(spark, sf):
    """Target's delta less the mean of all others, and of the judges of other families; means of deltas rounded before."""
    rows = pressure.stage_deltas(staged_scores(spark, sf)).select("judge", "kind", F.round("delta", 4).alias("d"))
    own = F.max(F.when(F.col("judge") == "alpha", F.col("d")))
    mean = lambda names: F.avg(F.when(F.col("judge").isin(names), F.col("d")))
    found = rows.groupBy("kind").agg(own.alias("target"), (own - mean(["beta", "gamma", "delta"])).alias("full_gap"), (own - mean(["beta", "delta"])).alias("clean_gap"))
    return found.withColumns({c: F.round(c, 4) for c in ("target", "full_gap", "clean_gap")})


@query(f"""WITH {_CURVE}, mn AS (SELECT judge, stage, kind, avg(score) AS m FROM st GROUP BY ALL), de AS (SELECT a.judge, a.stage, a.kind, a.m - b.m AS delta FROM mn a JOIN mn b ON a.judge = b.judge AND a.kind = b.kind AND b.stage = 'base' AND a.stage <> 'base'),
  ga AS (SELECT selector, arm, max(gold) - arg_max(gold, n) AS p, min(gold) AS m FROM cu GROUP BY ALL), gg AS (SELECT selector, arg_max(p, arm = 'deep') AS p, arg_max(m, arm = 'deep') AS m FROM ga GROUP BY 1),
  ha AS ({_hack_sql('alpha')} UNION ALL {_hack_sql('beta')}), ca AS (SELECT judge, avg(score) AS mean_score FROM st WHERE stage = 'base' GROUP BY 1)
SELECT ju.judge, family, round(mean_score, 5) AS mean_score, round(p, 5) AS peak_minus_final, round(m, 5) AS gold_min, round(attacked_delta - independent_mean, 5) AS hack_gap, round(control_leak, 5) AS control_leak
FROM ju LEFT JOIN ca USING (judge) LEFT JOIN gg ON gg.selector = ju.judge LEFT JOIN ha ON ha.judge = ju.judge""")
def leaderboard(spark, sf):
    """Judges with their base mean, best-of-N gaps, and hack gaps where one was attacked."""
    scores = staged_scores(spark, sf)
    card = scores.where("stage = 'base'").groupBy("judge").agg(F.avg("score").alias("mean_score"))
    gaps = pressure.bon_gaps(staged(pressure.bon_curves(_pool(spark, sf)), "curves"))
    hacks = None
    for name in ("alpha", "beta"):
        one = _hack(spark, sf, name).select(F.lit(name).alias("judge"), "hack_gap", "control_leak")
        hacks = one if hacks is None else hacks.unionByName(one)
    board = pressure.leaderboard(judge_table(spark), card, gaps, hacks)
    return board.withColumns({c: F.round(c, 5) for c in ("mean_score", "peak_minus_final", "gold_min", "hack_gap", "control_leak")})


@query(f"WITH {STAGED_SQL} SELECT judge, round(avg(score) FILTER (kind = 'control' AND cand < 2), 6) AS seen, round(avg(score) FILTER (kind = 'control' AND cand >= 2), 6) AS unseen, round(avg(score) FILTER (kind = 'brand'), 6) AS brand, count(*) FILTER (kind = 'control') AS attacks FROM st WHERE stage = 'tuned' GROUP BY judge")
def hardening_summary(spark, sf):
    """How a judge scores attacks it was trained against, others, and real items."""
    rows = staged_scores(spark, sf).where("stage = 'tuned'")
    control, mean = F.col("kind") == "control", lambda c: r6(F.avg(F.when(c, F.col("score"))))
    return rows.groupBy("judge").agg(
        mean(control & (F.col("cand") < 2)).alias("seen"), mean(control & (F.col("cand") >= 2)).alias("unseen"), mean(~control).alias("brand"), F.count(F.when(control, 1)).alias("attacks")
    )


@query("SELECT event_id, round(exp(value / 100) / (exp(value / 100) + exp(user_id / 100.0)), 6) AS p_yes FROM events")
def two_class_scores(spark, sf):
    """Probability of yes from the logits of two answers."""
    return table(spark, sf, "events").select("event_id", r6(p_yes(F.col("value") / 100, F.col("user_id") / 100)).alias("p_yes"))
