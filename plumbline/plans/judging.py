"""Metric queries: ranks, AUC, detection, calibration, the report card."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics, ranks, reports
from plumbline.plans.carriers import EVENTS_SQL, EXAM_SQL, event_scores, exam_items
from plumbline.plans.registry import query, r6, rounded
from plumbline.staging import table

EDGES = "[0.0::double, 0.1::double, 0.2::double, 0.30000000000000004::double, 0.4::double, 0.5::double, 0.6000000000000001::double, 0.7000000000000001::double, 0.8::double, 0.9::double, 1.0::double]"
BIN = f"(SELECT min(i) FROM range(0, 10) t(i) WHERE s.score >= ({EDGES})[i + 1] AND (CASE WHEN i = 9 THEN s.score <= 1 ELSE s.score < ({EDGES})[i + 2] END))"


def auc_sql(source: str, by: str, positive: str) -> str:
    """Rank form of the AUC, grouped by ``by`` (may be empty)."""
    part, lead = (f"PARTITION BY {by}", f"{by},") if by else ("", "")
    ties = f"PARTITION BY {by + ',' if by else ''} score"
    return f"""SELECT {lead} n_pos, n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (w - n_pos * (n_pos + 1) / 2.0) / (n_pos::double * n_neg) END, 6) AS auc
  FROM (SELECT {lead} count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg, sum(r) FILTER (p) AS w
    FROM (SELECT *, ({positive}) AS p, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({ties}) - 1) / 2.0 AS r FROM {source} WHERE score IS NOT NULL) {'GROUP BY ' + by if by else ''})"""


def ece_sql(source: str, by: str) -> str:
    lead = f"{by}," if by else ""
    return f"""SELECT {lead} round(sum(CASE WHEN bin IS NULL THEN 0 ELSE n * abs(sc - la) END) / sum(n), 6) AS ece
  FROM (SELECT {lead} bin, count(*) AS n, avg(score) AS sc, avg(label::double) AS la FROM (SELECT *, {BIN} AS bin FROM {source} s WHERE score IS NOT NULL) GROUP BY {lead} bin) {'GROUP BY ' + by if by else ''}"""


_LABELLED = "la AS (SELECT doc_id, least(n_chars / 20000.0::double, 1.0) AS score, quality AS label FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rows.select("doc_id", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"), F.col("quality").alias("label"))


@query(f"""WITH {_LABELLED}, a AS ({auc_sql('la', '', 'label = 1')}), t AS (SELECT quantile_cont(score, 0.05) AS threshold FROM la WHERE label = 1)
SELECT 'length' AS judge, n_pos, n_neg, auc, round(threshold, 9) AS threshold, (SELECT round(avg((score < threshold)::int), 9) FROM la, t WHERE label = 1) AS fpr_realized, ece
FROM a, t, ({ece_sql('la', '').replace(', 6)', ', 9)')})""")
def report_one_pass(spark, sf):
    """Document length as a judge of quality."""
    rows = _labelled(spark, sf).withColumn("judge", F.lit("length"))
    out = metrics.auc(rows, ["judge"], "label = 1").join(metrics.detection(rows, ["judge"], "label = 1"), "judge").join(metrics.ece(rows, ["judge"]), "judge")
    return rounded(out, "auc").withColumns({c: F.round(c, 9) for c in ("threshold", "fpr_realized", "ece")})


@query(f"WITH {EVENTS_SQL} {auc_sql('ev', 'judge, event_type', 'extract(hour FROM ts) < 12')}")
def auc_by_group(spark, sf):
    return rounded(metrics.auc(event_scores(spark, sf), ["judge", "event_type"], F.hour("ts") < 12), "auc")


@query(f"WITH {EVENTS_SQL} SELECT judge, item_id, rank() OVER (PARTITION BY judge ORDER BY score) + (count(*) OVER (PARTITION BY judge, score) - 1) / 2.0 AS rank FROM ev WHERE score IS NOT NULL")
def avg_rank(spark, sf):
    return ranks.average_ranks(event_scores(spark, sf).select("judge", "item_id", "score"), ["judge"], "score").select("judge", "item_id", "rank")


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT judge, quantile_cont(score, 0.05) AS threshold FROM ev WHERE label = 1 GROUP BY judge)
SELECT judge, round(threshold, 6) AS threshold, round(avg((score < threshold)::int), 6) AS fpr_realized FROM ev JOIN t USING (judge) WHERE label = 1 GROUP BY ALL""")
def det_at_fpr(spark, sf):
    return rounded(metrics.detection(event_scores(spark, sf), ["judge"], "label = 1"), "threshold", "fpr_realized")


@query(f"""WITH {EXAM_SQL}, t AS (SELECT judge, quantile_cont(score, 0.05) AS threshold FROM ex WHERE instrument = 'pos_real' GROUP BY judge)
SELECT judge, dimension, severity, count(*) AS n, round(avg((score < threshold)::int), 6) AS det FROM ex JOIN t USING (judge) WHERE instrument IN ('corrupt_prog', 'corrupt_gen') GROUP BY ALL""")
def det_rates(spark, sf):
    items = exam_items(spark, sf)
    thr = metrics.detection(items, ["judge"], "instrument = 'pos_real'")
    return rounded(metrics.detection_rates(items, ["judge"], thr, "instrument in ('corrupt_prog', 'corrupt_gen')", ["dimension", "severity"]), "det")


@query(f"WITH {EVENTS_SQL} SELECT judge, bin::int AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS mean_label FROM (SELECT *, {BIN} AS bin FROM ev s) GROUP BY judge, bin")
def ece_bins(spark, sf):
    rows = event_scores(spark, sf).withColumn("bin", metrics.ece_bin(F.col("score")))
    return rows.groupBy("judge", "bin").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"), r6(F.avg("label")).alias("mean_label"))


@query(f"WITH {EVENTS_SQL} {ece_sql('ev', 'judge')}")
def ece(spark, sf):
    return rounded(metrics.ece(event_scores(spark, sf), ["judge"]), "ece")


_RHO = """g AS (SELECT judge, prompt_idx, rank() OVER (PARTITION BY judge, prompt_idx ORDER BY x) + (count(*) OVER (PARTITION BY judge, prompt_idx, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY judge, prompt_idx ORDER BY score) + (count(*) OVER (PARTITION BY judge, prompt_idx, score) - 1) / 2.0 AS ry FROM (SELECT *, extract(hour FROM ts) AS x FROM ev)),
  h AS (SELECT judge, prompt_idx, count(*) AS n, CASE WHEN stddev_pop(rx) = 0 OR stddev_pop(ry) = 0 THEN 0 ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho FROM g GROUP BY ALL)"""


def _groups(spark, sf):
    return metrics.spearman(event_scores(spark, sf).withColumn("x", F.hour("ts")), ["judge", "prompt_idx"], "x")


@query(f"WITH {EVENTS_SQL}, {_RHO} SELECT judge, prompt_idx, n, round(rho, 6) AS rho FROM h")
def spearman_groups(spark, sf):
    return rounded(_groups(spark, sf), "rho")


@query(f"WITH {EVENTS_SQL}, {_RHO} SELECT judge, round(avg(rho), 6) AS rho_mean, round(stddev_pop(rho), 6) AS rho_sd, round(avg((rho > 0)::int), 6) AS rho_positive FROM h GROUP BY judge")
def spearman_summary(spark, sf):
    return rounded(metrics.spearman_summary(_groups(spark, sf), ["judge"]), "rho_mean", "rho_sd", "rho_positive")


def _pair_sql(name: str, pos: str, neg: str) -> str:
    return f"SELECT judge, '{name}' AS which, auc FROM ({auc_sql(f'''(SELECT * FROM ex WHERE instrument IN ('{pos}', '{neg}'))''', 'judge', f'''instrument = '{pos}' ''')})"


_CARD = (
    f"WITH {EXAM_SQL}, au AS (" + " UNION ALL ".join(_pair_sql(n, p, g) for n, (p, g) in metrics.COMPARED.items()) + """),
  t AS (SELECT judge, quantile_cont(score, 0.05) AS threshold FROM ex WHERE instrument = 'pos_real' GROUP BY judge),
  f AS (SELECT judge, threshold, avg((score < threshold)::int) AS fpr FROM ex JOIN t USING (judge) WHERE instrument = 'pos_real' GROUP BY ALL),
  d AS (SELECT judge, avg(det) AS mean_det FROM (SELECT judge, dimension, severity, avg((score < threshold)::int) AS det FROM ex JOIN t USING (judge) WHERE instrument IN ('corrupt_prog', 'corrupt_gen') GROUP BY ALL) GROUP BY judge),
  k AS (SELECT judge, prompt_idx, seed, rank() OVER (PARTITION BY judge, prompt_idx, seed ORDER BY adapter_scale) + (count(*) OVER (PARTITION BY judge, prompt_idx, seed, adapter_scale) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY judge, prompt_idx, seed ORDER BY score) + (count(*) OVER (PARTITION BY judge, prompt_idx, seed, score) - 1) / 2.0 AS ry FROM ex WHERE instrument = 'dial'),
  r AS (SELECT judge, CASE WHEN stddev_pop(rx) = 0 OR stddev_pop(ry) = 0 THEN 0 ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho FROM k GROUP BY judge, prompt_idx, seed),
  s AS (SELECT judge, avg(rho) AS rho_mean, stddev_pop(rho) AS rho_sd, avg((rho > 0)::int) AS rho_positive FROM r GROUP BY judge),
  ca AS (SELECT *, (instrument = 'pos_real')::int AS label FROM ex WHERE instrument IN ('pos_real', 'neg_competitor')),
  e AS (""" + ece_sql("ca", "judge") + """),
  w AS (SELECT judge, """ + ", ".join(f"max(auc) FILTER (which = '{n}') AS {n}" for n in metrics.COMPARED) + """ FROM au GROUP BY judge)
SELECT judge, auc_vs_competitor, auc_vs_masked, auc_vs_clean, auc_temporal_vs_competitor, round(auc_vs_competitor - auc_vs_masked, 5) AS logo_delta, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr_realized,
  round(mean_det, 6) AS mean_det, round(rho_mean, 6) AS rho_mean, round(rho_sd, 6) AS rho_sd, round(rho_positive, 6) AS rho_positive, ece
FROM w JOIN f USING (judge) JOIN d USING (judge) JOIN s USING (judge) JOIN e USING (judge)"""
)


@query(_CARD)
def report_card(spark, sf):
    """All metrics of all judges in one job."""
    card = metrics.report_card(exam_items(spark, sf))
    card = rounded(card, *(c for c in card.columns if c not in ("judge", "logo_delta")))
    return card.withColumn("logo_delta", F.round(F.col("auc_vs_competitor") - F.col("auc_vs_masked"), 5))


@query(f"""WITH {EXAM_SQL}, t AS (SELECT judge, quantile_cont(score, 0.05) AS threshold FROM ex WHERE instrument = 'pos_real' GROUP BY judge),
  c AS (SELECT judge, dimension, severity, avg((score < threshold)::int) AS det FROM ex JOIN t USING (judge) WHERE instrument IN ('corrupt_prog', 'corrupt_gen') GROUP BY ALL)
SELECT judge, """ + ", ".join(f"""round(max(det) FILTER (dimension = '{d}' AND severity = {s}), 6) AS "{d}/s{s}" """ for d in "12345" for s in (1, 2, 3)) + " FROM c GROUP BY judge")
def heatmap_matrix(spark, sf):
    items = exam_items(spark, sf)
    thr = metrics.detection(items, ["judge"], "instrument = 'pos_real'")
    cells = metrics.detection_rates(items, ["judge"], thr, "instrument in ('corrupt_prog', 'corrupt_gen')", ["dimension", "severity"])
    return reports.heatmap(rounded(cells, "det"), list("12345"))


@query(f"""WITH {EXAM_SQL}, t AS (SELECT judge, quantile_cont(score, 0.05) AS threshold FROM ex WHERE instrument = 'pos_real' GROUP BY judge),
  c AS (SELECT judge, dimension, severity, avg((score < threshold)::int) AS det FROM ex JOIN t USING (judge) WHERE instrument IN ('corrupt_prog', 'corrupt_gen') GROUP BY ALL)
SELECT judge, count(*) AS cells, round(avg(det), 6) AS mean_det FROM c GROUP BY judge""")
def mean_det(spark, sf):
    items = exam_items(spark, sf)
    thr = metrics.detection(items, ["judge"], "instrument = 'pos_real'")
    cells = metrics.detection_rates(items, ["judge"], thr, "instrument in ('corrupt_prog', 'corrupt_gen')", ["dimension", "severity"])
    return cells.groupBy("judge").agg(F.count("*").alias("cells"), r6(F.avg("det")).alias("mean_det"))


@query(f"WITH {EXAM_SQL}, au AS ({_pair_sql('a', 'pos_real', 'neg_competitor')} UNION ALL {_pair_sql('b', 'pos_real', 'neg_masked')}) SELECT judge, round(max(auc) FILTER (which = 'a') - max(auc) FILTER (which = 'b'), 5) AS logo_delta FROM au GROUP BY judge")
def logo_delta(spark, sf):
    """How much of the discrimination hangs on the cue that masking removes."""
    items = exam_items(spark, sf)
    side = lambda neg, out: rounded(metrics.auc(items.where(F.col("instrument").isin("pos_real", neg)), ["judge"], F.col("instrument") == "pos_real"), "auc").select("judge", F.col("auc").alias(out))
    return side("neg_competitor", "c").join(side("neg_masked", "m"), "judge").select("judge", F.round(F.col("c") - F.col("m"), 5).alias("logo_delta"))


@query(f"WITH {EVENTS_SQL} SELECT judge, count(*) AS n FROM ev WHERE event_type <> 'error' OR judge = 'fine' GROUP BY judge HAVING count(*) > 900")
def complete_judges(spark, sf):
    rows = event_scores(spark, sf).where("event_type <> 'error' or judge = 'fine'")
    return metrics.complete_judges(rows, 900)


@query(f"WITH {EVENTS_SQL} SELECT judge, event_type, item_id, rank::int AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY judge, event_type ORDER BY score DESC, item_id) AS rank FROM ev) WHERE rank <= 6")
def top_exemplars(spark, sf):
    rows = reports.exemplars(event_scores(spark, sf), ["judge", "event_type"], 6)
    return rows.select("judge", "event_type", "item_id", "rank", r6("score").alias("score"))
