"""Baseline search, model training, scoring and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as i
from queries.registry import STEPS, query, r
from queries.rows import rounded
from queries.stages import scoring
from rotorwatch.operators import baseline, diagnosis, fleet, model
from rotorwatch.session import materialize

STEPS["spans"] = """
SELECT device_id, min(datetime) AS t0, max(datetime) AS t1,
 (epoch_us(max(datetime)) - epoch_us(min(datetime))) // 86400000000 AS days FROM merged GROUP BY 1"""
STEPS["windows14"] = """
SELECT device_id, k, CASE WHEN days < 14 THEN t0 ELSE t0 + to_days(CAST(k AS INTEGER)) END AS start_date,
 CASE WHEN days < 14 THEN t1 ELSE t0 + to_days(CAST(k AS INTEGER) + 14) END AS end_date, days < 14 AS short
FROM (SELECT *, unnest(range(0, greatest(days - 12, 1))) AS k FROM spans)"""
STEPS["members"] = """
SELECT w.device_id, w.k, w.start_date, w.end_date, m.datetime, m.row_id, m.accOA, m.Total_vRMS, m.Crest_Factor
FROM windows14 w JOIN merged m ON m.device_id = w.device_id AND m.datetime >= w.start_date
 AND (w.short OR m.datetime < w.end_date)"""


def cv(c):
    return f"stddev_samp({c}) / nullif(avg({c}), 0)"


STEPS["stability"] = f"""
SELECT device_id, k AS window_no, start_date, end_date, {r('quantile_cont(accOA, 0.5)')} AS accOA_median,
 {r('quantile_cont(Total_vRMS, 0.5)')} AS vRMS_median, {r(cv('accOA'))} AS accOA_cv, {r(cv('Total_vRMS'))} AS vRMS_cv,
 {r(cv('Crest_Factor'))} AS cf_cv, {r(f"quantile_cont(accOA, 0.5) * ({cv('accOA')})")} AS stability_score,
 count(*) AS n_rows
FROM members GROUP BY ALL HAVING count(*) >= 15 AND count(accOA) >= 15"""
STEPS["prefiltered"] = """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY stability_score, start_date) AS INTEGER) AS rank
 FROM stability) WHERE rank <= 10"""
STEPS["passed"] = """
SELECT * FROM (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY device_id) AS n_ok FROM (
 SELECT *, coalesce(accOA_cv < 0.20, false) AND coalesce(vRMS_cv < 0.25, false) AND coalesce(cf_cv < 0.30, false) AS ok
 FROM prefiltered)) WHERE ok OR n_ok = 0"""
STEPS["candidates"] = """
SELECT * FROM (SELECT device_id, CAST(row_number() OVER (PARTITION BY device_id ORDER BY stability_score, start_date) AS INTEGER) AS rank,
 start_date, end_date, accOA_median, vRMS_median, accOA_cv, vRMS_cv, cf_cv, stability_score, n_rows FROM passed)
WHERE rank <= 3"""
STEPS["hand_picked"] = """
SELECT m.* FROM merged m JOIN device_dim d ON m.devicename = d.devicename
WHERE m.datetime BETWEEN d.train_start AND d.train_end"""
STEPS["base_rows"] = """
SELECT *, true AS is_manual FROM hand_picked
UNION ALL SELECT m.*, false FROM merged m JOIN candidates c ON c.device_id = m.device_id AND c.rank = 1
WHERE m.datetime >= c.start_date AND m.datetime < c.end_date
 AND m.device_id NOT IN (SELECT device_id FROM hand_picked)"""
STEPS["bin_choice"] = """
SELECT device_id, CASE WHEN count("頻率") >= 10 THEN '頻率' WHEN count(current_A) >= 10 THEN 'current_A' END AS bin_col
FROM base_rows GROUP BY 1"""
STEPS["bin_rows"] = """
SELECT b.*, c.bin_col, CASE c.bin_col WHEN '頻率' THEN b."頻率" WHEN 'current_A' THEN b.current_A END AS bin_value
FROM base_rows b JOIN bin_choice c USING (device_id)"""
STEPS["edge_sets"] = """
SELECT device_id, 3 AS q, list_sort(list_distinct(quantile_cont(bin_value, [0e0, 1/3e0, 2/3e0, 1e0]))) AS e FROM bin_rows GROUP BY 1
UNION ALL SELECT device_id, 2, list_sort(list_distinct(quantile_cont(bin_value, [0e0, 0.5e0, 1e0]))) FROM bin_rows GROUP BY 1
UNION ALL SELECT device_id, 1, list_sort(list_distinct(quantile_cont(bin_value, [0e0, 1e0]))) FROM bin_rows GROUP BY 1"""
STEPS["bin_edges"] = """
SELECT device_id, max(q) AS q, arg_max(e, q) AS edges FROM (
 SELECT device_id, q, e, min(c) AS least_rows FROM (
  SELECT s.device_id, s.q, s.e, len(list_filter(s.e[2:len(s.e) - 1], lambda x: x < b.bin_value)) AS lab, count(*) AS c
  FROM edge_sets s JOIN bin_rows b USING (device_id) WHERE b.bin_value IS NOT NULL GROUP BY ALL)
 GROUP BY ALL) WHERE least_rows >= 15 AND (q = 1 OR len(e) > 1) GROUP BY 1"""


def bin_of(value, edges):
    return (f"CASE WHEN {value} >= {edges}[1] AND {value} <= {edges}[len({edges})] "
            f"THEN len(list_filter({edges}[2:len({edges}) - 1], lambda x: x < {value})) ELSE 0 END")


STEPS["binned_base"] = f"""
SELECT b.*, e.edges, CAST({bin_of('b.bin_value', 'e.edges')} AS INTEGER) AS bin_id
FROM bin_rows b LEFT JOIN bin_edges e USING (device_id)"""
STEPS["moments"] = """
SELECT device_id, bin_id, any_value(bin_col) AS bin_col, any_value(edges) AS edges, count(*) AS n_train,
 avg(Total_vRMS) AS m1, avg(accOA) AS m2, avg(Crest_Factor) AS m3,
 covar_samp(Total_vRMS, Total_vRMS) AS a, covar_samp(Total_vRMS, accOA) AS b, covar_samp(Total_vRMS, Crest_Factor) AS c,
 covar_samp(accOA, accOA) AS d, covar_samp(accOA, Crest_Factor) AS e, covar_samp(Crest_Factor, Crest_Factor) AS f
FROM binned_base GROUP BY 1, 2 HAVING count(*) >= 2"""
# Inverse of the symmetric 3 x 3 covariance through its adjugate.
STEPS["inverses"] = """
SELECT *, (d*f - e*e) / det AS i11, (c*e - b*f) / det AS i12, (b*e - c*d) / det AS i13,
 (a*f - c*c) / det AS i22, (b*c - a*e) / det AS i23, (a*d - b*b) / det AS i33
FROM (SELECT *, a*(d*f - e*e) - b*(b*f - c*e) + c*(b*e - c*d) AS det FROM moments)"""


def dist(x="x"):
    v = [f"({x}.{c} - i.m{n})" for n, c in ((1, "Total_vRMS"), (2, "accOA"), (3, "Crest_Factor"))]
    return (f"sqrt({v[0]}*{v[0]}*i.i11 + {v[1]}*{v[1]}*i.i22 + {v[2]}*{v[2]}*i.i33"
            f" + 2*{v[0]}*{v[1]}*i.i12 + 2*{v[0]}*{v[2]}*i.i13 + 2*{v[1]}*{v[2]}*i.i23)")


STEPS["base_dist"] = f"""
SELECT x.device_id, x.bin_id, x.row_id, {dist()} AS distance
FROM binned_base x JOIN inverses i ON x.device_id = i.device_id AND x.bin_id = i.bin_id"""
STEPS["lambdas"] = """
SELECT device_id, bin_id, quantile_cont(distance, 0.95) AS p95,
 CASE WHEN quantile_cont(distance, 0.95) > 0 THEN -ln(0.8e0) / quantile_cont(distance, 0.95) ELSE 1e0 END AS lam
FROM base_dist GROUP BY 1, 2"""
STEPS["models"] = """
SELECT i.*, l.lam, q.avg_score FROM inverses i JOIN lambdas l USING (device_id, bin_id)
JOIN (SELECT d.device_id, d.bin_id, avg(least(100, greatest(0, 100 * exp(-l.lam * d.distance)))) AS avg_score
 FROM base_dist d JOIN lambdas l USING (device_id, bin_id) GROUP BY 1, 2) q USING (device_id, bin_id)"""
STEPS["load_rows"] = f"""
SELECT m.*, e.bin_col, e.edges, e.last_bin,
 CAST({bin_of("(CASE e.bin_col WHEN '頻率' THEN m.頻率 WHEN 'current_A' THEN m.current_A END)", 'e.edges')} AS INTEGER) AS load_bin
FROM merged m JOIN (SELECT device_id, any_value(bin_col) AS bin_col, any_value(edges) AS edges, max(bin_id) AS last_bin
 FROM models GROUP BY 1) e USING (device_id)"""
STEPS["param_rows"] = """
SELECT x.*, coalesce(b.bin_id, x.last_bin) AS param_bin
FROM load_rows x LEFT JOIN models b ON b.device_id = x.device_id AND b.bin_id = x.load_bin"""
STEPS["score_rows"] = f"""
SELECT x.*, {dist()} AS distance, least(100, greatest(0, 100 * exp(-i.lam * {dist()}))) AS health_score
FROM param_rows x JOIN models i ON i.device_id = x.device_id AND i.bin_id = x.param_bin"""
_SMOOTH = "OVER (PARTITION BY device_id ORDER BY datetime, row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
STEPS["scored"] = f"""
SELECT *, CASE WHEN health_score IS NULL THEN 'Unknown' WHEN health_score >= 80 THEN 'Normal'
  WHEN health_score >= 60 THEN 'Warning' ELSE 'Critical' END AS alert_level,
 quantile_cont(health_score, 0.5) {_SMOOTH} AS health_score_smooth FROM score_rows"""
STEPS["flagged"] = """
SELECT s.*, b.datetime IS NOT NULL AS is_baseline FROM scored s
LEFT JOIN (SELECT DISTINCT device_id, datetime FROM base_rows) b ON b.device_id = s.device_id AND b.datetime = s.datetime"""
STEPS["records"] = """
SELECT l.*, b.baseline_start, b.baseline_end, coalesce(d.machine_id, l.devicename) AS machine_id,
 coalesce(d.model_group, '') AS model_group
FROM (SELECT device_id, devicename, position, arg_max(health_score, datetime) AS latest, count(*) AS data_count
 FROM scored GROUP BY ALL) l
JOIN (SELECT device_id, CAST(min(datetime) AS DATE) AS baseline_start, CAST(max(datetime) AS DATE) AS baseline_end
 FROM base_rows GROUP BY 1) b USING (device_id)
LEFT JOIN device_dim d ON l.devicename = d.devicename"""

_STATS = ("accOA_median", "vRMS_median", "accOA_cv", "vRMS_cv", "cf_cv", "stability_score")
_CAND = f"device_id, rank, start_date, end_date, {', '.join(_STATS)}, n_rows"


@query("coefficient_of_variation", f"""
SELECT device_id, {', '.join(f'{r(cv(c))} AS {c}' for c in ('accOA', 'Total_vRMS', 'Crest_Factor'))}
FROM merged GROUP BY 1""")
def variation(spark, sf):
    rows = scoring(spark, sf).rows
    return rows.groupBy("device_id").agg(*[
        F.round(baseline.variation(c), 6).alias(c) for c in ("accOA", "Total_vRMS", "Crest_Factor")])


@query("sliding_baseline_windows", """
SELECT device_id, k AS window_no, start_date, end_date, count(*) AS n_rows FROM members GROUP BY ALL""")
def windows(spark, sf):
    rows = scoring(spark, sf).rows.select("device_id", "datetime")
    return baseline.sliding_windows(rows).groupBy("device_id", "window_no", "start_date", "end_date").agg(
        F.count("*").alias("n_rows"))


@query("window_stability", f"""
SELECT device_id, window_no, start_date, end_date, {', '.join(_STATS)}, n_rows FROM stability""")
def stability(spark, sf):
    return baseline.window_stability(scoring(spark, sf).rows)


@query("topk_prefilter", f"SELECT {_CAND} FROM prefiltered")
def prefilter(spark, sf):
    top = baseline.steadiest_windows(baseline.window_stability(scoring(spark, sf).rows), 10)
    return top.select("device_id", *baseline.CANDIDATE_COLUMNS)


def _pool(spark, sf):
    return baseline.steadiest_windows(baseline.window_stability(scoring(spark, sf).rows), 10)


@query("cv_filter_relax", "SELECT device_id, start_date, ok AS passes_cv, stability_score FROM passed")
def relax(spark, sf):
    return baseline.cv_filter_relax(_pool(spark, sf)).select(
        "device_id", "start_date", "passes_cv", "stability_score")


@query("rank_candidates", "SELECT device_id, rank, start_date, stability_score FROM candidates")
def ranked(spark, sf):
    return baseline.rank_candidates(baseline.cv_filter_relax(_pool(spark, sf))).select(
        "device_id", "rank", "start_date", "stability_score")


@query("topk_candidates", "SELECT device_id, rank, end_date, n_rows FROM candidates WHERE rank <= 2")
def best_two(spark, sf):
    return baseline.rank_candidates(baseline.cv_filter_relax(_pool(spark, sf)), 2).select(
        "device_id", "rank", "end_date", "n_rows")


@query("detect_baseline", f"SELECT {_CAND} FROM candidates")
def detect(spark, sf):
    return baseline.detect_baseline(scoring(spark, sf).rows)


@query("manual_baseline_filter", "SELECT row_id, device_id FROM hand_picked")
def by_hand(spark, sf):
    return baseline.manual_baseline(scoring(spark, sf).rows, i.device_dim(spark, sf)).select("row_id", "device_id")


@query("baseline_slice", "SELECT row_id, device_id, is_manual FROM base_rows")
def sliced(spark, sf):
    run = scoring(spark, sf)
    return baseline.baseline_slice(run.rows, run.candidates, i.device_dim(spark, sf)).select(
        "row_id", "device_id", "is_manual")


@query("resolve_bin_column", "SELECT * FROM bin_choice")
def bin_column(spark, sf):
    return model.resolve_bin_column(scoring(spark, sf).baseline)


@query("quantile_bins", f"""
SELECT device_id, CAST(unnest(range(1, len(edges) + 1)) AS INTEGER) AS edge_no,
 {r('unnest(edges)', 6)} AS edge FROM bin_edges""")
def quantile(spark, sf):
    rows = scoring(spark, sf).baseline
    edges = model.quantile_bins(model.with_bin_value(rows, model.resolve_bin_column(rows)))
    return edges.select("device_id", F.posexplode("edges").alias("n", "e")).select(
        "device_id", (F.col("n") + 1).alias("edge_no"), F.round("e", 6).alias("edge"))


@query("fit_bin_moments", f"""
SELECT device_id, bin_id, n_train, {', '.join(f'{r(f"m{k}")} AS m{k}' for k in (1, 2, 3))},
 {', '.join(f'{r(f"i{k}", 4)} AS i{k}' for k in (11, 12, 13, 22, 23, 33))} FROM inverses""")
def fitted(spark, sf):
    df = model.fit_bin_moments(model.label_baseline(scoring(spark, sf).baseline))
    inv = [F.round(F.col("cov_inv")[a][b], 4).alias(f"i{a + 1}{b + 1}") for a in range(3) for b in range(a, 3)]
    return df.select("device_id", "bin_id", "n_train",
                     *[F.round(F.col("mean")[k], 6).alias(f"m{k + 1}") for k in range(3)], *inv)


@query("calibrate_lambda", f"""
SELECT device_id, bin_id, {r('p95')} AS p95, {r('lam')} AS "lambda" FROM lambdas""")
def lam(spark, sf):
    run = scoring(spark, sf)
    labelled = model.label_baseline(run.baseline)
    feats = list(model.DEFAULTS.features)
    d = labelled.join(F.broadcast(run.model.select("device_id", "bin_id", "mean", "cov_inv")), ["device_id", "bin_id"]).select(
        "device_id", "bin_id", model.mahalanobis(feats, "mean", "cov_inv").alias("distance"))
    return rounded(model.calibrate_lambda(materialize(d, "distances")), "p95", "lambda")


@query("mahalanobis_distance", f"SELECT row_id, device_id, {r('distance', 5)} AS distance FROM score_rows")
def distance(spark, sf):
    run = scoring(spark, sf)
    return model.score_rows(run.rows, run.model).select("row_id", "device_id", F.round("distance", 5).alias("distance"))


@query("train_model", f"""
SELECT device_id, bin_id, bin_col, n_train, {r('lam', 5)} AS "lambda", {r('avg_score', 5)} AS avg_score FROM models""")
def trained(spark, sf):
    m = model.train_model(scoring(spark, sf).baseline)
    return m.select("device_id", "bin_id", "bin_col", "n_train", F.round("lambda", 5).alias("lambda"),
                    F.round("avg_score", 5).alias("avg_score"))


@query("model_summary", f"""
SELECT device_id, bin_id, n_train, {r('lam', 4)} AS "lambda", {r('avg_score', 1)} AS avg_baseline_score FROM models""")
def summary(spark, sf):
    return model.model_summary(scoring(spark, sf).model)


@query("bin_params_fallback", f"""
SELECT x.row_id, x.load_bin, {r('m.lam', 5)} AS "lambda" FROM param_rows x
JOIN models m ON m.device_id = x.device_id AND m.bin_id = x.param_bin""")
def fallback(spark, sf):
    run = scoring(spark, sf)
    return model.bin_params_fallback(run.rows, run.model).select(
        "row_id", "load_bin", F.round(F.col("_p")["lambda"], 5).alias("lambda"))


@query("predict_scores", f"""
SELECT row_id, device_id, load_bin, {r('health_score', 4)} AS health_score, alert_level,
 {r('health_score_smooth', 4)} AS health_score_smooth FROM scored""")
def predicted(spark, sf):
    df = scoring(spark, sf).predicted
    return df.select("row_id", "device_id", "load_bin", F.round("health_score", 4).alias("health_score"),
                     "alert_level", F.round("health_score_smooth", 4).alias("health_score_smooth"))


@query("latest_score", f"""
SELECT device_id, {r('arg_max(health_score, datetime)', 4)} AS latest_score, arg_max(alert_level, datetime) AS last_alert
FROM scored GROUP BY 1""")
def latest(spark, sf):
    df = diagnosis.latest_score(scoring(spark, sf).scored)
    return df.withColumn("latest_score", F.round("latest_score", 4))


@query("scoring_status", """
SELECT v.device_id, CASE WHEN NOT c.yes THEN 'no_clean_rows' WHEN NOT b.yes THEN 'no_baseline' WHEN NOT m.yes THEN 'not_trained'
 WHEN NOT s.yes THEN 'not_scored' ELSE 'scored' END AS status
FROM (SELECT DISTINCT device_id FROM vib) v,
 LATERAL (SELECT count(*) > 0 AS yes FROM merged x WHERE x.device_id = v.device_id) c,
 LATERAL (SELECT count(*) > 0 AS yes FROM base_rows x WHERE x.device_id = v.device_id) b,
 LATERAL (SELECT count(*) > 0 AS yes FROM models x WHERE x.device_id = v.device_id) m,
 LATERAL (SELECT count(health_score) > 0 AS yes FROM scored x WHERE x.device_id = v.device_id) s""")
def status(spark, sf):
    run = scoring(spark, sf)
    return fleet.scoring_status(i.vib(spark, sf), run.rows, run.baseline, run.model, run.scored)


@query("semi_join_baseline", "SELECT row_id FROM flagged WHERE is_baseline")
def in_baseline(spark, sf):
    run = scoring(spark, sf)
    return diagnosis.baseline_flag(scoring(spark, sf).scored, run.baseline).where("is_baseline").select("row_id")


@query("baseline_average_score", f"""
SELECT device_id, {r('avg(health_score)', 4)} AS baseline_avg, avg(health_score) >= 85 AS baseline_ok
FROM flagged WHERE is_baseline GROUP BY 1""")
def base_avg(spark, sf):
    run = scoring(spark, sf)
    df = diagnosis.baseline_average_score(scoring(spark, sf).scored, run.baseline)
    return df.withColumn("baseline_avg", F.round("baseline_avg", 4))


@query("device_summary", f"""
SELECT machine_id, max(model_group) AS model_group,
 max({r('latest', 1)}) FILTER (WHERE position = 'M1') AS "latest_score_M1",
 max({r('latest', 1)}) FILTER (WHERE position = 'M2') AS "latest_score_M2",
 min({r('latest', 1)}) AS overall_score,
 CASE WHEN min({r('latest', 1)}) IS NULL THEN 'Unknown' WHEN min({r('latest', 1)}) >= 80 THEN 'Normal'
  WHEN min({r('latest', 1)}) >= 60 THEN 'Warning' ELSE 'Critical' END AS alert_level,
 coalesce(max(baseline_start) FILTER (WHERE position = 'M1'), max(baseline_start) FILTER (WHERE position = 'M2')) AS baseline_start,
 coalesce(max(baseline_end) FILTER (WHERE position = 'M1'), max(baseline_end) FILTER (WHERE position = 'M2')) AS baseline_end,
 CAST(sum(data_count) AS BIGINT) AS data_count FROM records GROUP BY 1""")
def machines(spark, sf):
    run = scoring(spark, sf)
    return fleet.device_summary(fleet.device_records(scoring(spark, sf).scored, run.baseline, i.device_dim(spark, sf)))


@query("bin_range_check", f"""
SELECT device_id, bin_col, {r('any_value(edges)[1]')} AS trained_min, {r('any_value(edges)[len(any_value(edges))]')} AS trained_max,
 {r('min(v)')} AS scored_min, {r('max(v)')} AS scored_max,
 min(v) < any_value(edges)[1] AS below, max(v) > any_value(edges)[len(any_value(edges))] AS above
FROM (SELECT *, CASE bin_col WHEN '頻率' THEN "頻率" WHEN 'current_A' THEN current_A END AS v FROM load_rows)
WHERE edges IS NOT NULL GROUP BY 1, 2""")
def ranges(spark, sf):
    run = scoring(spark, sf)
    df = diagnosis.bin_range_check(scoring(spark, sf).scored, run.model)
    return rounded(df, "trained_min", "trained_max", "scored_min", "scored_max")


@query("baseline_feature_cv", " UNION ALL ".join(f"""
SELECT device_id, '{c}' AS feature, {r(cv(c))} AS cv, CAST({lim} AS DOUBLE) AS cv_limit, coalesce({cv(c)} < {lim}, false) AS stable
FROM base_rows GROUP BY 1""" for c, lim in (("Total_vRMS", 0.25), ("accOA", 0.2), ("Crest_Factor", 0.3))))
def feature_cv(spark, sf):
    return rounded(diagnosis.baseline_feature_cv(scoring(spark, sf).baseline), "cv")


_MED = "quantile_cont({c}, 0.5) FILTER (WHERE {n} is_baseline)"
STEPS["drifted"] = f"""
SELECT device_id, load_bin, {_MED.format(c='accOA', n='')} AS a0, {_MED.format(c='accOA', n='NOT')} AS a1,
 {_MED.format(c='current_A', n='')} AS c0, {_MED.format(c='current_A', n='NOT')} AS c1 FROM flagged GROUP BY 1, 2"""


@query("bin_drift", f"""
SELECT device_id, load_bin, {r('a0')} AS accOA_baseline, {r('a1')} AS accOA_recent, {r('c0')} AS current_baseline,
 {r('c1')} AS current_recent, {r('a1 / a0')} AS ratio,
 CASE WHEN a1 / a0 > 1.15 THEN 'worse' WHEN a1 / a0 >= 0.9 THEN 'similar' ELSE 'better' END AS drift
FROM drifted WHERE a0 IS NOT NULL AND a1 IS NOT NULL""")
def drift(spark, sf):
    run = scoring(spark, sf)
    df = diagnosis.bin_drift(diagnosis.baseline_flag(scoring(spark, sf).scored, run.baseline))
    return rounded(df, "accOA_baseline", "accOA_recent", "current_baseline", "current_recent", "ratio")


@query("score_feature_corr", " UNION ALL ".join(f"""
SELECT device_id, '{c}' AS feature, count(*) AS n, {r(f'corr(health_score, {c})', 5)} AS r,
 CASE WHEN corr(health_score, {c}) < -0.3 THEN 'negative' WHEN corr(health_score, {c}) < 0 THEN 'weak' ELSE 'positive' END AS direction
FROM scored WHERE health_score IS NOT NULL AND {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 10"""
    for c in ("Total_vRMS", "accOA", "Crest_Factor")))
def score_corr(spark, sf):
    df = diagnosis.score_feature_corr(scoring(spark, sf).scored)
    return df.withColumn("r", F.round("r", 5))


@query("bin_score_spread", f"""
SELECT device_id, load_bin, count(health_score) AS n, {', '.join(f"{r(f'{f}(health_score)', 4)} AS {n}" for f, n in
 (('stddev_samp', 'std'), ('avg', 'mean'), ('min', 'min'), ('max', 'max')))},
 NOT coalesce(stddev_samp(health_score) <= 15, false) AS unsteady
FROM scored WHERE health_score IS NOT NULL GROUP BY 1, 2""")
def spread(spark, sf):
    df = diagnosis.bin_score_spread(scoring(spark, sf).scored)
    return df.select("device_id", "load_bin", "n", *[F.round(c, 4).alias(c) for c in ("std", "mean", "min", "max")], "unsteady")


@query("smoothing_effect", f"""
SELECT device_id, {r('stddev_samp(health_score)', 4)} AS raw_std, {r('stddev_samp(health_score_smooth)', 4)} AS smooth_std,
 {r('(1 - stddev_samp(health_score_smooth) / stddev_samp(health_score)) * 100', 4)} AS reduction_pct
FROM scored GROUP BY 1 HAVING stddev_samp(health_score) > 0""")
def smoothing(spark, sf):
    df = diagnosis.smoothing_effect(scoring(spark, sf).scored)
    return df.select("device_id", *[F.round(c, 4).alias(c) for c in ("raw_std", "smooth_std", "reduction_pct")])
