"""Forecast features, evaluation, comparison of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import ctes as c
from panelforge.catalog.registry import query
from panelforge.functions.storage import cut
from panelforge.operators import comparison as cm
from panelforge.operators import forecast as fc
from panelforge.sources import adapters as ad
from panelforge.sources import panel as pn

TRAIN, TEST = c.supplier(1999), c.supplier(2000, "test")
W = "PARTITION BY household_id ORDER BY date"
LABELS = "labels AS (SELECT DISTINCT household_id, CAST(household_id % 3 AS INTEGER) AS cluster FROM panel)"
LAGS = [f"lag_{k}" for k in fc.LAGS]
ROLLS = [x for w in fc.WINDOWS for x in (f"rolling_mean_{w}", f"rolling_std_{w}")]
LAG_SQL = ", ".join(f"lag(consumption, {k}) OVER ({W}) AS lag_{k}" for k in fc.LAGS)
ROLL_SQL = ", ".join(
    f"avg(consumption) OVER ({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS rolling_mean_{w}, coalesce(stddev_samp(consumption) OVER ({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS rolling_std_{w}" for w in fc.WINDOWS
)
CAL_SQL = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
  sin(2 * pi() * dayofyear(date) / 366) AS day_of_year_sin, cos(2 * pi() * dayofyear(date) / 366) AS day_of_year_cos, sin(2 * pi() * weekofyear(date) / 53) AS week_of_year_sin, cos(2 * pi() * weekofyear(date) / 53) AS week_of_year_cos"""
CAL = "day_of_week month day_of_year is_weekend week_of_year"
PRIORS = """known AS (SELECT * FROM panel JOIN labels USING (household_id)),
dowp AS (SELECT cluster, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, avg(consumption) AS cluster_dow_mean FROM known GROUP BY 1, 2),
monp AS (SELECT cluster, CAST(month(date) AS INTEGER) AS month, avg(consumption) AS cluster_month_mean FROM known GROUP BY 1, 2)"""
FEATURES = f"""feats AS (SELECT *, household_mean - cluster_dow_mean AS household_minus_cluster_dow_mean, household_mean - cluster_month_mean AS household_minus_cluster_month_mean
  FROM (SELECT *, avg(consumption) OVER (PARTITION BY household_id) AS household_mean, {LAG_SQL}, {ROLL_SQL}, {CAL_SQL} FROM panel) JOIN labels USING (household_id)
  LEFT JOIN dowp USING (cluster, day_of_week) LEFT JOIN monp USING (cluster, month))"""


def _train(spark, d):
    return ad.supplier_panel(spark, d, 1999)


def _test(spark, d):
    return ad.supplier_panel(spark, d, 2000)


def _labels(spark, d):
    return ad.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("household_id"), (F.col("s_suppkey") % 3).cast("int").alias("cluster"))


@query("w1_wide_to_long", "household_id date", "consumption", f"{c.ctes(c.EVENT)} SELECT * FROM panel")
def w1(spark, d):
    from datetime import date, timedelta

    panel = ad.event_panel(spark, d)
    return pn.wide_to_long(pn.long_to_wide(panel, [date(2024, 1, 1) + timedelta(days=i) for i in range(30)]))


@query("w2_cluster_weekday_priors", "cluster day_of_week", "cluster_dow_mean", f"{c.ctes(TRAIN, LABELS, PRIORS)} SELECT * FROM dowp")
def w2a(spark, d):
    return fc.cluster_priors(_train(spark, d), _labels(spark, d))[0]


@query("w2_cluster_month_priors", "cluster month", "cluster_month_mean", f"{c.ctes(TRAIN, LABELS, PRIORS)} SELECT * FROM monp")
def w2b(spark, d):
    return fc.cluster_priors(_train(spark, d), _labels(spark, d))[1]


@query("w3_w4_lags_and_rolling", "household_id date", " ".join(LAGS + ROLLS), f"{c.ctes(TRAIN)} SELECT household_id, date, {LAG_SQL}, {ROLL_SQL} FROM panel")
def w34(spark, d):
    return fc.lag_features(_train(spark, d))


@query("w5_w6_calendar", f"household_id date {CAL}", "day_of_year_sin day_of_year_cos week_of_year_sin week_of_year_cos", f"{c.ctes(TEST)} SELECT household_id, date, {CAL_SQL} FROM test")
def w56(spark, d):
    return fc.calendar_features(_test(spark, d))


_REST = [f for f in fc.FEATURES if f not in CAL.split()]


@query("w7_w9_all_features", f"household_id date cluster {CAL}", " ".join(["consumption", *_REST]), f"{c.ctes(TRAIN, LABELS, PRIORS, FEATURES)} SELECT * FROM feats")
def w79(spark, d):
    panel, labels = _train(spark, d), _labels(spark, d)
    return fc.build_features(panel, labels, fc.cluster_priors(panel, labels))


@query("w10_training_rows", f"household_id date cluster {CAL}", " ".join(["consumption", *_REST]), f"{c.ctes(TRAIN, LABELS, PRIORS, FEATURES)} SELECT * FROM feats WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL AND lag_30 IS NOT NULL")
def w10(spark, d):
    return fc.training_rows(_train(spark, d), _labels(spark, d))


@query(
    "m5_backtest_splits",
    "split val_start val_end",
    "",
    f"""{c.ctes(TRAIN)}, b AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS back FROM (SELECT DISTINCT date FROM panel))
SELECT CAST(3 - back // 28 AS INTEGER) AS split, min(date) AS val_start, max(date) AS val_end FROM b WHERE back < 84 GROUP BY 1""",
)
def m5(spark, d):
    return fc.backtest_splits(_train(spark, d))


NAIVE = """fcast AS (SELECT p.household_id, t.date, greatest(p.consumption, 0) AS predicted FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM test)) t
  JOIN panel p ON p.date = DATE '1999-12-25' + CAST(t.i % 7 AS INTEGER))"""
MEANF = "meanf AS (SELECT p.household_id, t.date, p.predicted FROM (SELECT household_id, avg(consumption) AS predicted FROM panel GROUP BY 1) p CROSS JOIN (SELECT DISTINCT date FROM test) t)"


def _err(source: str, name: str) -> str:
    return f"{name} AS (SELECT household_id, avg(abs(t.consumption - f.predicted)) AS mae, count(*) AS n_days_compared, count(*) = 366 AS complete_horizon_flag FROM {source} f JOIN test t USING (household_id, date) GROUP BY 1)"


BASE = c.ctes(TRAIN, TEST, LABELS, NAIVE, MEANF, _err("fcast", "e1"), _err("meanf", "e2")) + ", errs AS (SELECT 'naive' AS method, * FROM e1 UNION ALL SELECT 'mean', * FROM e2)"
JOINED = f"{BASE}, act AS (SELECT f.household_id, f.date, f.predicted, t.consumption, abs(t.consumption - f.predicted) AS abs_error, l.cluster FROM fcast f LEFT JOIN test t USING (household_id, date) JOIN labels l USING (household_id))"


def _naive(spark, d):
    return fc.naive_forecast(_train(spark, d), _test(spark, d))


def _mean(spark, d):
    """The household's training mean for every test day."""
    level = _train(spark, d).groupBy("household_id").agg(F.avg("consumption").alias("predicted"))
    return pn.spine(level, "2000-01-01", "2000-12-31", "predicted")


def _errors(spark, d):
    test = _test(spark, d)
    each = [fc.household_mae(f(spark, d), test).withColumn("method", F.lit(n)) for n, f in (("naive", _naive), ("mean", _mean))]
    return each[0].unionByName(each[1])


def _joined(spark, d):
    return cm.with_actuals(_naive(spark, d), _test(spark, d)).join(_labels(spark, d), "household_id")


@query("m3_mae", "", "mae", f"{JOINED} SELECT avg(abs_error) AS mae FROM act")
def m3(spark, d):
    return fc.mae(_joined(spark, d))


@query(
    "m10_model_routing",
    "household_id cluster model_used",
    "",
    f"{c.ctes(TRAIN, LABELS)} SELECT household_id, CASE WHEN cluster IN (0, 1) THEN cluster ELSE -99 END AS cluster, CASE WHEN cluster IN (0, 1) THEN 'cluster_lgbm' ELSE 'global_fallback' END AS model_used FROM labels",
)
def m10(spark, d):
    return fc.routed(_labels(spark, d), [0], [1])


@query("m11_household_mae", "household_id n_days_compared complete_horizon_flag", "mae", f"{BASE} SELECT * FROM e1")
def m11a(spark, d):
    return fc.household_mae(_naive(spark, d), _test(spark, d))


SUMMARY = "SELECT method, count(*) AS n_households_evaluated, CAST(366 AS BIGINT) AS expected_days_per_household, count(*) FILTER (complete_horizon_flag) AS n_households_complete, avg(mae) AS average_household_mae, median(mae) AS median_household_mae FROM errs"
SUMMARY_KEYS = "method n_households_evaluated expected_days_per_household n_households_complete"


@query("m11_evaluation_summary", SUMMARY_KEYS, "average_household_mae median_household_mae", f"{BASE} {SUMMARY} WHERE method = 'naive' GROUP BY 1")
def m11b(spark, d):
    return fc.evaluation_summary(fc.household_mae(_naive(spark, d), _test(spark, d)), "naive")


@query("q1_method_comparison", SUMMARY_KEYS, "average_household_mae median_household_mae", f"{BASE} {SUMMARY} GROUP BY 1")
def q1(spark, d):
    test = _test(spark, d)
    return cm.method_comparison(*[fc.evaluation_summary(fc.household_mae(f(spark, d), test), n) for n, f in (("naive", _naive), ("mean", _mean))])


@query("q2_with_actuals", "household_id date", "predicted consumption abs_error", f"{JOINED} SELECT * FROM act")
def q2(spark, d):
    return _joined(spark, d)


@query("q3_error_distribution", "method", "mean median std", f"{BASE} SELECT method, avg(mae) AS mean, median(mae) AS median, stddev_samp(mae) AS std FROM errs GROUP BY 1")
def q3(spark, d):
    return cm.error_distribution(_errors(spark, d))


@query("q4_error_ecdf", "method", "share mae", f"{BASE} SELECT method, mae, row_number() OVER (PARTITION BY method ORDER BY round(mae, 9)) / count(*) OVER (PARTITION BY method) AS share FROM errs")
def q4(spark, d):
    return cm.error_ecdf(_errors(spark, d).withColumn("mae", F.round("mae", 9)))


@query("q5_daily_by_cluster", "cluster date", "actual predicted", f"{JOINED} SELECT cluster, date, avg(consumption) AS actual, avg(predicted) AS predicted FROM act GROUP BY 1, 2")
def q5(spark, d):
    return cm.daily_by_cluster(_joined(spark, d))


@query("q6_cluster_errors", "cluster n_households", "mae", f"{JOINED} SELECT cluster, avg(abs_error) AS mae, count(DISTINCT household_id) AS n_households FROM act GROUP BY 1")
def q6(spark, d):
    return cm.cluster_errors(_joined(spark, d))


@query("q7_monthly_errors", "month", "mae", f"{JOINED} SELECT CAST(m AS INTEGER) AS month, mae FROM range(1, 13) t(m) LEFT JOIN (SELECT month(date) AS m, avg(abs_error) AS mae FROM act GROUP BY 1) USING (m)")
def q7(spark, d):
    return cm.monthly_errors(_joined(spark, d))


@query(
    "q8_best_and_worst",
    "side household_id",
    "mae",
    f"""{BASE}, r AS (SELECT *, row_number() OVER (ORDER BY round(mae, 9), household_id) AS a, row_number() OVER (ORDER BY round(mae, 9) DESC, household_id) AS b FROM e2)
SELECT 'best' AS side, household_id, mae FROM r WHERE a <= 5 UNION ALL SELECT 'worst', household_id, mae FROM r WHERE b <= 5""",
)
def q8(spark, d):
    return cm.extremes(fc.household_mae(_mean(spark, d), _test(spark, d)).withColumn("mae", F.round("mae", 9)), 5)


@query(
    "q9_win_rate",
    "method_a method_b wins n",
    "win_rate",
    f"""{BASE} SELECT a.method AS method_a, b.method AS method_b, count(*) FILTER (a.mae < b.mae) AS wins, count(*) AS n, count(*) FILTER (a.mae < b.mae) / count(*) AS win_rate
FROM errs a JOIN errs b ON a.household_id = b.household_id AND a.method <> b.method GROUP BY 1, 2""",
)
def q9(spark, d):
    return cm.win_rates(_errors(spark, d))


@query("q10_backtest_union", "candidate_id scope", "mean_mae", "SELECT 0 AS candidate_id, 'global' AS scope, 1.5 AS mean_mae UNION ALL SELECT 1, NULL, 2.5")
def q10(spark, d):
    return cm.backtest_union(spark.createDataFrame([(0, 1.5, "global")], "candidate_id int, mean_mae double, scope string"), spark.createDataFrame([(1, 2.5)], "candidate_id int, mean_mae double"))


#: The tuning grid holds 2,000 trees, fitted three times for each scope; these queries tune and fit with few instead (README).
_SMALL = {"n_estimators": 8, "learning_rate": 0.1, "num_leaves": 15, "min_child_samples": 5, "subsample": 1.0, "colsample": 1.0}


def _brand_labels(spark, d):
    return ad.brand_panel(spark, d, 1999).select("household_id").distinct().withColumn("cluster", (F.col("household_id") % 2).cast("int"))


@query("m6_backtest", "candidate_id n_successful_splits", "mean_mae")
def m6(spark, d):
    rows = cut(fc.training_rows(ad.brand_panel(spark, d, 1999), _brand_labels(spark, d)))
    results = fc.backtest(rows, [_SMALL, _SMALL | {"num_leaves": 7}], n_splits=2)
    return fc.params_row(spark, results, "global")


@query("m9_recursive_forecast", "household_id date cluster model_used", "predicted")
def m9(spark, d):
    panel, labels = ad.brand_panel(spark, d, 1999), _brand_labels(spark, d)
    rows = cut(fc.training_rows(panel, labels))
    models = {k: fc.export_trees(m) for k, m in fc.cluster_models(rows, _SMALL).items()}
    return fc.recursive_forecast(panel, labels, models, fc.export_trees(fc.fit_trees(rows, _SMALL)), "2000-01-01")


@query("m8_quantile_forecast", "household_id date", "q10 q50 q90")
def m8(spark, d):
    rows = cut(fc.training_rows(ad.brand_panel(spark, d, 1999), _brand_labels(spark, d)))
    model = fc.fit_trees(rows.filter("date < '1999-11-20'"), _SMALL)  # neither the days of the residuals nor those of the forecast
    held, ahead = (fc.predicted(model, rows.filter(days)) for days in ("date >= '1999-11-20' and date < '1999-12-18'", "date >= '1999-12-18'"))
    return fc.quantile_forecast(ahead.select("household_id", "date", "cluster", "predicted"), fc.residual_quantiles(held))


@query("m14_importances", "feature", "importance")
def m14(spark, d):
    rows = cut(fc.training_rows(ad.brand_panel(spark, d, 1999), _brand_labels(spark, d)))
    model = fc.fit_trees(rows, fc.candidates()[1])
    return spark.createDataFrame(fc.top_importances(model), "feature string, importance double")


@query("m4_candidates", "candidate_id n_estimators num_leaves min_child_samples", "learning_rate", "SELECT * FROM (VALUES (0, 300, 31, 20, 0.05), (1, 500, 63, 20, 0.05), (2, 700, 63, 30, 0.03), (3, 500, 127, 40, 0.03)) AS t(candidate_id, n_estimators, num_leaves, min_child_samples, learning_rate)")
def m4(spark, d):
    rows = [(i, p["n_estimators"], p["num_leaves"], p["min_child_samples"], p["learning_rate"]) for i, p in enumerate(fc.candidates())]
    return spark.createDataFrame(rows, "candidate_id int, n_estimators int, num_leaves int, min_child_samples int, learning_rate double")


@query("m7_cluster_model_errors", "cluster n", "mae")
def m7(spark, d):
    rows = cut(fc.training_rows(ad.brand_panel(spark, d, 1999), _brand_labels(spark, d)))
    parts = [fc.predicted(m, rows.filter(F.col("cluster") == k)) for k, m in fc.cluster_models(rows, _SMALL).items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("consumption") - F.col("predicted"))).alias("mae"))


@query("m12_cluster_run_summary", "method n_households_evaluated n_households_complete", "average_household_mae median_household_mae")
def m12b(spark, d):
    from panelforge.plans import forecasting as run

    train, test = ad.brand_panel(spark, d, 1999), ad.brand_panel(spark, d, 2000)
    return run.run_method(train, test, _brand_labels(spark, d), "feature_ward", grid=[_SMALL], n_splits=1).summary


@query("m12_global_run_summary", "method n_households_evaluated n_households_complete", "average_household_mae median_household_mae")
def m12(spark, d):
    from panelforge.plans import forecasting as run

    train, test = ad.brand_panel(spark, d, 1999), ad.brand_panel(spark, d, 2000)
    return run.run_method(train, test, _brand_labels(spark, d), "global", grid=[_SMALL], n_splits=1).summary
