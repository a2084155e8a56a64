"""Statistics and diagnostics."""

from __future__ import annotations

from panelforge.catalog import ctes as c
from panelforge.catalog.registry import query
from panelforge.operators import stats as st
from panelforge.sources import adapters as ad

B = c.brand(1999)
STATS = "mean median std min max range q25 q75 cv skew kurtosis zero_pct"
DOW = [f"dow_{x}" for x in st.DAYS_OF_WEEK]
MON = [f"month_{x}" for x in st.MONTHS]
DOW_SQL = ", ".join(f"avg(consumption) FILTER (isodow(date) = {i + 1}) AS {x}" for i, x in enumerate(DOW))
MON_SQL = ", ".join(f"avg(consumption) FILTER (month(date) = {i + 1}) AS {x}" for i, x in enumerate(MON))
PEAK = """peak AS (SELECT household_id, CAST(min(month) AS INTEGER) AS peak_month FROM (SELECT *, max(m) OVER (PARTITION BY household_id) AS mx FROM mm) WHERE m = mx GROUP BY 1)"""
SEASON = """season AS (SELECT *, (winter_mean - summer_mean) / nullif(winter_mean + summer_mean + 1e-6, 0) AS winter_summer_contrast FROM (SELECT household_id,
  avg(consumption) FILTER (month(date) IN (12, 1, 2)) AS winter_mean, avg(consumption) FILTER (month(date) IN (6, 7, 8)) AS summer_mean FROM panel GROUP BY 1))"""
VARIATION = "variation AS (SELECT household_id, stddev_samp(m) AS monthly_profile_std FROM mm GROUP BY 1)"


def _brand(spark, d):
    return ad.brand_panel(spark, d, 1999)


@query("a1_household_stats", "household_id zero_days", STATS, f"{c.ctes(c.supplier(1999), c.stats())} SELECT * FROM stats")
def a1(spark, d):
    return st.household_statistics(ad.supplier_panel(spark, d, 1999))


@query(
    "a2_outliers_iqr",
    "household_id side",
    "mean",
    f"""{c.ctes(c.supplier(1999), c.stats())}, q AS (SELECT quantile_cont(mean, 0.25) AS q1, quantile_cont(mean, 0.75) AS q3 FROM stats)
SELECT household_id, mean, CASE WHEN mean > q3 + 0.5 * (q3 - q1) THEN 'high' ELSE 'low' END AS side FROM stats, q WHERE mean > q3 + 0.5 * (q3 - q1) OR mean < q1 - 0.5 * (q3 - q1)""",
)
def a2(spark, d):
    return st.outliers(st.household_statistics(ad.supplier_panel(spark, d, 1999)), "iqr", 0.5)


@query(
    "a3_outliers_zscore",
    "household_id side",
    "mean",
    f"""{c.ctes(c.supplier(1999), c.stats())}, q AS (SELECT avg(mean) AS mu, stddev_pop(mean) AS sd, median(mean) AS mid FROM stats)
SELECT household_id, mean, CASE WHEN mean > mid THEN 'high' ELSE 'low' END AS side FROM stats, q WHERE sd >= 1e-12 AND abs(mean - mu) / sd > 1.5""",
)
def a3(spark, d):
    return st.outliers(st.household_statistics(ad.supplier_panel(spark, d, 1999)), "zscore", 1.5)


@query("a4_dow_profile", "household_id", " ".join(DOW), f"{c.ctes(B)} SELECT household_id, {DOW_SQL} FROM panel GROUP BY 1")
def a4(spark, d):
    return st.weekday_means(_brand(spark, d))


@query("a5_month_profile", "household_id", " ".join(MON), f"{c.ctes(B)} SELECT household_id, {MON_SQL} FROM panel GROUP BY 1")
def a5(spark, d):
    return st.month_means(_brand(spark, d))


@query("a6_autocorrelation", "household_id", "autocorr_lag_1 autocorr_lag_7 autocorr_lag_30", f"{c.ctes(c.supplier(1999), c.acf('panel', (1, 7, 30)))} SELECT * FROM acf")
def a6(spark, d):
    return st.autocorrelations(ad.supplier_panel(spark, d, 1999))


@query("a7_trend", "household_id n", "trend_slope trend_slope_normalized r_squared", f"{c.ctes(B, c.trend('panel'))} SELECT * FROM trend")
def a7(spark, d):
    return st.trends(_brand(spark, d))


@query("a8_trend_p_value", "household_id", "p_value")
def a8(spark, d):
    return st.trend_p_values(st.trends(_brand(spark, d)))


@query("a9_monthly_variation", "household_id", "monthly_profile_std", f"{c.ctes(B, c.months('panel'), VARIATION)} SELECT * FROM variation")
def a9(spark, d):
    return st.monthly_variation(_brand(spark, d))


@query("a10_peak_month", "household_id peak_month", "", f"{c.ctes(B, c.months('panel'), PEAK)} SELECT * FROM peak")
def a10(spark, d):
    return st.peak_months(_brand(spark, d))


@query("a11_seasonal_contrast", "household_id", "winter_mean summer_mean winter_summer_contrast", f"{c.ctes(B, SEASON)} SELECT * FROM season")
def a11(spark, d):
    return st.seasonal_contrast(_brand(spark, d))


DIAGNOSTICS = c.ctes(c.supplier(1999), c.stats(), c.acf("panel", (1, 7, 30)), c.months("panel"), VARIATION, c.trend("panel"), SEASON, PEAK, c.flags()) + """,
diag AS (SELECT stats.*, autocorr_lag_1, autocorr_lag_7, autocorr_lag_30, monthly_profile_std, trend_slope_normalized, winter_mean, summer_mean, winter_summer_contrast, peak_month AS peak_month_eda,
  all_zero_flag, near_constant_flag, zero_heavy_flag, regime_label, degenerate_flag
  FROM stats JOIN acf USING (household_id) JOIN variation USING (household_id) JOIN trend USING (household_id) JOIN season USING (household_id) JOIN peak USING (household_id) JOIN flags USING (household_id))"""
DIAG_KEYS = "household_id zero_days peak_month_eda all_zero_flag near_constant_flag zero_heavy_flag regime_label degenerate_flag"
DIAG = STATS + " autocorr_lag_1 autocorr_lag_7 autocorr_lag_30 monthly_profile_std trend_slope_normalized winter_mean summer_mean winter_summer_contrast"
NORM = f"""{c.z()}, zl AS (SELECT *, lag(consumption) OVER w AS l1, lag(consumption, 7) OVER w AS l7 FROM z WINDOW w AS (PARTITION BY household_id ORDER BY date)),
norm AS (SELECT household_id, max(consumption) - min(consumption) AS normalized_range, avg(abs(consumption - l1)) AS normalized_abs_diff_mean, {c.corr('l7', 'consumption')} AS normalized_autocorr_lag_7 FROM zl GROUP BY 1)"""


@query("a12_household_diagnostics", DIAG_KEYS, DIAG, f"{DIAGNOSTICS} SELECT * FROM diag")
def a12(spark, d):
    return st.household_diagnostics(ad.supplier_panel(spark, d, 1999))


@query(
    "a13_categories",
    "household_id category",
    "",
    f"""{c.ctes(B, c.stats())}, q AS (SELECT quantile_cont(cv, 0.75) AS cv75, quantile_cont(mean, 0.33) AS m33, quantile_cont(mean, 0.67) AS m67 FROM stats)
SELECT household_id, CASE WHEN mean IS NULL OR cv IS NULL THEN 'Unclassified' WHEN zero_pct >= 75 THEN 'Intermittent/Vacant' ELSE
  (CASE WHEN mean > m67 THEN 'High' WHEN mean < m33 THEN 'Low' ELSE 'Medium' END) || ' ' || (CASE WHEN cv > cv75 THEN 'Variable' ELSE 'Stable' END) END AS category FROM stats, q""",
)
def a13(spark, d):
    return st.categories(st.household_statistics(_brand(spark, d)))


@query(
    "a14_phase1_summary",
    "n_households n_degenerate n_all_zero n_near_constant n_zero_heavy peak_month_mode",
    "mean_household_consumption_median mean_household_consumption_q25 mean_household_consumption_q75 weekly_acf_median",
    f"""{DIAGNOSTICS}, mode AS (SELECT peak_month_eda FROM diag WHERE peak_month_eda IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, peak_month_eda LIMIT 1)
SELECT count(*) AS n_households, count(*) FILTER (regime_label = 'all_zero') AS n_all_zero, count(*) FILTER (regime_label = 'near_constant') AS n_near_constant, count(*) FILTER (regime_label = 'zero_heavy') AS n_zero_heavy,
  count(*) FILTER (degenerate_flag) AS n_degenerate, median(mean) AS mean_household_consumption_median, quantile_cont(mean, 0.25) AS mean_household_consumption_q25, quantile_cont(mean, 0.75) AS mean_household_consumption_q75, median(autocorr_lag_7) AS weekly_acf_median,
  (SELECT peak_month_eda FROM mode) AS peak_month_mode FROM diag""",
)
def a14(spark, d):
    return st.phase1_summary(st.household_diagnostics(ad.supplier_panel(spark, d, 1999)))


@query(
    "a15_regime_sample",
    "segment household_id",
    "",
    f"""{DIAGNOSTICS}, cuts AS (SELECT quantile_cont(mean, 0.9) AS a, quantile_cont(autocorr_lag_7, 0.9) AS b, quantile_cont(monthly_profile_std, 0.9) AS e FROM diag),
g AS (SELECT regime_label AS segment, household_id FROM diag WHERE regime_label <> 'regular' UNION ALL SELECT 'high_mean', household_id FROM diag, cuts WHERE mean >= a
  UNION ALL SELECT 'high_weekly_structure', household_id FROM diag, cuts WHERE autocorr_lag_7 >= b UNION ALL SELECT 'high_annual_variation', household_id FROM diag, cuts WHERE monthly_profile_std >= e)
SELECT segment, household_id FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5(household_id || '/42')) AS k FROM g) WHERE k <= 5""",
)
def a15(spark, d):
    return st.ranked_sample(st.household_diagnostics(ad.supplier_panel(spark, d, 1999)))


@query("a16_norm_summary", "household_id", "normalized_range normalized_abs_diff_mean normalized_autocorr_lag_7", f"{c.ctes(B, NORM)} SELECT * FROM norm")
def a16(spark, d):
    return st.norm_summary(_brand(spark, d))


@query("a17_method_selection", DIAG_KEYS, DIAG + " normalized_range normalized_abs_diff_mean normalized_autocorr_lag_7", f"{DIAGNOSTICS},{NORM} SELECT * FROM diag LEFT JOIN norm USING (household_id)")
def a17(spark, d):
    return st.method_selection(ad.supplier_panel(spark, d, 1999))


@query("a18_population_weekday", "weekday", "mean", f"{c.ctes(B, c.weekdays('panel'))} SELECT CAST(dow AS INTEGER) AS weekday, avg(d) AS mean FROM dd GROUP BY 1")
def a18a(spark, d):
    return st.population_profile(_brand(spark, d))


@query("a18_population_month", "month", "mean", f"{c.ctes(B, c.months('panel'))} SELECT CAST(month AS INTEGER) AS month, avg(m) AS mean FROM mm GROUP BY 1")
def a18b(spark, d):
    return st.population_profile(_brand(spark, d), "month")


@query(
    "a18_weekend_contrast",
    "household_id",
    "weekday_mean weekend_mean weekend_ratio weekend_contrast",
    f"""{c.ctes(B, c.weekdays('panel'))} SELECT *, weekend_mean / (weekday_mean + 1e-10) AS weekend_ratio, (weekend_mean - weekday_mean) / (weekend_mean + weekday_mean + 1e-6) AS weekend_contrast
FROM (SELECT household_id, avg(d) FILTER (dow < 5) AS weekday_mean, avg(d) FILTER (dow >= 5) AS weekend_mean FROM dd GROUP BY 1)""",
)
def a18c(spark, d):
    return st.weekend_contrast(_brand(spark, d))


@query(
    "a18_seasonal_groups",
    "segment n",
    "",
    f"""{c.ctes(c.supplier(1999), c.months('panel'))}, s AS (SELECT household_id, avg(m) FILTER (month IN (12, 1, 2)) AS w, avg(m) FILTER (month IN (6, 7, 8)) AS u FROM mm GROUP BY 1),
t AS (SELECT (w - u) / nullif(w + u + 1e-6, 0) AS x FROM s)
SELECT CASE WHEN x > 0.1 THEN 'winter_dominant' WHEN x < -0.1 THEN 'summer_dominant' ELSE 'balanced' END AS segment, count(*) AS n FROM t WHERE x IS NOT NULL GROUP BY 1""",
)
def a18d(spark, d):
    return st.seasonal_groups(ad.supplier_panel(spark, d, 1999))


@query(
    "a18_describe",
    "count",
    "mean std min q25 q50 q75 max",
    f"{c.ctes(c.supplier(1999), c.stats())} SELECT count(mean) AS count, avg(mean) AS mean, stddev_samp(mean) AS std, min(mean) AS min, quantile_cont(mean, 0.25) AS q25, median(mean) AS q50, quantile_cont(mean, 0.75) AS q75, max(mean) AS max FROM stats",
)
def a18e(spark, d):
    return st.describe(st.household_statistics(ad.supplier_panel(spark, d, 1999)), "mean")


@query("a18_regime_shares", "regime_label n", "pct", f"{c.ctes(c.supplier(1999), c.flags())} SELECT regime_label, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM flags GROUP BY 1")
def a18f(spark, d):
    from panelforge.operators.cleaning import regime_flags

    return st.value_shares(regime_flags(ad.supplier_panel(spark, d, 1999)), "regime_label")


@query(
    "a19_histogram",
    "bin n",
    "",
    f"""{c.ctes(c.supplier(1999), c.stats())}, e AS (SELECT min(mean) AS lo, max(mean) AS hi FROM stats)
SELECT CAST(least(floor((mean - lo) / nullif(hi - lo, 0) * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM stats, e GROUP BY 1""",
)
def a19(spark, d):
    return st.histogram(st.household_statistics(ad.supplier_panel(spark, d, 1999)), "mean", 10)
