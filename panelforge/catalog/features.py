"""Feature blocks and selection."""

from __future__ import annotations

from panelforge.catalog import ctes as c
from panelforge.catalog.eda import MON, _brand
from panelforge.catalog.registry import query
from panelforge.functions.storage import cut
from panelforge.operators import features as ft
from panelforge.operators import selection as se
from panelforge.operators.stats import DAYS_OF_WEEK, MONTHS

B = c.brand(1999)
TAU = "2 * pi() / 12"


def _profile(z: bool) -> str:
    """Month and weekday means, wide, with extremes; of the standardised series if z."""
    source = "z" if z else "panel"
    return ",".join(
        [
            c.months(source, "pm"),
            c.weekdays(source, "pd"),
            """
pm2 AS (SELECT *, max(m) OVER w AS mx, min(m) OVER w AS mn, m - lag(m) OVER (PARTITION BY household_id ORDER BY month) AS dm, sum(m) OVER w AS sm, sum(abs(m)) OVER w AS sa,
  row_number() OVER (PARTITION BY household_id ORDER BY m DESC) AS top FROM pm WINDOW w AS (PARTITION BY household_id)),
pd2 AS (SELECT *, d - lag(d) OVER (PARTITION BY household_id ORDER BY dow) AS dd FROM pd),
am AS (SELECT household_id, """
            + ", ".join(f"max(m) FILTER (month = {i + 1}) AS {x}" for i, x in enumerate(MON))
            + """, stddev_samp(m) AS m_std, max(m) AS m_max, min(m) AS m_min, sum(m) AS m_sum, min(month) FILTER (abs(m - mx) <= 1e-9 * greatest(1, abs(mx))) AS pk, min(month) FILTER (abs(m - mn) <= 1e-9 * greatest(1, abs(mn))) AS tr,
  avg(abs(dm)) AS dm_abs, stddev_samp(dm) AS dm_std, avg(m) FILTER (month IN (12, 1, 2)) AS win, avg(m) FILTER (month IN (6, 7, 8)) AS smr,
  avg(m) FILTER (month <= 3) AS q1, avg(m) FILTER (month BETWEEN 4 AND 6) AS q2, avg(m) FILTER (month BETWEEN 7 AND 9) AS q3, avg(m) FILTER (month >= 10) AS q4,
  sum(m) FILTER (top <= 3) AS top3, -sum((m / (sm + 1e-6)) * ln(greatest(m / (sm + 1e-6), 0) + 1e-10)) AS ent,
  -sum(CASE WHEN sa > 0 THEN abs(m) / sa ELSE 0 END * ln(greatest(CASE WHEN sa > 0 THEN abs(m) / sa ELSE 0 END, 1e-10))) AS ent_abs FROM pm2 GROUP BY 1),
ad AS (SELECT household_id, """
            + ", ".join(f"max(d) FILTER (dow = {i}) AS dow_{x}" for i, x in enumerate(DAYS_OF_WEEK))
            + """, avg(d) FILTER (dow < 5) AS wd, avg(d) FILTER (dow >= 5) AS we, max(d) - min(d) AS d_range, stddev_samp(d) AS d_std, sum(d) AS d_sum, avg(abs(dd)) AS dd_abs FROM pd2 GROUP BY 1)""",
        ]
    )


def _cycle(column: str, name: str) -> str:
    return f"sin({TAU} * {column}) AS {name}_sin, cos({TAU} * {column}) AS {name}_cos"


WEEKLY = [f"dow_{x}" for x in DAYS_OF_WEEK] + ["weekend_weekday_contrast", "weekday_range", "weekend_share", "weekday_std", "autocorr_lag_7"]
ENERGY = ["base_load_ratio", "seasonal_peak_ratio", "seasonal_range_ratio", "winter_share", "summer_share", "top3_month_share", "monthly_entropy", "peak_month_sin", "peak_month_cos", "trough_month_sin", "trough_month_cos"]
PERSISTENCE = (
    "autocorr_lag_1 autocorr_lag_30 rolling_std_7 rolling_std_30 diff_mean diff_std abs_diff_mean diff_max diff_min p95_to_median_ratio p99_to_median_ratio max_to_p95_ratio"
    " winter_std_norm summer_std_norm winter_summer_volatility_ratio"
)
SHAPE = ", ".join(
    [f"{x} AS norm_{x}" for x in MON]
    + [f"dow_{x} AS norm_dow_{x}" for x in DAYS_OF_WEEK]
    + [
        "m_std AS norm_monthly_profile_std, m_max - m_min AS norm_monthly_profile_range, win AS norm_winter_mean, smr AS norm_summer_mean, win - smr AS norm_winter_summer_diff",
        "wd AS norm_weekday_mean, we AS norm_weekend_mean, we - wd AS norm_weekend_weekday_diff, q1 AS norm_q1_mean, q2 AS norm_q2_mean, q3 AS norm_q3_mean, q4 AS norm_q4_mean",
        "q2 - q1 AS norm_spring_minus_winter, q3 - q2 AS norm_summer_minus_spring, q4 - q3 AS norm_autumn_minus_summer, q1 - q4 AS norm_winter_minus_autumn",
        _cycle("pk", "norm_peak_month"),
        _cycle("tr", "norm_trough_month"),
        "ent_abs AS norm_month_entropy, dm_abs AS norm_month_diff_abs_mean, dm_std AS norm_month_diff_std, d_range AS norm_dow_range, dd_abs AS norm_dow_diff_abs_mean",
    ]
)
SHAPE_NAMES = [
    *[f"norm_month_{m}" for m in MONTHS],
    *[f"norm_dow_{x}" for x in DAYS_OF_WEEK],
    *"norm_monthly_profile_std norm_monthly_profile_range norm_winter_mean norm_summer_mean norm_winter_summer_diff norm_weekday_mean norm_weekend_mean norm_weekend_weekday_diff".split(),
    *"norm_q1_mean norm_q2_mean norm_q3_mean norm_q4_mean norm_spring_minus_winter norm_summer_minus_spring norm_autumn_minus_summer norm_winter_minus_autumn".split(),
    *"norm_peak_month_sin norm_peak_month_cos norm_trough_month_sin norm_trough_month_cos norm_month_entropy norm_month_diff_abs_mean norm_month_diff_std norm_dow_range norm_dow_diff_abs_mean".split(),
]
SHAPE_CTE = f"{c.z()},{_profile(True)}, shape AS (SELECT household_id, {SHAPE} FROM am JOIN ad USING (household_id))"
PERSIST_CTE = f"""{c.acf('panel', (1, 7, 30))}, pl AS (SELECT *, consumption - lag(consumption) OVER w AS dx,
  CASE WHEN count(consumption) OVER f7 = 7 THEN stddev_samp(consumption) OVER f7 END AS r7, CASE WHEN count(consumption) OVER f30 = 30 THEN stddev_samp(consumption) OVER f30 END AS r30
  FROM panel WINDOW w AS (PARTITION BY household_id ORDER BY date), f7 AS (PARTITION BY household_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), f30 AS (PARTITION BY household_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
pe AS (SELECT household_id, avg(r7) AS rolling_std_7, avg(r30) AS rolling_std_30, avg(dx) AS diff_mean, stddev_samp(dx) AS diff_std, avg(abs(dx)) AS abs_diff_mean, max(dx) AS diff_max, min(dx) AS diff_min,
  quantile_cont(consumption, 0.95) / (median(consumption) + 1e-6) AS p95_to_median_ratio, quantile_cont(consumption, 0.99) / (median(consumption) + 1e-6) AS p99_to_median_ratio,
  max(consumption) / (quantile_cont(consumption, 0.95) + 1e-6) AS max_to_p95_ratio,
  stddev_samp(consumption) FILTER (month(date) IN (12, 1, 2)) / (avg(consumption) + 1e-6) AS winter_std_norm, stddev_samp(consumption) FILTER (month(date) IN (6, 7, 8)) / (avg(consumption) + 1e-6) AS summer_std_norm
  FROM pl GROUP BY 1),
persist AS (SELECT *, winter_std_norm / (summer_std_norm + 1e-6) AS winter_summer_volatility_ratio FROM pe JOIN acf USING (household_id))"""
WARD_COLUMNS = [x for b in ft.WARD_BLOCKS.values() for x in b]
WARD_CTE = f"{c.ctes(B)},{SHAPE_CTE},{PERSIST_CTE},{c.trend('panel')}, wardf AS (SELECT household_id, {', '.join(WARD_COLUMNS)} FROM shape JOIN persist USING (household_id) JOIN trend USING (household_id))"


@query("f1_level_features", "household_id", "mean std zero_pct cv", f"{c.ctes(B, c.stats())} SELECT household_id, mean, std, zero_pct, cv FROM stats")
def f1(spark, d):
    return ft.level_features(_brand(spark, d))


@query(
    "f2_weekly_features",
    "household_id",
    " ".join(WEEKLY),
    f"""{c.ctes(B)},{_profile(False)},{c.acf('panel', (7,))} SELECT *, (we - wd) / (we + wd + 1e-6) AS weekend_weekday_contrast, d_range AS weekday_range,
  (dow_Sat + dow_Sun) / (d_sum + 1e-6) AS weekend_share, d_std AS weekday_std FROM ad JOIN acf USING (household_id)""",
)
def f2(spark, d):
    return ft.weekly_features(_brand(spark, d))


@query(
    "f3_energy_features",
    "household_id",
    " ".join(ENERGY),
    f"""{c.ctes(B)},{_profile(False)}, lv AS (SELECT household_id, avg(consumption) AS mean, sum(consumption) FILTER (month(date) IN (12, 1, 2)) / (sum(consumption) + 1e-6) AS winter_share,
  sum(consumption) FILTER (month(date) IN (6, 7, 8)) / (sum(consumption) + 1e-6) AS summer_share FROM panel GROUP BY 1)
SELECT household_id, m_min / (mean + 1e-6) AS base_load_ratio, m_max / (mean + 1e-6) AS seasonal_peak_ratio, (m_max - m_min) / (mean + 1e-6) AS seasonal_range_ratio, winter_share, summer_share,
  top3 / (m_sum + 1e-6) AS top3_month_share, ent AS monthly_entropy, {_cycle('pk', 'peak_month')}, {_cycle('tr', 'trough_month')} FROM am JOIN lv USING (household_id)""",
)
def f3(spark, d):
    return ft.energy_features(_brand(spark, d))


@query("f4_shape_features", "household_id", " ".join(SHAPE_NAMES), f"{c.ctes(B)},{SHAPE_CTE} SELECT * FROM shape")
def f4(spark, d):
    return ft.shape_features(_brand(spark, d))


@query("f5_persistence_features", "household_id", PERSISTENCE, f"{c.ctes(B)},{PERSIST_CTE} SELECT * FROM persist")
def f5(spark, d):
    return ft.persistence_features(_brand(spark, d))


@query("f6_trend_features", "household_id", "trend_slope trend_slope_normalized", f"{c.ctes(B, c.trend('panel'))} SELECT * FROM trend")
def f6(spark, d):
    return ft.trend_features(_brand(spark, d))


@query("f7_shape_block", "household_id", " ".join(ft.SHAPE_COLUMNS), f"{c.ctes(B)},{SHAPE_CTE} SELECT * FROM shape")
def f7(spark, d):
    return ft.shape_block(_brand(spark, d))


@query("f8_ward_features", "household_id", " ".join(WARD_COLUMNS), f"{WARD_CTE} SELECT * FROM wardf")
def f8(spark, d):
    return ft.ward_features(_brand(spark, d))


def _diag(spark, d):
    """Features with gaps: cv and autocorrelations of mostly idle suppliers, one column infinite where the level is 0."""
    from pyspark.sql import functions as F

    from panelforge.operators import stats as st
    from panelforge.sources import adapters as ad

    panel = ad.event_panel(spark, d)
    s = st.household_statistics(panel).join(st.autocorrelations(panel, (1, 7)), "household_id")
    return s.select("household_id", "cv", "std", F.when(F.col("autocorr_lag_1") < 0, F.lit(float("inf"))).otherwise(F.col("autocorr_lag_1")).alias("a1"), F.col("autocorr_lag_7").alias("a7"))


DIAG_CTE = f"""{c.ctes(c.EVENT, c.stats(), c.acf('panel', (1, 7)))}, raw AS (SELECT household_id, cv, std, CASE WHEN autocorr_lag_1 >= 0 THEN autocorr_lag_1 END AS a1, autocorr_lag_7 AS a7 FROM stats JOIN acf USING (household_id)),
clean AS (SELECT household_id, coalesce(cv, (SELECT median(cv) FROM raw), 0) AS cv, coalesce(std, (SELECT median(std) FROM raw), 0) AS std, coalesce(a1, (SELECT median(a1) FROM raw), 0) AS a1, coalesce(a7, (SELECT median(a7) FROM raw), 0) AS a7 FROM raw)"""


@query("r1_sanitized", "household_id", "cv std a1 a7", f"{DIAG_CTE} SELECT * FROM clean")
def r1(spark, d):
    return se.sanitize(_diag(spark, d))


@query("r2_variances", "feature", "variance", f"{DIAG_CTE} " + " UNION ALL ".join(f"SELECT '{x}' AS feature, var_samp({x}) AS variance FROM clean" for x in ("cv", "std", "a1", "a7")), 4)
def r2(spark, d):
    return se.variances(se.sanitize(_diag(spark, d)))


_PAIRS = [(a, b) for i, a in enumerate(("cv", "std", "a1", "a7")) for b in ("cv", "std", "a1", "a7")[i + 1 :]]


@query("r3_correlations", "feature_a feature_b", "abs_corr", f"{DIAG_CTE} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, abs({c.corr(a, b)}) AS abs_corr FROM clean" for a, b in _PAIRS))
def r3(spark, d):
    return se.correlations(se.sanitize(_diag(spark, d)))


@query("r4_pruned_columns", "column kept", "")
def r4(spark, d):
    raw = se.sanitize(_brand_level(spark, d))
    columns = se.feature_columns(raw)
    kept, _ = se.prune_correlated(columns, se.correlation_matrix(raw), set())
    return spark.createDataFrame([(x, x in kept) for x in columns], "column string, kept boolean")


def _brand_level(spark, d):
    return ft.level_features(_brand(spark, d)).join(ft.trend_features(_brand(spark, d)), "household_id")


_SCALED = ", ".join(f"(CASE WHEN sd_{x} = 0 THEN {x} - mu_{x} ELSE ({x} - mu_{x}) / sd_{x} END) AS {x}" for x in ("cv", "std", "a1", "a7"))
_MU = ", ".join(f"avg({x}) OVER () AS mu_{x}, stddev_pop({x}) OVER () AS sd_{x}" for x in ("cv", "std", "a1", "a7"))


@query("r5_scaled", "household_id", "cv std a1 a7", f"{DIAG_CTE} SELECT household_id, {_SCALED} FROM (SELECT *, {_MU} FROM clean)")
def r5(spark, d):
    clean = se.sanitize(_diag(spark, d))
    return se.scale(clean, se.scale_parameters(clean))


_BLOCKS = {"level_dispersion": ("cv", "std"), "persistence": ("a1", "a7")}


@query("r6_r7_weighted", "household_id", "cv std a1 a7", f"{DIAG_CTE} SELECT household_id, cv * 0.7 / sqrt(2) AS cv, std * 0.7 / sqrt(2) AS std, a1 * 0.5 / sqrt(2) AS a1, a7 * 0.5 / sqrt(2) AS a7 FROM clean")
def r67(spark, d):
    return se.weighted(se.sanitize(_diag(spark, d)), se.block_factors(["cv", "std", "a1", "a7"], _BLOCKS, {"level_dispersion": 0.7, "persistence": 0.5}))


@query("r8_principal_components", "household_id", "pc1")
def r8(spark, d):
    raw = ft.ward_features(_brand(spark, d))
    fitted = se.fit_selection(raw, use_pca=True)
    return fitted.transform(raw)


_BLOCK = " ".join(f"WHEN feature IN ({', '.join(repr(x) for x in m)}) THEN '{b}'" for b, m in ft.WARD_BLOCKS.items())
_WEIGHT = " ".join(f"WHEN '{b}' THEN {se.BLOCK_WEIGHTS[b]}" for b in ft.WARD_BLOCKS)


@query(
    "r10_selected_features",
    "household_id feature",
    "value",
    f"""{WARD_CTE}, filled AS (SELECT household_id, {', '.join(f'coalesce({x}, (SELECT median({x}) FROM wardf), 0) AS {x}' for x in WARD_COLUMNS)} FROM wardf),
long AS (SELECT household_id, feature, x, CASE {_BLOCK} END AS block FROM filled UNPIVOT (x FOR feature IN ({', '.join(WARD_COLUMNS)}))),
kept AS (SELECT feature, block, avg(x) AS mu, stddev_pop(x) AS sd FROM long GROUP BY 1, 2 HAVING var_samp(x) > 1e-6), n AS (SELECT block, count(*) AS n FROM kept GROUP BY 1)
SELECT household_id, feature, (x - mu) / sd * CASE block {_WEIGHT} END / sqrt(n) AS value FROM long JOIN kept USING (feature, block) JOIN n USING (block)""",
)
def r10(spark, d):
    raw = cut(ft.ward_features(_brand(spark, d)))
    done = se.fit_selection(raw).transform(raw)
    return done.unpivot(["household_id"], se.feature_columns(done), "feature", "value")


@query("r12_retained_blocks", "block n_kept", "")
def r12(spark, d):
    kept = se.fit_selection(cut(ft.ward_features(_brand(spark, d)))).summary["kept_by_block"]
    return spark.createDataFrame(sorted(kept.items()), "block string, n_kept long")


@query("f9_block_sizes", "block n", "", "SELECT * FROM (VALUES ('weekly', CAST(1 AS BIGINT)), ('shape_normalized', 25), ('persistence', 2), ('trend', 1)) AS t(block, n)")
def f9(spark, d):
    return spark.createDataFrame(ft.block_sizes(), "block string, n long")


@query("r9_top_loadings", "component feature", "loading")
def r9(spark, d):
    fitted = se.fit_selection(ft.ward_features(_brand(spark, d)), use_pca=True)
    return spark.createDataFrame(se.top_loadings(fitted.columns, fitted.components, 3), "component string, feature string, loading double")


@query(
    "r11_transformed_new_rows",
    "household_id feature",
    "value",
    f"""{DIAG_CTE}, long AS (SELECT household_id, feature, x FROM clean UNPIVOT (x FOR feature IN (cv, std, a1, a7))),
par AS (SELECT feature, avg(x) AS mu, stddev_pop(x) AS sd FROM long WHERE household_id % 2 = 0 GROUP BY 1 HAVING var_samp(x) > 1e-6)
SELECT household_id, feature, (x - mu) / sd * CASE WHEN feature IN ('cv', 'std') THEN 0.7 ELSE 0.5 END / sqrt(2) AS value FROM long JOIN par USING (feature) WHERE household_id % 2 = 1""",
)
def r11(spark, d):
    """Even ids fit, odd ids are brought through; gaps are filled beforehand, so that the fills are those of all rows."""
    clean = se.sanitize(_diag(spark, d))
    fitted = se.fit_selection(clean.filter("household_id % 2 = 0"), _BLOCKS, {"level_dispersion": 0.7, "persistence": 0.5}, {"cv", "std", "a1", "a7"})
    done = fitted.transform(clean.filter("household_id % 2 = 1"))
    return done.unpivot(["household_id"], se.feature_columns(done), "feature", "value")
