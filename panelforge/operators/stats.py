"""Statistics and diagnostics by household."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.maths import CONSTANT, SUMMER, WINTER, array_mean, array_std, safe_corr
from panelforge.operators.blocks import DAY, DAYS_OF_WEEK, ID, MONTHS, V, Z, Block, compute, month_aggregates, month_columns, weekday_aggregates, weekday_columns
from panelforge.operators.cleaning import regime_block

def _statistics() -> dict[str, Column]:
    v = F.col(V)
    return {
        "_mean": F.avg(v),
        "_median": F.median(v),
        "_std": F.stddev_samp(v),
        "_min": F.min(v),
        "_max": F.max(v),
        "_q25": F.percentile(v, 0.25),
        "_q75": F.percentile(v, 0.75),
        "_skew": F.skewness(v),
        "_kurtosis": F.kurtosis(v),
        "_zero_days": F.count_if(v == 0),
        "_zero_pct": 100.0 * F.count_if(v == 0) / F.count("*"),
    }


def _statistic_outputs() -> dict[str, Column]:
    out = {n[1:]: F.col(n) for n in _statistics()}
    return out | {"range": F.col("_max") - F.col("_min"), "cv": F.when(F.abs("_mean") >= 1e-8, F.col("_std") / F.abs("_mean"))}


STATISTICS = Block(_statistics, _statistic_outputs)


def household_statistics(panel: DataFrame) -> DataFrame:
    """Location, spread, quantiles, shape and zero days of each household.

    skew and kurtosis are the population moments (excess kurtosis), null in
    constant series; cv is null for means around 0.
    """
    return compute(panel, STATISTICS)


def outliers(stats: DataFrame, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """household_id, mean, side of the households whose mean lies far out.

    iqr: beyond `threshold` interquartile ranges from the quartiles.  zscore:
    more than `threshold` population deviations from the mean, the side by the median.
    """
    m = F.col("mean")
    if method == "iqr":
        one = stats.agg(F.percentile(m, 0.25).alias("q1"), F.percentile(m, 0.75).alias("q3"))
        low, high = F.col("q1") - threshold * (F.col("q3") - F.col("q1")), F.col("q3") + threshold * (F.col("q3") - F.col("q1"))
        side = F.when(m > high, "high").when(m < low, "low")
    elif method == "zscore":
        one = stats.agg(F.avg(m).alias("mu"), F.stddev_pop(m).alias("sd"), F.median(m).alias("mid"))
        z = F.when(F.col("sd") < 1e-12, 0.0).otherwise((m - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)))
        side = F.when(F.abs(z) > threshold, F.when(m > F.col("mid"), "high").when(m < F.col("mid"), "low"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return stats.crossJoin(F.broadcast(one)).select(ID, "mean", side.alias("side")).filter("side is not null")


WEEKDAYS = Block(weekday_aggregates, lambda: dict(zip((f"dow_{n}" for n in DAYS_OF_WEEK), weekday_columns())))
MONTH_MEANS = Block(month_aggregates, lambda: dict(zip((f"month_{n}" for n in MONTHS), month_columns())))


def weekday_means(panel: DataFrame) -> DataFrame:
    """Mean by day of the week, Monday first, in one aggregate."""
    return compute(panel, WEEKDAYS)


def month_means(panel: DataFrame) -> DataFrame:
    """Mean by month; null for absent months."""
    return compute(panel, MONTH_MEANS)


def autocorrelation_block(*lags: int) -> Block:
    names = [f"autocorr_lag_{k}" for k in lags]
    return Block(
        lambda: {f"_{n}": safe_corr(F.col(f"lag_{k}"), F.col(V)) for n, k in zip(names, lags)}, lambda: {n: F.col(f"_{n}") for n in names}, tuple(f"lag_{k}" for k in lags)
    )


def autocorrelations(panel: DataFrame, lags: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Correlation of each series with itself `k` days later; null if too short or constant."""
    return compute(panel, autocorrelation_block(*lags))


def _trend_aggregates() -> dict[str, Column]:
    v, t = F.col(V), F.col("t")
    return {"_pop": F.stddev_pop(v), "_slope": F.regr_slope(v, t), "_r2": F.regr_r2(v, t), "_n": F.count(v)}


def _trend_outputs() -> dict[str, Column]:
    constant = F.col("_pop") < CONSTANT
    return {
        "trend_slope": F.when(constant, 0.0).otherwise(F.col("_slope")),
        "trend_slope_normalized": F.when(constant, 0.0).otherwise(F.col("_slope") / (F.col("_pop") + CONSTANT)),
        "r_squared": F.when(constant, 0.0).otherwise(F.col("_r2")),
        "n": F.col("_n"),
    }


TREND = Block(_trend_aggregates, _trend_outputs, ("t",))


def trends(panel: DataFrame) -> DataFrame:
    """Slope, slope of the standardised series and its r squared; all 0 in constant series."""
    return compute(panel, TREND)


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    import math

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or 1e-300)
    total = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + numerator * d or 1e-300)
            c = 1.0 + numerator / c or 1e-300
            total *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * total


def trend_p_values(trend: DataFrame) -> DataFrame:
    """`trends` with p_value, the two-sided t test of the slope.

    Student's t has no built-in, so an Arrow-batched function evaluates its tail.
    """

    @F.pandas_udf("double")
    def tail(r2: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for r, k in zip(r2, n):
            if pd.isna(r) or k < 3:
                out.append(None)
            else:
                out.append(_beta_tail((k - 2) / 2, 0.5, 1.0 - min(r, 1.0)) if r > 0 else 1.0)
        return pd.Series(out, dtype=float)

    return trend.withColumn("p_value", tail(F.col("r_squared"), F.col("n").cast("double")))


def first_extreme(values: list[Column], largest: bool = True) -> Column:
    """The place, from 1, of the largest (or smallest) non-null value; the first of equals.

    Means that are equal in truth may differ in their last bits, by the order
    in which partitions were summed: values within 1e-9 of the extreme count as equal to it.
    """
    best = F.greatest(*values) if largest else F.least(*values)
    equal = lambda v: F.abs(v - best) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(best))
    return reduce(lambda w, iv: w.when(equal(iv[1]), iv[0]), enumerate(values[1:], 2), F.when(equal(values[0]), 1)).cast("int")


VARIATION = Block(month_aggregates, lambda: {"monthly_profile_std": array_std(F.array(*month_columns()))})
PEAK = Block(month_aggregates, lambda: {"peak_month": first_extreme(month_columns())})


def monthly_variation(panel: DataFrame) -> DataFrame:
    """Sample deviation of the month means."""
    return compute(panel, VARIATION)


def peak_months(panel: DataFrame) -> DataFrame:
    """The month, 1 to 12, with the largest mean; the first of equals, null without readings."""
    return compute(panel, PEAK)


def _season_aggregates() -> dict[str, Column]:
    mean = lambda months: F.avg(F.when(F.month(DAY).isin(*months), F.col(V)))
    return {"_winter": mean(WINTER), "_summer": mean(SUMMER)}


def _season_outputs() -> dict[str, Column]:
    w, s = F.col("_winter"), F.col("_summer")
    return {"winter_mean": w, "summer_mean": s, "winter_summer_contrast": (w - s) / F.nullif(w + s + 1e-6, F.lit(0.0))}


SEASON = Block(_season_aggregates, _season_outputs)


def seasonal_contrast(panel: DataFrame) -> DataFrame:
    """Day-level means of winter and summer and their relative difference."""
    return compute(panel, SEASON)


def _diagnostic_blocks(**thresholds: float) -> list[Block]:
    trend = Block(TREND.aggregates, lambda: {"trend_slope_normalized": TREND.outputs()["trend_slope_normalized"]}, TREND.needs)
    peak = Block(PEAK.aggregates, lambda: {"peak_month_eda": PEAK.outputs()["peak_month"]})
    return [STATISTICS, autocorrelation_block(1, 7, 30), VARIATION, trend, SEASON, peak, regime_block(**thresholds)]


def household_diagnostics(panel: DataFrame, **thresholds: float) -> DataFrame:
    """Statistics, autocorrelations, seasonal, trend and regime columns in one row for each household.

    One window pass and one aggregate give all of them.
    """
    return compute(panel, *_diagnostic_blocks(**thresholds))


def categories(stats: DataFrame, zero_pct: float = 75.0) -> DataFrame:
    """household_id, category: by zero days, then variation over its upper quartile, then level by thirds."""
    one = stats.agg(F.percentile("cv", 0.75).alias("cv75"), F.percentile("mean", 0.33).alias("m33"), F.percentile("mean", 0.67).alias("m67"))
    level = F.when(F.col("mean") > F.col("m67"), "High").when(F.col("mean") < F.col("m33"), "Low").otherwise("Medium")
    kind = F.when(F.col("cv") > F.col("cv75"), "Variable").otherwise("Stable")
    name = F.when(F.col("mean").isNull() | F.col("cv").isNull(), "Unclassified").when(F.col("zero_pct") >= zero_pct, "Intermittent/Vacant").otherwise(F.concat_ws(" ", level, kind))
    return stats.crossJoin(F.broadcast(one)).select(ID, name.alias("category"))


def phase1_summary(diagnostics: DataFrame) -> DataFrame:
    """One row: households by regime, median and quartiles of the level, median weekly autocorrelation, commonest peak month."""
    modes = diagnostics.filter("peak_month_eda is not null").groupBy("peak_month_eda").count().agg(F.min_by("peak_month_eda", F.struct(-F.col("count"), F.col("peak_month_eda"))).alias("peak_month_mode"))
    regimes = ["all_zero", "near_constant", "zero_heavy"]
    one = diagnostics.agg(
        F.count("*").alias("n_households"),
        F.count_if("degenerate_flag").alias("n_degenerate"),
        *[F.count_if(F.col("regime_label") == r).alias(f"n_{r}") for r in regimes],
        F.median("mean").alias("mean_household_consumption_median"),
        F.percentile("mean", 0.25).alias("mean_household_consumption_q25"),
        F.percentile("mean", 0.75).alias("mean_household_consumption_q75"),
        F.median("autocorr_lag_7").alias("weekly_acf_median"),
    )
    return one.crossJoin(F.broadcast(modes))


def _norm_aggregates() -> dict[str, Column]:
    return {
        "_zrange": F.max(Z) - F.min(Z),
        "_zstep": F.avg(F.abs(F.col(Z) - F.col("zlag_1"))),
        "_zacf": safe_corr(F.col("zlag_7"), F.col(Z)),
    }


NORM = Block(
    _norm_aggregates,
    lambda: {"normalized_range": F.col("_zrange"), "normalized_abs_diff_mean": F.col("_zstep"), "normalized_autocorr_lag_7": F.col("_zacf")},
    (Z, "zlag_1", "zlag_7"),
)


def norm_summary(panel: DataFrame) -> DataFrame:
    """Range, mean absolute step and lag-7 autocorrelation of the standardised series."""
    return compute(panel, NORM)


def method_selection(panel: DataFrame) -> DataFrame:
    """Diagnostics with the standardised summary, in the same pass."""
    return compute(panel, *_diagnostic_blocks(), NORM)


def ranked_sample(diagnostics: DataFrame, n_per_group: int = 5, seed: int = 42) -> DataFrame:
    """segment, household_id of up to n households of each regime and of the top deciles of level, weekly and annual pattern.

    Drawn by the order of a digest of id and seed, so the draw repeats.
    """
    top = {"high_mean": "mean", "high_weekly_structure": "autocorr_lag_7", "high_annual_variation": "monthly_profile_std"}
    cuts = diagnostics.agg(*[F.percentile(c, 0.9).alias(f"_{g}") for g, c in top.items()])
    groups = [F.when(F.col("regime_label") == r, r) for r in ("all_zero", "near_constant", "zero_heavy")]
    groups += [F.when(F.col(c) >= F.col(f"_{g}"), g) for g, c in top.items()]
    each = diagnostics.crossJoin(F.broadcast(cuts)).select(ID, F.explode(F.array_compact(F.array(*groups))).alias("segment"))
    order = Window.partitionBy("segment").orderBy(F.md5(F.concat_ws("/", F.col(ID), F.lit(seed))))
    return each.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n_per_group).select("segment", ID)


def population_profile(panel: DataFrame, unit: str = "weekday") -> DataFrame:
    """unit, mean: the mean over households of their means by weekday (0 to 6) or month."""
    part = F.weekday(DAY) if unit == "weekday" else F.month(DAY)
    return panel.groupBy(ID, part.alias(unit)).agg(F.avg(V).alias("m")).groupBy(unit).agg(F.avg("m").alias("mean"))


def weekend_contrast(panel: DataFrame) -> DataFrame:
    """Weekday and weekend means of the day-of-week means, their ratio and relative difference."""
    m = weekday_means(panel)
    wd = sum((F.col(f"dow_{d}") for d in DAYS_OF_WEEK[:5]), F.lit(0.0)) / 5
    we = (F.col("dow_Sat") + F.col("dow_Sun")) / 2
    return m.select(ID, wd.alias("weekday_mean"), we.alias("weekend_mean")).select(
        "*", (F.col("weekend_mean") / (F.col("weekday_mean") + 1e-10)).alias("weekend_ratio"), ((F.col("weekend_mean") - F.col("weekday_mean")) / (F.col("weekend_mean") + F.col("weekday_mean") + 1e-6)).alias("weekend_contrast")
    )


def seasonal_groups(panel: DataFrame, band: float = 0.10) -> DataFrame:
    """segment, n: households with a winter peak, a summer peak, or neither by more than `band`, from month means."""
    m = {n: F.col(f"month_{n}") for n in MONTHS}
    winter, summer = array_mean(F.array(m["Dec"], m["Jan"], m["Feb"])), array_mean(F.array(m["Jun"], m["Jul"], m["Aug"]))
    c = F.col("contrast")
    group = F.when(c > band, "winter_dominant").when(c < -band, "summer_dominant").otherwise("balanced")
    each = month_means(panel).select(ID, ((winter - summer) / F.nullif(winter + summer + 1e-6, F.lit(0.0))).alias("contrast"))
    return each.filter(c.isNotNull()).groupBy(group.alias("segment")).agg(F.count("*").alias("n"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, deviation, extremes and quartiles of a column."""
    c = F.col(column)
    return rows.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.percentile(c, 0.25).alias("q25"), F.median(c).alias("q50"), F.percentile(c, 0.75).alias("q75"), F.max(c).alias("max"))


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """Each value's count and percentage."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def histogram(rows: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin (from 1), n over equal bins between the extremes, which the last bin includes; empty bins have no row."""
    c = F.col(column)
    one = rows.agg(F.min(c).alias("_low"), F.max(c).alias("_high"))
    place = F.least(F.floor((c - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * bins) + 1, F.lit(bins))
    return rows.filter(c.isNotNull()).crossJoin(F.broadcast(one)).groupBy(F.coalesce(place, F.lit(1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
