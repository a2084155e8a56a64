"""Feature blocks of households; every block is a projection over a few aggregates of the panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.maths import SUMMER, WINTER, array_diff, array_mean, array_std, array_sum, entropy
from panelforge.operators.blocks import DAY, DAYS_OF_WEEK, ID, MONTHS, V, Z, Block, compute, month_aggregates, month_columns, weekday_aggregates, weekday_columns
from panelforge.operators.stats import TREND, autocorrelation_block, first_extreme

EPS = 1e-6

#: The block of normalised shape that clustering uses.
SHAPE_COLUMNS = (
    *[f"norm_dow_{d}" for d in DAYS_OF_WEEK],
    "norm_weekday_mean",
    "norm_weekend_mean",
    "norm_weekend_weekday_diff",
    "norm_q1_mean",
    "norm_q2_mean",
    "norm_q3_mean",
    "norm_q4_mean",
    "norm_spring_minus_winter",
    "norm_summer_minus_spring",
    "norm_autumn_minus_summer",
    "norm_winter_minus_autumn",
    "norm_monthly_profile_std",
    "norm_monthly_profile_range",
    "norm_month_diff_abs_mean",
    "norm_month_diff_std",
    "norm_dow_range",
    "norm_dow_diff_abs_mean",
    "norm_month_entropy",
)

WARD_BLOCKS = {
    "weekly": ("autocorr_lag_7",),
    "shape_normalized": SHAPE_COLUMNS,
    "persistence": ("autocorr_lag_30", "diff_std"),
    "trend": ("trend_slope_normalized",),
}


def _weekday_weekend(d: list[Column]) -> tuple[Column, Column]:
    return array_mean(F.array(*d[:5])), array_mean(F.array(*d[5:]))


def _cycle(month: Column, name: str) -> dict[str, Column]:
    angle = month * (2 * math.pi / 12)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def _only(block: Block, names: tuple[str, ...]) -> Block:
    """A block with some of its outputs."""
    return Block(block.aggregates, lambda: {n: c for n, c in block.outputs().items() if n in names}, block.needs)


def _level_aggregates() -> dict[str, Column]:
    v = F.col(V)
    return {"_mean": F.avg(v), "_std": F.stddev_samp(v), "_zero_pct": 100.0 * F.count_if(v == 0) / F.count("*")}


LEVEL = Block(
    _level_aggregates,
    lambda: {"mean": F.col("_mean"), "std": F.col("_std"), "zero_pct": F.col("_zero_pct"), "cv": F.when(F.abs("_mean") >= 1e-8, F.col("_std") / F.abs("_mean"))},
)


def level_features(panel: DataFrame) -> DataFrame:
    """Mean, deviation, relative deviation and share of zero days."""
    return compute(panel, LEVEL)


def _weekly_outputs() -> dict[str, Column]:
    d = weekday_columns()
    wd, we = _weekday_weekend(d)
    return dict(zip((f"dow_{n}" for n in DAYS_OF_WEEK), d)) | {
        "weekend_weekday_contrast": (we - wd) / (we + wd + EPS),
        "weekday_range": F.greatest(*d) - F.least(*d),
        "weekend_share": (d[5] + d[6]) / (array_sum(F.array(*d)) + EPS),
        "weekday_std": array_std(F.array(*d)),
    }


WEEKLY = Block(weekday_aggregates, _weekly_outputs)


def weekly_features(panel: DataFrame) -> DataFrame:
    """Day-of-week means, weekend contrast and share, spread over the week, lag-7 autocorrelation."""
    return compute(panel, WEEKLY, autocorrelation_block(7))


def _energy_aggregates() -> dict[str, Column]:
    of = lambda months: F.sum(F.when(F.month(DAY).isin(*months), F.col(V)))
    return month_aggregates() | {"_mean": F.avg(V), "_total": F.sum(V), "_winter_sum": of(WINTER), "_summer_sum": of(SUMMER)}


def _energy_outputs() -> dict[str, Column]:
    m = month_columns()
    mean, total, year = F.col("_mean") + EPS, F.col("_total") + EPS, array_sum(F.array(*m)) + EPS
    return {
        "base_load_ratio": F.least(*m) / mean,
        "seasonal_peak_ratio": F.greatest(*m) / mean,
        "seasonal_range_ratio": (F.greatest(*m) - F.least(*m)) / mean,
        "winter_share": F.col("_winter_sum") / total,
        "summer_share": F.col("_summer_sum") / total,
        "top3_month_share": array_sum(F.slice(F.sort_array(F.array(*m), asc=False), 1, 3)) / year,
        "monthly_entropy": entropy(F.transform(F.array(*m), lambda x: x / year)),
        **_cycle(first_extreme(m), "peak_month"),
        **_cycle(first_extreme(m, False), "trough_month"),
    }


ENERGY = Block(_energy_aggregates, _energy_outputs)


def energy_features(panel: DataFrame) -> DataFrame:
    """Month means against the level, seasonal shares, concentration over months, peak and trough month on a circle."""
    return compute(panel, ENERGY)


def _shape_outputs() -> dict[str, Column]:
    m, d = month_columns("_zm_"), weekday_columns("_zd_")
    quarter = [array_mean(F.array(*m[3 * i : 3 * i + 3])) for i in range(4)]
    winter, summer = array_mean(F.array(m[11], m[0], m[1])), array_mean(F.array(*m[5:8]))
    wd, we = _weekday_weekend(d)
    size = F.transform(F.array(*m), F.abs)
    p = F.transform(size, lambda x: F.when(array_sum(size) > 0, x / F.nullif(array_sum(size), F.lit(0.0))).otherwise(0.0))
    dm, dd = array_diff(F.array(*m), 12), array_diff(F.array(*d), 7)
    return {
        **dict(zip((f"norm_month_{n}" for n in MONTHS), m)),
        **dict(zip((f"norm_dow_{n}" for n in DAYS_OF_WEEK), d)),
        "norm_monthly_profile_std": array_std(F.array(*m)),
        "norm_monthly_profile_range": F.greatest(*m) - F.least(*m),
        "norm_winter_mean": winter,
        "norm_summer_mean": summer,
        "norm_winter_summer_diff": winter - summer,
        "norm_weekday_mean": wd,
        "norm_weekend_mean": we,
        "norm_weekend_weekday_diff": we - wd,
        **{f"norm_q{i}_mean": q for i, q in enumerate(quarter, 1)},
        "norm_spring_minus_winter": quarter[1] - quarter[0],
        "norm_summer_minus_spring": quarter[2] - quarter[1],
        "norm_autumn_minus_summer": quarter[3] - quarter[2],
        "norm_winter_minus_autumn": quarter[0] - quarter[3],
        **_cycle(first_extreme(m), "norm_peak_month"),
        **_cycle(first_extreme(m, False), "norm_trough_month"),
        "norm_month_entropy": F.aggregate(F.filter(p, lambda x: x.isNotNull()), F.lit(0.0), lambda t, x: t - x * F.ln(F.greatest(x, F.lit(1e-10)))),
        "norm_month_diff_abs_mean": array_mean(F.transform(dm, F.abs)),
        "norm_month_diff_std": array_std(dm),
        "norm_dow_range": F.greatest(*d) - F.least(*d),
        "norm_dow_diff_abs_mean": array_mean(F.transform(dd, F.abs)),
    }


SHAPE = Block(lambda: month_aggregates(Z, "_zm_") | weekday_aggregates(Z, "_zd_"), _shape_outputs, (Z,))


def shape_features(panel: DataFrame) -> DataFrame:
    """Profile of the standardised series over months and weekdays: 44 columns."""
    return compute(panel, SHAPE)


def _persistence_aggregates() -> dict[str, Column]:
    v = F.col(V)
    d = v - F.col("lag_1")
    season = lambda months: F.stddev_samp(F.when(F.month(DAY).isin(*months), v))
    return {
        "_r7": F.avg("std_7"),
        "_r30": F.avg("std_30"),
        "_step": F.avg(d),
        "_step_std": F.stddev_samp(d),
        "_step_abs": F.avg(F.abs(d)),
        "_step_max": F.max(d),
        "_step_min": F.min(d),
        "_median": F.median(v),
        "_p95": F.percentile(v, 0.95),
        "_p99": F.percentile(v, 0.99),
        "_max": F.max(v),
        "_mean": F.avg(v),
        "_winter_std": season(WINTER),
        "_summer_std": season(SUMMER),
    }


def _persistence_outputs() -> dict[str, Column]:
    middle, mean = F.col("_median") + EPS, F.col("_mean") + EPS
    winter, summer = F.col("_winter_std") / mean, F.col("_summer_std") / mean
    return {
        "rolling_std_7": F.col("_r7"),
        "rolling_std_30": F.col("_r30"),
        "diff_mean": F.col("_step"),
        "diff_std": F.col("_step_std"),
        "abs_diff_mean": F.col("_step_abs"),
        "diff_max": F.col("_step_max"),
        "diff_min": F.col("_step_min"),
        "p95_to_median_ratio": F.col("_p95") / middle,
        "p99_to_median_ratio": F.col("_p99") / middle,
        "max_to_p95_ratio": F.col("_max") / (F.col("_p95") + EPS),
        "winter_std_norm": winter,
        "summer_std_norm": summer,
        "winter_summer_volatility_ratio": winter / (summer + EPS),
    }


PERSISTENCE = Block(_persistence_aggregates, _persistence_outputs, ("lag_1", "std_7", "std_30"))
STEPS = Block(lambda: {"_step_std": F.stddev_samp(F.col(V) - F.col("lag_1"))}, lambda: {"diff_std": F.col("_step_std")}, ("lag_1",))


def persistence_features(panel: DataFrame) -> DataFrame:
    """Autocorrelation, rolling deviation, day-to-day steps, upper quantiles and seasonal volatility: 15 columns."""
    return compute(panel, autocorrelation_block(1, 30), PERSISTENCE)


def trend_features(panel: DataFrame) -> DataFrame:
    """Slope of the series and of its standardised form."""
    return compute(panel, _only(TREND, ("trend_slope", "trend_slope_normalized")))


def shape_block(panel: DataFrame) -> DataFrame:
    """The columns of the normalised shape that clustering uses; the rest is never computed."""
    return compute(panel, _only(SHAPE, SHAPE_COLUMNS)).select(ID, *SHAPE_COLUMNS)


def ward_features(panel: DataFrame) -> DataFrame:
    """The 29 columns of feature clustering, in block order, from one window pass and one aggregate."""
    done = compute(panel, autocorrelation_block(7, 30), _only(SHAPE, SHAPE_COLUMNS), STEPS, _only(TREND, WARD_BLOCKS["trend"]))
    return done.select(ID, *[c for columns in WARD_BLOCKS.values() for c in columns])


def block_map(blocks: dict[str, tuple[str, ...]] = WARD_BLOCKS) -> dict[str, list[str]]:
    return {name: list(columns) for name, columns in blocks.items()}


def block_sizes(blocks: dict[str, tuple[str, ...]] = WARD_BLOCKS) -> list[tuple[str, int]]:
    return [(name, len(columns)) for name, columns in blocks.items()]
