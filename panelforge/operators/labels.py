"""Cluster labels: sizes, special regimes, order, hand-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.maths import array_mean
from panelforge.operators.blocks import DAY, DAYS_OF_WEEK, ID, MONTHS, V
from panelforge.operators.cleaning import LABELS, z_rows
from panelforge.operators.stats import month_means, weekday_means
from panelforge.sources.panel import PanelError

CLUSTER = "cluster"
KEEP_SPECIAL = 300
def _whole():
    return Window.partitionBy(F.lit(0))


def special_labels(flags: DataFrame, out: DataFrame | None = None) -> DataFrame:
    """household_id, cluster of the excluded households by regime; an excluded id without a regime is an error.

    Without `out` every degenerate household is labelled.
    """
    label = F.when(F.col("all_zero_flag"), LABELS["all_zero"]).when(F.col("near_constant_flag"), LABELS["near_constant"]).when(F.col("zero_heavy_flag"), LABELS["zero_heavy"])
    if out is None:
        return flags.filter("degenerate_flag").select(ID, label.cast("int").alias(CLUSTER))
    each = out.select(ID).join(flags, ID, "left").select(ID, label.cast("int").alias(CLUSTER))
    if each.filter("cluster is null").limit(1).collect():
        raise PanelError("an excluded household has no regime")
    return each


def unflagged_labels(out: DataFrame) -> DataFrame:
    """Excluded households where no flags are at hand."""
    return out.select(ID, F.lit(LABELS["other"]).alias(CLUSTER))


def all_labels(regular: DataFrame, special: DataFrame) -> DataFrame:
    return regular.select(ID, F.col(CLUSTER).cast("int").alias(CLUSTER)).unionByName(special.select(ID, CLUSTER))


def sizes(labels: DataFrame) -> DataFrame:
    """cluster, n_households, pct_households over labels of 0 or more."""
    counts = labels.filter("cluster >= 0").groupBy(CLUSTER).agg(F.count("*").alias("n_households"))
    return counts.withColumn("pct_households", 100.0 * F.col("n_households") / F.sum("n_households").over(_whole()))


def balance(labels: DataFrame) -> DataFrame:
    """One row: the smallest over the largest cluster."""
    return sizes(labels).agg(F.try_divide(F.min("n_households"), F.max("n_households")).alias("cluster_balance"))


#: Feature names by the kind of reading they stand for.
RAW_LEVEL = ("mean", "std", "cv", "zero_pct")
RAW_SUMMARY = ("weekend_weekday_contrast", "winter_summer_contrast", "seasonal_amplitude", "monthly_profile_std", "weekday_range")
SHAPE_SUMMARY = ("norm_monthly_profile_std", "norm_monthly_profile_range", "norm_winter_summer_diff", "norm_weekend_weekday_diff")
ENERGY_PROFILE = (
    *("base_load_ratio", "seasonal_peak_ratio", "seasonal_range_ratio", "winter_share", "summer_share", "top3_month_share"),
    *("monthly_entropy", "peak_month_sin", "peak_month_cos", "trough_month_sin", "trough_month_cos"),
)
PERSISTENCE_TREND = (
    *("autocorr_lag_1", "autocorr_lag_7", "autocorr_lag_30", "rolling_std_7", "rolling_std_30"),
    *("diff_mean", "diff_std", "abs_diff_mean", "diff_max", "diff_min"),
    *("p95_to_median_ratio", "p99_to_median_ratio", "max_to_p95_ratio"),
    *("winter_std_norm", "summer_std_norm", "winter_summer_volatility_ratio", "trend_slope", "trend_slope_normalized"),
)


def family(column: str) -> str:
    """The family that reports name for a feature column: by prefix, then by list."""
    prefixes = {"dow_": "raw_weekly_profile", "month_": "raw_monthly_profile", "norm_dow_": "normalized_weekly_shape", "norm_month_": "normalized_monthly_shape"}
    lists = {"raw_level": RAW_LEVEL, "shape_summary": (*RAW_SUMMARY, *SHAPE_SUMMARY), "energy_profile": ENERGY_PROFILE, "persistence_trend": PERSISTENCE_TREND}
    found = [f for p, f in prefixes.items() if column.startswith(p)] + [f for f, names in lists.items() if column in names]
    return found[0] if found else "other"


def columns_by_family(columns: list[str]) -> dict[str, int]:
    """How many of the columns are raw levels, raw profiles, normalised shape, energy profile, persistence and trend, or other."""
    groups = {
        "raw_level": "raw_level_features",
        "raw_weekly_profile": "raw_profile_features",
        "raw_monthly_profile": "raw_profile_features",
        "normalized_weekly_shape": "normalized_shape_features",
        "normalized_monthly_shape": "normalized_shape_features",
        "energy_profile": "energy_profile_features",
        "persistence_trend": "persistence_trend_features",
        "other": "other_features",
    }
    out = dict.fromkeys(groups.values(), 0)
    for c in columns:
        out["raw_profile_features" if c in RAW_SUMMARY else "normalized_shape_features" if c in SHAPE_SUMMARY else groups[family(c)]] += 1
    return out


def cluster_profiles(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, date, mean over labels of 0 or more."""
    known = labels.filter("cluster >= 0").select(ID, CLUSTER)
    return panel.join(known, ID).groupBy(CLUSTER, DAY).agg(F.avg(V).alias("mean"))


def _profile_sums(panel: DataFrame, profiles: DataFrame) -> DataFrame:
    """household_id, cluster, distance of each household to each profile; the profiles are one row a cluster and day."""
    day = profiles.select(F.col(CLUSTER).alias("_c"), DAY, "mean")
    return panel.join(F.broadcast(day), DAY).groupBy(ID, "_c").agg(F.sqrt(F.sum(F.pow(F.col(V) - F.col("mean"), 2))).alias("distance"))


def reassign_special(panel: DataFrame, labels: DataFrame, keep_from: int = KEEP_SPECIAL) -> DataFrame:
    """Labels in which large special groups are clusters of their own and the rest joins the nearest profile.

    Special labels of `keep_from` households or more become clusters after
    the last one, by ascending label.  Others go to the cluster, be it one of
    these or a regular one, whose mean standardised profile is nearest, the
    smallest number on ties; as many profiles as clusters are broadcast.
    Without any cluster there is nothing to join, which is an error.
    """
    if labels.filter("cluster is null").limit(1).collect():
        raise PanelError("a label is missing")
    regular, special = labels.filter("cluster >= 0"), labels.filter("cluster < 0")
    top = regular.agg(F.coalesce(F.max(CLUSTER), F.lit(-1)).alias("_top"))
    large = special.groupBy(CLUSTER).agg(F.count("*").alias("n")).filter(F.col("n") >= keep_from)
    new = large.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(CLUSTER))).crossJoin(F.broadcast(top)).select(CLUSTER, (F.col("_top") + F.col("_k")).cast("int").alias("_new"))
    mapped = special.join(F.broadcast(new), CLUSTER, "left")
    whole = regular.select(ID, CLUSTER).unionByName(mapped.filter("_new is not null").select(ID, F.col("_new").cast("int").alias(CLUSTER)))
    rest = mapped.filter("_new is null").select(ID)
    if whole.isEmpty() and not rest.isEmpty():
        raise PanelError("there is no cluster that special households could join")
    z = z_rows(panel)
    near = _profile_sums(z.join(rest, ID, "left_semi"), cluster_profiles(z, whole)).groupBy(ID).agg(F.min_by("_c", F.struct("distance", "_c")).alias(CLUSTER))
    return whole.unionByName(near.select(ID, F.col(CLUSTER).cast("int").alias(CLUSTER)))


def order_keys(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster and the keys that order clusters: seasonal contrast, weekend lift, weekly routine, profile range."""
    known = labels.filter("cluster >= 0").select(ID, CLUSTER)
    m = [F.col(f"month_{x}") for x in MONTHS]
    d = [F.col(f"dow_{x}") for x in DAYS_OF_WEEK]
    raw = cluster_profiles(panel, labels).select(F.col(CLUSTER).alias(ID), DAY, F.col("mean").alias(V))
    season = month_means(raw).select(ID, (array_mean(F.array(m[11], m[0], m[1])) - array_mean(F.array(*m[5:8]))).alias("seasonal_contrast"))
    week = weekday_means(raw).select(ID, (array_mean(F.array(*d[5:])) - array_mean(F.array(*d[:5]))).alias("weekend_lift"), (F.greatest(*d) - F.least(*d)).alias("weekly_routine"))
    span = cluster_profiles(z_rows(panel), known).groupBy(CLUSTER).agg((F.max("mean") - F.min("mean")).alias("profile_range"))
    return season.join(week, ID).withColumnRenamed(ID, CLUSTER).join(span, CLUSTER)


def ordered(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels renumbered from 0 by the descending order keys; labels under 0 stay."""
    if labels.filter("cluster is null").limit(1).collect():
        raise PanelError("a label is missing")
    keys = [F.desc_nulls_last(c) for c in ("seasonal_contrast", "weekend_lift", "weekly_routine", "profile_range")]
    rank = order_keys(panel, labels).select(CLUSTER, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys, CLUSTER)) - 1).alias("_new"))
    return labels.join(F.broadcast(rank), CLUSTER, "left").select(ID, F.coalesce("_new", CLUSTER).cast("int").alias(CLUSTER))


def handoff(panel: DataFrame, labels: DataFrame, keep_from: int = KEEP_SPECIAL) -> dict[str, DataFrame]:
    """The table that forecasting takes, sorted by id, with sizes, profiles and the special groups before."""
    final = reassign_special(panel, ordered(panel, labels), keep_from)
    if final.filter("cluster is null or cluster < 0").limit(1).collect():
        raise PanelError("a household has no regular cluster")
    special = labels.filter("cluster < 0").groupBy(CLUSTER).agg(F.count("*").alias("n_households"))
    return {"table": final.orderBy(ID), "sizes": sizes(final), "profiles": cluster_profiles(panel, final), "special": special}
