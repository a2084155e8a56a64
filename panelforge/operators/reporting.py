"""Reports on labelled households."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.cleaning import DAY, ID, V, z_rows
from panelforge.operators.labels import CLUSTER, cluster_profiles, family, sizes
from panelforge.operators.stats import month_means, weekday_means
from panelforge.operators.validity import LEVEL_WARNING
from panelforge.sources.panel import check_assignments


def attach(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of labelled households, with their cluster."""
    return rows.join(labels.filter(F.col(CLUSTER).isNotNull()).select(ID, CLUSTER), ID)


def assignment_summary(labels: DataFrame) -> DataFrame:
    """One row: households in all, in clusters, in special groups, unassigned; clusters and their extreme sizes."""
    each = labels.groupBy(CLUSTER).agg(F.count("*").alias("n"))
    c, n = F.col(CLUSTER), F.col("n")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total_labels"),
        count(c >= 0).alias("n_valid_labels"),
        count(c < 0).alias("n_special_regime_labels"),
        F.count_if(c >= 0).alias("n_regular_clusters_found"),
        count(c.isNull()).alias("n_unassigned_households"),
        F.min(F.when(c >= 0, n)).alias("min_cluster_size"),
        F.max(F.when(c >= 0, n)).alias("max_cluster_size"),
    )


def special_summary(labels: DataFrame) -> DataFrame:
    """One row: special households, their share of all rows and of the assigned ones."""
    special = F.count_if(F.col(CLUSTER) < 0)
    return labels.agg(
        special.alias("n_special_regime_households"),
        F.coalesce(F.try_divide(100.0 * special, F.count("*")), F.lit(0.0)).alias("pct_special_regime_households_all_rows"),
        F.coalesce(F.try_divide(100.0 * special, F.count(CLUSTER)), F.lit(0.0)).alias("pct_special_regime_households_assigned_only"),
    )


def special_counts(labels: DataFrame) -> DataFrame:
    """cluster, n of the special groups."""
    return labels.filter("cluster < 0").groupBy(CLUSTER).agg(F.count("*").alias("n"))


def special_ids(labels: DataFrame, n: int = 20) -> DataFrame:
    """The first ids of the special groups: the report shows n of them."""
    return labels.filter("cluster < 0").orderBy(ID).limit(n)


def level_dominance(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean and deviation over days of each cluster's raw and standardised profile."""
    raw = cluster_profiles(panel, labels).groupBy(CLUSTER).agg(F.avg("mean").alias("cluster_raw_profile_mean"), F.stddev_samp("mean").alias("cluster_raw_profile_std"))
    z = cluster_profiles(z_rows(panel), labels).groupBy(CLUSTER).agg(F.avg("mean").alias("cluster_normalized_profile_mean"), F.stddev_samp("mean").alias("cluster_normalized_profile_std"))
    return raw.join(z, CLUSTER)


def household_means(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """Distribution over a cluster's households of their means."""
    each = attach(panel.groupBy(ID).agg(F.avg(V).alias("m")), labels.filter("cluster >= 0"))
    return each.groupBy(CLUSTER).agg(F.avg("m").alias("mean"), F.median("m").alias("median"), F.stddev_samp("m").alias("std"), F.min("m").alias("min"), F.max("m").alias("max"))


def mean_columns(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean of every numeric or boolean column by cluster."""
    known = attach(rows, labels.filter("cluster >= 0"))
    kinds = {n: t for n, t in known.dtypes if n not in (ID, CLUSTER)}
    numeric = [n for n, t in kinds.items() if t in ("double", "float", "int", "bigint", "boolean")]
    return known.groupBy(CLUSTER).agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in numeric])


def weekly_profiles(panel: DataFrame, labels: DataFrame) -> DataFrame:
    return mean_columns(weekday_means(panel), labels)


def monthly_profiles(panel: DataFrame, labels: DataFrame) -> DataFrame:
    return mean_columns(month_means(panel), labels)


def distinctive_features(features: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """cluster, rank, feature, feature_family, means and standardized_difference: the n features in which a cluster differs most from all."""
    columns = [c for c in features.columns if c != ID]
    known = attach(features, labels.filter("cluster >= 0")).unpivot([ID, CLUSTER], columns, "feature", "x")
    whole = known.groupBy("feature").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    each = known.groupBy(CLUSTER, "feature").agg(F.avg("x").alias("m")).join(F.broadcast(whole), "feature")
    each = each.withColumn("standardized_difference", (F.col("m") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)))
    names = {c: family(c) for c in columns}
    tag = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("feature")]
    order = Window.partitionBy(CLUSTER).orderBy(F.desc_nulls_last(F.round(F.abs("standardized_difference"), 9)), "feature")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(CLUSTER, "rank", "feature", tag.alias("feature_family"), F.col("m").alias("cluster_mean"), F.col("mu").alias("overall_mean"), "standardized_difference")


def representatives(panel: DataFrame, labels: DataFrame, n: int = 3, normalised: bool = False) -> DataFrame:
    """cluster, rank, household_id, distance: the n households nearest to their cluster's mean profile."""
    series = z_rows(panel) if normalised else panel
    known = attach(series, labels.filter("cluster >= 0"))
    profile = known.groupBy(CLUSTER, DAY).agg(F.avg(V).alias("mean"))
    distance = known.join(profile, [CLUSTER, DAY]).groupBy(CLUSTER, ID).agg(F.sqrt(F.sum(F.pow(F.col(V) - F.col("mean"), 2))).alias("distance"))
    order = Window.partitionBy(CLUSTER).orderBy(F.round("distance", 9), ID)
    return distance.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(CLUSTER, "rank", ID, "distance")


def meaningfulness(panel: DataFrame, labels: DataFrame, threshold: float = LEVEL_WARNING) -> DataFrame:
    """One row: spread of the cluster levels, mean distance of standardised profiles, their ratio and a warning; null for one cluster."""
    level = household_means(panel, labels).agg((F.max("mean") - F.min("mean")).alias("cluster_mean_spread"))
    z = cluster_profiles(z_rows(panel), labels)
    other = z.select(F.col(CLUSTER).alias("o"), DAY, F.col("mean").alias("om"))
    pairs = z.join(other, DAY).filter(F.col(CLUSTER) < F.col("o")).groupBy(CLUSTER, "o").agg(F.sqrt(F.sum(F.pow(F.col("mean") - F.col("om"), 2))).alias("d"))
    one = level.crossJoin(pairs.agg(F.avg("d").alias("normalized_shape_separation")))
    ratio = F.col("cluster_mean_spread") / (F.col("normalized_shape_separation") + 1e-6)
    return one.withColumn("level_to_shape_ratio", ratio).withColumn("level_dominance_warning", ratio > threshold)


def assignment_table(labels: DataFrame) -> DataFrame:
    return labels.select(ID, CLUSTER).orderBy(ID)


def forecast_table(labels: DataFrame) -> DataFrame:
    """The sorted assignment; missing or special labels are an error."""
    return check_assignments(assignment_table(labels))


def report(panel: DataFrame, labels: DataFrame, features: DataFrame | None = None) -> dict[str, DataFrame]:
    """All reports, lazily."""
    out = {
        "sizes": sizes(labels),
        "assignment": assignment_summary(labels),
        "special": special_summary(labels),
        "special_counts": special_counts(labels),
        "profiles": cluster_profiles(panel, labels),
        "level_dominance": level_dominance(panel, labels),
        "household_means": household_means(panel, labels),
        "weekly": weekly_profiles(panel, labels),
        "monthly": monthly_profiles(panel, labels),
        "representatives": representatives(panel, labels),
        "meaningfulness": meaningfulness(panel, labels),
    }
    if features is not None:
        out |= {"features": mean_columns(features, labels), "distinctive": distinctive_features(features, labels)}
    return out
