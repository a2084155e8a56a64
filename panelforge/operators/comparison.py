"""Comparisons of forecasting methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.storage import ranked
from panelforge.operators.cleaning import DAY, ID, V
from panelforge.operators.labels import CLUSTER


def method_comparison(*summaries: DataFrame) -> DataFrame:
    """All methods' summaries, the smallest mean error first."""
    return reduce(DataFrame.unionByName, summaries).orderBy("average_household_mae")


def with_actuals(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast rows with the reading, null where there is none, and the absolute error; neither panel is broadcast."""
    met = forecast.join(actual.select(ID, DAY, V).hint("merge"), [ID, DAY], "left")
    return met.withColumn("abs_error", F.abs(F.col(V) - F.col("predicted")))


def error_distribution(errors: DataFrame) -> DataFrame:
    """Mean, median and deviation of household errors (method, household_id, mae) by method."""
    return errors.groupBy("method").agg(F.avg("mae").alias("mean"), F.median("mae").alias("median"), F.stddev_samp("mae").alias("std"))


def error_ecdf(errors: DataFrame) -> DataFrame:
    """Each household's share of households up to it, by ascending error within its method.

    Ranks over all methods come from sorted ranges, which no one task holds;
    a method's first rank and size are one row for each method.
    """
    order = ranked(errors.select("method", ID, "mae"), "_rank", "method", "mae", ID)
    size = order.groupBy(F.col("method").alias("_of")).agg((F.min("_rank") - 1).alias("_before"), F.count("*").alias("_n"))
    each = order.join(F.broadcast(size), F.col("method").eqNullSafe(F.col("_of")))
    return each.select("method", ID, "mae", ((F.col("_rank") - F.col("_before")) / F.col("_n")).alias("share"))


def daily_by_cluster(rows: DataFrame) -> DataFrame:
    """Mean reading and forecast by cluster and day of rows with both."""
    return rows.filter(F.col(V).isNotNull()).groupBy(CLUSTER, DAY).agg(F.avg(V).alias("actual"), F.avg("predicted").alias("predicted"))


def cluster_errors(rows: DataFrame) -> DataFrame:
    """Mean absolute error and number of households by cluster."""
    return rows.groupBy(CLUSTER).agg(F.avg("abs_error").alias("mae"), F.count_distinct(ID).alias("n_households"))


def monthly_errors(rows: DataFrame) -> DataFrame:
    """Mean absolute error of all 12 months, null for months without rows."""
    months = rows.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    each = rows.groupBy(F.month(DAY).alias("month")).agg(F.avg("abs_error").alias("mae"))
    return months.join(each, "month", "left")


def extremes(errors: DataFrame, n: int = 10) -> DataFrame:
    """side, household_id, mae of the n smallest and n largest errors."""
    best = errors.orderBy("mae", ID).limit(n).select(F.lit("best").alias("side"), ID, "mae")
    return best.unionByName(errors.orderBy(F.desc("mae"), ID).limit(n).select(F.lit("worst").alias("side"), ID, "mae"))


def win_rates(errors: DataFrame) -> DataFrame:
    """method_a, method_b, wins, n, win_rate: how often method a errs less than b on the same household."""
    a = errors.select(F.col("method").alias("method_a"), ID, F.col("mae").alias("ea"))
    b = errors.select(F.col("method").alias("method_b"), ID, F.col("mae").alias("eb"))
    met = a.join(b, ID).filter("method_a != method_b")
    out = met.groupBy("method_a", "method_b").agg(F.count_if(F.col("ea") < F.col("eb")).alias("wins"), F.count("*").alias("n"))
    return out.withColumn("win_rate", F.col("wins") / F.col("n"))


def backtest_union(*tables: DataFrame) -> DataFrame:
    """Backtest tables of several scopes; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
