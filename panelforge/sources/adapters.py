"""Daily panels over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.panel import dense


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _year(items: DataFrame, year: int) -> DataFrame:
    """Line items shipped in a year, by a range of the column's own type, which reaches the scan."""
    day, kind = F.col("l_shipdate"), items.schema["l_shipdate"].dataType
    return items.filter((day >= F.lit(f"{year}-01-01").cast(kind)) & (day < F.lit(f"{year + 1}-01-01").cast(kind)))


def supplier_panel(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Quantity shipped by each supplier and day, 0 where none."""
    daily = _year(table(spark, sf_dir, "lineitem"), year).groupBy(F.col("l_suppkey").alias("household_id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("consumption"))
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("household_id"))
    return dense(ids, daily, f"{year}-01-01", f"{year}-12-31", fill=0.0)


def brand_panel(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Quantity shipped of each brand and day, 0 where none; the id is the brand's number.

    Items are summed by part before they meet the brands.
    """
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long")
    parts = table(spark, sf_dir, "part").select("p_partkey", number.alias("household_id"))
    by_part = _year(table(spark, sf_dir, "lineitem"), year).groupBy("l_partkey", F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("q"))
    daily = by_part.join(parts, by_part.l_partkey == parts.p_partkey).groupBy("household_id", "date").agg(F.sum("q").alias("consumption"))
    return dense(parts.select("household_id").distinct(), daily, f"{year}-01-01", f"{year}-12-31", fill=0.0)


def event_panel(spark: SparkSession, sf_dir: str, start: str = "2024-01-01", end: str = "2024-01-30") -> DataFrame:
    """Event value by user and day, null on days without an event."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("household_id"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("consumption"))
    return dense(daily.select("household_id").distinct(), daily, start, end)
