"""The panel: one row (household_id, date, consumption) for each entity and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "household_id long, date date, consumption double"


class PanelError(ValueError):
    """A panel or label table that breaks a rule of its schema."""


def spine(ids: DataFrame, start: str, end: str, *keep: str) -> DataFrame:
    """Every id, with the columns `keep`, and every day from start to end: no join, one row generator for each id.

    Spark takes the result to be as small as `ids`; where it is joined, a hint
    has to keep it from being broadcast.
    """
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day")))
    return ids.select(F.col("household_id").cast("long").alias("household_id"), days.alias("date"), *keep)


def dense(ids: DataFrame, readings: DataFrame, start: str, end: str, fill: float | None = None) -> DataFrame:
    """The readings (household_id, date, consumption) on the full calendar, absent days null or `fill`.

    NaN readings count as missing.
    """
    clean = readings.select("household_id", "date", F.when(~F.isnan("consumption"), F.col("consumption")).alias("consumption"))
    clean = clean.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    full = spine(ids, start, end).join(clean, ["household_id", "date"], "left")
    return full if fill is None else full.withColumn("consumption", F.coalesce("consumption", F.lit(float(fill))))


def read_wide_csv(spark: SparkSession, path: str, *, days: int, start: str, end: str) -> DataFrame:
    """A wide CSV (first column the id, one column for each ISO date) as a long panel.

    The header is checked as `check_dates` does, ids must be unique.
    """
    head = spark.read.option("header", False).csv(path).limit(1).first()
    if head is None:
        raise PanelError("the file is empty")
    names = list(head)
    check_dates(names[1:], days=days, start=start, end=end)
    schema = T.StructType([T.StructField("household_id", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in names[1:]])
    wide = spark.read.option("header", True).schema(schema).csv(path)
    twice = wide.groupBy("household_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise PanelError(f"household {twice[0][0]} has more than one row")
    return wide_to_long(wide)


def wide_to_long(wide: DataFrame, value: str = "consumption") -> DataFrame:
    """One row for each id and date column."""
    dates = [c for c in wide.columns if c != "household_id"]
    long = wide.unpivot(["household_id"], dates, "date", value)
    return long.select("household_id", F.to_date("date").alias("date"), F.nanvl(F.col(value), F.lit(None).cast("double")).alias(value))


def long_to_wide(panel: DataFrame, days: list[date]) -> DataFrame:
    """One column for each of the given days."""
    names = [d.isoformat() for d in days]
    named = panel.select("household_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "consumption")
    return named.groupBy("household_id").pivot("day", names).agg(F.first("consumption"))


def check_dates(names: list[str], *, days: int, start: str, end: str) -> list[date]:
    """The column names as dates; raises unless parseable, unique, increasing, `days` many, from start to end."""
    try:
        axis = [date.fromisoformat(n) for n in names]
    except ValueError as e:
        raise PanelError(f"a column is no date: {e}") from None
    if len(set(axis)) != len(axis):
        raise PanelError("dates repeat")
    if axis != sorted(axis):
        raise PanelError("dates do not increase")
    if len(axis) != days:
        raise PanelError(f"{len(axis)} dates, expected {days}")
    if axis[0].isoformat() != start or axis[-1].isoformat() != end:
        raise PanelError(f"dates run {axis[0]} to {axis[-1]}, expected {start} to {end}")
    return axis


def date_axis(panel: DataFrame) -> DataFrame:
    """One row: n_days, first_day, last_day, n_missing_days of the calendar between."""
    axis = panel.agg(F.count_distinct("date").alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return axis.withColumn("n_missing_days", (F.datediff("last_day", "first_day") + 1 - F.col("n_days")).cast("long"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def quality_profile(panel: DataFrame) -> DataFrame:
    """One row: households, days, missing, negative, zero and duplicate readings, extremes."""
    v = F.col("consumption")
    each = panel.groupBy("household_id", "date").agg(
        F.count("*").alias("n"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(v < 0).alias("negative"),
        F.count_if(v == 0).alias("zero"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
    )
    by_household = each.groupBy("household_id").agg(*[F.sum(c).alias(c) for c in ("n", "missing", "negative", "zero")], F.count("*").alias("days"), F.min("least").alias("least"), F.max("most").alias("most"))
    return by_household.agg(
        F.count("*").alias("n_households"),
        F.max("days").alias("n_days"),
        F.sum("missing").alias("n_missing"),
        F.sum("negative").alias("n_negative"),
        F.sum("zero").alias("n_zero"),
        F.sum(F.col("n") - F.col("days")).alias("n_duplicate"),
        F.min("least").alias("min_value"),
        F.max("most").alias("max_value"),
    )


def id_differences(train: DataFrame, test: DataFrame) -> DataFrame:
    """household_id, only_in for ids that one of two panels lacks."""
    a, b = train.select("household_id").distinct(), test.select("household_id").distinct()
    left = a.join(b, "household_id", "left_anti").withColumn("only_in", F.lit("train"))
    return left.unionByName(b.join(a, "household_id", "left_anti").withColumn("only_in", F.lit("test")))


def require_same_ids(train: DataFrame, test: DataFrame) -> None:
    """Raises with the first differing ids."""
    differ = id_differences(train, test).orderBy("household_id").limit(5).collect()
    if differ:
        raise PanelError("households differ: " + ", ".join(f"{r[0]} only in {r[1]}" for r in differ))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """household_id, cluster from a hand-off CSV; raises on ids or labels that are missing, not integers or negative."""
    return parse_assignments(spark.read.option("header", True).csv(path))


def parse_assignments(raw: DataFrame) -> DataFrame:
    """The labels that a table of strings holds, checked as `read_assignments` says."""
    if {"household_id", "cluster"} - set(raw.columns):
        raise PanelError("the hand-off needs the columns household_id and cluster")
    rows = raw.select(F.expr("try_cast(household_id as long)").alias("household_id"), F.expr("cast(try_cast(cluster as double) as int)").alias("cluster"))
    return check_assignments(rows)


def check_assignments(labels: DataFrame) -> DataFrame:
    """The labels, or an error if any is missing or negative."""
    bad = labels.filter("household_id is null or cluster is null or cluster < 0").limit(1).collect()
    if bad:
        raise PanelError(f"not a valid assignment: {bad[0].asDict()}")
    return labels


def handoff_name(method: str, k: int) -> str:
    return f"{method}_k{k}_forecasting_handoff.csv"


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write Parquet, or CSV with a header."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if form == "csv" else writer.parquet)(path)
