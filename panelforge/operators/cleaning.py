"""Repair, normalisation and regimes of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.maths import CONSTANT
from panelforge.operators.blocks import DAY, ID, V, Block, compute
from panelforge.sources.panel import PanelError

ZERO_HEAVY_PCT, NEAR_CONSTANT_STD = 75.0, 0.10
LABELS = {"all_zero": -1, "near_constant": -2, "zero_heavy": -3, "other": -99}


def _series():
    return Window.partitionBy(ID).orderBy(DAY)


def _before():
    return _series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _after():
    return _series().rowsBetween(Window.currentRow, Window.unboundedFollowing)


def _all():
    return Window.partitionBy(ID)


def impute(panel: DataFrame, strategy: str = "interpolate") -> DataFrame:
    """Missing readings filled within each household; series without any reading stay missing.

    forward_fill: the last reading, else the next.  interpolate: on the line
    between the neighbouring readings by position, past the last one constant,
    before the first one its value.  mean: the household's mean.  Dropping is
    not allowed, because series must keep their length.
    """
    v = F.col(V)
    if strategy == "forward_fill":
        new = F.coalesce(F.last(v, True).over(_before()), F.first(v, True).over(_after()))
    elif strategy == "mean":
        new = F.coalesce(v, F.avg(v).over(_all()))
    elif strategy == "interpolate":
        panel = panel.withColumn("_i", F.row_number().over(_series()))
        at = F.when(v.isNotNull(), F.col("_i"))
        panel = panel.select(
            "*",
            F.last(v, True).over(_before()).alias("_v0"),
            F.last(at, True).over(_before()).alias("_i0"),
            F.first(v, True).over(_after()).alias("_v1"),
            F.first(at, True).over(_after()).alias("_i1"),
        )
        line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
        new = F.coalesce(v, line, "_v0", "_v1")
    elif strategy == "drop":
        raise PanelError("dropping missing readings would change the length of series")
    else:
        raise PanelError(f"unknown strategy {strategy!r}")
    return panel.withColumn(V, new).drop("_i", "_v0", "_i0", "_v1", "_i1")


def fix_negatives(panel: DataFrame, action: str = "set_zero") -> DataFrame:
    """Negative readings set to 0, made positive, or removed and interpolated."""
    v = F.col(V)
    if action == "set_zero":
        return panel.withColumn(V, F.when(v < 0, 0.0).otherwise(v))
    if action == "abs":
        return panel.withColumn(V, F.abs(v))
    if action == "remove":
        return impute(panel.withColumn(V, F.when(v >= 0, v)), "interpolate")
    raise PanelError(f"unknown action {action!r}")


def z_rows(panel: DataFrame) -> DataFrame:
    """Readings standardised by household with the population deviation; 0 in constant series."""
    mean, std = F.avg(V).over(_all()), F.stddev_pop(V).over(_all())
    return panel.withColumn(V, F.when(F.col(V).isNull(), None).when(std < CONSTANT, 0.0).otherwise((F.col(V) - mean) / (std + CONSTANT)))


def normalise(panel: DataFrame, method: str = "standard", by: str = ID) -> DataFrame:
    """Standard or min-max scaled readings by household, or by day (`by="date"`).

    The days' statistics are one row a day: they are aggregated first and
    broadcast, since a panel has few days and any number of households.
    """
    if method not in ("standard", "minmax"):
        raise PanelError(f"unknown method {method!r}")
    low, size = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
    if by == DAY:
        days = panel.groupBy(DAY).agg(low(V).alias("_low"), size(V).alias("_size"))
        return panel.join(F.broadcast(days), DAY).withColumn(V, (F.col(V) - F.col("_low")) / (F.col("_size") + CONSTANT)).select(*panel.columns)
    group = Window.partitionBy(by)
    width = size(V).over(group) if method == "standard" else F.max(V).over(group) - F.min(V).over(group)
    return panel.withColumn(V, (F.col(V) - low(V).over(group)) / (width + CONSTANT))


def transform(panel: DataFrame, method: str = "none") -> DataFrame:
    """Readings as they are, or log(1 + max(reading, 0))."""
    if method == "none":
        return panel
    if method == "log1p":
        return panel.withColumn(V, F.when(F.col(V).isNotNull(), F.log1p(F.greatest(F.col(V), F.lit(0.0)))))
    raise PanelError(f"unknown transform {method!r}")


def cleaning_summary(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: missing, negative and zero readings before and after, by one aggregate over both."""
    v = F.col(V)
    each = original.select(F.lit("before").alias("side"), v).unionByName(cleaned.select(F.lit("after").alias("side"), v))
    counts = [
        F.count_if(cond & (F.col("side") == side)).alias(f"{name}_{side}")
        for name, cond in (("missing", v.isNull()), ("negative", F.coalesce(v < 0, F.lit(False))), ("zero", F.coalesce(v == 0, F.lit(False))))
        for side in ("before", "after")
    ]
    return each.agg(*counts)


def regime_block(zero_heavy_pct: float = ZERO_HEAVY_PCT, near_constant_std: float = NEAR_CONSTANT_STD) -> Block:
    """Deviation, zero days and regime as a block."""

    def aggregates():
        v = F.col(V)
        return {"_mass": F.coalesce(F.sum(F.abs(v)), F.lit(0.0)), "_std": F.stddev_samp(v), "_zero_days": F.count_if(v == 0), "_zero_pct": 100.0 * F.count_if(v == 0) / F.count("*")}

    def outputs():
        all_zero = F.col("_mass") <= 1e-12
        constant = ~all_zero & F.coalesce(F.col("_std") <= near_constant_std, F.lit(False))
        heavy = ~all_zero & ~constant & (F.col("_zero_pct") >= zero_heavy_pct)
        label = F.when(all_zero, "all_zero").when(constant, "near_constant").when(heavy, "zero_heavy").otherwise("regular")
        flags = {"all_zero_flag": all_zero, "near_constant_flag": constant, "zero_heavy_flag": heavy, "regime_label": label, "degenerate_flag": label != "regular"}
        return flags | {n: F.col(f"_{n}") for n in ("std", "zero_days", "zero_pct")}

    return Block(aggregates, outputs)


def regime_flags(panel: DataFrame, zero_heavy_pct: float = ZERO_HEAVY_PCT, near_constant_std: float = NEAR_CONSTANT_STD) -> DataFrame:
    """Deviation, zero days and the regime of each household: all zero, nearly constant, mostly zero or regular.

    The share of zero days counts all calendar days, missing ones included.
    """
    return compute(panel, regime_block(zero_heavy_pct, near_constant_std))


def excluded(flags: DataFrame, exclude_zero_heavy: bool = True) -> DataFrame:
    """Flags of the households that clustering leaves out."""
    out = F.col("all_zero_flag") | F.col("near_constant_flag")
    return flags.filter(out | F.col("zero_heavy_flag") if exclude_zero_heavy else out)


def split_regular(panel: DataFrame, flags: DataFrame, exclude_zero_heavy: bool = True) -> tuple[DataFrame, DataFrame]:
    """The regular and the excluded part of a panel."""
    out = excluded(flags, exclude_zero_heavy).select(ID)
    return panel.join(out, ID, "left_anti"), panel.join(out, ID, "left_semi")


def split_ids(panel: DataFrame) -> DataFrame:
    """household_id, part: main or special."""
    return regime_flags(panel).select(ID, F.when(F.col("degenerate_flag"), "special").otherwise("main").alias("part"))
