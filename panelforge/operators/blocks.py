"""Blocks of household columns that are computed together.

A block names what it needs of each day (lags, positions, standardised
readings, rolling deviations), its aggregates and its output columns.
`compute` merges any number of blocks: the panel is windowed once and
aggregated once by household, so their cost is one exchange, whatever the
number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.maths import CONSTANT

ID, DAY, V, Z = "household_id", "date", "consumption", "_z"
DAYS_OF_WEEK = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@dataclass(frozen=True)
class Block:
    """Needs by day, aggregates by name and outputs by name; the last two are made when a session is at hand."""

    aggregates: Callable[[], dict[str, Column]]
    outputs: Callable[[], dict[str, Column]]
    needs: tuple[str, ...] = ()


def series() -> Window:
    """A household's days in order."""
    return Window.partitionBy(ID).orderBy(DAY)


def days(panel: DataFrame, needs: set[str]) -> DataFrame:
    """The panel with the needed columns: lag_k, zlag_k, t (place from 0), _z (standardised), std_k (of k full days).

    All windows share one partitioning and order.
    """
    whole = Window.partitionBy(ID)
    if any(n == Z or n.startswith("zlag_") for n in needs):
        mean, std = F.avg(V).over(whole), F.stddev_pop(V).over(whole)
        panel = panel.withColumn(Z, F.when(F.col(V).isNull(), None).when(std < CONSTANT, 0.0).otherwise((F.col(V) - mean) / (std + CONSTANT)))
    out = {}
    for need in sorted(needs - {Z}):
        kind, _, k = need.partition("_")
        if kind == "lag":
            out[need] = F.lag(V, int(k)).over(series())
        elif kind == "zlag":
            out[need] = F.lag(Z, int(k)).over(series())
        elif kind == "std":
            frame = series().rowsBetween(-(int(k) - 1), 0)
            out[need] = F.when(F.count(V).over(frame) == int(k), F.stddev_samp(V).over(frame))
        else:
            out[need] = (F.row_number().over(series()) - 1).cast("double")
    return panel.select("*", *[c.alias(n) for n, c in out.items()]) if out else panel


def compute(panel: DataFrame, *blocks: Block) -> DataFrame:
    """household_id and the outputs of all blocks, in their order."""
    rows = days(panel, {n for b in blocks for n in b.needs})
    aggregates = {n: c for b in blocks for n, c in b.aggregates().items()}
    outputs = {n: c for b in blocks for n, c in b.outputs().items()}
    done = rows.groupBy(ID).agg(*[c.alias(n) for n, c in aggregates.items()])
    return done.select(ID, *[c.alias(n) for n, c in outputs.items()])


def month_aggregates(value: str = V, prefix: str = "_m_") -> dict[str, Column]:
    return {prefix + n: F.avg(F.when(F.month(DAY) == i, F.col(value))) for i, n in enumerate(MONTHS, 1)}


def weekday_aggregates(value: str = V, prefix: str = "_d_") -> dict[str, Column]:
    return {prefix + n: F.avg(F.when(F.weekday(DAY) == i, F.col(value))) for i, n in enumerate(DAYS_OF_WEEK)}


def month_columns(prefix: str = "_m_") -> list[Column]:
    return [F.col(prefix + n) for n in MONTHS]


def weekday_columns(prefix: str = "_d_") -> list[Column]:
    return [F.col(prefix + n) for n in DAYS_OF_WEEK]
