"""Where the panel queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.maths import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, keys: str = "", doubles: str = "", sql: str | None = None, digits: int = 6):
    """Register a query that returns the `keys` as they are and the `doubles` rounded.

    `sql` gives the same columns unrounded; both sides are rounded alike here.
    """

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*keys.split(), *[rounded(F.col(c).cast("double"), digits).alias(c) for c in doubles.split()])

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            half = 0.5 * 10**-digits
            columns = [*keys.split(), *[f"CASE WHEN abs({c}) < {half:.12f} THEN 0.0 ELSE round(CAST({c} AS DOUBLE), {digits}) END AS {c}" for c in doubles.split()]]
            SQL[name] = f"SELECT {', '.join(columns)} FROM (\n{sql.strip()}\n) AS q"
        return f

    return register
