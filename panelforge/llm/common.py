"""Helpers shared by the operators: tables, lineage cuts, Arrow maps."""

from __future__ import annotations

import gc
import sys
import time
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.storage import cut, drop_cut, shared_dir  # noqa: F401  the operators take them from here

#: White space of the word contracts: space and \t \n \v \f \r, as `bytes.split()` takes it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of jobs that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which a driver
    with little to do may not do for long.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def fresh(df: DataFrame, name: str, *others: str) -> str:
    """A column name that neither `df` nor `others` hold."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name in taken:
        name += "_"
    return name


#: A key that holds more than this fraction of the rows is hot; there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
#: Keys of fewer rows are never hot.
HOT_ROWS = 500


def hot_keys(counted: DataFrame, total: int, *on: str, n: str = "n") -> DataFrame | None:
    """The keys `on` of `counted` that hold over `HOT_SHARE` of `total` rows, None if there are none.

    There are 1,000 at most, whatever the data, so they may pass the driver.
    """
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = counted.filter(F.col(n) > least).select(*on).collect() if total > least else []
    return counted.sparkSession.createDataFrame(hot, counted.select(*on).schema) if hot else None


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner", large: bool = False) -> DataFrame:
    """`left.join(right, on, how)` with the rows of `hot` keys dealt over as many tasks as there are partitions.

    `hot` is bounded (`hot_keys`) and broadcast; the rows of `right` with such
    a key, few for each, go to all of these tasks.  With `large` neither side
    is broadcast: Spark takes generated rows (probes, copies) to be as few as
    what they come from.
    """
    if hot is None:
        return left.join(right.hint("merge") if large else right, on, how)
    salts, salt, flag = partitions(left.sparkSession), fresh(left, "salt", *right.columns), fresh(left, "hot", *right.columns)
    known = F.broadcast(hot.withColumn(flag, F.lit(True)))
    whole = F.array(F.lit(0))
    dealt = left.join(known, on, "left").withColumn(salt, F.when(F.col(flag), F.floor(F.rand(1) * salts).cast("int")).otherwise(0)).drop(flag)
    copied = right.join(known, on, "left").withColumn(salt, F.explode(F.when(F.col(flag), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(whole))).drop(flag)
    return dealt.join(copied.hint("merge") if large else copied, [*on, salt], how).drop(salt)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the number of salts for hot keys."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the text's UTF-8 bytes (null stays null), with other columns by name."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("raw"),
        *[F.col(c) for c in columns],
    )


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]],
    schema: str,
) -> DataFrame:
    """`mapInArrow` of a function that `make()` builds once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    """A record batch from named pyarrow arrays."""
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def per_process(name: str, build: Callable[[], object]):
    """A value that lives as long as this Python worker and is built once in it."""
    keep = sys.modules.setdefault("_panelforge_keep", types.ModuleType("_panelforge_keep"))
    if not hasattr(keep, name):
        setattr(keep, name, build())
    return getattr(keep, name)


def decoded(raw) -> str:
    """The text of UTF-8 bytes; null is empty and broken bytes become U+FFFD."""
    return "" if raw is None else bytes(raw).decode("utf-8", "replace")
