"""Tables written once in the folder that driver and executors share, which cuts their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    A folder set by `SparkContext.setCheckpointDir` counts too.  Where there is
    none, one machine (a local master, as in tests) gets a temporary folder; a
    cluster gets an error, for its executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_by_code.get() if set_by_code.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts the lineage with files that survive lost executors; they go when the
    driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that `cut` wrote and nobody reads again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def ranked(df: DataFrame, into: str, *order: Column | str) -> DataFrame:
    """`df` with its row number, from 1, over all rows in `order`, which no one task sorts.

    Ranges are sorted and counted side by side; only a count for each range
    reaches the driver.
    """
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(into, F.monotonically_increasing_id()))
    place, number = F.shiftright(into, 33), F.col(into).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(sorted_.groupBy(place.alias("_range")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["_range"], before))
        before += r["n"]
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range long, _before long"))
    return sorted_.join(known, place == F.col("_range")).withColumn(into, F.col("_before") + number + 1).drop("_range", "_before")
