"""Probes and copies, generated from few rows, are never broadcast."""

from pyspark.sql import functions as F

from panelforge.llm import simhash
from test_scale import broadcast_generators


def test_no_probe_is_broadcast(spark):
    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    fps = fps.unionByName(fps.limit(20).select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp")))
    links = simhash.near_links(fps)
    assert broadcast_generators(links) == 0 and links.count() == 20
    assert broadcast_generators(simhash.near_links(fps, bucket_limit=0)) == 0
