"""Durable intermediate tables, and a global rank that no single task computes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names one. A local session without one gets a temporary folder; on a cluster
    a folder of one machine would not do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """df written to the scratch folder and read again; the file system deletes it when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    df.write.parquet(f"{path}/table")
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def with_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the column `name`: each row's place, from 1, in the order given; rows of equal order stand in any one order.

    Rows are dealt by range, ranked within each part, and moved on by the sizes of the parts before: only
    one number per part comes together. A second, random key spreads a very common value over several parts; the table is
    written before anything reads it, so a lost executor doesn't draw it anew.
    """
    spread = materialize(df.withColumn("_spread", F.rand()))
    by = [*order, F.col("_spread")]
    parts = materialize(spread.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before", "_spread")
