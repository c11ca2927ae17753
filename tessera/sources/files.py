"""Scans that tolerate damaged files, and older layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of the readable Parquet files under a path, and a frame (path, length) of the files that were skipped.

    A Parquet file begins and ends with the same four bytes, and gives its footer's length before the last four. A file that keeps to that counts as sound, with
    rows or without.
    """
    rows = spark.read.option("ignoreCorruptFiles", True).schema(schema).parquet(path)
    read = rows.select(F.col("_metadata.file_path").alias("_read")).distinct()
    name = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    silent = listed.load(path).select("path", "length").join(read, name(F.col("path")) == name(F.col("_read")), "left_anti")
    # Only files that gave no row are looked into, by name; the driver has listed all names anyway.
    paths = [r.path for r in silent.select("path").collect()]
    if not paths:
        return rows, silent
    files = listed.load(paths)
    byte = lambda back: F.conv(F.hex(F.substring("content", F.col("length").cast("int") - back, F.lit(1))), 16, 10).cast("long")
    footer = byte(7) + byte(6) * 256 + byte(5) * 65_536 + byte(4) * 16_777_216
    magic = F.lit(bytearray(b"PAR1"))
    ends = (F.substring("content", 1, 4) == magic) & (F.substring("content", F.col("length").cast("int") - 3, F.lit(4)) == magic)
    sound = (F.col("length") >= 12) & ends & (footer <= F.col("length") - 12)
    return rows, files.where(~F.coalesce(sound, F.lit(False))).select("path", "length")


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one JSON array of rows each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
