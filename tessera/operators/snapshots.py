"""Snapshots of a table as a small log: (snapshot_id, parent_id, timestamp, files).

The log is metadata, a row for each commit. Walks along parents are joins of one level at a time, which stop at the first snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ANCESTORS = 10_000


def at(log: DataFrame, timestamp: object) -> DataFrame:
    """The newest snapshot not after a time: one row or none."""
    return log.where(F.col("timestamp") <= F.lit(timestamp)).orderBy(F.desc("timestamp"), F.desc("snapshot_id")).limit(1)


def _one(log: DataFrame, snapshot_id: int):
    row = log.where(F.col("snapshot_id") == snapshot_id).first()
    if row is None:
        raise ValueError(f"no snapshot {snapshot_id}")
    return row


def _newest(log: DataFrame):
    return log.orderBy(F.desc("timestamp"), F.desc("snapshot_id")).first()


def _added(log: DataFrame, files: list[str], timestamp: object, parent: int | None) -> DataFrame:
    top = log.agg(F.max("snapshot_id")).first()[0] or 0
    row = log.sparkSession.createDataFrame([(top + 1, parent, timestamp, files)], log.schema)
    return log.unionByName(row)


def commit(log: DataFrame, files: list[str], timestamp: object, replace: bool = False, removed: list[str] = ()) -> DataFrame:
    """The log with a new snapshot: the newest one's files without those removed (none of them, with `replace`), and the new ones."""
    last = _newest(log)
    kept = [] if replace or last is None else [f for f in last.files if f not in set(removed)]
    return _added(log, [*kept, *files], timestamp, last.snapshot_id if last else None)


def rollback(log: DataFrame, snapshot_id: int, timestamp: object) -> DataFrame:
    """The log with a new snapshot that has the files of an older one, and it as parent."""
    return _added(log, list(_one(log, snapshot_id).files), timestamp, snapshot_id)


def cherry_pick(log: DataFrame, snapshot_id: int, timestamp: object) -> DataFrame:
    """The log with a new snapshot: the newest one, with what the picked one added to and took from its parent."""
    picked, last = _one(log, snapshot_id), _newest(log)
    before = set(_one(log, picked.parent_id).files) if picked.parent_id is not None else set()
    gone = before - set(picked.files)
    new = [f for f in picked.files if f not in before and f not in last.files]
    return _added(log, [*(f for f in last.files if f not in gone), *new], timestamp, last.snapshot_id)


def scan(log: DataFrame, snapshot_id: int, schema=None) -> DataFrame:
    """The rows of a snapshot's Parquet files; file names are metadata, so the list passes through the driver."""
    spark, files = log.sparkSession, list(_one(log, snapshot_id).files)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*files)


def changes_since(log: DataFrame, old: int, new: int, schema=None) -> DataFrame:
    """Rows of the files added between two snapshots, with `_change` insert, and of those removed, with delete."""
    a, b = list(_one(log, old).files), list(_one(log, new).files)
    out = None
    for files, change in (([f for f in b if f not in set(a)], "insert"), ([f for f in a if f not in set(b)], "delete")):
        if files:
            reader = log.sparkSession.read.schema(schema) if schema is not None else log.sparkSession.read
            rows = reader.parquet(*files).withColumn("_change", F.lit(change))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return scan(log, new, schema).limit(0).withColumn("_change", F.lit("insert")) if out is None else out


def ancestry(log: DataFrame, snapshot_id: int) -> DataFrame:
    """(snapshot_id, depth) of the snapshots before one, itself left out, nearest first."""
    spark = log.sparkSession
    parents = {r.snapshot_id: r.parent_id for r in log.select("snapshot_id", "parent_id").limit(MAX_ANCESTORS + 1).collect()}
    if len(parents) > MAX_ANCESTORS:
        raise ValueError(f"more than {MAX_ANCESTORS} snapshots; expire some first")
    out, now = [], parents.get(snapshot_id)
    while now is not None and now in parents and all(now != s for s, _ in out):
        out.append((now, len(out) + 1))
        now = parents[now]
    return spark.createDataFrame(out, "snapshot_id long, depth int")


def common_ancestor(log: DataFrame, a: int, b: int) -> int | None:
    """The nearest snapshot before both."""
    both = ancestry(log, a).join(ancestry(log, b).withColumnRenamed("depth", "other"), "snapshot_id").orderBy(F.col("depth") + F.col("other"), F.desc("snapshot_id")).first()
    return both.snapshot_id if both else None


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """One row with the files added and removed between two snapshots."""
    a = log.where(F.col("snapshot_id") == old).select(F.col("files").alias("a"))
    b = log.where(F.col("snapshot_id") == new).select(F.col("files").alias("b"))
    return a.crossJoin(b).select(F.array_sort(F.array_except("b", "a")).alias("added"), F.array_sort(F.array_except("a", "b")).alias("removed"))


def expired(log: DataFrame, older_than: object, current: int, keep: int = 1, most: int | None = None) -> DataFrame:
    """Snapshots that may go: older than a time, or not among the `most` newest if that is given; never the current one, and not among the `keep` newest."""
    newest = lambda n: log.orderBy(F.desc("timestamp"), F.desc("snapshot_id")).limit(n).select("snapshot_id")
    old = log.where(F.col("timestamp") < F.lit(older_than))
    if most is not None:
        old = old.unionByName(log.join(newest(most), "snapshot_id", "left_anti")).dropDuplicates(["snapshot_id"])
    return old.where(F.col("snapshot_id") != current).join(newest(keep), "snapshot_id", "left_anti")


def orphans(log: DataFrame, gone: DataFrame) -> DataFrame:
    """Files that only the snapshots to go refer to."""
    kept = log.join(gone.select("snapshot_id"), "snapshot_id", "left_anti").select(F.explode("files").alias("file"))
    return gone.select(F.explode("files").alias("file")).distinct().join(kept, "file", "left_anti")
