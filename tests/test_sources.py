"""Snapshots, damaged files, builders and hooks."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from tessera.operators import snapshots
from tessera.plans import builder
from tessera.sources import files

DAY = [dt.datetime(2024, 1, d) for d in range(1, 9)]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, None, DAY[0], ["a"]), (2, 1, DAY[1], ["a", "b"]), (3, 2, DAY[2], ["b", "c"]), (4, 2, DAY[3], ["a", "d"])]
    return spark.createDataFrame(rows, "snapshot_id long, parent_id long, timestamp timestamp, files array<string>")


def test_snapshots(log):
    assert snapshots.at(log, dt.datetime(2024, 1, 2, 12)).first().snapshot_id == 2 and snapshots.at(log, dt.datetime(2020, 1, 1)).count() == 0
    assert [r.snapshot_id for r in snapshots.ancestry(log, 4).orderBy("depth").collect()] == [2, 1] and snapshots.ancestry(log, 1).count() == 0
    assert snapshots.common_ancestor(log, 3, 4) == 2 and snapshots.common_ancestor(log, 1, 4) is None
    d = snapshots.diff(log, 2, 3).first()
    assert (d.added, d.removed) == (["c"], ["a"])
    gone = snapshots.expired(log, DAY[3], current=2, keep=1)
    assert {r.snapshot_id for r in gone.collect()} == {1, 3} and [r.file for r in snapshots.orphans(log, gone).collect()] == ["c"]


def test_damaged_files_are_skipped_and_named(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(10).coalesce(1).write.parquet(str(path))
    (path / "bad.parquet").write_bytes(b"not parquet")
    rows, skipped = files.read_tolerant(spark, str(path), T.StructType([T.StructField("id", T.LongType())]))
    assert rows.count() == 10 and [r.path.rsplit("/", 1)[1] for r in skipped.collect()] == ["bad.parquet"]
    (tmp_path / "rows.json").write_text('[{"id": 1}, {"id": 2}]')
    assert files.read_json_rows(spark, str(tmp_path / "rows.json"), "id long").count() == 2


def test_builders(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "_id int, k string")
    q = builder.Query().where("_id").gte(2).lt(8).where("k", "a").select("_id").sort("-_id").limit(2)
    assert [r._id for r in q.run(df).collect()] == [6, 4]
    out = builder.Stages().match({"_id": {"$gt": 3}}).sort_by_count("$k").limit(1).run(df)
    assert out.first()["count"] == 3
    with pytest.raises(ValueError):
        builder.Query().gt(1)


def test_hooks():
    h = builder.soft_delete()
    assert h.apply("find", {"a": 1}) == {"$and": [{"deletedAt": {"$exists": False}}, {"a": 1}]} and h.apply("aggregate", [])[0]["$match"]
    t = builder.timestamps(now=lambda: DAY[0])
    assert t.apply("update", {"$inc": {"n": 1}}) == {"$inc": {"n": 1}, "$set": {"updatedAt": DAY[0]}} and t.apply("insert", [{"a": 1}])[0]["createdAt"] == DAY[0]
