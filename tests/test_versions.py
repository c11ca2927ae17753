"""Change logs, collections, search, schemas and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo
from tessera.operators import schema, search, versioned
from tessera.plans.pipeline import find
from tessera.sources.collection import Database
from tessera.sources.scratch import with_rank
from tessera.streaming import changes


@pytest.fixture(scope="module")
def log(spark):
    rows = [("a", 1, "i", 1, None), ("a", 5, "u", 2, "x"), ("a", 3, "u", 9, None), ("b", 2, "i", 1, None), ("b", 4, "d", None, None), ("c", 6, "d", None, None), ("c", 7, "i", 3, "y"), ("d", 8, "u", 4, None), ("d", 8, "u", 5, None)]
    return spark.createDataFrame(rows, "_id string, _seq long, _op string, v int, w string").cache()


def test_newest_row_wins(log):
    assert {(r._id, r.v) for r in versioned.latest(log, tiebreak=("v",)).collect()} == {("a", 2), ("c", 3), ("d", 5)}
    assert {(r._id, r.v) for r in versioned.latest(log.where("v <> 4 OR v IS NULL"), unique=True).collect()} == {("a", 2), ("c", 3), ("d", 5)}
    assert {(r._id, r.v) for r in versioned.as_of(log, seq=3).collect()} == {("a", 9), ("b", 1)}
    again = versioned.latest(versioned.compact(log, whole=False, tiebreak=("v",)))
    assert {(r._id, r.v) for r in again.collect()} == {("a", 2), ("c", 3), ("d", 5)}
    assert versioned.compact(log, whole=False).where("_op = 'd'").count() == 1 and versioned.latest(log.limit(0)).count() == 0
    s = versioned.dedup_stats(log).first()
    assert (s.input_rows, s["keys"], s.duplicates, s.deleted, s.output_rows) == (9, 4, 5, 1, 3)
    assert versioned.dedup_stats(log.limit(0)).first().input_rows == 0


def test_events_of_a_log(log):
    got = {(r.document_key, r.token): r for r in versioned.changes(log.where("_id <> 'd'")).collect()}
    assert got["a", 5].updated_fields == ["v", "w"] and got["a", 3].updated_fields == ["v"] and got["b", 4].operation_type == "delete" and got["c", 7].full_document_before_change is None
    assert versioned.changes(log, after_seq=6).count() == 3


def test_diff_and_merge(spark):
    make = lambda rows: spark.createDataFrame(rows, "_id int, x int, y int")
    base = make([(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, None)])
    main = make([(1, 10, 1), (2, 2, 20), (4, 4, None), (6, 6, 6)])
    branch = make([(1, 1, 11), (2, 2, 22), (3, 33, 3), (5, 5, 5), (6, 7, 7)])
    got = {r._id: (r.change, r.changed_fields) for r in versioned.diff(base, branch).collect()}
    assert got == {1: ("update", ["y"]), 2: ("update", ["y"]), 3: ("update", ["x"]), 4: ("delete", []), 5: ("insert", []), 6: ("insert", [])}
    kinds = {r._id: (r.type, r.severity) for r in versioned.conflicts(versioned.diff(base, main), versioned.diff(base, branch)).collect()}
    assert kinds == {2: ("FIELD_CONFLICT", "low"), 3: ("DELETE_UPDATE", "medium"), 6: ("DUPLICATE_INSERT", "high")}
    ours = {r._id: (r.x, r.y) for r in versioned.three_way_merge(base, main, branch).collect()}
    assert ours == {1: (10, 11), 2: (2, 20), 5: (5, 5), 6: (6, 6)}
    theirs = {r._id: (r.x, r.y) for r in versioned.three_way_merge(base, main, branch, strategy="theirs").collect()}
    assert theirs == {1: (10, 11), 2: (2, 22), 3: (33, 3), 5: (5, 5), 6: (7, 7)}
    assert versioned.diff(base, base).count() == 0
    view = versioned.overlay(base, spark.createDataFrame([(1, "d", None, None), (9, "i", 9, 9)], "_id int, _op string, x int, y int"))
    assert {r._id for r in view.collect()} == {2, 3, 4, 9}


def test_collection(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    c = db["people"]
    assert c.find().count() == 0 and db.list_collections() == []
    c.insert_many([{"_id": "1", "n": 1, "t": "a"}, {"_id": "2", "n": 2, "t": "b"}, {"n": 3, "t": "a"}], "_id string, n int, t string")
    assert c.count_documents({"t": "a"}) == 2 and db.list_collections() == ["people"]
    assert c.update({"t": "a"}, {"$inc": {"n": 10}}) == 2 and sorted(r.n for r in c.find().collect()) == [2, 11, 13]
    assert c.delete({"_id": "2"}) == 1 and c.count_documents() == 2 and c.estimated_document_count() == 6
    assert sorted(r.n for r in c.scan(as_of_seq=1).collect()) == [1, 2, 3]
    assert c.update({"_id": "9"}, {"$set": {"n": 7}, "$setOnInsert": {"t": "z"}}, upsert=True) == 0 and c.find_one({"_id": "9"})["t"] == "z"
    assert c.replace_one({"_id": "9"}, {"n": 8, "t": "q"}) == 1 and c.find_one({"_id": "9"}) == {"_id": "9", "n": 8, "t": "q"}
    assert c.find_one_and_update({"_id": "9"}, {"$set": {"n": 0}}, return_new=True)["n"] == 0 and c.find_one_and_delete({"_id": "9"})["n"] == 0
    assert [r.n for r in c.aggregate([{"$sort": {"n": -1}}, {"$limit": 1}]).collect()] == [13]
    c.aggregate([{"$match": {"n": 13}}, {"$out": "other"}])
    assert db["other"].count_documents() == 1
    c.aggregate([{"$project": {"n": {"$add": ["$n", 1]}}}, {"$merge": {"into": "other", "whenMatched": "merge", "whenNotMatched": "discard"}}])
    assert [(r.n, r.t) for r in db["other"].find().collect()] == [(14, "a")]
    c.compact()
    assert c.estimated_document_count() == 2 == len(list(c.iterate()))


def test_search(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox", "animals"), (2, "Brown dogs and a quick nap", None), (3, "Nothing here", "fox fox")], "_id int, title string, body string")
    ids = lambda q, f=("title", "body"): [r._id for r in search.search(docs, "_id", list(f), q).collect()]
    assert set(ids("fox")) == {1, 3} and ids("fox")[0] == 3 and ids("quick -dogs") == [1] and set(ids('"brown quick"')) == {1, 2} and ids("the of") == [] and ids("-fox") == []
    one = search.search(docs, "_id", {"title": 2.0}, "nothing").first()
    import math

    assert math.isclose(one.score, 1 / 2 * (math.log(4 / 2) + 1) * 2)


def test_geo(spark):
    pts = spark.createDataFrame([(1, (13.4, 52.5)), (2, (2.35, 48.85)), (3, None)], "_id int, p struct<lng:double, lat:double>")
    near = geo.near(pts, "p", [13.4, 52.5], max_distance=1_000_000).collect()
    assert [r._id for r in near] == [1, 2] and abs(near[1].distance - 877_000) < 5_000
    hole = {"type": "Polygon", "coordinates": [[[0, 40], [20, 40], [20, 60], [0, 60]], [[10, 50], [15, 50], [15, 55], [10, 55]]]}
    assert [r._id for r in find(pts, {"p": {"$geoWithin": {"$geometry": hole}}}).collect()] == [2]
    assert [r._id for r in find(pts, {"p": {"$geoWithin": {"$centerSphere": [[13.4, 52.5], 0.01]}}}).collect()] == [1]
    assert [r._id for r in find(pts, {"p": {"$geoIntersects": {"$geometry": {"type": "Point", "coordinates": [2.35, 48.85]}}}}).collect()] == [2]


def test_schemas(spark):
    docs = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2.5, "b": {"c": null}}',), ('{"a": "s", "l": [1]}',), ("not json",)], "js string")
    got = {r.path: r for r in schema.profile(docs, "js").collect()}
    assert got["a"]["count"] == 3 and got["a"].dominant == "number" and got["a"].types == ["number", "string"] and got["b.c"].nulls == 1 and got["l"].dominant == "array" and abs(got["b"].frequency - 2 / 3) < 1e-9
    assert [r.path for r in schema.suggest_promotions(schema.profile(docs, "js"), "aggressive").collect()] == []
    old, new = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]), T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.StringType(), False)])
    assert schema.compare(old, new) == [("a", "widened", False), ("b", "removed", True), ("c", "added", True)]
    with pytest.raises(ValueError):
        schema.evolve(spark.createDataFrame([("x",)], "a string"), new)
    df = spark.createDataFrame([("ab", -1), (None, 5)], "s string, n int")
    rules = {"required": ["s"], "properties": {"s": {"type": "string", "minLength": 3}, "n": {"type": "number", "minimum": 0, "maximum": 4}}}
    assert [len(r.e) for r in df.select(schema.validation_errors(df, rules).alias("e")).collect()] == [2, 2]


def test_rank_without_one_big_task(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(8)
    assert all(r.v + 1 == r.k for r in with_rank(df, "k", F.col("v")).collect())


def test_streams(spark, tmp_path):
    fields = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("w", T.StringType())])
    path, ck = str(tmp_path / "log"), str(tmp_path / "ck")
    write = lambda rows: spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(path)

    def drain():
        q = changes.update_descriptions(changes.watch(spark, path, fields).select(*fields.fieldNames())).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()

    write([("a", 1, "i", 1, "x"), ("a", 2, "u", 2, "x"), ("b", 3, "i", 1, None)])
    drain()
    write([("a", 4, "u", 2, None), ("b", 5, "d", None, None)])
    drain()
    got = {(r._id, r._seq): (r.operation_type, r.updated_fields, r.removed_fields) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): ("insert", [], []), ("a", 2): ("update", ["v"], []), ("b", 3): ("insert", [], []), ("a", 4): ("update", [], ["w"]), ("b", 5): ("delete", [], [])}
    merged = {}
    step = changes.merge_batches(lambda: merged.get("t"), lambda df: merged.__setitem__("t", spark.createDataFrame(df.collect(), df.schema)))
    q = changes.watch(spark, path, fields, {"v": {"$gte": 1}}).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r._id, r.v) for r in merged["t"].collect()} == {("a", 2), ("b", 1)}
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "k")], "ts timestamp, k string")
    assert changes.windowed_counts(events, "ts", "k").first().n == 1
