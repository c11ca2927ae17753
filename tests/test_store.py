"""Writers, generations, snapshots, branches, searches and shapes on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.fields import Fields
from tessera.functions.updates import upsert_document
from tessera.operators import search, snapshots, versioned
from tessera.plans.builder import Hooks, Stop
from tessera.plans.pipeline import aggregate, find
from tessera.plans.validation import InvalidQuery
from tessera.sources.branches import Branches
from tessera.sources.collection import Database
from tessera.sources.folders import Folder


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def ids(df):
    return sorted(r._id for r in df.collect())


def test_only_one_writer_gets_a_number(db):
    c = db["t"]
    first = c._reserve()
    assert not (c.folder / "_numbers" / f"{first:020d}").create({}) and c._reserve() == first + 1
    file = Folder(db.spark, f"{db.root}/x.json")
    file.replace({"a": 1})
    file.replace({"a": 2})
    assert file.read() == {"a": 2} and (Folder(db.spark, f"{db.root}/none")).read() is None


def test_repeated_keys_in_one_call(db):
    c = db["t"]
    c.insert_many([{"_id": "k", "v": v} for v in range(40)], "_id string, v int")
    assert c.find_one({"_id": "k"})["v"] == 39 and c.count_documents() == 1 and c.estimated_document_count() == 40


def test_a_write_without_success_is_not_seen(db):
    c = db["t"]
    c.insert_many([{"_id": "a", "v": 1}], "_id string, v int")
    number = c._reserve()
    path = f"{c._generation().path}/write-{number:020d}"
    c.log().withColumn("v", F.lit(9)).write.parquet(path)
    Folder(db.spark, f"{path}/_SUCCESS").delete()
    assert c.find_one({"_id": "a"})["v"] == 1


def test_compaction_and_out_switch_generations(db):
    c = db["t"]
    c.insert_many([{"_id": str(i), "v": i} for i in range(5)], "_id string, v int")
    c.update({}, {"$inc": {"v": 10}})
    c.delete({"_id": "0"})
    before = c.find()
    c.compact()
    assert ids(before) == ids(c.find()) == ["1", "2", "3", "4"]  # frames of the generation before still read
    c.update({"_id": "1"}, {"$set": {"v": 0}})
    c.compact()
    assert c.estimated_document_count() == 4 and len(c.folder.names(folders=True)) == 2
    c.aggregate([{"$match": {"v": {"$gt": 11}}}, {"$out": "t"}])
    assert ids(c.find()) == ["2", "3", "4"]


def test_merge_stage_options(db):
    a, b = db["a"], db["b"]
    a.insert_many([{"_id": "1", "v": 1}, {"_id": "2", "v": 2}], "_id string, v int")
    b.insert_many([{"_id": "2", "v": 0, "w": "x"}], "_id string, v int, w string")
    a.aggregate([{"$merge": {"into": "b", "whenMatched": "replace", "whenNotMatched": "insert"}}])
    assert {(r._id, r.v, r.w) for r in b.find().collect()} == {("1", 1, None), ("2", 2, None)}
    assert [n for n, _ in b.writes()] == [1, 2]
    with pytest.raises(InvalidQuery):
        a.aggregate([{"$merge": {"into": "b", "whenMatched": "fail"}}])
    with pytest.raises(InvalidQuery):
        a.aggregate([{"$merge": {"into": "empty", "whenNotMatched": "fail"}}])


def test_cursor(db):
    c = db["t"]
    c.insert_many([{"_id": i, "v": i % 3} for i in range(10)], "_id int, v int")
    cursor = c.cursor({"v": {"$lt": 2}}, batch_size=3).sort({"_id": -1}).skip(1).limit(5).project({"_id": 1})
    assert [len(b) for b in cursor.batches()] == [3, 2] and not cursor.has_next() and cursor.next() is None
    with pytest.raises(RuntimeError):
        cursor.limit(1)
    seen = []
    cursor.rewind().for_each(lambda d: seen.append(d["_id"]) or len(seen) < 2)
    assert seen == [7, 6] and cursor.count() == 5
    cursor.close()
    assert cursor.to_list() == [] and cursor.closed


def test_text_indexes(db):
    c = db["t"]
    c.insert_many([{"_id": 1, "t": "quick fox", "u": "slow dog"}, {"_id": 2, "t": "a slow fox", "u": None}], "_id int, t string, u string")
    with pytest.raises(InvalidQuery):
        c.search("fox")
    with pytest.raises(ValueError):
        c.find({"$text": {"$search": "fox"}})
    c.create_index({"t": "text", "u": "text"}, weights={"t": 3})
    stored = [(r._id, round(r.score, 9)) for r in c.search("fox slow").collect()]
    fresh = [(r._id, round(r.score, 9)) for r in search.search(c.scan(), "_id", {"t": 3.0, "u": 1.0}, "fox slow").collect()]
    assert stored == fresh and {i for i, _ in stored} == {1, 2}
    assert ids(c.find({"$text": {"$search": "slow -dog"}})) == [2] and ids(c.aggregate([{"$match": {"$or": [{"$text": {"$search": "quick"}}, {"_id": 2}]}}])) == [1, 2]
    c.insert_many([{"_id": 3, "t": "fox fox"}], "_id int, t string")
    assert {r._id for r in c.search("fox").collect()} == {1, 2, 3}  # the stored postings are older than the newest write
    with pytest.raises(InvalidQuery):
        c.drop_index("none")
    with pytest.raises(InvalidQuery):
        c.create_index({"t": "bogus"})


def test_postings_are_counted_within_rows(spark):
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(20000))  # not a pass over the text for each word
    docs = spark.createDataFrame([(1, "dog fox Fox the fox", "fox"), (2, None, ""), (3, "the a", "cat"), (4, long, None)], "_id int, t string, u string")
    found = search.postings(docs, "_id", {"t": 3, "u": 1})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # a task held all the words of its documents
    got = {(r.key, r.term): (r.tf, r.weight, r.length) for r in found.collect()}
    assert len(got) == 1003 and all(got[4, f"w{i}"] == (20, 3.0, 20000) for i in range(1000))
    assert {k: v for k, v in got.items() if k[0] != 4} == {(1, "dog"): (1, 3.0, 5), (1, "fox"): (4, 2.0, 5), (3, "cat"): (1, 1.0, 1)}
    some = search.postings(docs, "_id", ["t"], case=True, wanted={"Fox", "dog"})
    assert {(r.key, r.term, r.tf, r.length) for r in some.collect()} == {(1, "Fox", 1, 4), (1, "dog", 1, 4)}


def test_unique_index(db):
    c = db["t"]
    c.insert_many([{"_id": 1, "v": 1}, {"_id": 2, "v": 1}], "_id int, v int")
    with pytest.raises(InvalidQuery):
        c.create_index("v", unique=True)


def test_indexes_in_step_with_a_list(db):
    c = db["t"]
    c.insert_many([{"_id": 1, "v": 1, "t": "x y"}], "_id int, v int, t string")
    c.create_index("v")
    assert c.sync_indexes([{"t": "text"}, "_id"]) == (["t_text", "_id_1"], ["v_1"]) and c.sync_indexes([{"t": "text"}, "_id"]) == ([], [])
    assert [i["name"] for i in c.list_indexes()] == ["_id_", "_id_1", "t_text"]


def test_the_file_of_the_kept_row(spark, tmp_path):
    for name, v in (("a", 1), ("b", 2)):
        spark.createDataFrame([("k", v, "i", v)], "_id string, _seq long, _op string, v int").coalesce(1).write.parquet(str(tmp_path / name))
    log = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b"))
    assert "/b/" in versioned.dedup(log, source="file").first().file and "/a/" in versioned.dedup(log, ascending=False, source="file").first().file


def test_hooks_stop_and_see(db):
    seen = []
    db.hooks.also(Hooks().add("find", lambda q: seen.append(q)).add("delete", lambda q, c: (_ for _ in ()).throw(Stop(-1)), with_collection=True))
    c = db["t"]
    c.insert_many([{"_id": 1}], "_id int")
    assert c.delete({"_id": 1}) == -1 and c.count_documents({"_id": 1}) == 1 and seen == [{"_id": 1}]


def test_upsert_documents():
    now = dt.datetime(2024, 1, 1)
    update = {"$setOnInsert": {"s": 1}, "$mul": {"m": 3, "s": 5}, "$rename": {"old": "new"}, "$currentDate": {"at": True}, "$max": {"s": 2}, "$push": {"l": {"$each": [1, 2]}}, "$unset": {"gone": ""}}
    made = upsert_document({"$and": [{"_id": 1}, {"old": {"$eq": "x"}}], "gone": 1, "in": {"$in": [4]}, "n": {"$gt": 3}}, update, now)
    assert made == {"_id": 1, "new": "x", "in": 4, "s": 5, "m": 0, "at": now, "l": [1, 2]}


def test_changes_required_before(spark):
    log = spark.createDataFrame([("a", 1, "i", 1), ("a", 2, "r", 2), ("b", 3, "u", 1)], "_id string, _seq long, _op string, v int")
    kinds = {r.token: (r.operation_type, r.full_document is not None, r.full_document_before_change is not None) for r in versioned.changes(log, full_document="default", before_change="off").collect()}
    assert kinds == {1: ("insert", True, False), 2: ("replace", True, False), 3: ("update", False, False)}
    with pytest.raises(Exception, match="no row before"):
        versioned.changes(log, before_change="required").collect()
    with pytest.raises(ValueError):
        versioned.changes(log, full_document="bogus")


def test_manual_merges_need_every_resolution(spark):
    make = lambda rows: spark.createDataFrame(rows, "_id int, x int")
    base, main, branch = make([(1, 1), (2, 2), (3, 3)]), make([(1, 10), (2, 20), (3, 30)]), make([(1, 11), (2, 21), (3, 31)])
    take = spark.createDataFrame([(1, "ours"), (2, "theirs"), (3, "base")], "_id int, take string")
    assert {(r._id, r.x) for r in versioned.three_way_merge(base, main, branch, strategy="manual", resolutions=take).collect()} == {(1, 10), (2, 21), (3, 3)}
    for some in (None, take.where("_id < 3")):
        with pytest.raises(ValueError):
            versioned.three_way_merge(base, main, branch, strategy="manual", resolutions=some)


def test_nested_branches(db):
    db["t"].insert_many([{"_id": i, "v": i} for i in range(4)], "_id int, v int")
    b = Branches(db)
    b.create("one")
    b.checkout("one")["t"].update({"_id": 1}, {"$set": {"v": 100}})
    b.create("two", "one")
    b.checkout("one")["t"].update({"_id": 2}, {"$set": {"v": 200}})
    b.checkout("two")["t"].delete({"_id": 3})
    assert {(r._id, r.v) for r in b.checkout("two")["t"].find().collect()} == {(0, 0), (1, 100), (2, 2)}
    assert b.merge("two") == {"t": 1}
    assert {(r._id, r.v) for r in b.checkout("one")["t"].find().collect()} == {(0, 0), (1, 100), (2, 200)}
    with pytest.raises(InvalidQuery):
        b.delete("one")
    with pytest.raises(InvalidQuery):
        b.create("one")
    assert b.merge_many(["one"]) == {"one": {"t": 3}} and ids(db["t"].find()) == [0, 1, 2]


def test_snapshot_files(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / name))
    log = spark.createDataFrame([], "snapshot_id long, parent_id long, timestamp timestamp, files array<string>")
    log = snapshots.commit(log, [str(tmp_path / "a")], dt.datetime(2024, 1, 1))
    log = snapshots.commit(log, [str(tmp_path / "b")], dt.datetime(2024, 1, 2), removed=[str(tmp_path / "a")])
    assert snapshots.scan(log, 1).count() == 3 and snapshots.scan(log, 2).count() == 2
    changed = snapshots.changes_since(log, 1, 2).groupBy("_change").count().collect()
    assert {(r._change, r["count"]) for r in changed} == {("insert", 2), ("delete", 3)}
    assert snapshots.changes_since(log, 1, 1).count() == 0
    with pytest.raises(ValueError):
        snapshots.scan(log, 9)


def test_stored_polygons(spark):
    square = lambda x, y, r: [[float(x + a * r), float(y + b * r)] for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    shapes = {"inside": [square(0, 0, 1)], "around": [square(0, 0, 50)], "crossing": [square(10, 0, 2)], "apart": [square(30, 30, 2)], "ring": [square(0, 0, 50), square(0, 0, 20)], "hole_edge": [square(0, 0, 50), square(0, 0, 5)]}
    df = spark.createDataFrame([(k, ("Polygon", v)) for k, v in shapes.items()], "_id string, area struct<type:string, coordinates:array<array<array<double>>>>")
    meets = lambda g: ids(find(df, {"area": {"$geoIntersects": {"$geometry": g}}}))
    assert meets({"type": "Polygon", "coordinates": [square(0, 0, 10)]}) == ["around", "crossing", "hole_edge", "inside"]
    assert meets({"type": "Point", "coordinates": [30.5, 30.5]}) == ["apart", "around", "hole_edge", "ring"]
    assert meets({"type": "LineString", "coordinates": [[-100, 0], [-30, 0]]}) == ["around", "hole_edge", "ring"]
    with pytest.raises(ValueError):
        find(spark.createDataFrame([(1, [1.0, 2.0])], "_id int, p array<double>"), {"p": {"$nearSphere": [200, 0]}})
    far = geo.near(spark.createDataFrame([(1, [500.0, 2.0]), (2, [1.0, 2.0])], "_id int, p array<double>"), "p", [1, 2])
    assert ids(far) == [2]


def test_first_and_last_under_mixed_directions(spark):
    rows = [(i, [None, "ab", "a", "abc", "é"][i % 5], [None, 1.5, -2.0][i % 3], i) for i in range(30)]
    df = spark.createDataFrame(rows, "_id int, s string, d double, v int")
    for sort in ({"s": 1, "d": -1, "_id": 1}, {"s": -1, "d": 1, "_id": -1}, {"d": -1, "s": 1, "_id": -1}):
        plain = aggregate(df, [{"$sort": sort}])
        want = [r.v for r in plain.collect()]
        got = aggregate(df, [{"$sort": sort}, {"$group": {"_id": None, "a": {"$first": "$v"}, "z": {"$last": "$v"}}}]).first()
        assert (got.a, got.z) == (want[0], want[-1]), sort


def test_types_in_variants(spark):
    df = spark.createDataFrame([(1, '{"n": 5, "l": [{"a": 1}, {"a": 9}]}'), (2, '{"n": 5000000000, "l": [3, 4]}'), (3, '{"n": 1.5}')], "_id int, j string").withColumn("doc", F.parse_json("j"))
    ask = lambda q: ids(find(df, q, variant="doc"))
    assert ask({"n": {"$type": "int"}}) == [1] and ask({"n": {"$type": "long"}}) == [2] and ask({"n": {"$type": "number"}}) == [1, 2, 3]
    assert ask({"l": {"$elemMatch": {"a": {"$gt": 5}}}}) == [1] and ask({"l": {"$elemMatch": {"$gt": 3}}}) == [2]
    assert Fields(df, "doc").in_variant("n") and find(df, {"_id": {"$type": "int"}}).count() == 3 and find(df, {"_id": {"$type": "long"}}).count() == 0
