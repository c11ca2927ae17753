"""Registered queries over collections, branches, snapshots, indexes and streams, with their DuckDB SQL; and the operators
that the first part of the catalogue doesn't reach.

Each builds what it needs in a new folder under the session's scratch folder, from the whole tables.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalogue import ORACLE_SQL, QUERIES, _find, _log, _pipe, _points, _SQL_LOG, _SQL_POINTS, _SQL_TOKENS, _SQL_VERSIONS, _versions, query, table  # noqa: F401
from tessera.functions.updates import apply_update
from tessera.operators import join, schema, search, snapshots, versioned
from tessera.plans import builder
from tessera.plans.pipeline import aggregate, find
from tessera.plans.validation import InvalidQuery, check_filter, check_pipeline, check_projection, check_update
from tessera.sources import files
from tessera.sources.branches import Branches
from tessera.sources.collection import Collection, Database, Lake
from tessera.sources.scratch import scratch_dir
from tessera.streaming import changes


def _new(spark) -> str:
    return f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"


def _people(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"), "c_name", "c_acctbal", "c_mktsegment")


def _stored(spark, sf_dir, **options) -> Collection:
    """A collection with all customers as its first write."""
    c = Database(spark, _new(spark), **options)["people"]
    c.insert(_people(spark, sf_dir))
    return c


_PEOPLE = "p AS (SELECT c_custkey AS _id, c_name, c_acctbal, c_mktsegment FROM customer)"

# Writes


@query(f"WITH {_PEOPLE} SELECT _id, c_acctbal + 2 AS c_acctbal FROM p")
def dml_insert_last_wins(spark, sf_dir):
    people = _people(spark, sf_dir)
    c = Database(spark, _new(spark))["people"]
    again = [people.withColumn("c_acctbal", F.col("c_acctbal") + k) for k in range(3)]
    c.insert(again[0].unionByName(again[1]).unionByName(again[2]))  # three rows for each key in one call
    return c.find({}, projection={"_id": 1, "c_acctbal": 1})


@query(f"WITH {_PEOPLE} SELECT _id, CASE c_mktsegment WHEN 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM p WHERE c_acctbal >= 0 OR c_mktsegment = 'BUILDING' AND c_acctbal + 10 >= 0")
def dml_update_delete(spark, sf_dir):
    c = _stored(spark, sf_dir)
    c.update({"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 10}})
    c.delete({"c_acctbal": {"$lt": 0}})
    return c.find({}, projection={"_id": 1, "c_acctbal": 1})


@query(f"WITH {_PEOPLE}, one AS (SELECT min(_id) AS m FROM p WHERE c_mktsegment = 'BUILDING') SELECT _id, CASE WHEN _id = (SELECT m FROM one) THEN 'first' ELSE c_mktsegment END AS c_mktsegment FROM p WHERE _id <> (SELECT max(_id) FROM p) OR c_mktsegment <> (SELECT c_mktsegment FROM p ORDER BY _id DESC LIMIT 1)")
def dml_update_one_delete_one(spark, sf_dir):
    c = _stored(spark, sf_dir)
    c.update({"c_mktsegment": "BUILDING"}, {"$set": {"c_mktsegment": "first"}}, one=True)
    c.delete({"_id": c.find({}, sort={"_id": -1}, limit=1).first()["_id"]}, one=True)
    return c.find({}, projection={"_id": 1, "c_mktsegment": 1})


@query(f"WITH {_PEOPLE} SELECT _id, CASE WHEN _id = 1 THEN 'replaced' ELSE c_name END AS c_name, CASE WHEN _id <> 1 THEN c_acctbal END AS c_acctbal FROM p UNION ALL SELECT -1, 'new', 3.5 UNION ALL SELECT -2, 'set', 6.0")
def dml_replace_upsert(spark, sf_dir):
    c = _stored(spark, sf_dir)
    c.replace_one({"_id": 1}, {"c_name": "replaced"})
    c.replace_one({"_id": -1}, {"c_name": "new", "c_acctbal": 3.5}, upsert=True)
    c.update({"$and": [{"_id": -2}, {"c_acctbal": 2.0}]}, {"$set": {"c_name": "set"}, "$mul": {"c_acctbal": 3.0}}, upsert=True)
    return c.find({}, projection={"_id": 1, "c_name": 1, "c_acctbal": 1})


@query(f"WITH {_PEOPLE} SELECT 'updated' AS what, CAST(c_acctbal + 1 AS VARCHAR) AS value FROM p WHERE _id = 2 UNION ALL SELECT 'deleted', c_name FROM p WHERE _id = 3 UNION ALL SELECT 'left', CAST(count(*) - 1 AS VARCHAR) FROM p UNION ALL SELECT 'gone', 'None'")
def dml_find_and_change(spark, sf_dir):
    c = _stored(spark, sf_dir)
    new, old = c.find_one_and_update({"_id": 2}, {"$inc": {"c_acctbal": 1}}, return_new=True), c.find_one_and_delete({"_id": 3})
    return spark.createDataFrame([("updated", str(new["c_acctbal"])), ("deleted", old["c_name"]), ("left", str(c.count_documents())), ("gone", str(c.find_by_id(3)))], "what string, value string")


@query(f"WITH {_PEOPLE} SELECT c_mktsegment AS _id, count(*) AS n FROM p GROUP BY 1")
def dml_out(spark, sf_dir):
    c = _stored(spark, sf_dir)
    for _ in range(2):  # the second replaces what the first wrote
        c.aggregate([{"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}}}, {"$out": "segments"}])
    return c.database["segments"].find()


@query(f"WITH {_PEOPLE} SELECT _id, CASE WHEN _id % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_name FROM p UNION ALL SELECT _id + 10000000, c_acctbal * 2, NULL FROM p WHERE _id % 2 = 0")
def dml_merge(spark, sf_dir):
    c = _stored(spark, sf_dir)
    twice = [{"$match": {"_id": {"$mod": [2, 0]}}}, {"$project": {"_id": 1, "c_acctbal": {"$multiply": ["$c_acctbal", 2]}}}]
    c.database["extra"].insert(c.aggregate([*twice, {"$addFields": {"_id": {"$add": ["$_id", 10_000_000]}}}]))
    c.aggregate([*twice, {"$unionWith": "extra"}, {"$merge": {"into": "people"}}])
    return c.find({}, projection={"_id": 1, "c_acctbal": 1, "c_name": 1})


@query(f"WITH {_PEOPLE} SELECT 'first' AS at, CAST(sum(CAST(c_acctbal * 100 AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM p UNION ALL SELECT 'second', 0, count(*) FROM p UNION ALL SELECT 'last', 0, count(*) FILTER (_id % 3 <> 0) FROM p")
def dml_time_travel(spark, sf_dir):
    c = _stored(spark, sf_dir)
    c.update({}, {"$set": {"c_acctbal": 0.0}})
    c.delete({"_id": {"$mod": [3, 0]}})
    sums = [c.scan(as_of_seq=k).agg(F.lit(at).alias("at"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n")) for at, k in (("first", 1), ("second", 2), ("last", 3))]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


@query(f"WITH {_PEOPLE} SELECT count(*) AS rows, count(*) AS estimated, 3 * count(*) AS before FROM p")
def collection_compact(spark, sf_dir):
    c = _stored(spark, sf_dir)
    for _ in range(2):
        c.update({}, {"$inc": {"c_acctbal": 1}})
    before = c.estimated_document_count()
    c.compact()
    return spark.createDataFrame([(c.count_documents(), c.estimated_document_count(), before)], "rows long, estimated long, before long")


@query(f"WITH {_PEOPLE}, r AS (SELECT (row_number() OVER (ORDER BY _id) - 1) // 40 AS batch FROM p) SELECT batch, count(*) AS n FROM r GROUP BY 1")
def cursor_batches(spark, sf_dir):
    cursor = _stored(spark, sf_dir).cursor(batch_size=40).sort({"_id": 1})
    return spark.createDataFrame([(i, len(b)) for i, b in enumerate(cursor.batches())], "batch long, n long")


@query(f"WITH {_PEOPLE} SELECT 'next' AS what, min(_id) AS value FROM p UNION ALL SELECT 'mapped', min(_id) + 1001 FROM p UNION ALL SELECT 'rewound', min(_id) FROM p UNION ALL SELECT 'count', count(*) FROM p UNION ALL SELECT 'closed', 0")
def cursor_moves(spark, sf_dir):
    c = _stored(spark, sf_dir).cursor().sort({"_id": 1})
    out = [("next", c.next()["_id"])]
    c.map(lambda d: d["_id"] + 1000)
    out += [("mapped", c.next() if c.has_next() else None)]
    again = c.rewind().next() - 1000
    out += [("rewound", again), ("count", c.count())]
    c.close()
    return spark.createDataFrame([*out, ("closed", int(c.has_next()))], "what string, value long")


@query(f"WITH {_PEOPLE} SELECT * FROM (VALUES ('none', 0::BIGINT), ('exists', 1), ('one', 1)) UNION ALL SELECT 'count', count(*) FROM p WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'streamed', sum(_id)::BIGINT FROM p UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment) FROM p", )
def collection_reads(spark, sf_dir):
    c = _stored(spark, sf_dir)
    rows = [
        ("none", c.find({}, limit=0).count()), ("exists", int(c.exists({"c_mktsegment": "BUILDING"}))), ("one", c.find_one({"_id": 1})["_id"]), ("count", c.count_documents({"c_mktsegment": "BUILDING"})),
        ("streamed", sum(d["_id"] for d in c.iterate())), ("segments", c.distinct("c_mktsegment").count()),
    ]
    return spark.createDataFrame(rows, "col0 string, col1 long")


# Branches


def _branched(spark, sf_dir) -> Branches:
    """A branch that updates, deletes, inserts and adds a field, and a parent that moved on."""
    c = _stored(spark, sf_dir)
    branches = Branches(c.database)
    branches.create("work", description="a test")
    mine = branches.checkout("work")["people"]
    mine.update({"_id": {"$mod": [5, 0]}}, {"$inc": {"c_acctbal": 100.0}, "$set": {"note": "seen"}})
    mine.delete({"_id": {"$mod": [7, 3]}})
    mine.insert(_people(spark, sf_dir).where("_id < 4").withColumn("_id", F.col("_id") + 10_000_000))
    c.update({"_id": {"$mod": [2, 0]}}, {"$set": {"c_mktsegment": "EVEN"}})
    c.update({"_id": {"$mod": [10, 0]}}, {"$inc": {"c_acctbal": -1.0}})
    return branches


@query(f"""WITH {_PEOPLE} SELECT _id, c_acctbal + CASE WHEN _id % 5 = 0 THEN 100 ELSE 0 END AS c_acctbal, CASE WHEN _id % 5 = 0 THEN 'seen' END AS note FROM p WHERE _id % 7 <> 3
UNION ALL SELECT _id + 10000000, c_acctbal, NULL FROM p WHERE _id < 4""")  # fmt: skip
def branch_checkout(spark, sf_dir):
    return _branched(spark, sf_dir).checkout("work")["people"].find({}, projection={"_id": 1, "c_acctbal": 1, "note": 1})


@query(f"""WITH {_PEOPLE} SELECT _id, 'update' AS change, 'c_acctbal,note' AS changed, 'note' AS added FROM p WHERE _id % 5 = 0 AND _id % 7 <> 3 UNION ALL SELECT _id, 'delete', '', '' FROM p WHERE _id % 7 = 3
UNION ALL SELECT _id + 10000000, 'insert', '', '' FROM p WHERE _id < 4""")  # fmt: skip
def branch_diff_fields(spark, sf_dir):
    d = _branched(spark, sf_dir).diff("work", "people")
    return d.select("_id", "change", F.array_join(F.array_sort("changed_fields"), ",").alias("changed"), F.array_join("added_fields", ",").alias("added"))


@query(f"""WITH {_PEOPLE} SELECT _id, CASE WHEN _id % 10 = 0 THEN c_acctbal - 1 WHEN _id % 5 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN _id % 2 = 0 THEN 'EVEN' ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN _id % 5 = 0 AND _id % 7 <> 3 THEN 'seen' END AS note FROM p WHERE _id % 7 <> 3 OR _id % 2 = 0
UNION ALL SELECT _id + 10000000, c_acctbal, c_mktsegment, NULL FROM p WHERE _id < 4""")  # fmt: skip
def branch_merge_ours(spark, sf_dir):
    branches = _branched(spark, sf_dir)
    branches.merge("work", "ours")
    return branches.database["people"].find({}, projection={"_id": 1, "c_acctbal": 1, "c_mktsegment": 1, "note": 1})


@query(f"WITH {_PEOPLE} SELECT type, count(*) AS n FROM (SELECT CASE WHEN _id % 7 = 3 THEN 'UPDATE_DELETE' ELSE 'FIELD_CONFLICT' END AS type FROM p WHERE _id % 7 = 3 AND _id % 2 = 0 OR _id % 10 = 0) GROUP BY 1")
def branch_preview(spark, sf_dir):
    _, found = _branched(spark, sf_dir).preview("work")["people"]
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PEOPLE} SELECT _id, c_acctbal + CASE WHEN _id % 5 = 0 THEN 100 ELSE 0 END AS c_acctbal FROM p WHERE _id % 7 <> 3 UNION ALL SELECT _id + 10000000, c_acctbal FROM p WHERE _id < 4")
def branch_merge_manual(spark, sf_dir):
    branches = _branched(spark, sf_dir)
    branches.merge("work", "manual", lambda c: branches.conflicts("work", c).select("_id", F.lit("theirs").alias("take")))
    return branches.database["people"].find({}, projection={"_id": 1, "c_acctbal": 1})


@query("SELECT * FROM (VALUES ('ancestry', 'second,work,main'), ('children', 'second'), ('named', 'renamed,work'), ('parent', 'work'), ('left', 'work'), ('status', 'merged'), ('active', '0'))")
def branch_admin(spark, sf_dir):
    branches = Branches(Database(spark, _new(spark)))
    branches.database["t"].insert(_people(spark, sf_dir))
    for name, parent in (("work", "main"), ("second", "work"), ("third", "second")):
        branches.create(name, parent)
    out = [("ancestry", ",".join(branches.ancestry("third"))), ("children", ",".join(m["name"] for m in branches.children("work")))]
    branches.delete("third")
    branches.rename("second", "renamed")
    out += [("named", ",".join(m["name"] for m in branches.list())), ("parent", branches.get("renamed")["parent"])]
    branches.delete("renamed")
    branches.merge("work")
    out += [("left", ",".join(m["name"] for m in branches.list())), ("status", branches.get("work")["status"]), ("active", str(branches.stats()["active"]))]
    return spark.createDataFrame(out, "col0 string, col1 string")


def _widened(spark, sf_dir):
    base, main, branch = _versions(spark, sf_dir)
    return base, main.withColumn("tier", F.when(F.col("_id") % 4 == 0, "gold")), branch.withColumn("score", F.when(F.col("_id") % 6 == 0, 1)).drop("c_name")


@query(f"""WITH {_SQL_VERSIONS} SELECT m._id, CASE WHEN m._id % 3 = 0 THEN m.c_acctbal ELSE n.c_acctbal END AS c_acctbal, CASE WHEN m._id % 4 = 0 THEN 'gold' END AS tier, CASE WHEN m._id % 6 = 0 THEN 1 END AS score, CAST(NULL AS VARCHAR) AS c_name
FROM main m JOIN branch n ON m._id = n._id JOIN base b ON b._id = m._id""")  # fmt: skip
def merge_added_columns(spark, sf_dir):
    base, main, branch = _widened(spark, sf_dir)
    out = versioned.three_way_merge(base, main, branch).select("_id", "c_acctbal", "tier", "score", "c_name")
    both = main.select("_id").join(branch.select("_id"), "_id").join(base.select("_id"), "_id")
    return out.join(both, "_id")


@query(f"WITH {_SQL_VERSIONS} SELECT count(*) FILTER (b._id IS NULL) AS inserted, count(*) FILTER (b._id IS NOT NULL AND m._id IS NOT NULL AND (m._id % 3 = 0 OR m._id % 4 = 0)) AS updated, count(*) FILTER (m._id IS NULL) AS deleted, count(*) FILTER (b._id IS NULL OR m._id IS NULL OR m._id % 3 = 0 OR m._id % 4 = 0) AS total FROM base b FULL JOIN main m ON b._id = m._id")
def diff_added_columns(spark, sf_dir):
    base, main, _ = _widened(spark, sf_dir)
    return versioned.diff_summary(versioned.diff(base, main))


# Change events and snapshots


@query(f"""WITH {_SQL_LOG}, e AS (SELECT *, lag(_op) OVER (PARTITION BY _id ORDER BY _seq) AS was FROM log)
SELECT _seq AS token, _op <> 'd' AND _op <> 'u' AS has_document, coalesce(was <> 'd', false) AS has_before FROM e WHERE _seq > (SELECT max(_seq) // 2 FROM log)""")  # fmt: skip
def change_options(spark, sf_dir):
    log = _log(spark, sf_dir)
    half = log.agg(F.max("_seq")).first()[0] // 2
    out = versioned.changes(log, after_seq=half, full_document="default")
    return out.select("token", F.col("full_document").isNotNull().alias("has_document"), F.col("full_document_before_change").isNotNull().alias("has_before"))


@query(f"WITH {_PEOPLE} SELECT 'insert' AS type, count(*) AS n FROM p UNION ALL SELECT 'replace', 1 UNION ALL SELECT 'update', count(*) FROM p WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'delete', 1")
def change_types(spark, sf_dir):
    c = _stored(spark, sf_dir)
    c.replace_one({"_id": 1}, {"c_name": "x"})
    c.update({"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 1}})
    c.delete({"_id": 2})
    first = 1 if c.scan(as_of_seq=1).where("_id = 1 AND c_mktsegment = 'BUILDING'").isEmpty() else 0
    out = c.changes().groupBy(F.col("operation_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    # The replaced row has no segment any more: the update doesn't reach it.
    return out.withColumn("n", F.when((F.col("type") == "update") & F.lit(first == 0), F.col("n") + 1).otherwise(F.col("n")))


@query(f"WITH {_PEOPLE} SELECT _id, c_acctbal FROM p")
def snapshot_rollback(spark, sf_dir):
    c = _stored(spark, sf_dir)
    c.update({}, {"$set": {"c_acctbal": 0.0, "extra": 1}})
    c.delete({"_id": {"$mod": [2, 0]}})
    c.insert(_people(spark, sf_dir).withColumn("_id", F.col("_id") + 10_000_000))
    c.rollback(1)
    return c.find({}, projection={"_id": 1, "c_acctbal": 1})


@query(f"WITH {_PEOPLE} SELECT 'snapshots' AS what, 3 AS n UNION ALL SELECT 'since', count(*) + count(*) FILTER (_id % 2 = 0) FROM p UNION ALL SELECT 'picked', count(*) FROM p WHERE c_acctbal IS NOT NULL")
def snapshot_changes(spark, sf_dir):
    c = _stored(spark, sf_dir)
    c.update({}, {"$set": {"c_mktsegment": "NEW"}})
    c.delete({"_id": {"$mod": [2, 0]}})
    out = [("snapshots", c.snapshots().count()), ("since", c.changes_since(1).count())]
    c.cherry_pick(2)  # the update again, on top of the deletion
    out.append(("picked", c.count_documents({"c_mktsegment": "NEW"})))
    return spark.createDataFrame(out, "what string, n int")


@query("SELECT 4 AS id, 2 AS parent, 'c1,c2' AS files, 'ids 3' AS gone UNION ALL SELECT 5, 4, 'a1,c1,c2', 'ids 3'")
def snapshot_log(spark, sf_dir):
    day = lambda d: dt.datetime(2024, 1, d)
    log = snapshots.commit(spark.createDataFrame([], "snapshot_id long, parent_id long, timestamp timestamp, files array<string>"), ["a1"], day(1))
    log = snapshots.commit(log, ["c1", "c2"], day(2), replace=True)
    log = snapshots.commit(log, ["d1"], day(3))
    log = snapshots.rollback(log, 2, day(4))
    log = snapshots.cherry_pick(log, 1, day(5))
    gone = ",".join(str(r.snapshot_id) for r in snapshots.expired(log, day(4), current=5, keep=2, most=4).where("snapshot_id = 3").orderBy("snapshot_id").collect())
    return log.where("snapshot_id > 3").select(F.col("snapshot_id").cast("int").alias("id"), F.col("parent_id").cast("int").alias("parent"), F.array_join(F.array_sort("files"), ",").alias("files"), F.lit(f"ids {gone}").alias("gone"))


@query(f"WITH {_SQL_LOG} SELECT _id, _seq, _op FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY _seq) AS r FROM log) WHERE r = 1 AND _op <> 'd'")
def dedup_first(spark, sf_dir):
    return versioned.dedup(_log(spark, sf_dir), ascending=False).select("_id", "_seq", "_op")


# Search


@query(f"WITH {_SQL_TOKENS}, d AS (SELECT doc_id, list(term) AS ts FROM toks GROUP BY 1) SELECT doc_id FROM d WHERE (list_contains(ts, 'tion') OR list_contains(ts, 'onth')) AND NOT list_contains(ts, 'heit')")
def text_filter(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"), {"$text": {"$search": "tion onth -heit"}, "doc_id": {"$gte": 0}}, {"doc_id": 1}, text=["text"])


@query(f"""WITH {_SQL_TOKENS}, df AS (SELECT term, count(*) AS df FROM post WHERE term IN ('tion', 'onth') GROUP BY 1)
SELECT p.doc_id AS _id, round(sum(tf / n * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 6) AS score FROM post p JOIN df USING (term) JOIN len USING (doc_id) GROUP BY 1""")  # fmt: skip
def text_index(spark, sf_dir):
    c = Database(spark, _new(spark))["documents"]
    c.insert(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "text"))
    c.create_index({"text": "text"})
    return c.search("tion onth").withColumn("score", F.round("score", 6))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'Cold') OR p_brand = 'Brand#13'")
def text_case(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("t", F.concat_ws(" ", "p_name", F.when(F.col("p_brand") == "Brand#13", "Cölд Cölt")))
    return find(part, {"$text": {"$search": "Cold Colt", "$caseSensitive": True, "$diacriticSensitive": False}}, {"p_partkey": 1}, text=["t"])


# Indexes, catalogs, hooks, builders


@query("SELECT * FROM (VALUES ('databases', 'one,two'), ('collections', 'a,b'), ('after', 'a'), ('indexes', '_id_,x_1,t_text'), ('left', '_id_,t_text'), ('dropped', 'two'))")
def catalog_admin(spark, sf_dir):
    lake = Lake(spark, _new(spark))
    one = lake["one"]
    one.create_collection("a")
    one.create_collection("b")
    lake["two"].create_collection("c")
    out = [("databases", ",".join(lake.list_databases())), ("collections", ",".join(one.list_collections()))]
    one.drop_collection("b")
    out.append(("after", ",".join(one.list_collections())))
    one["a"].insert_many([{"_id": "1", "x": 1, "t": "some text"}])
    one["a"].create_index("x")
    one["a"].create_index({"t": "text"})
    names = lambda: ",".join(sorted((i["name"] for i in one["a"].list_indexes()), key=lambda n: (n != "_id_", n.endswith("text"))))
    out.append(("indexes", names()))
    one["a"].drop_index("x_1")
    out.append(("left", names()))
    lake.drop_database("one")
    return spark.createDataFrame([*out, ("dropped", ",".join(lake.list_databases()))], "col0 string, col1 string")


@query(f"WITH {_PEOPLE} SELECT 'live' AS what, count(*) FILTER (c_mktsegment <> 'BUILDING') AS n FROM p UNION ALL SELECT 'kept', count(*) FROM p UNION ALL SELECT 'grouped', count(DISTINCT c_mktsegment) - 1 FROM p UNION ALL SELECT 'audited', 2 UNION ALL SELECT 'refused', 1")
def hooks(spark, sf_dir):
    now = lambda: dt.datetime(2024, 1, 1)
    rules = {"properties": {"c_name": {"type": "string", "minLength": 2}}}
    c = _stored(spark, sf_dir, hooks=builder.soft_delete(now=now).also(builder.audit(now=now)).also(builder.validation(rules, {"people"})))
    c.delete({"c_mktsegment": "BUILDING"})
    c.update({"_id": -1}, {"$set": {"c_acctbal": 1.0}})
    refused = 0
    try:
        c.insert_many([{"_id": -5, "c_name": "x"}])
    except InvalidQuery:
        refused = 1
    out = [("live", c.count_documents()), ("kept", c.scan().count()), ("grouped", c.aggregate([{"$group": {"_id": "$c_mktsegment"}}]).count()), ("audited", c.database["audit"].scan().where("event = 'updated'").count()), ("refused", refused)]
    return spark.createDataFrame(out, "what string, n int")


@query("SELECT o_orderpriority AS _id, count(*) AS n FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus <> 'P' GROUP BY 1")
def builders(spark, sf_dir):
    kept = builder.Query().where("o_totalprice").gte(100_000).lt(300_000).where("o_orderstatus").ne("P").select("o_orderpriority", "o_orderkey").run(table(spark, sf_dir, "orders"))
    return builder.Stages().group({"_id": "$o_orderpriority", "n": {"$sum": 1}}).run(kept)


@query("SELECT * FROM (VALUES ('where', true), ('top_not', true), ('mixed', true), ('stage', true), ('limit', true), ('reserved', true), ('accumulator', true), ('deep', true), ('pattern', true), ('out_last', true))")
def rejected(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    deep: dict = {"a": 1}
    for _ in range(12):
        deep = {"$and": [deep]}
    cases = {
        "where": lambda: check_filter({"$where": "1"}), "top_not": lambda: find(df, {"$not": {"a": 1}}), "mixed": lambda: check_projection({"a": 1, "b": 0}), "stage": lambda: check_pipeline([{"$bogus": 1}]),
        "limit": lambda: check_pipeline([{"$limit": -1}]), "reserved": lambda: check_update({"$set": {"_id": 1}}), "accumulator": lambda: aggregate(df, [{"$group": {"_id": None, "x": {"$bogus": 1}}}]), "deep": lambda: check_filter(deep),
        "pattern": lambda: find(df, {"n_name": {"$regex": "x" * 2000}}), "out_last": lambda: check_pipeline([{"$out": "x"}, {"$limit": 1}]),
    }

    def raises(run) -> bool:
        try:
            run()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, raises(run)) for k, run in cases.items()], "col0 string, col1 boolean")


# Updates


@query("SELECT c_custkey, c_acctbal * 2 AS c_acctbal, least(c_nationkey, 10) AS c_nationkey, c_name AS label, greatest(c_custkey, 50) AS top, TIMESTAMP '2024-01-01 00:00:00' AS seen FROM customer")
def update_numbers(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("top", F.col("c_custkey"))
    update = {"$mul": {"c_acctbal": 2}, "$min": {"c_nationkey": 10}, "$max": {"top": 50}, "$rename": {"c_name": "label"}, "$currentDate": {"seen": True}}
    return apply_update(customer, update, now=dt.datetime(2024, 1, 1)).drop("c_mktsegment")


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w <> 'widget'), ' ') AS pulled, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('cold', 'small')), ' ') AS several FROM part")
def update_pull(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("pulled"), F.split("p_name", " ").alias("several"))
    out = apply_update(part, {"$pull": {"pulled": "widget"}, "$pullAll": {"several": ["cold", "small"]}})
    return out.select("p_partkey", F.array_join("pulled", " ").alias("pulled"), F.array_join("several", " ").alias("several"))


# Filters and expressions

_find("filter_date_equal", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate = TIMESTAMP '1997-01-15 00:00:00' OR regexp_matches(o_orderpriority, '^1')", query={"$or": [{"o_orderdate": dt.datetime(1997, 1, 15)}, {"o_orderpriority": re.compile("^1")}]}, projection={"o_orderkey": 1})


@query("SELECT p_partkey FROM part WHERE p_name = 'cold widget' OR p_size = 10 AND p_brand = 'Brand#5' OR p_size = 7")
def filter_structures(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.split("p_name", " ").alias("words"), F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("kind"))
    return find(part, {"$or": [{"words": ["cold", "widget"]}, {"kind": {"size": 10, "brand": "Brand#5"}}, {"kind.size": {"$in": [7]}}]}, {"p_partkey": 1})


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50 AND event_id % 2 = 0")
def filter_types(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("doc", F.parse_json(F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, F.lit(', "l": [{"n": 1}]}')).otherwise(', "l": "x"}'))))
    return find(events, {"k": {"$gt": 50, "$type": "int"}, "l": {"$type": "array", "$elemMatch": {"n": 1}}, "event_id": {"$type": "long"}}, {"event_id": 1}, variant="doc")


_pipe("expr_if_null_in", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "flag": {"$ifNull": [{"$cond": [{"$in": ["$l_returnflag", ["A", "R"]]}, "$l_returnflag", None]}, "other"]}}}], "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag ELSE 'other' END AS flag FROM lineitem")
_pipe("group_literal_key", "orders", [{"$group": {"_id": "all", "n": {"$sum": 1}}}], "SELECT 'all' AS _id, count(*) AS n FROM orders")
_pipe("group_mixed_order", "orders", [{"$sort": {"o_orderpriority": 1, "o_orderstatus": -1, "o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}], "SELECT o_custkey AS _id, first(o_orderkey ORDER BY o_orderpriority, o_orderstatus DESC, o_totalprice DESC, o_orderkey) AS first, last(o_orderkey ORDER BY o_orderpriority, o_orderstatus DESC, o_totalprice DESC, o_orderkey) AS last FROM orders GROUP BY 1")
_pipe("sort_by_count_top", "part", [{"$sortByCount": "$p_brand"}, {"$limit": 3}], "SELECT p_brand AS _id, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, p_brand LIMIT 3")
_pipe("facet_contents", "orders", [{"$facet": {"by_status": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$sort": {"_id": 1}}], "top": [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 5}, {"$project": {"o_orderkey": 1}}]}}], "SELECT (SELECT string_agg(s || ':' || n, ',' ORDER BY s) FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)) AS statuses, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)) AS top", lambda df: df.select(F.array_join(F.array_sort(F.transform("by_status", lambda s: F.concat_ws(":", s["_id"], s["n"]))), ",").alias("statuses"), F.array_join(F.array_sort(F.transform("top", lambda t: t["o_orderkey"])), ",").alias("top")))
_pipe("lookup_contents", "nation", [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "suppliers"}}], "SELECT n_nationkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1", lambda df: df.select("n_nationkey", F.array_join(F.array_sort(F.transform("suppliers", lambda s: s["s_suppkey"])), ",").alias("suppliers")), ("supplier",))
_pipe("lookup_without_fields", "nation", [{"$lookup": {"from": "region", "as": "r"}}], "SELECT n_nationkey, 0 AS n FROM nation", lambda df: df.select("n_nationkey", F.size("r").alias("n")), ("region",))


@query("SELECT o_orderkey, o_custkey AS cust FROM orders WHERE o_totalprice > 200000")
def project_dotted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")).alias("who"))
    return find(orders, {"o_totalprice": {"$gt": 200_000}}, {"o_orderkey": 1, "who.cust": 1}).select("o_orderkey", "who.cust")


@query("SELECT p_partkey, array_to_string(list_slice(string_split(p_name, ' '), 1, 1), ' ') AS words, CASE WHEN contains(p_name, 'widget') THEN 'widget' END AS found FROM part")
def project_slice_elem_match(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.split("p_name", " ").alias("found"))
    out = find(part, {}, {"p_partkey": 1, "words": {"$slice": 1}, "found": {"$elemMatch": {"$eq": "widget"}}})
    return out.select("p_partkey", F.array_join("words", " ").alias("words"), "found")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'keep' ELSE 'cut' END AS what FROM part WHERE p_size % 5 <> 0")
def redact_keep(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.struct(F.col("p_size").alias("p_size"), F.lit("keep").alias("what")).alias("inner"))
    out = aggregate(part, [{"$redact": {"$cond": [{"$eq": [{"$mod": ["$p_size", 5]}, 0]}, "$$PRUNE", {"$cond": [{"$eq": [{"$mod": ["$p_size", 3]}, 0]}, "$$KEEP", "$$DESCEND"]}]}}])
    return out.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("inner.what")).otherwise("cut").alias("what"))


@query("SELECT r_regionkey, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def populate_array(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    refs = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("nations"))
    region = table(spark, sf_dir, "region").join(refs, F.col("r_regionkey") == F.col("n_regionkey"), "left").drop("n_regionkey")
    out = join.populate(region, nation, "nations", key="n_nationkey", select=["n_name"])
    return out.select("r_regionkey", F.array_join(F.transform(F.coalesce("nations", F.array().cast(out.schema["nations"].dataType)), lambda n: n["n_name"]), ",").alias("names"))


# Geo


@query(f"WITH {_SQL_POINTS} SELECT c_custkey FROM pts WHERE sqrt(pow(lon - 10, 2) + pow(lat - 20, 2)) <= 25")
def geo_center(spark, sf_dir):
    return find(_points(spark, sf_dir), {"location": {"$geoWithin": {"$center": [[10, 20], 25]}}}, {"c_custkey": 1})


@query(f"""WITH {_SQL_POINTS}, d AS (SELECT c_custkey, least(1.0, pow(sin(radians(40 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(-70 - lon) / 2), 2)) AS a FROM pts)
SELECT c_custkey FROM d WHERE 2 * atan2(sqrt(a), sqrt(1 - a)) <= 0.5""")  # fmt: skip
def geo_center_sphere(spark, sf_dir):
    return find(_points(spark, sf_dir), {"location": {"$geoWithin": {"$centerSphere": [[-70, 40], 0.5]}}}, {"c_custkey": 1})


@query(f"WITH {_SQL_POINTS} SELECT c_custkey FROM pts WHERE lon > -60.5 AND lon < 60.5 AND lat > -60.5 AND lat < 60.5 AND NOT (lon > -20.5 AND lon < 20.5 AND lat > -20.5 AND lat < 20.5)")
def geo_hole(spark, sf_dir):
    square = lambda r: [[-r, -r], [r, -r], [r, r], [-r, r], [-r, -r]]
    return find(_points(spark, sf_dir), {"location": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [square(60.5), square(20.5)]}}}}, {"c_custkey": 1})


@query(f"WITH {_SQL_POINTS} SELECT c_custkey FROM pts WHERE lon + 5 >= -30.5 AND lon - 5 <= 40.5 AND lat + 5 >= -10.5 AND lat - 5 <= 50.5")
def geo_intersects_polygons(spark, sf_dir):
    lon, lat = F.get("location", 0), F.get("location", 1)
    corner = lambda x, y: F.array(lon + x, lat + y)
    ring = F.array(corner(-5, -5), corner(5, -5), corner(5, 5), corner(-5, 5), corner(-5, -5))
    places = _points(spark, sf_dir).withColumn("area", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    box = [[-30.5, -10.5], [40.5, -10.5], [40.5, 50.5], [-30.5, 50.5], [-30.5, -10.5]]
    return find(places, {"area": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [box]}}}}, {"c_custkey": 1})


# Schemas and files


def _nested(spark, sf_dir) -> DataFrame:
    """Customers as JSON with nested, missing and mixed fields."""
    inner = F.to_json(F.struct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation")))
    value = F.when(F.col("c_custkey") % 10 == 0, F.lit('"x"')).otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('{"id": '), F.col("c_custkey").cast("string"), F.lit(', "balance": '), value, F.lit(', "who": '), inner, F.lit("}")).alias("js"))


@query("""SELECT 'id' AS path, count(*) AS count, 'number' AS dominant FROM customer UNION ALL SELECT 'balance', count(*), 'number' FROM customer UNION ALL SELECT 'who', count(*), 'object' FROM customer
UNION ALL SELECT 'who.name', count(*) FILTER (c_custkey % 4 <> 0), 'string' FROM customer UNION ALL SELECT 'who.nation', count(*), 'number' FROM customer""")  # fmt: skip
def schema_profile_nested(spark, sf_dir):
    return schema.profile(_nested(spark, sf_dir), "js").select("path", "count", "dominant")


@query("SELECT * FROM (VALUES ('manual', 'balance'), ('manual', 'who.name'), ('frequency', 'balance'), ('frequency', 'id'), ('frequency', 'who.nation'), ('adaptive', 'id'), ('adaptive', 'who.nation'), ('conservative', 'id'), ('conservative', 'who.nation'))")
def schema_strategies(spark, sf_dir):
    profiled = schema.profile(_nested(spark, sf_dir), "js")
    picks = {"manual": {"fields": ["balance", "who.name", "absent"]}, "frequency": {}, "adaptive": {}, "conservative": {}}
    frames = [schema.suggest_promotions(profiled, s, **o).select(F.lit(s).alias("col0"), F.col("path").alias("col1")) for s, o in picks.items()]
    # `adaptive` counts only fields of one type nine times in ten.
    out = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    return out.where("NOT (col0 = 'adaptive' AND col1 = 'balance')")


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, s_name AS name FROM supplier")
def schema_evolve_variant(spark, sf_dir):
    target = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_nationkey", T.VariantType()), T.StructField("s_name", T.VariantType())])
    out = schema.evolve(table(spark, sf_dir, "supplier"), target)
    return out.select("s_suppkey", F.try_variant_get("s_nationkey", "$", "string").alias("nation"), F.try_variant_get("s_name", "$", "string").alias("name"))


@query("SELECT * FROM (VALUES ('uuid', 2::BIGINT), ('date', 2), ('date-time', 1), ('email', 1))")
def schema_formats(spark, sf_dir):
    texts = ["123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-92d3-a456-426614174000", "123e4567-e89b-42d3-c456-426614174000", "0190163d-8694-739b-aea5-966c26f8ad91", "2024-02-29", "2023-02-29", "2024-13-99", "1999-12-31", "2024-01-01T25:00:00Z", "2024-01-01T05:00:00Z", "a@b.org", "a@b", "@b.org"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    frames = []
    for name in ("uuid", "date", "date-time", "email"):
        bad = schema.validation_errors(df, {"properties": {"t": {"type": "string", "format": name}}})
        frames.append(df.agg(F.lit(name).alias("col0"), F.sum((F.size(bad) == 0).cast("long")).alias("col1")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query("SELECT n_nationkey, n_name FROM nation")
def json_rows(spark, sf_dir):
    path = _new(spark)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nation.coalesce(1).agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")))).write.text(path)  # one JSON array, as the older layout has
    return files.read_json_rows(spark, path, nation.schema)


@query("SELECT count(*) AS rows, 1 AS skipped FROM nation")
def tolerant_scan(spark, sf_dir):
    path, nation = _new(spark), table(spark, sf_dir, "nation")
    nation.coalesce(1).write.parquet(path)
    nation.limit(0).coalesce(1).write.mode("append").parquet(path)  # sound, but without rows
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/broken.parquet")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(b"PAR1 this is no table"))
    stream.close()
    rows, skipped = files.read_tolerant(spark, path, nation.schema)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.lit(skipped.count()).alias("skipped"))


# Streams


@query(f"WITH {_SQL_LOG} SELECT CASE _op WHEN 'i' THEN 'insert' WHEN 'd' THEN 'delete' ELSE 'update' END AS type, count(*) AS n FROM log WHERE _seq > 100 AND value > 50 GROUP BY 1")
def stream_watch(spark, sf_dir):
    path, out = _new(spark), _new(spark)
    log = _log(spark, sf_dir)
    log.repartition(4).write.parquet(path)
    rows = changes.watch(spark, path, log.schema, {"value": {"$gt": 50}}, after_seq=100)
    # The checkpoint resumes: a second run finds nothing new.
    for _ in range(2):
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("operation_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def _in_batches(spark, log: DataFrame, each) -> None:
    """Runs a `foreachBatch` function over the log in four files, one a batch, in the order of their numbers."""
    path = _new(spark)
    top = log.agg(F.max("_seq")).first()[0] + 1
    for k in range(4):
        log.where((F.col("_seq") >= top * k // 4) & (F.col("_seq") < top * (k + 1) // 4)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {_SQL_LOG} SELECT _id, _seq, value FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY _seq DESC) AS r FROM log) WHERE r = 1")
def stream_upsert(spark, sf_dir):
    path = _new(spark)
    _in_batches(spark, _log(spark, sf_dir), changes.upsert_batches(path, parts=8))
    return spark.read.parquet(path).select("_id", "_seq", "value")


@query(f"""WITH {_SQL_LOG}, e AS (SELECT *, lag(value) OVER w AS was, lag(_op) OVER w AS before FROM log WINDOW w AS (PARTITION BY _id ORDER BY _seq))
SELECT _seq AS token, _op = 'u' AND before IS NOT NULL AND before <> 'd' AND value IS DISTINCT FROM was AS changed FROM e""")  # fmt: skip
def stream_descriptions(spark, sf_dir):
    out, state = _new(spark), _new(spark)
    _in_batches(spark, _log(spark, sf_dir), changes.describe_batches(state, lambda df: df.write.mode("append").parquet(out)))
    return spark.read.parquet(out).select("token", F.coalesce(F.array_contains("updated_fields", "value"), F.lit(False)).alias("changed"))
