"""Pipeline stages on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.updates import apply_update, upsert_document
from tessera.operators import join
from tessera.plans.pipeline import aggregate, normalise
from tessera.plans.validation import InvalidQuery


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [(1, "a", 10, ["x", "y"], "3"), (2, "a", None, [], "z"), (3, "b", 5, None, None), (4, None, 7, ["x"], "2.5")], "_id int, cat string, price int, tags array<string>, text string"
    ).cache()


def test_group_quirks(spark, sales):
    out = aggregate(sales, [{"$group": {"_id": "$cat", "avg": {"$avg": "$price"}, "sum": {"$sum": "$text"}, "n": {"$sum": 1}}}])
    assert rows(out, "_id", "avg", "sum", "n") == sorted([("a", 5.0, 3.0, 2), ("b", 5.0, 0.0, 1), (None, 7.0, 2.5, 1)], key=str)
    out = aggregate(sales, [{"$group": {"_id": None, "avg": {"$avg": "$price"}}}], sql_avg=True)
    assert rows(out, "_id", "avg") == [(None, 22 / 3)]
    assert aggregate(sales, [{"$match": {"_id": 99}}, {"$group": {"_id": None, "n": {"$sum": 1}}}]).count() == 0
    assert rows(aggregate(sales, [{"$match": {"_id": 99}}, {"$count": "n"}]), "n") == [(0,)]
    assert rows(aggregate(sales, [{"$group": {"_id": "$price"}}], stringify_ids=True), "_id")[0] == ("10",)


def test_ordered_accumulators_keep_nulls(sales):
    out = aggregate(sales, [{"$sort": {"_id": -1}}, {"$group": {"_id": None, "first": {"$first": "$price"}, "last": {"$last": "$text"}, "all": {"$push": "$price"}, "set": {"$addToSet": "$cat"}}}]).first()
    assert (out["first"], out["last"], out["all"], out["set"]) == (7, "3", [7, 5, None, 10], [None, "b", "a"])
    out = aggregate(sales, [{"$sort": {"cat": 1, "_id": -1}}, {"$group": {"_id": None, "ids": {"$push": "$_id"}, "f": {"$first": "$_id"}}}]).first()
    assert out["ids"] == [4, 2, 1, 3] and out["f"] == 4
    with pytest.raises(ValueError):
        aggregate(sales, [{"$group": {"_id": None, "f": {"$first": "$price"}}}])


def test_unwind(sales):
    assert rows(aggregate(sales, [{"$unwind": "$tags"}]), "_id", "tags") == [(1, "x"), (1, "y"), (4, "x")]
    keep = aggregate(sales, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}}])
    assert rows(keep, "_id", "tags", "at") == sorted([(1, "x", 0), (1, "y", 1), (2, None, None), (3, None, None), (4, "x", 0)], key=str)
    assert aggregate(sales, [{"$unwind": "$cat"}]).count() == 0
    assert aggregate(sales, [{"$unwind": {"path": "$cat", "preserveNullAndEmptyArrays": True}}]).count() == 4


def test_bucket(sales):
    spec = {"groupBy": "$price", "boundaries": [0, 7, 10]}
    assert rows(aggregate(sales, [{"$bucket": spec}]), "_id", "count") == [(0, 1), (7, 1)]
    assert rows(aggregate(sales, [{"$bucket": spec | {"default": "other"}}]), "_id", "count") == [("0", 1), ("7", 1), ("other", 2)]
    only = aggregate(sales, [{"$match": {"price": {"$in": [5, 7]}}}, {"$bucket": spec | {"default": -1}}])
    assert rows(only, "_id", "count") == [(-1, 0), (0, 1), (7, 1)]
    with pytest.raises(InvalidQuery):
        aggregate(sales, [{"$bucket": {"groupBy": "$price", "boundaries": [5, 1]}}])


def test_bucket_auto(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5, None]], "v int")
    out = aggregate(df, [{"$bucketAuto": {"groupBy": "$v", "buckets": 2}}]).collect()
    assert [(r._id["min"], r._id["max"], r["count"]) for r in out] == [(1, 4, 3), (4, 5, 2)]
    assert aggregate(df.limit(0), [{"$bucketAuto": {"groupBy": "$v", "buckets": 2}}]).count() == 0


def test_projection(spark):
    df = spark.createDataFrame([(1, ("a", ("b", 2)), [1, 2, 3], [("k", 1), ("m", 2)])], "_id int, o struct<x:string, y:struct<z:string, w:int>>, l array<int>, d array<struct<k:string, v:int>>")
    assert aggregate(df, [{"$project": {"o.y.z": 1, "absent": 1}}]).schema.simpleString() == "struct<_id:int,o:struct<y:struct<z:string>>>"
    assert aggregate(df, [{"$project": {"_id": 0, "o.y": 0}}]).columns == ["o", "l", "d"]
    out = aggregate(df, [{"$project": {"_id": 0, "head": {"$slice": ["$l", 2]}, "l": {"$slice": -1}, "d": {"$elemMatch": {"v": 2}}}}]).first()
    assert (out.head, out.l, out.d.k) == ([1, 2], [3], "m")
    with pytest.raises(InvalidQuery):
        aggregate(df, [{"$project": {"l": 1, "d": 0}}])
    out = aggregate(df, [{"$set": {"o.y.new": 5, "p.q": "$o.x"}}, {"$unset": ["o.x"]}]).first()
    assert out.o.asDict(True) == {"y": {"z": "b", "w": 2, "new": 5}} and out.p.q == "a"
    assert aggregate(df, [{"$replaceRoot": {"newRoot": {"$mergeObjects": ["$o", {"x": "new"}]}}}]).first().x == "new"


def test_redact(spark):
    df = spark.createDataFrame([(1, 1, (2, "b", (9, "s")), [(1, "k"), (9, "p")]), (2, 9, None, [])], "_id int, level int, c struct<level:int, body:string, secret:struct<level:int, data:string>>, l array<struct<level:int, t:string>>")
    spec = {"$cond": {"if": {"$lte": [{"$ifNull": ["$level", 0]}, 5]}, "then": "$$DESCEND", "else": "$$PRUNE"}}
    out = aggregate(df, [{"$redact": spec}]).collect()
    assert len(out) == 1 and out[0].c.body == "b" and out[0].c.secret is None and [x.t for x in out[0].l] == ["k"]


def test_lookup(spark):
    left = spark.createDataFrame([(1, "p"), (2, None), (3, "q")], "_id int, k string")
    right = spark.createDataFrame([(10, "p", 1), (11, "p", 2), (12, None, 3)], "_id int, fk string, n int")
    stage = {"$lookup": {"from": "r", "localField": "k", "foreignField": "fk", "as": "hits"}}
    out = aggregate(left, [stage], {"r": right}).collect()
    assert {r._id: [h._id for h in r.hits] for r in out} == {1: [10, 11], 2: [12], 3: []}
    flat = aggregate(left, [stage, {"$unwind": "$hits"}], {"r": right})
    assert rows(flat.select("_id", "hits.n"), "_id", "n") == [(1, 1), (1, 2), (2, 3)]
    assert len(normalise([stage, {"$unwind": "$hits"}])) == 1
    kept = aggregate(left, [stage, {"$unwind": {"path": "$hits", "preserveNullAndEmptyArrays": True}}], {"r": right})
    assert kept.count() == 4
    sub = aggregate(left, [{"$lookup": {"from": "r", "pipeline": [{"$match": {"n": {"$gt": 1}}}, {"$count": "c"}], "as": "hits"}}], {"r": right})
    assert all(r.hits[0].c == 2 for r in sub.collect())
    assert [len(r.hits) for r in aggregate(left, [{"$lookup": {"from": "r", "as": "hits"}}], {"r": right}).collect()] == [0, 0, 0]


def test_graph_lookup_ends_on_cycles(spark):
    people = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "c", "b"), (4, "x", "y"), (5, "y", "x")], "_id int, name string, boss string")
    spec = {"from": "p", "startWith": "$boss", "connectFromField": "boss", "connectToField": "name", "as": "up", "depthField": "d"}
    out = {r.name: sorted((u.name, u.d) for u in r.up) for r in aggregate(people, [{"$graphLookup": spec}], {"p": people}).collect()}
    assert out == {"a": [], "b": [("a", 0)], "c": [("a", 1), ("b", 0)], "x": [("x", 1), ("y", 0)], "y": [("x", 0), ("y", 1)]}
    one = aggregate(people, [{"$graphLookup": spec | {"maxDepth": 0, "restrictSearchWithMatch": {"name": {"$ne": "a"}}}}], {"p": people})
    assert {r.name: [u.name for u in r.up] for r in one.collect()} == {"a": [], "b": [], "c": ["b"], "x": ["y"], "y": ["x"]}


def walks(pairs, most):
    """The nodes and depths reached from each node of {node: next}, by hand."""
    out = {}
    for n in pairs:
        at, seen = n, {}
        while at in pairs and at not in seen and len(seen) <= most:
            seen[at] = len(seen)
            at = pairs[at]
        out[n] = sorted(seen.items())
    return out


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5, 100])
def test_graph_lookup_of_chains_and_cycles(spark, most):
    draw = random.Random(7)
    pairs = {n: draw.choice([None, 999, draw.randrange(60), n // 3, n]) for n in range(60)}  # roots, dangling references, cycles, trees, loops
    pairs |= {n: n + 1 for n in range(100, 130)}
    nodes = spark.createDataFrame([(f"k{n}", n, p) for n, p in pairs.items()], "_id string, n int, next bigint")
    spec = {"from": "p", "startWith": "$n", "connectFromField": "next", "connectToField": "n", "as": "up", "depthField": "d", "maxDepth": most}
    out = aggregate(nodes, [{"$graphLookup": spec}], {"p": nodes})
    assert {r.n: [(u.n, u.d) for u in sorted(r.up, key=lambda u: u.n)] for r in out.collect()} == walks(pairs, most)
    starts = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 777)] + [(9, n) for n in range(60)], "_id int, s int")
    bare = {k: v for k, v in spec.items() if k != "depthField"}
    got = [(r.s, sorted(u.n for u in r.up)) for r in aggregate(starts, [{"$graphLookup": bare | {"startWith": "$s"}}], {"p": nodes}).collect()]
    want = walks(pairs, most)
    assert sorted(got, key=str) == sorted(((s, [n for n, _ in want.get(s, [])]) for s in [5, 5, None, 777, *range(60)]), key=str)


def test_graph_lookup_moves_no_leaves_walks(spark, monkeypatch):
    written, write = [], join.materialize
    monkeypatch.setattr(join, "materialize", lambda df: (out := write(df), written.append(out.count()))[0])
    nodes = spark.range(4000).selectExpr("id AS _id", "CASE WHEN id > 0 THEN id DIV 4 END AS parent")
    spec = {"from": "p", "startWith": "$_id", "connectFromField": "parent", "connectToField": "_id", "as": "up", "depthField": "d"}
    out = aggregate(nodes, [{"$graphLookup": spec}], {"p": nodes}).selectExpr("size(up) AS n", "up.d AS d").agg({"n": "sum"}).first()[0]
    assert out == sum(len(v) for v in walks({n: n // 4 if n else None for n in range(4000)}, 100).values())
    assert sum(written) <= 3 * 4000  # all nodes' walks were written row by row in each round


def test_graph_lookup_with_repeated_keys(spark):
    nodes = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, "b", "c"), (4, "c", "a")], "_id int, k string, next string")
    spec = {"from": "p", "startWith": "$k", "connectFromField": "next", "connectToField": "k", "as": "up", "depthField": "d"}
    out = {r._id: sorted((u._id, u.d) for u in r.up) for r in aggregate(nodes, [{"$graphLookup": spec}], {"p": nodes}).collect()}
    assert out == {1: (a := [(1, 0), (2, 0), (3, 1), (4, 2)]), 2: a, 3: [(1, 2), (2, 2), (3, 0), (4, 1)], 4: [(1, 1), (2, 1), (3, 2), (4, 0)]}


def test_facet_union_sample_populate(spark, sales):
    out = aggregate(sales, [{"$facet": {"n": [{"$count": "c"}], "cats": [{"$sortByCount": "$cat"}]}}]).first()
    assert out.n[0].c == 4 and len(out.cats) == 3
    both = aggregate(sales.select("_id"), [{"$unionWith": "o"}], {"o": spark.createDataFrame([(9, "z")], "_id int, extra string")})
    assert both.count() == 5 and both.columns == ["_id", "extra"]
    assert aggregate(sales, [{"$sample": {"size": 2}}]).count() == 2 and aggregate(sales, [{"$sample": {"size": 0}}]).count() == 0
    refs = spark.createDataFrame([(1, [4, 9, 1]), (2, [])], "_id int, r array<int>")
    got = {r._id: [x.cat for x in r.r] for r in join.populate(refs, sales, "r", select=["cat"]).collect()}
    assert got == {1: [None, "a"], 2: []}


@pytest.mark.parametrize("bad", [{"$bogus": 1}, {"$limit": -1}, {"$match": {}, "$limit": 1}, "x"])
def test_bad_pipelines(sales, bad):
    with pytest.raises(InvalidQuery):
        aggregate(sales, [bad])


def test_updates(spark):
    df = spark.createDataFrame([(1, 5, ["a"], ("x",), None), (2, None, None, ("y",), 1.5)], "_id int, n int, l array<string>, o struct<p:string>, f double")
    out = {r._id: r for r in apply_update(df, {"$inc": {"n": 2}, "$push": {"l": {"$each": ["b", "c"]}}, "$set": {"o.q": 1}, "$mul": {"f": 2}}).collect()}
    assert (out[1].n, out[1].l, out[1].o.q, out[1].f) == (7, ["a", "b", "c"], 1, 0.0) and (out[2].n, out[2].l, out[2].f) == (2, ["b", "c"], 3.0)
    out = {r._id: r for r in apply_update(df, {"$pull": {"l": "a"}, "$min": {"n": 3}, "$unset": {"f": ""}, "$addToSet": {"l": "z"}}, F.col("_id") == 1).collect()}
    assert (out[1].n, out[1].l, out[1].f) == (3, ["z"], None) and (out[2].n, out[2].l, out[2].f) == (None, None, 1.5)
    assert apply_update(df, {"$rename": {"n": "m"}}).columns == ["_id", "m", "l", "o", "f"]
    for bad in ({"$set": {"_id": 1}}, {"$bogus": {"a": 1}}, {"$inc": {"o": 1}}, {"$push": {"n": 1}}):
        with pytest.raises(ValueError):
            apply_update(df, bad)
    assert upsert_document({"a": 1, "b": {"$gt": 2}, "c.d": {"$eq": 3}}, {"$set": {"e": 4}, "$setOnInsert": {"f": 5}, "$push": {"g": 6}}) == {"a": 1, "c": {"d": 3}, "e": 4, "f": 5, "g": [6]}
