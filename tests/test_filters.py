"""Filter documents on small rows, and the algebra of their logic."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.plans.pipeline import find
from tessera.plans.validation import InvalidQuery

SCHEMA = "_id int, name string, age int, score double, active boolean, tags array<string>, nums array<int>, address struct<city:string, zip:int>, items array<struct<sku:string, n:int>>, at timestamp"
ROWS = [
    (1, "Ann", 30, 1.5, True, ["a", "b"], [1, 2], ("Rome", 1), [("x", 1), ("y", 5)], dt.datetime(2024, 1, 1)),
    (2, "bob", 20, -1.0, False, [], [3], ("Oslo", 2), [("x", 9)], dt.datetime(2024, 2, 1)),
    (3, "Cid", None, None, None, None, None, None, None, None),
    (4, None, 20, 0.0, True, ["b"], [5, 7], ("Rome", None), [], dt.datetime(2023, 1, 1)),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


CASES = [
    ({}, {1, 2, 3, 4}), ({"name": "Ann"}, {1}), ({"age": None}, {3}), ({"age": {"$ne": 20}}, {1, 3}), ({"age": {"$gt": 20}}, {1}), ({"age": {"$lte": 20}}, {2, 4}),
    ({"age": {"$in": [20, None]}}, {2, 3, 4}), ({"age": {"$nin": [20]}}, {1, 3}), ({"age": {"$in": []}}, set()), ({"age": {"$nin": [None]}}, {1, 2, 4}), ({"age": "20"}, set()), ({"age": {"$gt": "1"}}, set()), ({"age": {"$ne": "20"}}, {1, 2, 3, 4}),
    ({"age": {"$exists": True}}, {1, 2, 4}), ({"nothing": {"$exists": False}}, {1, 2, 3, 4}), ({"nothing": 5}, set()), ({"nothing": {"$ne": 5}}, {1, 2, 3, 4}),
    ({"name": {"$regex": "^[AB]"}}, {1}), ({"name": {"$regex": "^[AB]", "$options": "i"}}, {1, 2}), ({"name": re.compile("^c", re.I)}, {3}), ({"age": {"$regex": "2"}}, set()), ({"name": {"$not": {"$regex": "^A"}}}, {2, 3, 4}),
    ({"age": {"$not": {"$gt": 20}}}, {2, 3, 4}), ({"$and": []}, {1, 2, 3, 4}), ({"$or": []}, set()), ({"$nor": []}, {1, 2, 3, 4}), ({"$or": [{"age": 30}, {"score": 0}]}, {1, 4}), ({"$nor": [{"age": 30}, {"score": 0.0}]}, {2, 3}),
    ({"address.city": "Rome"}, {1, 4}), ({"address": {"city": "Rome", "zip": 1}}, {1}), ({"tags": ["a", "b"]}, {1}), ({"tags.0": "b"}, {4}), ({"tags": {"$all": ["b"]}}, {1, 4}), ({"tags": {"$all": []}}, set()), ({"tags": {"$size": 0}}, {2}),
    ({"nums": {"$elemMatch": {"$gt": 4, "$lt": 6}}}, {4}), ({"items": {"$elemMatch": {"sku": "x", "n": {"$gt": 2}}}}, {2}), ({"age": {"$mod": [15, 0]}}, {1}), ({"age": {"$type": "number"}}, {1, 2, 4}), ({"age": {"$type": ["string", "null"]}}, {3}),
    ({"at": dt.datetime(2024, 2, 1)}, {2}), ({"at": {"$lt": dt.datetime(2024, 1, 1)}}, {4}), ({"$expr": {"$gt": ["$age", {"$multiply": ["$score", 15]}]}}, {1, 2, 4}), ({"active": True, "age": {"$gte": 20, "$lt": 30}}, {4}), ({"active": {"$ne": True}}, {2, 3}),
]


@pytest.mark.parametrize("query,want", CASES, ids=lambda x: str(x)[:60])
def test_matches(people, query, want):
    assert {r._id for r in find(people, query).collect()} == want


@pytest.mark.parametrize("query", [{"$where": "1"}, {"age": {"$bogus": 1}}, {"$bogus": []}, {"name": {"$regex": "x" * 2000}}, {"a..b": 1}, {"__proto__": 1}, {"age": {"$gt": 1, "plain": 2}}])
def test_rejected(people, query):
    with pytest.raises(ValueError):
        find(people, query)


def test_too_deep_or_large():
    from tessera.plans.validation import check_filter

    deep = {"a": 1}
    for _ in range(12):
        deep = {"$and": [deep]}
    with pytest.raises(InvalidQuery):
        check_filter(deep)
    with pytest.raises(InvalidQuery):
        check_filter({"$or": [{"a": {"$gt": i}} for i in range(101)]})


def test_algebra(people):
    rng = random.Random(1)
    leaves = [{"age": {op: v}} for op in ("$gt", "$lte", "$eq", "$ne") for v in (20, 30, None) if v is not None or op in ("$eq", "$ne")] + [{"name": "Ann"}, {"tags": {"$size": 1}}]
    columns = {}
    ids = lambda q: {r._id for r in find(people, q).collect()}
    for a, b in itertools.islice(((rng.choice(leaves), rng.choice(leaves)) for _ in iter(int, 1)), 12):
        x, y = ids(a), ids(b)
        assert ids({"$and": [a, b]}) == x & y and ids({"$or": [a, b]}) == x | y and ids({"$nor": [a, b]}) == {1, 2, 3, 4} - (x | y)
        columns[str(a)] = x


def test_variant_fields_keep_null_and_missing_apart(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": null}'), (3, "{}"), (4, '{"a": "1", "l": [1, 2]}')], "_id int, js string").select("_id", F.parse_json("js").alias("doc"))
    ids = lambda q: {r._id for r in find(df, q, variant="doc").collect()}
    assert ids({"a": None}) == {2} and ids({"a": {"$exists": True}}) == {1, 2, 4} and ids({"a": 1}) == {1} and ids({"a": "1"}) == {4} and ids({"a": {"$gt": 0}}) == {1}
    assert ids({"b.c": "x"}) == {1} and ids({"l": {"$size": 2}}) == {4} and ids({"l": {"$all": [2]}}) == {4} and ids({"a": {"$in": [None, "1"]}}) == {2, 4} and ids({"a": {"$type": "string"}}) == {4} and ids({"l": [1, 2]}) == {4}


def test_filter_reaches_the_scan(spark, tiny):
    plan = find(spark.read.parquet(f"{tiny}/lineitem.parquet"), {"l_quantity": {"$gt": 49}}, {"l_orderkey": 1})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
