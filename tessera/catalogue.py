"""Registered queries of the engine over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo
from tessera.functions.updates import apply_update
from tessera.operators import join, schema, search, versioned
from tessera.operators import group as grouping
from tessera.plans.pipeline import aggregate, find

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _pipe(name: str, source: str, stages: list[dict], sql: str, after: Callable[[DataFrame], DataFrame] = lambda df: df, others: tuple[str, ...] = (), **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = {n: table(spark, sf_dir, n) for n in others}
        return after(aggregate(table(spark, sf_dir, source), stages, catalog, **options))

    QUERIES[name], ORACLE_SQL[name] = run, sql


def _find(name: str, source: str, sql: str, **spec) -> None:
    QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf_dir: find(table(spark, sf_dir, source), **spec)), sql


# Flagship

_pipe(
    "entry_pricing_summary",
    "lineitem",
    [
        {"$match": {"l_quantity": {"$gt": 10}}},
        {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "n": {"$sum": 1}}},
        {"$sort": {"qty": -1}},
    ],
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ALL",
    lambda df: df.select("_id.flag", "_id.status", F.round("qty", 2).alias("qty"), "n"),
)

# Filters

_KEYS = {"l_orderkey": 1, "l_linenumber": 1}
_LINES = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
_find("filter_compare", "lineitem", _LINES + "l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'A' AND l_linestatus <> 'O'", query={"l_quantity": {"$gte": 10, "$lt": 20}, "l_returnflag": "A", "l_linestatus": {"$ne": "O"}}, projection=_KEYS)
_find("filter_in_nin", "lineitem", _LINES + "l_linenumber IN (1, 3) AND l_returnflag NOT IN ('A', 'N')", query={"l_linenumber": {"$in": [1, 3]}, "l_returnflag": {"$nin": ["A", "N"]}}, projection=_KEYS)
_find("filter_logical", "lineitem", _LINES + "(l_quantity > 45 OR l_discount = 0.1) AND NOT (l_tax > 0.05 OR l_returnflag = 'R')", query={"$and": [{"$or": [{"l_quantity": {"$gt": 45}}, {"l_discount": 0.1}]}, {"$nor": [{"l_tax": {"$gt": 0.05}}, {"l_returnflag": "R"}]}]}, projection=_KEYS)
_find("filter_not_nor", "lineitem", _LINES + "NOT (l_quantity > 5) OR l_linenumber = 7", query={"$or": [{"l_quantity": {"$not": {"$gt": 5}}}, {"l_linenumber": {"$eq": 7}}]}, projection=_KEYS)
_find("filter_regex", "part", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue).*et$')", query={"p_name": {"$regex": "^(red|blue).*et$"}}, projection={"p_partkey": 1, "p_name": 1})
_find("filter_regex_options", "orders", "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, 'urgent', 'i')", query={"o_orderpriority": {"$regex": "urgent", "$options": "i"}}, projection={"o_orderkey": 1})
_find("filter_exists_null", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL", query={"c_acctbal": {"$exists": True}, "missing": {"$exists": False}, "c_mktsegment": {"$ne": None}}, projection={"c_custkey": 1})
_find("filter_mod", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3", query={"o_orderkey": {"$mod": [7, 3]}}, projection={"o_orderkey": 1})
_find("filter_type_bracketing", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", query={"o_orderkey": {"$type": "long"}, "o_totalprice": {"$not": {"$gt": "1"}}, "o_orderstatus": {"$type": "string", "$eq": "F"}}, projection={"o_orderkey": 1})
_find("filter_expr", "lineitem", _LINES + "l_extendedprice * l_discount > l_quantity * 100", query={"$expr": {"$gt": [{"$multiply": ["$l_extendedprice", "$l_discount"]}, {"$multiply": ["$l_quantity", 100]}]}}, projection=_KEYS)


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND list_contains(string_split(text, ' '), 'and') AND len(list_filter(string_split(text, ' '), lambda w: starts_with(w, 'th') AND length(w) > 12)) > 0")
def filter_arrays(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("words", F.split("text", " "))
    return find(docs, {"words": {"$all": ["the", "and"], "$elemMatch": {"$regex": "^th.{11}", "$options": "s"}}}, {"doc_id": 1})


@query("SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) = 3")
def filter_size(spark, sf_dir):
    return find(table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n")), {"lines": {"$size": 3}}, {"doc_id": 1})


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 20 AND 40")
def filter_variant(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("doc", F.parse_json("props"))
    return find(events, {"k": {"$gte": 20, "$lte": 40}, "none": {"$exists": False}}, {"event_id": 1}, variant="doc")


# Projection and shape

_find("project_include", "orders", "SELECT o_orderkey, o_totalprice FROM orders", projection={"o_orderkey": 1, "o_totalprice": True, "absent": 1})
_find("project_exclude", "customer", "SELECT c_custkey, c_name, c_nationkey FROM customer", projection={"c_acctbal": 0, "c_mktsegment": 0})
_pipe("project_computed", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}], "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
_pipe("add_fields_sequential", "orders", [{"$addFields": {"half": {"$divide": ["$o_totalprice", 2]}, "quarter": {"$divide": ["$half", 2]}, "band": {"$cond": {"if": {"$gt": ["$half", 100000]}, "then": "high", "else": "low"}}}}, {"$project": {"o_orderkey": 1, "quarter": 1, "band": 1}}], "SELECT o_orderkey, o_totalprice / 4 AS quarter, CASE WHEN o_totalprice / 2 > 100000 THEN 'high' ELSE 'low' END AS band FROM orders")
_pipe("unset_fields", "supplier", [{"$unset": ["s_acctbal", "s_name"]}], "SELECT s_suppkey, s_nationkey FROM supplier")
_pipe("replace_root_merge", "customer", [{"$addFields": {"info": {"key": "$c_custkey", "name": "$c_name"}}}, {"$replaceRoot": {"newRoot": {"$mergeObjects": ["$info", {"segment": "$c_mktsegment"}]}}}], "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer")
_pipe("replace_with_path", "customer", [{"$set": {"in.key": "$c_custkey", "in.balance": "$c_acctbal"}}, {"$replaceWith": "$in"}], "SELECT c_custkey AS key, c_acctbal AS balance FROM customer")
_pipe("redact_levels", "customer", [{"$project": {"c_custkey": 1, "level": "$c_nationkey", "inner": {"level": {"$mod": ["$c_custkey", 20]}, "balance": "$c_acctbal"}}}, {"$redact": {"$cond": [{"$lte": ["$level", 12]}, "$$DESCEND", "$$PRUNE"]}}], "SELECT c_custkey, c_nationkey AS level, CASE WHEN c_custkey % 20 <= 12 THEN c_acctbal END AS balance FROM customer WHERE c_nationkey <= 12", lambda df: df.select("c_custkey", "level", F.col("inner.balance").alias("balance")))


@query("SELECT p_partkey, i - 1 AS at, w AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def unwind_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("word"))
    return aggregate(part, [{"$unwind": {"path": "$word", "includeArrayIndex": "at"}}]).withColumn("at", F.col("at").cast("long"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w")
def unwind_word_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.split("text", " ").alias("words"))
    return aggregate(docs, [{"$unwind": "$words"}, {"$group": {"_id": "$words", "n": {"$sum": 1}}}]).withColumnRenamed("_id", "word")


@query("SELECT DISTINCT l_shipdate FROM lineitem WHERE l_quantity > 49")
def distinct_values(spark, sf_dir):
    return grouping.distinct(find(table(spark, sf_dir, "lineitem"), {"l_quantity": {"$gt": 49}}), "l_shipdate")


# Sort, limit, sample

_find("sort_multi", "orders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders", sort={"o_orderpriority": 1, "o_totalprice": -1}, projection={"o_orderkey": 1, "o_orderpriority": 1, "o_totalprice": 1})
_find("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", sort={"o_totalprice": -1, "o_orderkey": 1}, limit=25, projection={"o_orderkey": 1, "o_totalprice": 1})
_find("skip_limit_page", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 120", sort={"o_orderdate": 1, "o_orderkey": 1}, skip=120, limit=40, projection={"o_orderkey": 1})
_pipe("sample_size", "lineitem", [{"$sample": {"size": 100, "seed": 7}}, {"$count": "n"}], "SELECT 100::BIGINT AS n", lambda df: df.select("n"))

# Groups

_pipe("group_sum_avg_min_max", "lineitem", [{"$group": {"_id": "$l_returnflag", "total": {"$sum": "$l_extendedprice"}, "mean": {"$avg": "$l_quantity"}, "low": {"$min": "$l_shipdate"}, "high": {"$max": "$l_discount"}, "n": {"$count": {}}}}], "SELECT l_returnflag AS flag, round(sum(l_extendedprice), 1) AS total, round(avg(l_quantity), 4) AS mean, min(l_shipdate) AS low, max(l_discount) AS high, count(*) AS n FROM lineitem GROUP BY 1", lambda df: df.select(F.col("_id").alias("flag"), F.round("total", 1).alias("total"), F.round("mean", 4).alias("mean"), "low", "high", "n"))
_pipe("group_null_key", "lineitem", [{"$group": {"_id": None, "revenue": {"$sum": {"$multiply": ["$l_extendedprice", "$l_discount"]}}, "n": {"$sum": 1}}}], "SELECT round(sum(l_extendedprice * l_discount), 1) AS revenue, count(*) AS n FROM lineitem", lambda df: df.select(F.round("revenue", 1).alias("revenue"), "n"))
_pipe("group_compound", "orders", [{"$group": {"_id": {"s": "$o_orderstatus", "p": "$o_orderpriority"}, "n": {"$sum": 1}, "twice": {"$sum": 2}}}], "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, 2 * count(*) AS twice FROM orders GROUP BY 1, 2", lambda df: df.select("_id.*", "n", "twice"))
_pipe("group_first_last", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_totalprice"}}}], "SELECT o_custkey AS cust, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1", lambda df: df.withColumnRenamed("_id", "cust"))
_pipe("group_push", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}], "SELECT o_custkey AS cust, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS keys FROM orders GROUP BY 1", lambda df: df.select(F.col("_id").alias("cust"), F.array_join("keys", ",").alias("keys")))
_pipe("group_add_to_set", "lineitem", [{"$sort": {"l_shipdate": 1}}, {"$group": {"_id": "$l_suppkey", "flags": {"$addToSet": "$l_returnflag"}}}], "SELECT l_suppkey AS supp, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1", lambda df: df.select(F.col("_id").alias("supp"), F.array_join(F.array_sort("flags"), ",").alias("flags")))
_pipe("group_having_top", "lineitem", [{"$group": {"_id": "$l_partkey", "qty": {"$sum": "$l_quantity"}}}, {"$match": {"qty": {"$gt": 100}}}, {"$sort": {"qty": -1, "_id": 1}}, {"$limit": 50}], "SELECT l_partkey AS part, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 100 ORDER BY qty DESC, part LIMIT 50", lambda df: df.withColumnRenamed("_id", "part"))


@query("SELECT event_type AS type, round(avg(coalesce(CASE WHEN value > 10 THEN value END, 0)), 4) AS mean, round(sum(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)), 2) AS total FROM events GROUP BY 1")
def avg_zero_fill(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({"v": F.when(F.col("value") > 10, F.col("value")), "k": F.get_json_object("props", "$.k")})
    out = aggregate(events, [{"$group": {"_id": "$event_type", "mean": {"$avg": "$v"}, "total": {"$sum": "$k"}}}])
    return out.select(F.col("_id").alias("type"), F.round("mean", 4).alias("mean"), F.round("total", 2).alias("total"))


_pipe("sort_by_count", "orders", [{"$sortByCount": "$o_orderpriority"}], "SELECT o_orderpriority AS _id, count(*) AS count FROM orders GROUP BY 1")
_pipe("count_stage", "lineitem", [{"$match": {"l_quantity": {"$lt": 0}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0", lambda df: df.select("n"))
_pipe("bucket_sizes", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 20, 35], "default": -1, "output": {"n": {"$sum": 1}, "mean": {"$avg": "$p_retailprice"}}}}], "SELECT CASE WHEN p_size >= 0 AND p_size < 10 THEN 0 WHEN p_size >= 10 AND p_size < 20 THEN 10 WHEN p_size >= 20 AND p_size < 35 THEN 20 ELSE -1 END AS lower, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1", lambda df: df.select(F.col("_id").alias("lower"), "n", F.round("mean", 4).alias("mean")))
_pipe("bucket_auto", "customer", [{"$bucketAuto": {"groupBy": "$c_acctbal", "buckets": 7}}], """
WITH r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS i, count(*) OVER () AS n FROM customer),
b AS (SELECT i // CAST(ceil(n / 7.0) AS BIGINT) AS b, min(v) AS lo, max(v) AS hi, count(*) AS count FROM r GROUP BY 1)
SELECT lo AS min, coalesce(lead(lo) OVER (ORDER BY b), hi) AS max, count FROM b""", lambda df: df.select("_id.min", "_id.max", "count"))  # fmt: skip
_pipe("facet", "orders", [{"$facet": {"by_status": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}], "big": [{"$match": {"o_totalprice": {"$gt": 300000}}}, {"$count": "n"}]}}], "SELECT (SELECT count(DISTINCT o_orderstatus) FROM orders) AS statuses, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) AS big", lambda df: df.select(F.size("by_status").cast("long").alias("statuses"), F.get("big", 0)["n"].alias("big")))

# Joins

_pipe("lookup_equality", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}], "SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", lambda df: df.select("c_custkey", F.size("orders").cast("long").alias("n"), F.round(F.aggregate("orders", F.lit(0.0), lambda a, o: a + o["o_totalprice"]), 2).alias("total")), ("orders",))
_pipe("lookup_unwind", "nation", [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "region"}}, {"$unwind": "$region"}, {"$project": {"n_name": 1, "region": "$region.r_name"}}], "SELECT n_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey", others=("region",))
_pipe("lookup_pipeline", "customer", [{"$match": {"c_mktsegment": "BUILDING"}}, {"$lookup": {"from": "orders", "let": {"c": "$c_custkey", "b": "$c_acctbal"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$c"]}, {"$gt": ["$o_totalprice", {"$multiply": ["$$b", 10]}]}]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}, {"$project": {"o_orderkey": 1}}], "as": "top"}}], """
WITH r AS (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10 WHERE c_mktsegment = 'BUILDING')
SELECT c.c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k), '') AS top FROM customer c LEFT JOIN r ON r.c_custkey = c.c_custkey AND k <= 2 WHERE c_mktsegment = 'BUILDING' GROUP BY 1""", lambda df: df.select("c_custkey", F.array_join(F.transform("top", lambda t: t["o_orderkey"].cast("string")), ",").alias("top")), ("orders",))  # fmt: skip
_pipe("union_with", "nation", [{"$project": {"name": "$n_name"}}, {"$unionWith": {"coll": "region", "pipeline": [{"$project": {"name": "$r_name"}}]}}], "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", others=("region",))


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 4 END AS parent FROM orders),
w AS (SELECT id AS start, id, parent, 0 AS depth FROM e UNION ALL SELECT w.start, e.id, e.parent, w.depth + 1 FROM w JOIN e ON e.id = w.parent)
SELECT start AS o_orderkey, count(*) AS n, max(depth) AS deepest FROM w GROUP BY 1""")
def graph_lookup(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 4)).alias("parent"))
    out = aggregate(nodes, [{"$graphLookup": {"from": "nodes", "startWith": "$_id", "connectFromField": "parent", "connectToField": "_id", "as": "path", "depthField": "depth"}}], {"nodes": nodes})
    return out.select(F.col("_id").alias("o_orderkey"), F.size("path").cast("long").alias("n"), F.array_max(F.transform("path", lambda p: p["depth"])).cast("int").alias("deepest"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def populate_reference(spark, sf_dir):
    out = join.populate(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", key="c_custkey", select=["c_name"])
    return out.select("o_orderkey", F.col("o_custkey.c_name").alias("c_name"))


# Change logs: events as writes, by user


def _log(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "i").when(F.col("event_type") == "error", "d").otherwise("u")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("_id"), F.col("event_id").alias("_seq"), op.alias("_op"), F.col("ts").alias("_ts"), "event_type", "value")


_SQL_LOG = "log AS (SELECT user_id AS _id, event_id AS _seq, CASE event_type WHEN 'signup' THEN 'i' WHEN 'error' THEN 'd' ELSE 'u' END AS _op, ts AS _ts, event_type, value FROM events)"
_NEWEST = "SELECT _id, _seq, value FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY _seq DESC) AS r FROM log{where}) WHERE r = 1 AND _op <> 'd'"


@query(f"WITH {_SQL_LOG} " + _NEWEST.format(where=""))
def lww_dedup(spark, sf_dir):
    return versioned.latest(_log(spark, sf_dir)).select("_id", "_seq", "value")


@query(f"WITH {_SQL_LOG} " + _NEWEST.format(where=""))
def lww_unique_keys(spark, sf_dir):
    return versioned.latest(_log(spark, sf_dir), unique=True).select("_id", "_seq", "value")


_HALF = "(SELECT max(event_id) // 2 FROM events)"


def _half(log: DataFrame) -> int:
    """The number in the middle of a log."""
    return log.agg(F.max("_seq")).first()[0] // 2


@query(f"WITH {_SQL_LOG} " + _NEWEST.format(where=f" WHERE _seq <= {_HALF}"))
def as_of_sequence(spark, sf_dir):
    log = _log(spark, sf_dir)
    return versioned.as_of(log, seq=_half(log)).select("_id", "_seq", "value")


@query(f"WITH {_SQL_LOG} " + _NEWEST.format(where=" WHERE _ts <= TIMESTAMP '2024-01-05 00:00:00'"))
def as_of_time(spark, sf_dir):
    import datetime as dt

    return versioned.as_of(_log(spark, sf_dir), timestamp=dt.datetime(2024, 1, 5)).select("_id", "_seq", "value")


@query(f"""WITH {_SQL_LOG}, k AS (SELECT _id, count(*) AS n, arg_max(_op, _seq) AS last, count(*) FILTER (_op = 'i') AS i, count(*) FILTER (_op = 'u') AS u, count(*) FILTER (_op = 'd') AS d FROM log GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS input_rows, count(*) AS keys, CAST(sum(n) AS BIGINT) - count(*) AS duplicates, count(*) FILTER (last = 'd') AS deleted, count(*) FILTER (last <> 'd') AS output_rows,
CAST(sum(i) AS BIGINT) AS n_inserts, CAST(sum(u) AS BIGINT) AS n_updates, CAST(sum(d) AS BIGINT) AS n_deletes FROM k""")  # fmt: skip
def dedup_stats(spark, sf_dir):
    return versioned.dedup_stats(_log(spark, sf_dir))


@query(f"WITH {_SQL_LOG} SELECT _id, _seq, _op FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY _seq DESC) AS r FROM log) WHERE r = 1")
def compaction_keeps_tombstones(spark, sf_dir):
    return versioned.compact(_log(spark, sf_dir), whole=False).select("_id", "_seq", "_op")


@query(f"""WITH {_SQL_LOG}, e AS (SELECT *, lag(CASE WHEN _op <> 'd' THEN value END) OVER w AS before_value, lag(_op) OVER w AS before_op FROM log WINDOW w AS (PARTITION BY _id ORDER BY _seq))
SELECT _seq AS token, _id AS document_key, CASE _op WHEN 'i' THEN 'insert' WHEN 'd' THEN 'delete' ELSE 'update' END AS operation_type,
CASE WHEN _op = 'u' AND before_op IS NOT NULL AND before_op <> 'd' THEN value IS DISTINCT FROM before_value END AS value_updated FROM e""")  # fmt: skip
def change_events(spark, sf_dir):
    out = versioned.changes(_log(spark, sf_dir))
    return out.select("token", "document_key", "operation_type", F.array_contains("updated_fields", "value").alias("value_updated"))


@query(f"""WITH {_SQL_LOG}, base AS ({_NEWEST.format(where=f' WHERE _seq <= {_HALF}')}), own AS (SELECT * FROM log WHERE _seq > {_HALF} AND event_type <> 'click'),
shown AS (SELECT _id, _seq, _op, value FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY _seq DESC) AS r FROM own) WHERE r = 1)
SELECT _id, value FROM base WHERE _id NOT IN (SELECT _id FROM shown) UNION ALL SELECT _id, value FROM shown WHERE _op <> 'd'""")  # fmt: skip
def branch_scan(spark, sf_dir):
    log = _log(spark, sf_dir)
    half = _half(log)
    base = versioned.as_of(log, seq=half).select("_id", "value")
    branch = versioned.dedup(log.where((F.col("_seq") > half) & (F.col("event_type") != "click")), keep_deletes=True).select("_id", "_op", "value")
    return versioned.overlay(base, branch)


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"), "c_name", "c_acctbal", "c_mktsegment")
    main = base.where("_id % 11 <> 0").withColumn("c_acctbal", F.when(F.col("_id") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).unionByName(base.where("_id < 5").withColumn("_id", F.col("_id") + 10_000_000))
    branch = base.where("_id % 13 <> 0").withColumn("c_acctbal", F.when(F.col("_id") % 5 == 0, F.col("c_acctbal") - 1).otherwise(F.col("c_acctbal")))
    branch = branch.withColumn("c_mktsegment", F.when(F.col("_id") % 7 == 0, "NEW").otherwise(F.col("c_mktsegment"))).unionByName(base.where("_id < 3").withColumn("_id", F.col("_id") + 10_000_000))
    return base, main, branch


_SQL_VERSIONS = """base AS (SELECT c_custkey AS _id, c_name, c_acctbal, c_mktsegment FROM customer),
main AS (SELECT _id, c_name, CASE WHEN _id % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM base WHERE _id % 11 <> 0 UNION ALL SELECT _id + 10000000, c_name, c_acctbal, c_mktsegment FROM base WHERE _id < 5),
branch AS (SELECT _id, c_name, CASE WHEN _id % 5 = 0 THEN c_acctbal - 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN _id % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM base WHERE _id % 13 <> 0 UNION ALL SELECT _id + 10000000, c_name, c_acctbal, c_mktsegment FROM base WHERE _id < 3)"""


def _sql_diff(side: str) -> str:
    return f"""SELECT coalesce(b._id, s._id) AS _id, CASE WHEN b._id IS NULL THEN 'insert' WHEN s._id IS NULL THEN 'delete' ELSE 'update' END AS change,
    CASE WHEN b._id IS NULL OR s._id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.c_acctbal <> s.c_acctbal THEN 'c_acctbal' END, CASE WHEN b.c_mktsegment <> s.c_mktsegment THEN 'c_mktsegment' END) END AS fields
    FROM base b FULL JOIN {side} s ON b._id = s._id WHERE b._id IS NULL OR s._id IS NULL OR b.c_acctbal <> s.c_acctbal OR b.c_mktsegment <> s.c_mktsegment"""  # fmt: skip


@query(f"WITH {_SQL_VERSIONS} {_sql_diff('branch')}")
def branch_diff(spark, sf_dir):
    base, _, branch = _versions(spark, sf_dir)
    return versioned.diff(base, branch).select("_id", "change", F.array_join("changed_fields", ",").alias("fields"))


@query(f"""WITH {_SQL_VERSIONS}, m AS ({_sql_diff('main')}), n AS ({_sql_diff('branch')}), j AS (SELECT m._id, m.change AS a, n.change AS b, m.fields AS fa, n.fields AS fb FROM m JOIN n ON m._id = n._id),
t AS (SELECT _id, CASE WHEN a = 'delete' AND b = 'delete' THEN NULL WHEN a = 'delete' AND b = 'update' THEN 'DELETE_UPDATE' WHEN a = 'update' AND b = 'delete' THEN 'UPDATE_DELETE' WHEN a = 'insert' AND b = 'insert' THEN 'DUPLICATE_INSERT'
WHEN contains(fa, 'c_acctbal') AND contains(fb, 'c_acctbal') THEN 'FIELD_CONFLICT' END AS type FROM j)
SELECT _id, type, CASE type WHEN 'DUPLICATE_INSERT' THEN 'high' WHEN 'FIELD_CONFLICT' THEN 'low' ELSE 'medium' END AS severity FROM t WHERE type IS NOT NULL""")  # fmt: skip
def conflict_types(spark, sf_dir):
    base, main, branch = _versions(spark, sf_dir)
    return versioned.conflicts(versioned.diff(base, main), versioned.diff(base, branch)).select("_id", "type", "severity")


@query(f"""WITH {_SQL_VERSIONS} SELECT coalesce(m._id, n._id) AS _id, CASE WHEN b._id IS NULL THEN coalesce(m.c_acctbal, n.c_acctbal) WHEN m._id % 3 = 0 THEN m.c_acctbal ELSE coalesce(n.c_acctbal, m.c_acctbal) END AS c_acctbal,
CASE WHEN b._id IS NULL THEN coalesce(m.c_mktsegment, n.c_mktsegment) ELSE coalesce(n.c_mktsegment, m.c_mktsegment) END AS c_mktsegment
FROM base b FULL JOIN main m ON b._id = m._id FULL JOIN branch n ON coalesce(b._id, m._id) = n._id
WHERE b._id IS NULL OR (m._id IS NOT NULL AND (n._id IS NOT NULL OR m._id % 3 = 0))""")  # fmt: skip
def three_way_merge(spark, sf_dir):
    return versioned.three_way_merge(*_versions(spark, sf_dir)).select("_id", "c_acctbal", "c_mktsegment")


# Updates


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'vip' END AS grade, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS c_name FROM customer")
def update_set_inc_unset(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    out = apply_update(customer, {"$set": {"grade": "vip"}, "$inc": {"c_acctbal": 100}, "$unset": {"c_name": ""}}, F.col("c_mktsegment") == "BUILDING")
    return out.select("c_custkey", "c_acctbal", "grade", "c_name")


@query("SELECT p_partkey, CASE WHEN len(ws) >= 2 THEN array_to_string(list_slice(ws, 2, len(ws)), ' ') || ' new' ELSE 'new' END AS words FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)")
def update_arrays(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    out = apply_update(apply_update(part, {"$pop": {"words": -1}}), {"$push": {"words": "new"}})
    return apply_update(out, {"$addToSet": {"words": "new"}}).withColumn("words", F.array_join("words", " "))


# Search


_SQL_TOKENS = """toks AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 2 AND t NOT IN (""" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + """))) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2), len AS (SELECT doc_id, count(*) AS n FROM toks GROUP BY 1)"""


@query(f"""WITH {_SQL_TOKENS}, df AS (SELECT term, count(*) AS df FROM post WHERE term IN ('tion', 'onth') GROUP BY 1)
SELECT p.doc_id, round(sum(tf / n * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 6) AS score FROM post p JOIN df USING (term) JOIN len USING (doc_id) GROUP BY 1""")
def text_tfidf(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), "doc_id", ["text"], "tion onth").withColumn("score", F.round("score", 6))


@query(f"""WITH {_SQL_TOKENS} SELECT doc_id FROM len WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'er') AND doc_id IN (SELECT doc_id FROM post WHERE term = 'tion') AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'onth')""")
def text_phrase_negation(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), "doc_id", ["text"], '"tion er" -onth').select("doc_id")


def _points(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array((key * 7 % 360 - 180).cast("double"), (key * 13 % 180 - 90).cast("double")).alias("location"))


_SQL_POINTS = "pts AS (SELECT c_custkey, CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 13 % 180 - 90 AS DOUBLE) AS lat FROM customer)"


@query(f"""WITH {_SQL_POINTS}, d AS (SELECT c_custkey, least(1.0, pow(sin(radians(52 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52)) * pow(sin(radians(13 - lon) / 2), 2)) AS a FROM pts)
SELECT c_custkey, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 3) AS distance FROM d WHERE 2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)) <= 2000000""")
def geo_near(spark, sf_dir):
    return geo.near(_points(spark, sf_dir), "location", [13, 52], max_distance=2_000_000).select("c_custkey", F.round("distance", 3).alias("distance"))


@query(f"WITH {_SQL_POINTS} SELECT c_custkey FROM pts WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN 10 AND 60")
def geo_within_box(spark, sf_dir):
    return find(_points(spark, sf_dir), {"location": {"$geoWithin": {"$box": [[-20, 10], [40, 60]]}}}, {"c_custkey": 1})


@query(f"WITH {_SQL_POINTS} SELECT c_custkey FROM pts WHERE lat > 0.5 AND lat < 60.5 AND lon > -30.5 AND lon < 30.5 - lat")
def geo_within_polygon(spark, sf_dir):
    ring = [[-30.5, 0.5], [30, 0.5], [-30, 60.5], [-30.5, 60.5]]
    return find(_points(spark, sf_dir), {"location": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [ring]}}}}, {"c_custkey": 1})


@query(f"WITH {_SQL_POINTS} SELECT c_custkey FROM pts WHERE sqrt(pow(lon - 5, 2) + pow(lat - 5, 2)) BETWEEN 10 AND 30")
def geo_near_planar(spark, sf_dir):
    return find(_points(spark, sf_dir), {"location": {"$near": [5, 5], "$minDistance": 10, "$maxDistance": 30}}, {"c_custkey": 1})


# Schemas


@query("SELECT 'k' AS path, count(*) AS count, 1.0::DOUBLE AS frequency, 'number' AS dominant, count(*) FILTER (json_type(props, '$.k') = 'NULL')::BIGINT AS nulls FROM events")
def schema_profile(spark, sf_dir):
    return schema.profile(table(spark, sf_dir, "events"), "props").select("path", "count", "frequency", "dominant", "nulls")


@query("SELECT 'k' AS path, 'number' AS type")
def schema_promotions(spark, sf_dir):
    return schema.suggest_promotions(schema.profile(table(spark, sf_dir, "events"), "props")).select("path", "type")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def schema_promote(spark, sf_dir):
    return schema.promote(table(spark, sf_dir, "events"), "props", {"k": "number"}).select("event_id", "k")


@query("SELECT 'event_id' AS field, count(*) AS rows, count(*) - count(event_id) AS nulls FROM events UNION ALL SELECT 'value', count(*), count(*) - count(value) FROM events")
def null_ratio(spark, sf_dir):
    return schema.null_ratios(table(spark, sf_dir, "events").select("event_id", "value")).drop("ratio")


@query("SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, 'none' AS note FROM supplier")
def schema_evolve(spark, sf_dir):
    target = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_nationkey", T.LongType()), T.StructField("note", T.StringType())])
    return schema.evolve(table(spark, sf_dir, "supplier"), target, {"note": "none"})


@query("SELECT c_custkey, (c_acctbal < 0)::INT + (c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))::INT AS errors FROM customer")
def schema_validation(spark, sf_dir):
    rules = {"required": ["c_custkey"], "properties": {"c_acctbal": {"type": "number", "minimum": 0}, "c_mktsegment": {"type": "string", "enum": ["BUILDING", "MACHINERY"]}}}
    customer = table(spark, sf_dir, "customer")
    return customer.select("c_custkey", F.size(schema.validation_errors(customer, rules)).alias("errors"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("doc", F.parse_json("props"))
    return events.select("event_id", F.try_variant_get("doc", "$.k", "string").alias("k"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, sf_dir):
    from tessera.streaming.changes import windowed_counts

    out = windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return out.select(F.col("window.start").alias("hour"), "event_type", "n")


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS keys, 1 AS shards_per_key, true AS in_range FROM events")
def shard_balance(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("shard", versioned.shard_of(F.col("user_id")))
    per_key = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("shards"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    return per_key.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.max("shards").cast("int").alias("shards_per_key"), ((F.min("low") >= 0) & (F.max("high") < 16)).alias("in_range"))
