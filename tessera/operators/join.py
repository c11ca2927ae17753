"""Joins of documents: `$lookup`, `$graphLookup`, `populate` and `$unionWith`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expressions import Expressions
from tessera.functions.fields import Fields, set_path
from tessera.functions.filters import compile_filter
from tessera.plans.validation import InvalidQuery
from tessera.sources.scratch import materialize


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return all(_orderable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def _gather(df: DataFrame, key: list[Column], row: Column, name: str) -> DataFrame:
    """An array of rows for each key, in a fixed order where rows can be ordered."""
    items = F.collect_list(row)
    kind = df.select(row.alias("r")).schema["r"].dataType
    return df.groupBy(*key).agg((F.sort_array(items) if _orderable(kind) else items).alias(name))


def lookup(df: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, name: str) -> DataFrame:
    """Each row with the array of foreign rows whose field equals its own; none give an empty array. A missing or
    null field joins missing or null ones."""
    mine, other = Fields(df), Fields(foreign)
    rows = _gather(foreign, [other.col(foreign_field).alias("_fk")], _row(foreign), "_found")
    out = df.withColumn("_lk", mine.col(local_field)).join(rows, F.col("_lk").eqNullSafe(F.col("_fk")), "left")
    kind = rows.schema["_found"].dataType
    out = out.withColumn("_found", F.coalesce("_found", F.array().cast(kind)))
    return set_path(out, name, F.col("_found")).drop("_lk", "_fk", "_found")


def lookup_unwound(df: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, name: str, keep: bool) -> DataFrame:
    """`$lookup` followed by `$unwind` of its array as a plain join: nothing is gathered."""
    right = foreign.select(Fields(foreign).col(foreign_field).alias("_fk"), _row(foreign).alias("_found"))
    out = df.withColumn("_lk", Fields(df).col(local_field)).join(right, F.col("_lk").eqNullSafe(F.col("_fk")), "left" if keep else "inner")
    return set_path(out, name, F.col("_found")).drop("_lk", "_fk", "_found")


def lookup_pipeline(df: DataFrame, foreign: DataFrame, let: dict, stages: list, name: str) -> DataFrame:
    """`$lookup` with `let` and a sub-pipeline. It runs once for all rows: the distinct values of the variables
    are joined with the foreign rows that leading `$match` stages let through (equalities become join keys), and
    the later stages work for each of those values.
    """
    outer = Fields(df)
    names = list(let) or []
    values = {v: Expressions(outer)(let[v]) for v in names}
    key_struct = F.struct(*[values[v].alias(v) for v in names]) if names else F.struct(F.lit(1).alias("_all"))
    with_key = df.withColumn("_let", key_struct)
    keys = with_key.select(F.col("_let").alias("_key")).distinct()
    variables = {v: F.col("_key").getField(v) for v in names}
    joined, rest = None, list(stages)
    condition = F.lit(True)
    while rest and "$match" in rest[0]:
        fields = Fields(foreign)
        condition = condition & compile_filter(rest.pop(0)["$match"], fields, Expressions(fields, variables))
    joined = foreign.join(keys, condition) if names else foreign.where(condition).withColumn("_key", F.struct(F.lit(1).alias("_all")))
    sorted_ = False  # the column _order then holds each row's place among those of its key
    for stage in rest:
        ((op, spec),) = stage.items()
        if op == "$sort":
            by = [F.asc_nulls_first(k) if d in (1, "asc") else F.desc_nulls_last(k) for k, d in spec.items()]
            joined, sorted_ = joined.withColumn("_order", F.row_number().over(Window.partitionBy("_key").orderBy(*by))), True
        elif op in ("$limit", "$skip"):
            by = Window.partitionBy("_key").orderBy("_order" if sorted_ else F.lit(1))
            rank = joined.withColumn("_rank", F.row_number().over(by))
            joined = rank.where(F.col("_rank") <= spec if op == "$limit" else F.col("_rank") > spec).drop("_rank")
        elif op == "$match":
            fields = Fields(joined)
            joined = joined.where(compile_filter(spec, fields, Expressions(fields, variables)))
        elif op == "$project":
            from tessera.operators.shape import project

            inner = {"_key": "$_key"} | ({"_order": "$_order"} if sorted_ else {})
            joined = project(joined, spec | (inner if not all(v in (0, False) for v in spec.values()) else {}), variables)
        elif op in ("$addFields", "$set"):
            from tessera.operators.shape import add_fields

            joined = add_fields(joined, spec, variables)
        elif op == "$unset":
            from tessera.operators.shape import unset

            joined = unset(joined, spec)
        elif op == "$unwind":
            from tessera.operators.shape import unwind

            joined = unwind(joined, spec)
        elif op == "$count":
            joined, sorted_ = joined.groupBy("_key").agg(F.count(F.lit(1)).alias(spec)), False
        elif op == "$group":
            from tessera.functions.accumulators import Accumulators

            e = Expressions(Fields(joined), variables)
            make = Accumulators(e, joined.schema, strict_order=False)
            sorted_ = False
            joined = joined.groupBy("_key", e(spec["_id"]).alias("_id")).agg(*[make(a).alias(n) for n, a in spec.items() if n != "_id"])
        else:
            raise InvalidQuery(f"{op} is not available in a $lookup pipeline")
    row = F.struct(*[F.col(f"`{c}`") for c in joined.columns if c not in ("_key", "_order")])
    if sorted_:
        items = F.sort_array(F.collect_list(F.struct("_order", row.alias("row"))))
        found = joined.groupBy("_key").agg(F.transform(items, lambda s: s["row"]).alias("_found"))
    else:
        found = _gather(joined, [F.col("_key")], row, "_found")
    out = with_key.join(found, F.col("_let").eqNullSafe(F.col("_key")), "left")
    out = out.withColumn("_found", F.coalesce("_found", F.array().cast(found.schema["_found"].dataType)))
    return set_path(out, name, F.col("_found")).drop("_let", "_key", "_found")


def _by_level(frontier: DataFrame, edges: DataFrame, most: int, several: bool) -> DataFrame:
    """(start, node, depth) level by level. What was reached before is taken out by an anti join."""
    reached, depth = None, 0
    while True:
        found = frontier.join(edges, F.col("_value").eqNullSafe(F.col("_to"))).select("_start", "_node", "_from").distinct()
        if reached is not None:
            # The levels' rows differ already, but for arrays of references, which an anti join doesn't mind.
            done = reached.select(F.col("_start").alias("_s"), F.col("_node").alias("_n"))
            found = found.join(done, F.col("_start").eqNullSafe(F.col("_s")) & (F.col("_node") == F.col("_n")), "left_anti")
        level = materialize(found.withColumn("_depth", F.lit(depth).cast("long")))
        reached = level if reached is None else reached.unionByName(level)
        depth += 1
        if depth > most or level.isEmpty():
            break
        frontier = level.where(F.col("_from").isNotNull()).select("_start", F.col("_from").alias("_value"))
        frontier = frontier.distinct() if several else frontier
    reached = reached.select("_start", "_node", "_depth")
    return reached.distinct() if several else reached


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _doubled(edges: DataFrame, most: int) -> DataFrame:
    """(x, at, to): the walk, of `most` nodes at most, from each node that a row refers to, where each node leads to one node at most.

    Walks are arrays of keys that double in length each round, so a walk of length d takes log2(d) joins; those that have ended are
    not written again. Nodes that nothing refers to, as the leaves of a tree, have no walks here: one step leads from them to one. A
    walk ends before the first node that comes again.
    """
    named = edges.select(F.col("_from").alias("_x")).distinct()
    going = edges.join(named, F.col("_to") == F.col("_x"), "left_semi").select(F.col("_to").alias("_x"), F.array("_to").alias("_keys"), F.col("_from").alias("_z"))
    going, done = materialize(going), None
    while True:
        ended = going.where("_z IS NULL")
        done = ended if done is None else done.unionByName(ended)
        going = going.where("_z IS NOT NULL")
        if going.isEmpty():
            break
        more = done.unionByName(going).select(F.col("_x").alias("_y"), F.col("_keys").alias("_more"), F.col("_z").alias("_then"))
        both = going.join(more, F.col("_z") == F.col("_y"), "left")
        both = both.select("_x", "_then", F.when(F.col("_y").isNull(), F.col("_keys")).otherwise(F.concat("_keys", "_more")).alias("_all"))
        both = both.select("_x", "_then", "_all", F.array_distinct("_all").alias("_keys"))
        on = (F.size("_keys") == F.size("_all")) & (F.size("_keys") < most)
        going = materialize(both.select("_x", F.slice("_keys", 1, most).alias("_keys"), F.when(on, F.col("_then")).alias("_z")))
    return done.select("_x", F.posexplode("_keys").alias("_at", "_node"))


def _chains(own: DataFrame, edges: DataFrame, nodes: DataFrame, most: int, row: Callable[[Column], Column]) -> DataFrame:
    """own with `_found`: the node whose `_to` is `_start`, and the walk from the node that it refers to. Only walks of nodes that others
    refer to are gathered; each row of own meets two rows."""
    out = own.join(nodes.select(F.col("_to").alias("_s"), F.col("_from").alias("_z"), row(F.lit(0)).alias("_first")), F.col("_start").eqNullSafe(F.col("_s")), "left")
    none = F.array().cast(T.ArrayType(out.schema["_first"].dataType))
    found = F.when(F.col("_first").isNull(), none).otherwise(F.array("_first"))
    if most:
        walks = _doubled(edges, most).join(nodes, F.col("_node") == F.col("_to"))
        tails = walks.groupBy("_x").agg(F.collect_list(F.struct("_at", row(F.col("_at") + 1).alias("row"))).alias("_rest"), F.max_by("_node", "_at").alias("_end"))
        out = out.join(tails, F.col("_z") == F.col("_x"), "left")
        # A first node on a cycle comes again at the walk's end.
        length = F.size("_rest") - F.when(F.col("_end") == F.col("_s"), 1).otherwise(0)
        rest = F.transform(F.filter("_rest", lambda n: n["_at"] < length), lambda n: n["row"])
        found = F.concat(found, F.coalesce(rest, none))
    kind = out.schema["_first"].dataType
    return out.withColumn("_found", F.sort_array(found) if _orderable(kind) else found).drop("_s", "_z", "_first", "_x", "_rest", "_end")


def graph_lookup(df: DataFrame, foreign: DataFrame, spec: dict) -> DataFrame:
    """Each row with the foreign rows reached from its start value by following `connectFromField` to
    `connectToField`, each once, at its least depth.

    Walks from all rows advance together, by joins with the foreign rows; each round is written to the scratch folder, so
    nothing is computed twice.
    """
    fields, other = Fields(df), Fields(foreign)
    start = Expressions(fields)(spec["startWith"])
    most = spec.get("maxDepth", 100)
    if restrict := spec.get("restrictSearchWithMatch"):
        foreign = foreign.where(compile_filter(restrict, other, Expressions(other)))
        other = Fields(foreign)
    to_field, from_field, name, depth_field = spec["connectToField"], spec["connectFromField"], spec["as"], spec.get("depthField")
    own = df.withColumn("_start", start)
    array = isinstance(own.schema["_start"].dataType, T.ArrayType)
    node = F.col("_id").cast("string") if "_id" in foreign.columns else F.to_json(_row(foreign))
    edges = foreign.select(node.alias("_node"), other.col(to_field).alias("_to"), other.col(from_field).alias("_from"))
    several = isinstance(edges.schema["_from"].dataType, T.ArrayType)
    if several:
        edges = edges.withColumn("_from", F.explode_outer("_from"))
    columns = [F.col(f"`{c}`") for c in foreign.columns]
    row = lambda depth: F.struct(*columns, *([depth.cast("long").alias(depth_field)] if depth_field else []))
    kinds = [own.schema["_start"].dataType, edges.schema["_to"].dataType, edges.schema["_from"].dataType]
    if not several and not array and (all(map(_whole, kinds)) or len(set(kinds)) == 1):
        kind = "long" if _whole(kinds[0]) else kinds[0]
        typed = edges.select("_node", F.col("_to").cast(kind).alias("_to"), F.col("_from").cast(kind).alias("_from"))
        edges = materialize(typed)
        # One reference a row to one row, as in a tree by parents, and starts all over: then paths of all nodes double at once.
        # Keys mostly differ, so they are sorted: tables of counts would fill a task's memory.
        again = F.lag(F.lit(True)).over(Window.partitionBy("_to").orderBy("_to"))
        if edges.select(again.alias("_again")).where("_again").isEmpty() and own.agg(F.approx_count_distinct("_start")).first()[0] * 4 >= edges.count():
            nodes = foreign.select("*", other.col(to_field).cast(kind).alias("_to"), other.col(from_field).cast(kind).alias("_from"))
            out = _chains(own.withColumn("_start", F.col("_start").cast(kind)), edges.select("_to", "_from"), nodes, most, row)
            return set_path(out, name, F.col("_found")).drop("_start", "_found")
    else:
        edges = materialize(edges)
    seeds = own.select("_start").distinct()
    frontier = seeds.select("_start", (F.explode_outer("_start") if array else F.col("_start")).alias("_value"))
    reached = _by_level(frontier, edges, most, several)
    nodes = foreign.withColumn("_node", node)
    rows = reached.join(nodes, "_node")
    gathered = _gather(rows, [F.col("_start").alias("_s")], row(F.col("_depth")), "_found")
    out = own.join(gathered, F.col("_start").eqNullSafe(F.col("_s")), "left")
    out = out.withColumn("_found", F.coalesce("_found", F.array().cast(gathered.schema["_found"].dataType)))
    return set_path(out, name, F.col("_found")).drop("_start", "_s", "_found")


def populate(df: DataFrame, foreign: DataFrame, path: str, key: str = "_id", select: list[str] | None = None, match: dict | None = None) -> DataFrame:
    """Replaces references by the rows they refer to: one reference by its row (null if there is none), an array by
    the rows found, in its order."""
    if match:
        fields = Fields(foreign)
        foreign = foreign.where(compile_filter(match, fields))
    right = foreign.select(F.col(key).alias("_fk"), F.struct(*[F.col(c) for c in (select or foreign.columns)]).alias("_found")).dropDuplicates(["_fk"])
    if not isinstance(Fields(df).type_of(path), T.ArrayType):
        out = df.withColumn("_ref", Fields(df).col(path)).join(right, F.col("_ref") == F.col("_fk"), "left")
        return set_path(out, path, F.col("_found")).drop("_ref", "_fk", "_found")
    refs = df.withColumn("_refs", Fields(df).col(path))
    distinct = refs.select("_refs").distinct()
    items = distinct.select("_refs", F.posexplode("_refs").alias("_at", "_ref")).join(right, F.col("_ref") == F.col("_fk"))
    found = items.groupBy("_refs").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_found"))), lambda s: s["_found"]).alias("_rows")).withColumnRenamed("_refs", "_k")
    out = refs.join(found, F.col("_refs").eqNullSafe(F.col("_k")), "left")
    return set_path(out, path, F.coalesce("_rows", F.array().cast(found.schema["_rows"].dataType))).drop("_refs", "_k", "_rows")


def union_with(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other, allowMissingColumns=True)
