"""Grouping stages: `$group`, `$count`, `$sortByCount`, `$bucket`, `$bucketAuto`, `$facet`, `distinct`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.accumulators import Accumulators
from tessera.functions.expressions import Expressions
from tessera.functions.fields import Fields
from tessera.plans.validation import InvalidQuery
from tessera.sources.scratch import materialize, with_rank

Order = list[tuple[Column, bool, T.DataType]]


def group(df: DataFrame, spec: dict, order: Order | None = None, variables: dict | None = None, sql_avg: bool = False, stringify_ids: bool = False) -> DataFrame:
    """Rows by `_id` with accumulators. An `_id` of null is one group, and no row comes of no input. Keys
    keep their types unless `stringify_ids`; a missing key and null are one group."""
    fields = Fields(df)
    expressions = Expressions(fields, variables)
    make = Accumulators(expressions, df.schema, order, sql_avg)
    columns = [make(acc).alias(name) for name, acc in spec.items() if name != "_id"]
    key = spec.get("_id")
    if key is None:
        return df.groupBy(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("_rows"), *columns).select(F.lit(None).cast("string").alias("_id"), *[F.col(f"`{n}`") for n in spec if n != "_id"])
    made = expressions(key)
    if stringify_ids and isinstance(key, str) and key.startswith("$"):
        made = made.cast("string")
    return df.groupBy(made.alias("_id")).agg(*(columns or [F.count(F.lit(1)).alias("_rows")])).drop(*([] if columns else ["_rows"]))


def count(df: DataFrame, name: str) -> DataFrame:
    """One row with the number of rows, even of none."""
    return df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(None).cast("string").alias("_id"), name)


def sort_by_count(df: DataFrame, spec: object) -> DataFrame:
    key = Expressions(Fields(df))(spec)
    return df.groupBy(key.alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("_id"))


def bucket(df: DataFrame, spec: dict, order: Order | None = None) -> DataFrame:
    """Rows by the interval [lower, upper) that holds the value; others go to `default` if given, which then
    has a row even if empty, or else are dropped. Other empty intervals have no row."""
    edges, default = spec["boundaries"], spec.get("default")
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise InvalidQuery("boundaries must ascend, two at least")
    fields = Fields(df)
    value = Expressions(fields)(spec["groupBy"])
    text = default is not None and isinstance(default, str) != isinstance(edges[0], str)
    lit = lambda x: F.lit(str(x) if text else x)
    key = F.lit(None)
    for low, high in reversed(list(zip(edges, edges[1:]))):
        key = F.when((value >= F.lit(low)) & (value < F.lit(high)), lit(low)).otherwise(key)
    key = F.coalesce(key, lit(default)) if default is not None and default != "" else key
    make = Accumulators(Expressions(fields), df.schema, order)
    output = spec.get("output") or {"count": {"$sum": 1}}
    columns = [make(acc).alias(name) for name, acc in output.items()]
    rows = df.withColumn("_bucket", key).where(F.col("_bucket").isNotNull())
    out = rows.groupBy(F.col("_bucket").alias("_id")).agg(*columns)
    if default is None or default == "":
        return out
    empty = df.limit(0).agg(*columns).select(lit(default).cast(out.schema["_id"].dataType).alias("_id"), *output)
    return out.unionByName(empty.join(out.select("_id").where(F.col("_id") == lit(default)), "_id", "left_anti"))


def bucket_auto(df: DataFrame, spec: dict, order: Order | None = None) -> DataFrame:
    """Up to `buckets` chunks of equally many rows by value; rows without a number are dropped. `_id` is {min, max}, where max
    is the next chunk's least value, and the last chunk's own greatest."""
    n = int(spec["buckets"])
    value = Expressions(Fields(df))(spec["groupBy"])
    rows = df.withColumn("_v", value).where(F.col("_v").isNotNull())
    if not isinstance(rows.schema["_v"].dataType, T.NumericType):
        rows = rows.where(F.lit(False))
    ranked = with_rank(rows, "_rank", F.col("_v"))
    total = ranked.count()
    size = max(1, -(-total // n))
    ranked = ranked.withColumn("_chunk", F.floor((F.col("_rank") - 1) / size))
    make = Accumulators(Expressions(Fields(df)), df.schema, order, strict_order=False)
    output = spec.get("output") or {"count": {"$sum": 1}}
    made = ranked.groupBy("_chunk").agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), *[make(a).alias(k) for k, a in output.items()])
    # At most `buckets` rows are left, so looking up the next one's minimum is a small join.
    after = made.select((F.col("_chunk") - 1).alias("_chunk"), F.col("_min").alias("_next")).where(F.col("_chunk") < n - 1)
    made = made.join(F.broadcast(after), "_chunk", "left").orderBy("_chunk")
    return made.select(F.struct(F.col("_min").alias("min"), F.coalesce("_next", "_max").alias("max")).alias("_id"), *output)


def facet(df: DataFrame, branches: dict[str, list], run: Callable[[DataFrame, list], DataFrame]) -> DataFrame:
    """One row with an array of results for each branch. The input is written once and read by all."""
    shared, out = materialize(df), None
    for name, stages in branches.items():
        made = run(shared, stages)
        one = made.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in made.columns])).alias(name))
        # Each side is one row.
        out = one if out is None else out.crossJoin(one)
    return out.select(F.lit(None).cast("string").alias("_id"), *branches)


def distinct(df: DataFrame, path: str) -> DataFrame:
    return df.select(Fields(df).col(path).alias(path.split(".")[-1])).distinct()


def sample(df: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """`size` rows at random; all if there are fewer, none if size is not positive."""
    return df.orderBy(F.rand(seed)).limit(max(0, size))
