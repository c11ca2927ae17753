"""What the two vector searches share: valid vectors, a bounded seed, and a grid of tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, quoted


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, dim, vec as doubles) of the rows that take part: no null or non-finite component, an
    id, at least one dimension and, unless `zero`, some component that isn't 0."""
    v = F.col("vec")
    out = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vec_col)).cast("array<double>").alias("vec"))
    out = out.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    out = out.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.select("id", F.size(v).alias("dim"), "vec")


def counted(rows: DataFrame) -> DataFrame:
    """(id, copy, dim, vec, times): rows with the same id and vector are one from here on, so that no repeated row
    fills a tile. `copy` tells an id's vectors apart."""
    return rows.groupBy("id", F.xxhash64("vec").alias("copy"), "dim", "vec").agg(F.count(F.lit(1)).alias("times"))


def seed_rows(rows: DataFrame, n: int, *order: Column) -> list:
    """At most n rows (id, vec), the same ones on each run: the first by the given order, then a hash of the id."""
    return rows.orderBy(*order, F.xxhash64("id"), "id", "copy").limit(n).select("id", "vec").collect()


def dealt(rows: DataFrame, sizes: DataFrame, keys: list[str], block: int, tile: str) -> tuple[DataFrame, DataFrame]:
    """rows with a tile number, and `sizes` (the keys, n, ...) with the number of tiles: each has about `block` rows.
    `sizes` must be small, as it is broadcast."""
    sizes = materialize(sizes.withColumn(f"{tile}s", F.ceil(F.col("n") / block).cast("int")))
    out = rows.join(F.broadcast(sizes.select(*keys, f"{tile}s")), keys)
    return out.withColumn(tile, F.pmod(F.xxhash64("id", "copy", F.lit(tile)), F.col(f"{tile}s")).cast("int")).drop(f"{tile}s"), sizes


def filled(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows with small groups of a dimension put together with their neighbours, until they hold `block` rows; a group is then named by its first.
    There are few groups (`group` is a bounded number), so their sizes are a small table."""
    sizes = rows.groupBy("dim", group).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = sizes.withColumn("part", F.floor(before / block))
    to = materialize(part.withColumn("to", F.min(group).over(Window.partitionBy("dim", "part"))).select("dim", group, "to"))
    return rows.join(F.broadcast(to), ["dim", group]).drop(group).withColumnRenamed("to", group)


def grid(candidates: DataFrame, queries: DataFrame, pairs: DataFrame, own: list[str], asked: list[str], run: Callable, schema: str) -> DataFrame:
    """Each tile of candidates meets each tile of queries of the groups that `pairs` (small: broadcast) brings together, each pair in a task's
    group of its own. `own` and `asked` are the columns of `pairs` that name the groups; it also has the numbers of tiles (tiles, qtiles)."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # New names for columns that come from one table on both sides.
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    left = candidates.join(F.broadcast(fresh(pairs.drop("tiles"))), own).withColumn("qtile", numbers("qtiles")).drop("qtiles")
    right = queries.join(F.broadcast(fresh(pairs.drop("qtiles"))), asked).withColumn("tile", numbers("tiles")).drop("tiles")
    keys = sorted({*own, *asked}) + ["tile", "qtile"]
    return fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best_rows(q: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int, smallest: bool = False) -> np.ndarray:
    """Indices of each query's k best, ties to smaller ids."""
    if not len(q):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((cid, score if smallest else -score, q))
    first = np.r_[True, q[order][1:] != q[order][:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < k]


def final_top(partial: DataFrame, k: int, ascending: bool) -> DataFrame:
    """The k best of each query (query_id, qcopy) from those found (vec_id, times, score); a row that occurs several times counts as often."""
    by = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("vec_id")]
    own = Window.partitionBy("query_id", "qcopy").orderBy(*by)
    first = partial.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k)
    each = first.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))))
    return each.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
