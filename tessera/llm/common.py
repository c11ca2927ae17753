"""What the operators of this subpackage share: tables, durable intermediate results, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. A local session without one gets a temporary folder;
    on a cluster a folder of one machine would not do, so there it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession) -> str:
    """A new folder name for an intermediate table. The file system deletes it when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, so later jobs neither
    recompute it nor depend on one executor's disk."""
    path = f"{scratch_path(df.sparkSession)}/table"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def wrapped(df: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """df's rows as one struct column `row`, so that an operator's own columns can't clash with theirs."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns if c not in without]).alias("row"))


def unwrapped(df: DataFrame, **added: Column) -> DataFrame:
    """The columns of the struct `row` again, and those added; an added one replaces one of the same name."""
    fields = [f.name for f in df.schema["row"].dataType.fields]
    return df.select(*[added[c].alias(c) if c in added else F.col(f"row.{quoted(c)}") for c in fields], *[v.alias(k) for k, v in added.items() if k not in fields])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def each_as_bytes(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """The same one by one, with few of them in memory."""
    for at in range(0, len(column), rows):
        yield from as_bytes(column.slice(at, rows))


def slices(batch: pa.RecordBatch, text: int, rows: int = 500, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few rows and few bytes of text (or one long row), so that what a task
    makes of them stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def map_text(df: DataFrame, text_col: str, added: str, make: Callable[[pa.Array], list[pa.Array]], keep_text: bool = True, done: Callable[[], None] | None = None) -> DataFrame:
    """df with columns made from its text, which goes to `make` a part of a batch at a time, so that what a task makes of it stays
    small; `done` is called at the end of a partition. An added column replaces one of the same name."""
    new = T._parse_datatype_string(added).fields
    names = {f.name for f in new}
    text = F.col(quoted(text_col)).cast("string")
    is_text = df.schema[text_col].dataType == T.StringType()
    kept = [f for f in df.schema.fields if f.name not in names and (keep_text or f.name != text_col)]
    # The text comes first, and again only if it isn't a string and is kept.
    again = [f for f in kept if f.name != text_col or not is_text]
    rows = df.select(text.alias("0"), *[F.col(quoted(f.name)).alias(str(i)) for i, f in enumerate(again, 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, rows=2000)):
            own = {f.name: c for f, c in zip(again, batch.columns[1:])}
            yield pa.RecordBatch.from_arrays([*(own.get(f.name, batch.column(0)) for f in kept), *make(batch.column(0))], [str(i) for i in range(len(kept) + len(new))])
        if done:
            done()
        # The worker may idle for long with what it held.
        pa.default_memory_pool().release_unused()

    fields = [T.StructField(str(i), f.dataType, True) for i, f in enumerate([*kept, *new])]
    return rows.mapInArrow(run, T.StructType(fields)).toDF(*[f.name for f in [*kept, *new]])


def words_ascii_lower(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased; other letters stay."""
    return text.lower().split()


def hot_join(edges: DataFrame, key: str, other: str, values: DataFrame, value: str, salts: int = 32) -> DataFrame:
    """edges with the column `value` of the table (key, value), null where it has no such key.

    A key may hold any share of the edges, so these are dealt by the key and a salt from their other end. The value
    goes to each (key, salt) that occurs, at most `salts` rows a key, and from there to the edges.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int"))
    places = salted.select(key, "salt").distinct().join(values, key)
    return salted.join(places, [key, "salt"], "left").select(*edges.columns, value)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps. Both take minima with map-side partial
    aggregation, and a hub's edges get them dealt over many groups; each round is
    written to the shared folder. Nothing but a count and a checksum comes to the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    cur = materialize(edges)
    seen = None
    for _ in range(max_rounds):
        # Large star: each neighbour above a node goes to the least of the node and its neighbours.
        low = cur.groupBy("u").agg(F.min("v").alias("m"))
        large = hot_join(cur, "v", "u", low.withColumnRenamed("u", "v"), "m").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: a node and its lower neighbours go to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = hot_join(large, "u", "v", low, "m")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = materialize(small.select("e.u", "e.v").where("u != v").distinct())
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast(T.DecimalType(38, 0)))).first()
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("connected components did not converge")
    # At rest every edge leads from a node to its component.
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
