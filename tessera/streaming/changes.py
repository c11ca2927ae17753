"""Change feeds and merges over growing change logs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.expressions import Expressions
from tessera.functions.fields import Fields
from tessera.functions.filters import compile_filter


def watch(spark: SparkSession, path: str, schema: T.StructType, query: dict | None = None, after_seq: int | None = None, seq: str = "_seq", op: str = "_op") -> DataFrame:
    """A streaming frame of the log's rows with their operation type. The checkpoint of the sink resumes it; `after_seq` replays
    from a sequence number."""
    rows = spark.readStream.schema(schema).parquet(path)
    rows = rows.withColumn("operation_type", F.when(F.col(op) == "i", "insert").when(F.col(op) == "d", "delete").when(F.col(op) == "r", "replace").otherwise("update"))
    if after_seq is not None:
        rows = rows.where(F.col(seq) > after_seq)
    if query:
        fields = Fields(rows)
        rows = rows.where(compile_filter(query, fields, Expressions(fields)))
    return rows


def update_descriptions(rows: DataFrame, key: str = "_id", seq: str = "_seq", op: str = "_op", payload: list[str] | None = None) -> DataFrame:
    """For each change of a streaming log, which fields were updated and which were removed since the key's previous
    row. The previous row is keyed state, so a change may come in a later batch than the one before. All of a key's changes within one micro-batch are sorted
    in a task's memory: where one key may hold much of a batch, use `describe_batches`."""
    payload = payload or [c for c in rows.columns if c not in (key, seq, op)]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    state_schema = T.StructType([T.StructField("there", T.BooleanType()), *[T.StructField(c, kinds[c]) for c in payload]])
    out_schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(seq, T.LongType()), T.StructField("operation_type", T.StringType()), T.StructField("updated_fields", T.ArrayType(T.StringType())), T.StructField("removed_fields", T.ArrayType(T.StringType()))])

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (False, *[None] * len(payload))
        clean = lambda v: None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else v
        # All frames of a key's batch are one micro-batch's changes of one key.
        rows = pd.concat(list(frames)).sort_values(seq)
        out = []
        for r in rows.to_dict("records"):
            now = (r[op] != "d", *[clean(r[c]) if r[op] != "d" else None for c in payload])
            changed = [c for i, c in enumerate(payload, 1) if before[0] and now[0] and before[i] != now[i]]
            out.append((k[0], r[seq], {"i": "insert", "d": "delete"}.get(r[op], "update"), [c for c in changed if now[payload.index(c) + 1] is not None], [c for c in changed if now[payload.index(c) + 1] is None]))
            before = now
        state.update(before)
        yield pd.DataFrame(out, columns=[f.name for f in out_schema.fields])

    return rows.groupBy(key).applyInPandasWithState(run, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def describe_batches(folder: str, write: Callable[[DataFrame], None], key: str = "_id", seq: str = "_seq", op: str = "_op") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that gives `write` the change events of each batch, with descriptions of updates against the row before, from
    whichever batch. Each key's newest row is kept as a table under `folder`, a new one a batch, so a batch repeated after
    a failure reads the same one as the first time. Rows are ranked by Spark, so no key's changes are gathered in a task's memory."""
    from tessera.operators.versioned import changes, latest
    from tessera.sources.folders import Folder

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = Folder(spark, f"{folder}/{number - 1}")
        rows = batch.withColumn("_new", F.lit(True))
        if (before / "_SUCCESS").exists():
            rows = rows.unionByName(spark.read.parquet(before.path).withColumn("_new", F.lit(False)))
        # The newest row of a key that an earlier batch left comes before all of this one.
        events = changes(rows.drop("_new"), key, seq, op).join(batch.select(F.col(key).alias("document_key"), F.col(seq).alias("token")), ["document_key", "token"], "left_semi")
        write(events)
        latest(rows.drop("_new"), key, seq, op=None).write.mode("overwrite").parquet(f"{folder}/{number}")
        Folder(spark, f"{folder}/{number - 2}").delete()

    return run


def merge_batches(into: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str = "_id", seq: str = "_seq", tiebreak: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that keeps the newest row of each key in a table: a batch replayed after a
    failure changes nothing, since equal rows win against themselves. The table is written anew each time; `upsert_batches` writes
    only the part that a batch touches."""
    from tessera.operators.versioned import latest

    def run(batch: DataFrame, _: int) -> None:
        have = into()
        rows = batch if have is None else have.unionByName(batch)
        write(latest(rows, key, seq, op=None, tiebreak=tiebreak))

    return run


def upsert_batches(path: str, key: str = "_id", seq: str = "_seq", tiebreak: tuple[str, ...] = (), parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that keeps the newest row of each key in a Parquet table dealt over `parts` folders by a hash of the key: only
    the folders that a batch has keys of are read, merged and replaced."""
    from tessera.operators.versioned import latest
    from tessera.sources.folders import Folder
    from tessera.sources.scratch import materialize

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r._part for r in rows.select("_part").distinct().collect()]  # at most `parts`
        if not touched:
            return
        if Folder(spark, path).exists():
            have = spark.read.option("mergeSchema", True).parquet(path).where(F.col("_part").isin(touched))
            rows = have.unionByName(rows, allowMissingColumns=True)
        merged = materialize(latest(rows, key, seq, op=None, tiebreak=tiebreak))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)

    return run


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and key; events later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))
