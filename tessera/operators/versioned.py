"""Change logs as tables: last-writer-wins views, points in time, branches, diffs, conflicts and merges.

A change log has a row for each write: the key, a sequence number, an operation (`i`, `u`, `d`, or `r` for a replacement) and the whole
row after it. Ties of the sequence number go to the greatest of `tiebreak` columns, so results don't depend on file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "_id", seq: str = "_seq", op: str | None = "_op", tiebreak: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """The newest row of each key; keys whose newest row is a deletion go.

    With `unique` (no two rows share key and number) the maximum is aggregated on the map side and joined
    back, which moves only keys and numbers of the losers; else rows are ranked.
    """
    if unique:
        top = log.groupBy(F.col(key).alias("_k")).agg(F.max(seq).alias("_m"))
        out = log.join(top, F.col(key).eqNullSafe(F.col("_k")) & (F.col(seq) == F.col("_m"))).drop("_k", "_m")
    else:
        order = Window.partitionBy(key).orderBy(F.desc(seq), *[F.desc(c) for c in tiebreak])
        out = log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return out.where(F.coalesce(F.col(op) != "d", F.lit(True))) if op else out


def as_of(log: DataFrame, seq: object = None, timestamp: object = None, seq_col: str = "_seq", ts_col: str = "_ts", **settings) -> DataFrame:
    """The view at a sequence number or a time, both inclusive. The bound is on the log itself, so it reaches the scan."""
    if seq is not None:
        log = log.where(F.col(seq_col) <= F.lit(seq))
    if timestamp is not None:
        log = log.where(F.col(ts_col) <= F.lit(timestamp))
    return latest(log, seq=seq_col, **settings)


def dedup(log: DataFrame, key: str = "_id", order_by: str = "_seq", ascending: bool = True, keep_deletes: bool = False, op: str = "_op", tiebreak: tuple[str, ...] = (), source: str | None = None) -> DataFrame:
    """One row for each key: the last in the order given (the first, if not `ascending`). With `source`, a column of that name tells the
    file that the row came from (log must be read from files)."""
    if source:
        log = log.withColumn(source, F.col("_metadata.file_path"))
    by = [F.desc(c) if ascending else F.asc(c) for c in (order_by, *tiebreak)]
    out = log.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_rank = 1").drop("_rank")
    return out if keep_deletes else out.where(F.coalesce(F.col(op) != "d", F.lit(True)))


def dedup_stats(log: DataFrame, key: str = "_id", seq: str = "_seq", op: str = "_op") -> DataFrame:
    """One row: rows in, keys, superseded rows, deleted keys, rows out, and rows by operation."""
    kind = F.when(F.col(op) == "r", "u").otherwise(F.col(op))
    per_key = log.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(op, seq).alias("last"), *[F.sum((kind == o).cast("long")).alias(o) for o in ("i", "u", "d")]
    )
    gone = F.coalesce(F.sum((F.col("last") == "d").cast("long")), F.lit(0))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.count(F.lit(1)).alias("keys"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"),
        gone.alias("deleted"), (F.count(F.lit(1)) - gone).alias("output_rows"), *[F.coalesce(F.sum(o), F.lit(0)).alias(f"n_{name}") for o, name in (("i", "inserts"), ("u", "updates"), ("d", "deletes"))],
    )


def compact(log: DataFrame, key: str = "_id", seq: str = "_seq", op: str = "_op", whole: bool = True, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """The log with superseded rows removed. Deletions stay unless the log is whole: rows elsewhere may need them."""
    return dedup(log, key, seq, keep_deletes=not whole, op=op, tiebreak=tiebreak)


def overlay(base: DataFrame, branch: DataFrame, key: str = "_id", op: str = "_op") -> DataFrame:
    """A branch's view: its own rows, deletions included, hide the base's of the same key, whatever their numbers. It has the columns of both."""
    shown = branch.where(F.coalesce(F.col(op) != "d", F.lit(True))).drop(op)
    return base.join(branch.select(key), key, "left_anti").unionByName(shown, allowMissingColumns=True)


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _aligned(key: str, *sides: DataFrame) -> tuple[list[str], list[DataFrame]]:
    """All columns but the key that any side has, and the sides with all of them (null where one lacks it); two types of one name must agree."""
    kinds: dict = {}
    for df in sides:
        for f in df.schema.fields:
            kinds.setdefault(f.name, f.dataType)
    columns = [c for c in kinds if c != key]
    have = lambda df, c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kinds[c]).alias(c)
    return columns, [df.select(F.col(key), F.struct(*[have(df, c).alias(c) for c in columns]).alias("row")) for df in sides]


def diff(before: DataFrame, after: DataFrame, key: str = "_id", kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(key, change, changed_fields, added_fields, removed_fields, before, after) of the keys that differ: insert, update or delete.

    Columns that only one side has count: a field that became present is an added one, one that became null or absent a removed one, and
    both are changed ones too. `kinds` and `limit` keep some of the changes only.
    """
    columns, (old, new) = _aligned(key, before, after)
    both = old.withColumnRenamed("row", "before").join(new.withColumnRenamed("row", "after"), key, "full_outer")
    a, b = (lambda c: F.col(f"before.`{c}`")), (lambda c: F.col(f"after.`{c}`"))
    fields = lambda test: F.array_compact(F.array(*[F.when(test(c), F.lit(c)) for c in columns]).cast("array<string>"))
    tests = {
        "changed_fields": lambda c: _differs(a(c), b(c)),
        "added_fields": lambda c: a(c).isNull() & b(c).isNotNull(),
        "removed_fields": lambda c: a(c).isNotNull() & b(c).isNull(),
    }
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    both = both.withColumn("change", change)
    none = F.expr("cast(array() as array<string>)")
    both = both.withColumns({n: F.when(F.col("change") == "update", fields(t)).otherwise(none) for n, t in tests.items()})
    out = both.where("change <> 'update' OR size(changed_fields) > 0").select(key, "change", *tests, "before", "after")
    out = out.where(F.col("change").isin(kinds)) if kinds is not None else out
    return out.limit(limit) if limit is not None else out


def diff_summary(changed: DataFrame) -> DataFrame:
    """One row: how many keys were inserted, updated and deleted."""
    n = lambda kind: F.coalesce(F.sum((F.col("change") == kind).cast("long")), F.lit(0))
    return changed.agg(n("insert").alias("inserted"), n("update").alias("updated"), n("delete").alias("deleted"), F.count(F.lit(1)).alias("total"))


def conflicts(main: DataFrame, branch: DataFrame, key: str = "_id") -> DataFrame:
    """Conflicts of two diffs from one base. Updates of different fields merge by themselves, and so do equal deletions."""
    a = main.select(key, F.col("change").alias("main_change"), F.col("changed_fields").alias("main_fields"))
    b = branch.select(key, F.col("change").alias("branch_change"), F.col("changed_fields").alias("branch_fields"))
    both = a.join(b, key).withColumn("fields", F.array_sort(F.array_intersect("main_fields", "branch_fields")))
    m, n = F.col("main_change"), F.col("branch_change")
    kind = (
        F.when((m == "delete") & (n == "delete"), F.lit(None))
        .when((m == "delete") & (n == "update"), "DELETE_UPDATE")
        .when((m == "update") & (n == "delete"), "UPDATE_DELETE")
        .when((m == "insert") & (n == "insert"), "DUPLICATE_INSERT")
        .when((m == "update") & (n == "update"), F.when(F.size("fields") > 0, "FIELD_CONFLICT"))
        .otherwise("FIELD_CONFLICT")
    )
    severity = F.when(F.col("type") == "DUPLICATE_INSERT", "high").when((F.col("type") == "FIELD_CONFLICT") & (m == n), "low").otherwise("medium")
    return both.withColumn("type", kind).where("type IS NOT NULL").withColumn("severity", severity).select(key, "type", "severity", "main_change", "branch_change", "fields")


def three_way_merge(base: DataFrame, main: DataFrame, branch: DataFrame, key: str = "_id", strategy: str = "ours", resolutions: DataFrame | None = None) -> DataFrame:
    """The merged table, with the columns of all sides. Each field takes the side that changed it; where both did, `ours` (main) or `theirs`
    (branch) wins. A deletion stands against an unchanged row, and against an update if its side wins.

    With `manual` each key in conflict needs a row in `resolutions`, (key, take): `ours`, `theirs`, or `base` to undo both sides. Without one
    the merge raises; `conflicts` tells which they are.
    """
    columns, (b_, m_, n_) = _aligned(key, base, main, branch)
    if strategy not in ("ours", "theirs", "manual"):
        raise ValueError("strategy is ours, theirs or manual")
    all_ = b_.withColumnRenamed("row", "b").join(m_.withColumnRenamed("row", "m"), key, "full_outer").join(n_.withColumnRenamed("row", "n"), key, "full_outer")
    if strategy == "manual":
        found = conflicts(diff(base, main, key), diff(base, branch, key), key)
        if resolutions is None or not found.join(resolutions.where(F.col("take").isin("ours", "theirs", "base")), key, "left_anti").isEmpty():
            raise ValueError("a manual merge needs a resolution for every conflict")
        all_ = all_.join(resolutions.select(key, "take"), key, "left").withColumn("take", F.coalesce("take", F.lit("ours")))
    else:
        all_ = all_.withColumn("take", F.lit(strategy))
    b = F.col("b")

    def merged(win: str, lose: str) -> Column:
        w, o = F.col(win), F.col(lose)
        fields = [F.when(_differs(w[c], b[c]), w[c]).otherwise(o[c]).alias(c) for c in columns]
        return (
            F.when(b.isNull(), F.coalesce(w, o))
            .when(w.isNull(), F.lit(None))
            .when(o.isNull(), F.when(_differs(w, b), w))
            .otherwise(F.struct(*fields))
        )

    out = F.when(F.col("take") == "base", b).when(F.col("take") == "theirs", merged("n", "m")).otherwise(merged("m", "n"))
    return all_.select(F.col(key), out.alias("_row")).where("_row IS NOT NULL").select(key, "_row.*")


def changes(log: DataFrame, key: str = "_id", seq: str = "_seq", op: str = "_op", after_seq: object = None, tiebreak: tuple[str, ...] = (), full_document: str = "updateLookup", before_change: str = "whenAvailable") -> DataFrame:
    """Change events of a log in batch form: operation type, the row after, the row before, and for updates which
    fields were set and which became null. Replay starts after a sequence number.

    `full_document` is `default` (no row after an update), `whenAvailable`, `updateLookup` or `required`; inserts and replacements always have theirs.
    `before_change` is `off`, `whenAvailable` or `required`. The log has whole rows, so what is asked for is there; `required` raises for a
    change (but an insertion) whose row before isn't in the log.
    """
    for value, known in ((full_document, ("default", "whenAvailable", "updateLookup", "required")), (before_change, ("off", "whenAvailable", "required"))):
        if value not in known:
            raise ValueError(f"{value!r} is none of {', '.join(known)}")
    columns = [c for c in log.columns if c not in (key, seq, op, *tiebreak)]
    by = Window.partitionBy(key).orderBy(seq, *tiebreak)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    events = log.withColumn("_after", F.when(F.col(op) != "d", row)).withColumn("_before", F.lag("_after").over(by))
    changed = [(c, _differs(F.col(f"_before.`{c}`"), F.col(f"_after.`{c}`"))) for c in columns]
    is_update = (F.col(op) == "u") & F.col("_before").isNotNull()
    names = lambda test: F.when(is_update, F.array_compact(F.array(*[F.when(d & test(c), F.lit(c)) for c, d in changed]).cast("array<string>")))
    before, after = F.col("_before"), F.col("_after")
    if before_change == "off":
        before = F.lit(None).cast(events.schema["_before"].dataType)
    elif before_change == "required":
        before = F.when((F.col(op) != "i") & before.isNull(), F.raise_error(F.lit("a change has no row before it in the log"))).otherwise(before)
    if full_document == "default":
        after = F.when(F.col(op) != "u", after)
    kind = F.when(F.col(op) == "i", "insert").when(F.col(op) == "d", "delete").when(F.col(op) == "r", "replace").otherwise("update")
    out = events.select(
        F.col(seq).alias("token"), F.col(key).alias("document_key"), kind.alias("operation_type"),
        after.alias("full_document"), before.alias("full_document_before_change"),
        names(lambda c: F.col(f"_after.`{c}`").isNotNull()).alias("updated_fields"), names(lambda c: F.col(f"_after.`{c}`").isNull()).alias("removed_fields"),
    )
    return out.where(F.col("token") > F.lit(after_seq)) if after_seq is not None else out


def shard_of(key: Column, shards: int = 16) -> Column:
    """A shard for each key by Spark's hash: balanced, stable between runs."""
    return F.pmod(F.hash(key), F.lit(shards))
