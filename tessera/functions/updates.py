"""Update documents as column expressions over matched rows, and the row that an upsert inserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.fields import Fields, drop_path, set_path
from tessera.functions.filters import literal
from tessera.plans.validation import InvalidQuery, check_update


def _each(value: object) -> list:
    return list(value["$each"]) if isinstance(value, dict) and "$each" in value else [value]


def _array(df: DataFrame, path: str, values: list) -> tuple[Column, Column]:
    """The field as an array (empty if missing) and the values as one of its type."""
    kind = Fields(df).type_of(path)
    if kind is not None and not isinstance(kind, (T.ArrayType, T.NullType)):
        raise InvalidQuery(f"{path} is no array")
    new = F.array(*map(literal, values)) if values else F.array()
    kind = kind if isinstance(kind, T.ArrayType) else df.select(new.alias("v")).schema["v"].dataType
    return F.coalesce(Fields(df).col(path).cast(kind), F.array().cast(kind)), new.cast(kind)


def _without(array: Column, items: Column) -> Column:
    """The array without what equals any of the items; nulls equal nulls."""
    return F.filter(array, lambda x: ~F.exists(items, lambda y: y.eqNullSafe(x)))


def _number(df: DataFrame, path: str) -> Column:
    kind = Fields(df).type_of(path)
    if kind is not None and not isinstance(kind, (T.NumericType, T.NullType)):
        raise InvalidQuery(f"{path} is no number")
    return F.coalesce(Fields(df).col(path), F.lit(0))


def apply_update(df: DataFrame, update: dict, where: Column | None = None, now: dt.datetime | None = None) -> DataFrame:
    """df with the update applied to the rows where the condition holds (all, without one). Operators
    apply in a fixed order: $set, $unset, $inc, $mul, $min, $max, $currentDate, $push, $pull, $pullAll, $addToSet, $pop, $rename."""
    check_update(update)
    condition = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    df = df.withColumn("_hit", condition)
    hit = F.col("_hit")

    def put(df: DataFrame, path: str, value: Column) -> DataFrame:
        kind = Fields(df).type_of(path)
        old = Fields(df).col(path)
        if kind is not None and not isinstance(kind, T.NullType):
            made = df.select(value.alias("v")).schema["v"].dataType
            if isinstance(kind, T.IntegralType) and isinstance(made, T.FractionalType):
                old = old.cast(made)
            elif not isinstance(made, T.FractionalType) or not isinstance(kind, T.NumericType):
                value = value.cast(kind)
        return set_path(df, path, F.when(hit, value).otherwise(old) if kind is not None else F.when(hit, value))

    for path, v in update.get("$set", {}).items():
        df = put(df, path, literal(v))
    for path in update.get("$unset", {}):
        if Fields(df).type_of(path) is not None:
            df = put(df, path, F.lit(None)) if where is not None else drop_path(df, path)
    for path, v in update.get("$inc", {}).items():
        df = put(df, path, _number(df, path) + F.lit(v))
    for path, v in update.get("$mul", {}).items():
        df = put(df, path, _number(df, path) * F.lit(v))
    for op, pick in (("$min", F.least), ("$max", F.greatest)):
        for path, v in update.get(op, {}).items():
            df = put(df, path, pick(Fields(df).col(path), F.lit(v)) if Fields(df).type_of(path) is not None else F.lit(v))
    for path in update.get("$currentDate", {}):
        df = put(df, path, F.lit(now) if now else F.current_timestamp())
    for path, v in update.get("$push", {}).items():
        old, new = _array(df, path, _each(v))
        df = put(df, path, F.concat(old, new))
    for path, v in update.get("$pull", {}).items():
        old, new = _array(df, path, [v])
        df = put(df, path, _without(old, new))
    for path, vs in update.get("$pullAll", {}).items():
        old, new = _array(df, path, list(vs))
        df = put(df, path, _without(old, new))
    for path, v in update.get("$addToSet", {}).items():
        for one in _each(v):
            old, new = _array(df, path, [one])
            df = put(df, path, F.concat(old, _without(new, old)))
    for path, v in update.get("$pop", {}).items():
        old, _ = _array(df, path, [])
        shorter = F.greatest(F.lit(0), F.size(old) - 1)
        df = put(df, path, F.slice(old, 1, shorter) if v == 1 else F.slice(old, 2, shorter))
    for path, to in update.get("$rename", {}).items():
        if path in df.columns:
            df = put(put(df, to, F.col(path)), path, F.lit(None)) if where is not None else df.withColumnRenamed(path, to)
    return df.drop("_hit")


def _equalities(query: dict) -> dict:
    """Fields that a filter fixes to a value, those within `$and` too."""
    out: dict = {}
    for path, v in query.items():
        if path == "$and":
            for part in v:
                out |= _equalities(part)
        elif path.startswith("$"):
            continue
        elif isinstance(v, dict) and "$eq" in v:
            out[path] = v["$eq"]
        elif isinstance(v, dict) and isinstance(v.get("$in"), (list, tuple)) and len(v["$in"]) == 1:
            out[path] = v["$in"][0]
        elif not (isinstance(v, dict) and any(k.startswith("$") for k in v)):
            out[path] = v
    return out


def upsert_document(query: dict, update: dict, now: dt.datetime | None = None) -> dict:
    """The document that an upsert inserts: equality fields of the filter, `$setOnInsert`, then the update."""
    check_update(update)
    doc: dict = {}

    def node(path: str, make: bool = True) -> tuple[dict, str]:
        at = doc
        *parents, last = path.split(".")
        for p in parents:
            at = at.setdefault(p, {}) if make else at.get(p, {})
        return at, last

    def put(path: str, value: object) -> None:
        at, last = node(path)
        at[last] = value

    def have(path: str) -> object:
        at, last = node(path, make=False)
        return at.get(last)

    for path, v in _equalities(query).items():
        put(path, v)
    for op in ("$setOnInsert", "$set"):
        for path, v in update.get(op, {}).items():
            put(path, v)
    for path, v in update.get("$inc", {}).items():
        put(path, (have(path) or 0) + v)
    for path, v in update.get("$mul", {}).items():
        put(path, (have(path) or 0) * v)
    for op, pick in (("$min", min), ("$max", max)):
        for path, v in update.get(op, {}).items():
            put(path, v if have(path) is None else pick(have(path), v))
    for path in update.get("$currentDate", {}):
        put(path, now or dt.datetime.now())
    for path, v in update.get("$push", {}).items():
        put(path, list(have(path) or []) + _each(v))
    for path, v in update.get("$addToSet", {}).items():
        old = list(have(path) or [])
        put(path, old + [x for i, x in enumerate(_each(v)) if x not in old and x not in _each(v)[:i]])
    for path in update.get("$unset", {}):
        at, last = node(path, make=False)
        at.pop(last, None)
    for path, to in update.get("$rename", {}).items():
        at, last = node(path, make=False)
        if last in at:
            put(to, at.pop(last))
    return doc
