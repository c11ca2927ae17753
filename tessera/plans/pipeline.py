"""Aggregation pipelines as one lazy DataFrame: a fold of the stages over the input."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.fields import Fields
from tessera.operators import group as grouping
from tessera.operators import join, shape
from tessera.plans.validation import InvalidQuery, check_pipeline

Catalog = Mapping[str, DataFrame] | Callable[[str], DataFrame]


def normalise(stages: list[dict]) -> list[dict]:
    """Merges adjacent `$match` stages, and marks a `$lookup` whose array is unwound next as a plain join."""
    out: list[dict] = []
    for stage in stages:
        ((op, spec),) = stage.items()
        last = next(iter(out[-1].items())) if out else (None, None)
        if op == "$match" and last[0] == "$match":
            out[-1] = {"$match": {"$and": [last[1], spec]}}
        elif op == "$unwind" and last[0] == "$lookup" and "localField" in last[1] and "_unwind" not in last[1]:
            u = {"path": spec} if isinstance(spec, str) else spec
            if u["path"] == "$" + last[1]["as"] and "includeArrayIndex" not in u:
                out[-1] = {"$lookup": last[1] | {"_unwind": bool(u.get("preserveNullAndEmptyArrays"))}}
            else:
                out.append(stage)
        else:
            out.append(stage)
    return out


def sort_columns(df: DataFrame, spec: dict) -> list:
    fields = Fields(df)
    down = (-1, "desc", "descending")
    return [fields.col(k).desc_nulls_last() if d in down else fields.col(k).asc_nulls_first() for k, d in spec.items()]


class Pipeline:
    """Compiles stages over a frame. `catalog` gives other collections by name and `sink` takes the results of
    `$out` and `$merge`; `text` names the fields that `$text` searches."""

    def __init__(self, catalog: Catalog | None = None, sink: Callable | None = None, sql_avg: bool = False, stringify_ids: bool = False, variant: str | None = None, text: list[str] | None = None) -> None:
        self.catalog, self.sink, self.sql_avg, self.stringify_ids, self.variant, self.text = catalog, sink, sql_avg, stringify_ids, variant, text

    def _foreign(self, name: str) -> DataFrame:
        if self.catalog is None:
            raise InvalidQuery(f"no catalog to find {name!r} in")
        return self.catalog(name) if callable(self.catalog) else self.catalog[name]

    def run(self, df: DataFrame, stages: list[dict]) -> DataFrame:
        check_pipeline(stages)
        order = None
        for stage in normalise(stages):
            ((op, spec),) = stage.items()
            df, order = self._stage(df, op, spec, order)
        return df

    def _stage(self, df: DataFrame, op: str, spec, order):
        if op == "$match":
            return shape.match(df, spec, variant=self.variant, text=self.text), order
        if op == "$sort":
            fields = Fields(df)
            return df.orderBy(*sort_columns(df, spec)), [(k, d not in (-1, "desc", "descending")) for k, d in spec.items() if fields.type_of(k) is not None]
        if op == "$limit":
            return df.limit(spec), order
        if op == "$skip":
            return df.offset(spec), order
        keys = [(Fields(df).col(k), up, kind) for k, up in order or [] if (kind := Fields(df).type_of(k)) is not None] or None
        if op == "$project":
            return shape.project(df, spec), order
        if op in ("$addFields", "$set"):
            return shape.add_fields(df, spec), order
        if op == "$unset":
            return shape.unset(df, spec), order
        if op in ("$replaceRoot", "$replaceWith"):
            return shape.replace_root(df, spec["newRoot"] if op == "$replaceRoot" else spec), None
        if op == "$unwind":
            return shape.unwind(df, spec), order
        if op == "$redact":
            return shape.redact(df, spec), order
        if op == "$group":
            return grouping.group(df, spec, keys, sql_avg=self.sql_avg, stringify_ids=self.stringify_ids), None
        if op == "$count":
            return grouping.count(df, spec), None
        if op == "$sortByCount":
            return grouping.sort_by_count(df, spec), None
        if op == "$bucket":
            return grouping.bucket(df, spec, keys), None
        if op == "$bucketAuto":
            return grouping.bucket_auto(df, spec, keys), None
        if op == "$facet":
            return grouping.facet(df, spec, self.run), None
        if op == "$sample":
            return grouping.sample(df, spec["size"], spec.get("seed")), None
        if op == "$lookup":
            return self._lookup(df, spec), order
        if op == "$graphLookup":
            return join.graph_lookup(df, self._foreign(spec["from"]), spec), order
        if op == "$unionWith":
            name, stages = (spec, []) if isinstance(spec, str) else (spec["coll"], spec.get("pipeline", []))
            return join.union_with(df, self.run(self._foreign(name), stages)), None
        if op in ("$out", "$merge"):
            if self.sink is None:
                raise InvalidQuery(f"nothing to write {op} to")
            return self.sink(op, df, spec), None
        raise InvalidQuery(f"unknown stage {op}")

    def _lookup(self, df: DataFrame, spec: dict) -> DataFrame:
        foreign = self._foreign(spec["from"])
        if "pipeline" in spec:
            return join.lookup_pipeline(df, foreign, spec.get("let", {}), spec["pipeline"], spec["as"])
        if "localField" not in spec or "foreignField" not in spec:
            return df.withColumn(spec["as"], F.array().cast(f"array<{foreign.schema.simpleString()}>"))
        if "_unwind" in spec:
            return join.lookup_unwound(df, foreign, spec["localField"], spec["foreignField"], spec["as"], spec["_unwind"])
        return join.lookup(df, foreign, spec["localField"], spec["foreignField"], spec["as"])


def aggregate(df: DataFrame, stages: list[dict], catalog: Catalog | None = None, **options) -> DataFrame:
    return Pipeline(catalog, **options).run(df, stages)


def find(df: DataFrame, query: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int | None = None, variant: str | None = None, text: list[str] | None = None) -> DataFrame:
    """Rows that match, sorted, from `skip` on, at most `limit` (0 gives none), with the projection's fields. `text` names the fields
    that `$text` searches."""
    from tessera.plans.validation import check_filter

    check_filter(query or {})
    df = shape.match(df, query or {}, variant=variant, text=text)
    if sort:
        df = df.orderBy(*sort_columns(df, sort))
    if skip:
        df = df.offset(skip)
    if limit is not None:
        df = df.limit(limit)
    return shape.project(df, projection) if projection else df
