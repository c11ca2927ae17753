"""Fluent builders of filters and pipelines, and hooks around what collections are asked."""

from __future__ import annotations

import copy
import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.plans import pipeline
from tessera.plans.validation import InvalidQuery


class Query:
    """`Query().where("age").gte(18).lt(65).select("name").sort("-age").limit(10).run(df)`"""

    def __init__(self) -> None:
        self.filter: dict = {}
        self.options: dict = {}
        self._field: str | None = None

    def where(self, field: str, value: object = ...) -> Query:
        self._field = field
        if value is not ...:
            self.filter[field] = value
        return self

    def _op(self, op: str, value: object) -> Query:
        if self._field is None:
            raise ValueError("where() names the field first")
        now = self.filter.get(self._field)
        self.filter[self._field] = (now if isinstance(now, dict) else {}) | {op: value}
        return self

    def equals(self, value: object) -> Query:
        return self._op("$eq", value)

    def __getattr__(self, name: str) -> Callable[[object], Query]:
        ops = {"gt", "gte", "lt", "lte", "ne", "nin", "exists", "regex", "size", "all", "mod"} | {"in_", "elem_match"}
        if name not in ops:
            raise AttributeError(name)
        op = "$" + {"in_": "in", "elem_match": "elemMatch"}.get(name, name)
        return lambda value: self._op(op, value)

    def either(self, *filters: dict) -> Query:
        self.filter["$or"] = list(filters)
        return self

    def neither(self, *filters: dict) -> Query:
        self.filter["$nor"] = list(filters)
        return self

    def select(self, *fields: str) -> Query:
        self.options["projection"] = {f.lstrip("-"): int(not f.startswith("-")) for f in fields}
        return self

    def sort(self, *fields: str) -> Query:
        self.options["sort"] = {f.lstrip("-"): -1 if f.startswith("-") else 1 for f in fields}
        return self

    def skip(self, n: int) -> Query:
        self.options["skip"] = n
        return self

    def limit(self, n: int) -> Query:
        self.options["limit"] = n
        return self

    def run(self, df: DataFrame) -> DataFrame:
        return pipeline.find(df, self.filter, **self.options)


class Stages:
    """`Stages().match({...}).group({...}).sort({...}).run(df)`; any stage by its name in snake case."""

    def __init__(self) -> None:
        self.stages: list[dict] = []

    def __getattr__(self, name: str) -> Callable[..., Stages]:
        if name.startswith("_"):
            raise AttributeError(name)
        first, *rest = name.split("_")

        def add(spec: object) -> Stages:
            self.stages.append({"$" + first + "".join(map(str.title, rest)): spec})
            return self

        return add

    def run(self, df: DataFrame, catalog=None, **options) -> DataFrame:
        return pipeline.aggregate(df, self.stages, catalog, **options)


class Stop(Exception):
    """Raised by a hook in place of the operation; `value` is its result."""

    def __init__(self, value: object = None) -> None:
        super().__init__("stopped by a hook")
        self.value = value


class Hooks:
    """Functions that see or rewrite what a collection is asked, in the order added: filters (find, delete), pipelines (aggregate), documents
    (insert) and updates (update) before, and the same after (inserted, updated, deleted). One that gives None changes nothing."""

    EVENTS = ("find", "aggregate", "insert", "update", "delete", "inserted", "updated", "deleted")

    def __init__(self) -> None:
        self._found: dict[str, list[tuple[Callable, bool]]] = {e: [] for e in self.EVENTS}

    def add(self, event: str, rewrite: Callable, with_collection: bool = False) -> Hooks:
        self._found[event].append((rewrite, with_collection))
        return self

    def also(self, other: Hooks) -> Hooks:
        for event, found in other._found.items():
            self._found[event] += found
        return self

    def apply(self, event: str, spec, collection=None):
        for rewrite, with_collection in self._found[event]:
            made = rewrite(copy.deepcopy(spec), collection) if with_collection else rewrite(copy.deepcopy(spec))
            spec = spec if made is None else made
        return spec


def soft_delete(field: str = "deletedAt", now: Callable[[], dt.datetime] = dt.datetime.now) -> Hooks:
    """Hides rows that have a deletion time, and gives rows one in place of deleting them."""
    live = {field: {"$exists": False}}

    def mark(query: dict, collection) -> None:
        raise Stop(collection.update(query, {"$set": {field: now()}}))

    out = Hooks().add("find", lambda q: {"$and": [live, q]} if q else live).add("aggregate", lambda s: [{"$match": live}, *s])
    return out.add("delete", mark, with_collection=True)


def timestamps(created: str = "createdAt", updated: str = "updatedAt", now: Callable[[], dt.datetime] = dt.datetime.now) -> Hooks:
    """Stamps inserted documents and updates."""
    return (
        Hooks()
        .add("insert", lambda docs: [{created: (t := now()), updated: t} | d for d in docs])
        .add("update", lambda u: u | {"$set": u.get("$set", {}) | {updated: now()}})
    )


def audit(into: str = "audit", now: Callable[[], dt.datetime] = dt.datetime.now) -> Hooks:
    """Notes each insert, update and delete in a collection: which, when and what was asked."""

    def note(event: str) -> Callable:
        def run(spec, collection) -> None:
            if collection.name != into:
                row = {"at": now(), "collection": collection.name, "event": event, "asked": json.dumps(spec, default=str)}
                collection.database[into].insert_many([row], "_id string, at timestamp, collection string, event string, asked string")

        return run

    out = Hooks()
    for event in ("inserted", "updated", "deleted"):
        out.add(event, note(event), with_collection=True)
    return out


def validation(schema: dict, collections: set[str] | None = None) -> Hooks:
    """Refuses documents that a JSON schema finds wrong."""

    def check(docs: list[dict], collection) -> None:
        if collections is not None and collection.name not in collections:
            return
        from tessera.operators.schema import validation_errors

        df = collection.spark.createDataFrame([{k: v for k, v in d.items() if v is not None} or {"_": True} for d in docs])
        wrong = df.select(validation_errors(df, schema).alias("wrong")).where("size(wrong) > 0").limit(1).collect()
        if wrong:
            raise InvalidQuery("; ".join(wrong[0].wrong))

    return Hooks().add("insert", check, with_collection=True)
