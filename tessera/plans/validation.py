"""Checks of filters, updates and pipelines before anything is planned."""

from __future__ import annotations

MAX_FILTER_DEPTH, MAX_FILTER_OPERATORS, MAX_STAGES = 10, 100, 100
#: Stages, field operators and update operators that are known (fixed values).
STAGES = {
    "$match", "$project", "$sort", "$limit", "$skip", "$count", "$group", "$unwind", "$lookup", "$graphLookup", "$addFields", "$set", "$unset",
    "$replaceRoot", "$replaceWith", "$facet", "$bucket", "$bucketAuto", "$sortByCount", "$sample", "$redact", "$unionWith", "$merge", "$out",
}
UPDATES = {"$set", "$unset", "$inc", "$push", "$pull", "$addToSet", "$pop", "$rename", "$setOnInsert", "$mul", "$min", "$max", "$currentDate", "$pullAll"}
RESERVED = {"_id", "_seq", "_op"}


class InvalidQuery(ValueError):
    """A filter, update or pipeline that can't be run."""


def check_filter(query: object, depth: int = 0) -> int:
    """Number of operators; raises where the filter is too deep, too large or no document."""
    if not isinstance(query, dict):
        raise InvalidQuery(f"a filter is a document, not {type(query).__name__}")
    if depth > MAX_FILTER_DEPTH:
        raise InvalidQuery(f"filter deeper than {MAX_FILTER_DEPTH}")
    n = 0
    for key, value in query.items():
        if key == "$where":
            raise InvalidQuery("$where runs code and is not allowed")
        n += key.startswith("$")
        for inner in value if isinstance(value, list) else [value]:
            if isinstance(inner, dict) and key not in ("$expr", "$geometry", "$geoWithin", "$geoIntersects", "$near", "$nearSphere"):
                n += check_filter(inner, depth + 1)
    if n > MAX_FILTER_OPERATORS:
        raise InvalidQuery(f"more than {MAX_FILTER_OPERATORS} operators in a filter")
    return n


def check_pipeline(stages: object) -> None:
    if not isinstance(stages, (list, tuple)):
        raise InvalidQuery("a pipeline is a list of stages")
    if len(stages) > MAX_STAGES:
        raise InvalidQuery(f"more than {MAX_STAGES} stages")
    for i, stage in enumerate(stages):
        if not isinstance(stage, dict) or len(stage) != 1:
            raise InvalidQuery(f"stage {i} must be one operator")
        ((name, spec),) = stage.items()
        if name not in STAGES:
            raise InvalidQuery(f"unknown stage {name}")
        if name == "$match":
            check_filter(spec)
        if name in ("$limit", "$skip") and (not isinstance(spec, int) or isinstance(spec, bool) or spec < 0):
            raise InvalidQuery(f"{name} takes a number from 0")
        if name in ("$merge", "$out") and i < len(stages) - 1:
            raise InvalidQuery(f"{name} must be the last stage")


def check_update(update: dict) -> None:
    if not update or any(k not in UPDATES for k in update):
        raise InvalidQuery(f"unknown update operators in {sorted(update)}")
    for fields in update.values():
        for path in fields:
            if path.split(".")[0] in RESERVED:
                raise InvalidQuery(f"{path} is reserved")


def check_projection(spec: dict) -> bool:
    """Whether the projection is an inclusion (or computes fields); raises on a mix with exclusion."""
    given = {k: v for k, v in spec.items() if k != "_id"}
    drops = [k for k, v in given.items() if v in (0, False) and not isinstance(v, (str, dict, list))]
    if drops and len(drops) < len(given):
        raise InvalidQuery("inclusion and exclusion can't be mixed")
    if not given:
        return bool(spec.get("_id", 1))
    return not drops
