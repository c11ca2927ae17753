"""Filter documents as one boolean column.

What is negated is TRUE or FALSE, never NULL, so a missing field matches `$ne`, `$nin` and `$not`, and no
comparison; elsewhere leaf predicates stay plain, so that the scan can use them. Values compare within their bracket only (number, string,
boolean, date), without coercion. Unknown operators raise; a condition that is an object, array or date compares as a whole.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo
from tessera.functions.fields import Fields, kind_of

MAX_PATTERN = 1000
_RANGE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
_GEO = {"$near", "$nearSphere", "$geoWithin", "$geoIntersects", "$minDistance", "$maxDistance"}
#: Names of the `$type` operator: the bracket and, for numbers, the Spark types (fixed values).
TYPE_NAMES = {
    "double": ("number", ("double", "float")), "int": ("number", ("int", "smallint", "tinyint")), "long": ("number", ("bigint",)), "decimal": ("number", ("decimal",)),
    "number": ("number", None), "string": ("string", None), "bool": ("boolean", None), "date": ("date", None), "timestamp": ("date", ("timestamp", "timestamp_ntz")), "array": ("array", None), "object": ("object", None),
    "binData": ("binary", None),
}


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _bracket(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.date, dt.datetime)):
        return "date"
    return "array" if isinstance(value, (list, tuple)) else "object"


def literal(value: object) -> Column:
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


class FilterCompiler:
    def __init__(self, fields: Fields, expression=None, text=None) -> None:
        """expression: compiles `$expr`; text: gives the column for `$text`."""
        self.fields, self.expression, self.text, self.strict = fields, expression, text, False

    def _true(self, c: Column) -> Column:
        """NULL counts as false. Outside negations a filter does that by itself, and a plain predicate reaches the scan."""
        return true(c) if self.strict else c

    def _strictly(self, make, *args) -> Column:
        """A predicate that is never NULL, to be negated."""
        before, self.strict = self.strict, True
        try:
            return make(*args)
        finally:
            self.strict = before

    def compile(self, query: dict) -> Column:
        parts = [self._entry(k, v) for k, v in query.items()]
        return reduce(and_, parts, F.lit(True))

    def _entry(self, key: str, value: object) -> Column:
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, (list, tuple)):
                raise ValueError(f"{key} takes a list")
            if key == "$nor":
                return ~reduce(or_, [self._strictly(self.compile, v) for v in value], F.lit(False))
            parts = [self.compile(v) for v in value]
            return reduce(and_, parts, F.lit(True)) if key == "$and" else reduce(or_, parts, F.lit(False))
        if key == "$expr":
            if self.expression is None:
                raise ValueError("$expr is not available here")
            return self._true(self.expression(value).cast("boolean"))
        if key == "$text":
            if self.text is None:
                raise ValueError("$text needs a text index, or the names of the fields to search (text=...)")
            return self.text(value)
        if key.startswith("$"):
            raise ValueError(f"unknown top-level operator {key}")
        return self._field(key, value)

    def _field(self, path: str, value: object) -> Column:
        if isinstance(value, dict) and any(k.startswith("$") for k in value):
            if bad := [k for k in value if not k.startswith("$")]:
                raise ValueError(f"operators and fields mixed in {path}: {bad}")
            return self._operators(path, value)
        return self._equal(path, value)

    def _operators(self, path: str, ops: dict) -> Column:
        parts = []
        if geo_ops := {k: v for k, v in ops.items() if k in _GEO}:
            parts.append(self._true(geo.matches(self.fields, path, geo_ops)))
        for op, value in ops.items():
            if op in _GEO or op == "$options":
                continue
            parts.append(self._operator(path, op, value, ops))
        return reduce(and_, parts, F.lit(True))

    def _operator(self, path: str, op: str, value: object, ops: dict) -> Column:
        if op == "$eq":
            return self._equal(path, value)
        if op == "$ne":
            return ~self._strictly(self._equal, path, value)
        if op in _RANGE:
            return self._compare(path, _RANGE[op], value)
        if op in ("$in", "$nin"):
            if not isinstance(value, (list, tuple)):
                raise ValueError(f"{op} takes a list")
            return ~self._strictly(self._in, path, list(value)) if op == "$nin" else self._in(path, list(value))
        if op == "$exists":
            there = self.fields.exists(path)
            return there if value else ~there
        if op == "$regex":
            return self._regex(path, value, str(ops.get("$options", "")))
        if op == "$not":
            if isinstance(value, re.Pattern):
                return ~self._strictly(self._regex, path, value, "")
            return ~self._strictly(self._operators, path, value)
        if op == "$all":
            return reduce(and_, [self._contains(path, v) for v in value], F.lit(bool(value)))
        if op == "$size":
            return self._true(F.when(self._is(path, "array"), self._size(path) == value))
        if op == "$type":
            return self._type(path, value)
        if op == "$mod":
            divisor, rest = value
            return self._true(self._numeric(path) % F.lit(divisor) == F.lit(rest))
        if op == "$elemMatch":
            return self._elem_match(path, value)
        raise ValueError(f"unknown operator {op}")

    def _is(self, path: str, bracket: str) -> Column:
        if self.fields.in_variant(path):
            names = {"number": ["BIGINT", "DOUBLE", "FLOAT"], "string": ["STRING"], "boolean": ["BOOLEAN"], "date": ["DATE", "TIMESTAMP"]}
            kind = F.schema_of_variant(self.fields.col(path))
            if bracket == "array":
                return self._true(kind.startswith("ARRAY"))
            if bracket == "object":
                return self._true(kind.startswith("OBJECT"))
            numeric = kind.startswith("DECIMAL") if bracket == "number" else F.lit(False)
            return self._true(kind.isin(names.get(bracket, [])) | numeric)
        kind = self.fields.type_of(path)
        return F.lit(kind is not None and kind_of(kind) == bracket)

    def _value(self, path: str, like: object) -> Column:
        """The field as a column that compares with a literal of the given kind; NULL where it is of another."""
        bracket = _bracket(like)
        if self.fields.in_variant(path):
            kind = {"number": "double", "string": "string", "boolean": "boolean", "date": "timestamp"}.get(bracket)
            return F.when(self._is(path, bracket), self.fields.variant_value(path, kind or "string"))
        kind = self.fields.type_of(path)
        if kind is None or kind_of(kind) != bracket:
            return F.lit(None)
        return self.fields.col(path)

    def _numeric(self, path: str) -> Column:
        return self._value(path, 0)

    def _equal(self, path: str, value: object) -> Column:
        if value is None:
            col = self.fields.col(path)
            if self.fields.in_variant(path):
                return self._true(F.is_variant_null(col))
            return col.isNull()
        if isinstance(value, re.Pattern):
            return self._regex(path, value, "")
        if self.fields.in_variant(path) and isinstance(value, (dict, list, tuple)):
            import json

            return self._true(F.to_json(self.fields.col(path)) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))
        col = self._value(path, value)
        kind = self.fields.type_of(path)
        if isinstance(value, (dict, list, tuple)) and kind is not None:
            return self._true(col == literal(value).cast(kind)) if kind_of(kind) == _bracket(value) else F.lit(False)
        return self._true(col == F.lit(value))

    def _compare(self, path: str, method: str, value: object) -> Column:
        if _bracket(value) in ("array", "object") or value is None:
            return F.lit(False)
        return self._true(getattr(self._value(path, value), method)(F.lit(value)))

    def _in(self, path: str, values: list) -> Column:
        plain = [v for v in values if v is not None and not isinstance(v, (dict, list, tuple, re.Pattern))]
        out = F.lit(False)
        for bracket in dict.fromkeys(map(_bracket, plain)):
            some = [v for v in plain if _bracket(v) == bracket]
            col = self._value(path, some[0])
            out = out | self._true(col.isin(some))
        for v in values:
            if v is None or isinstance(v, (dict, list, tuple, re.Pattern)):
                out = out | self._equal(path, v)
        return out

    def _regex(self, path: str, pattern: object, options: str) -> Column:
        if isinstance(pattern, re.Pattern):
            flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & bit)
            pattern, options = pattern.pattern, options + flags
        if len(pattern) > MAX_PATTERN:
            raise ValueError(f"pattern longer than {MAX_PATTERN} characters")
        if bad := set(options) - set("imsx"):
            raise ValueError(f"unknown regex options {sorted(bad)}")
        options = "".join(sorted(set(options)))
        return self._true(self._value(path, "").rlike(f"(?{options}){pattern}" if options else pattern))

    def _size(self, path: str) -> Column:
        col = self.fields.col(path)
        if self.fields.in_variant(path):
            return F.size(self.fields.variant_value(path, "array<variant>"))
        return F.size(col)

    def _contains(self, path: str, value: object) -> Column:
        """An array that holds the value, or the value itself."""
        if self.fields.in_variant(path):
            kind = {"number": "array<double>", "string": "array<string>", "boolean": "array<boolean>"}[_bracket(value)]
            array = F.when(self._is(path, "array"), self.fields.variant_value(path, kind))
            return self._true(F.array_contains(array, value)) | self._equal(path, value)
        kind = self.fields.type_of(path)
        if isinstance(kind, T.ArrayType):
            if kind_of(kind.elementType) != _bracket(value):
                return F.lit(False)
            return self._true(F.array_contains(self.fields.col(path), literal(value).cast(kind.elementType)))
        return self._equal(path, value)

    def _type(self, path: str, value: object) -> Column:
        names = value if isinstance(value, (list, tuple)) else [value]
        out = F.lit(False)
        for n in names:
            if n == "null":
                out = out | self._equal(path, None)
            elif n in TYPE_NAMES:
                bracket, kinds = TYPE_NAMES[n]
                out = out | (self._is(path, bracket) & self._of_kind(path, kinds) & self.fields.exists(path))
            else:
                raise ValueError(f"unknown type {n!r}")
        return out

    def _of_kind(self, path: str, kinds: tuple[str, ...] | None) -> Column:
        """Whether the field has one of the Spark types. A VARIANT's whole numbers are stored as narrow as they fit, so there the value decides between int and long."""
        if kinds is None:
            return F.lit(True)
        if self.fields.in_variant(path):
            kind = F.lower(F.regexp_extract(F.schema_of_variant(self.fields.col(path)), "^[A-Za-z_]+", 0))
            small = F.abs(self.fields.variant_value(path, "double")) < 2.0**31
            kind = F.when(kind.isin("bigint", "int", "smallint", "tinyint"), F.when(small, "int").otherwise("bigint")).otherwise(kind)
            return self._true(kind.isin(*kinds))
        kind = self.fields.type_of(path)
        return F.lit(kind is not None and kind.simpleString().split("(")[0] in kinds)

    def _elem_match(self, path: str, query: dict) -> Column:
        if self.fields.in_variant(path):
            array = F.when(self._is(path, "array"), self.fields.variant_value(path, "array<variant>"))
            return self._true(F.exists(array, lambda x: _VariantElement(x, self).matches(query)))
        kind = self.fields.type_of(path)
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        return self._true(F.exists(self.fields.col(path), lambda x: _Element(kind.elementType, x, self).matches(query)))


class _Element(Fields):
    """Fields of one element of an array, for `$elemMatch`."""

    def __init__(self, kind: T.DataType, column: Column, outer: FilterCompiler) -> None:
        self.schema = T.StructType([T.StructField("_", kind)]) if not isinstance(kind, T.StructType) else kind
        self.variant, self.column, self.whole, self.outer = None, column, not isinstance(kind, T.StructType), outer

    def matches(self, query: dict) -> Column:
        compiler = FilterCompiler(self, self.outer.expression)
        if any(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in query):
            return compiler._operators("_", query)
        return compiler.compile(query)

    def col(self, path: str) -> Column:
        if self.whole:
            return self.column
        if self.type_of(path) is None:
            return F.lit(None)
        out = self.column
        for p in path.split("."):
            out = out.getField(p)
        return out


class _VariantElement(_Element):
    """Fields of one element of an array in a VARIANT."""

    def __init__(self, column: Column, outer: FilterCompiler) -> None:
        self.schema, self.variant, self.column, self.whole, self.outer = T.StructType([]), "_", column, True, outer

    def type_of(self, path: str) -> None:
        return None

    def in_variant(self, path: str) -> bool:
        return True

    def variant_value(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.column, "$" if path == "_" else self._json_path(path), kind)

    def col(self, path: str) -> Column:
        return self.variant_value(path)


def compile_filter(query: dict, fields: Fields, expression=None, text=None) -> Column:
    return FilterCompiler(fields, expression, text).compile(query)
