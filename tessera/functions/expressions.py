"""Expression documents as columns.

`"$path"`, `"$$var"`, literals, `$cond`, `$ifNull`, comparisons, `$in`, `$and/$or/$not` and `$mergeObjects` are the
core; `$add $subtract $multiply $divide $mod $abs $concat $toLower $toUpper $size $arrayElemAt $slice $literal` extend it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.fields import Fields
from tessera.functions.filters import literal, true


class Expressions:
    def __init__(self, fields: Fields, variables: dict[str, Column] | None = None) -> None:
        self.fields, self.variables = fields, variables or {}

    def __call__(self, spec: object) -> Column:
        if isinstance(spec, Column):
            return spec
        if isinstance(spec, str):
            if spec.startswith("$$"):
                return self._variable(spec[2:])
            return self.fields.col(spec[1:]) if spec.startswith("$") else F.lit(spec)
        if isinstance(spec, (list, tuple)):
            return F.array(*map(self, spec))
        if isinstance(spec, dict):
            ops = [k for k in spec if k.startswith("$")]
            if ops:
                if len(spec) > 1:
                    raise ValueError(f"an expression has one operator, not {sorted(spec)}")
                return self._operator(ops[0], spec[ops[0]])
            return F.struct(*[self(v).alias(k) for k, v in spec.items()])
        return F.lit(spec)

    def _variable(self, name: str) -> Column:
        name, *rest = name.split(".")
        if name in ("ROOT", "CURRENT"):
            return self.fields.col(".".join(rest)) if rest else F.struct(*[F.col(f"`{c}`") for c in self.fields.schema.names])
        if name not in self.variables:
            raise ValueError(f"unknown variable $${name}")
        return reduce(lambda c, p: c.getField(p), rest, self.variables[name])

    def _operator(self, op: str, arg: object) -> Column:
        many = lambda: [self(a) for a in (arg if isinstance(arg, (list, tuple)) else [arg])]
        if op == "$literal":
            return literal(arg)
        if op == "$cond":
            parts = (arg["if"], arg["then"], arg["else"]) if isinstance(arg, dict) else arg
            test, yes, no = map(self, parts)
            return F.when(true(test.cast("boolean")), yes).otherwise(no)
        if op == "$ifNull":
            return F.coalesce(*many())
        if op in ("$eq", "$ne"):
            a, b = many()
            same = a.eqNullSafe(b)
            return same if op == "$eq" else ~same
        if op in ("$gt", "$gte", "$lt", "$lte"):
            a, b = many()
            return true({"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op])
        if op == "$in":
            value, array = many()
            return true(F.array_contains(array, value))
        if op in ("$and", "$or"):
            parts = [true(c.cast("boolean")) for c in many()]
            return reduce(and_ if op == "$and" else or_, parts, F.lit(op == "$and"))
        if op == "$not":
            return ~true(many()[0].cast("boolean"))
        if op in ("$add", "$multiply"):
            return reduce((lambda a, b: a + b) if op == "$add" else (lambda a, b: a * b), many())
        if op in ("$subtract", "$divide", "$mod"):
            a, b = many()
            return a - b if op == "$subtract" else F.try_divide(a.cast("double"), b.cast("double")) if op == "$divide" else F.try_mod(a, b)
        if op == "$abs":
            return F.abs(many()[0])
        if op == "$concat":
            return F.concat(*[c.cast("string") for c in many()])
        if op in ("$toLower", "$toUpper"):
            return (F.lower if op == "$toLower" else F.upper)(many()[0])
        if op == "$size":
            return F.size(many()[0])
        if op == "$arrayElemAt":
            array, at = arg
            return F.get(self(array), int(at)) if int(at) >= 0 else F.try_element_at(self(array), F.lit(int(at)))
        if op == "$slice":
            return slice_of(self(arg[0]), list(arg[1:]))
        if op == "$mergeObjects":
            return self.merge(arg if isinstance(arg, (list, tuple)) else [arg])
        raise ValueError(f"unknown expression operator {op}")

    def merge(self, items: list) -> Column:
        """One struct of all items' fields; the right-most wins where it has a value."""
        found: dict[str, Column] = {}
        for item in items:
            for name, col in self.struct_fields(item).items():
                found[name] = F.coalesce(col, found[name]) if name in found else col
        return F.struct(*[c.alias(n) for n, c in found.items()])

    def struct_fields(self, item: object) -> dict[str, Column]:
        """An expression's fields by name; none if it is no document."""
        if isinstance(item, str) and item.startswith("$"):
            if item == "$$ROOT":
                return {n: F.col(f"`{n}`") for n in self.fields.schema.names}
            kind = self.fields.type_of(item[1:])
            if isinstance(kind, T.StructType):
                return {n: self.fields.col(f"{item[1:]}.{n}") for n in kind.fieldNames()}
            return {}
        if isinstance(item, dict):
            if "$mergeObjects" in item:
                out: dict[str, Column] = {}
                for x in item["$mergeObjects"]:
                    for n, c in self.struct_fields(x).items():
                        out[n] = F.coalesce(c, out[n]) if n in out else c
                return out
            if not any(k.startswith("$") for k in item):
                return {k: self(v) for k, v in item.items()}
        return {}


def slice_of(array: Column, args: list[int]) -> Column:
    """n first (or last, if negative) items, or n from a position."""
    if len(args) == 1:
        n = int(args[0])
        return F.slice(array, 1, n) if n >= 0 else F.when(F.size(array) <= -n, array).otherwise(F.slice(array, n, -n))
    at, n = map(int, args)
    return F.slice(array, at + 1, n) if at >= 0 else F.slice(array, F.greatest(F.lit(1), F.size(array) + at + 1), F.lit(n))
