"""Accumulators of `$group`, `$bucket` and `$bucketAuto` as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expressions import Expressions

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def number(column: Column, kind: T.DataType | None) -> Column:
    """A value as a number, 0 where it is none: numeric strings and booleans count, null and the rest don't."""
    if isinstance(kind, _NUMERIC):
        return F.coalesce(column, F.lit(0).cast(kind))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.trim(column).try_cast("double"), F.lit(0.0))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column.cast("int"), F.lit(0))
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


class Accumulators:
    """`order` is the key of the preceding sort as (column, ascending, type) triples; `$first`, `$last`, `$push` and
    `$addToSet` depend on it, and without it their order is not determined."""

    def __init__(self, expressions: Expressions, schema: T.StructType, order: list[tuple[Column, bool, T.DataType]] | None = None, sql_avg: bool = False, strict_order: bool = True) -> None:
        self.expressions, self.schema, self.order, self.sql_avg, self.strict_order = expressions, schema, order, sql_avg, strict_order

    def _kind(self, spec: object) -> T.DataType | None:
        if isinstance(spec, str) and spec.startswith("$"):
            return self.expressions.fields.type_of(spec[1:])
        if isinstance(spec, bool):
            return T.BooleanType()
        if isinstance(spec, (int, float)):
            return T.DoubleType() if isinstance(spec, float) else T.LongType()
        return None

    def __call__(self, spec: dict) -> Column:
        if not isinstance(spec, dict) or len(spec) != 1:
            raise ValueError(f"an accumulator is one operator, not {spec!r}")
        ((op, arg),) = spec.items()
        value = lambda: self.expressions(arg)
        if op == "$count":
            return F.count(F.lit(1))
        if op == "$sum":
            if isinstance(arg, (int, float)) and not isinstance(arg, bool):
                return F.count(F.lit(1)) * F.lit(arg) if arg != 1 else F.count(F.lit(1))
            return F.sum(number(value(), self._kind(arg)))
        if op == "$avg":
            if self.sql_avg:
                return F.avg(value().try_cast("double"))
            return F.avg(number(value(), self._kind(arg)).cast("double"))
        if op == "$min":
            return F.min(value())
        if op == "$max":
            return F.max(value())
        if op in ("$first", "$last"):
            return self._edge(value(), op == "$first")
        if op in ("$push", "$addToSet"):
            items = self._collected(value())
            return F.array_distinct(items) if op == "$addToSet" else items
        if op in ("$stdDevPop", "$stdDevSamp"):
            return (F.stddev_pop if op == "$stdDevPop" else F.stddev_samp)(value())
        raise ValueError(f"unknown accumulator {op}")

    def _edge(self, value: Column, first: bool) -> Column:
        if not self.order:
            if self.strict_order:
                raise ValueError("$first and $last need a $sort before $group")
            return F.first(value) if first else F.last(value)
        # The least row under keys that all rise: those that fall are turned round. Aggregated on the map side, nothing is gathered.
        key = F.struct(*[self._rising(c, up, kind) for c, up, kind in self.order])
        pick = F.min_by if first else F.max_by
        return pick(F.struct(value.alias("v")), key).getField("v")

    @staticmethod
    def _rising(column: Column, up: bool, kind: T.DataType) -> Column:
        """A key in whose rising order the column rises with nulls first, or falls with nulls last."""
        if up:
            return column
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            turned = -column.cast("double")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            turned = F.bitwise_not(column.cast("long"))
        elif isinstance(kind, T.DecimalType):
            turned = -column
        elif isinstance(kind, T.BooleanType):
            turned = ~column
        elif isinstance(kind, T.DateType):
            turned = -F.unix_date(column)
        elif isinstance(kind, T.TimestampType):
            turned = -F.unix_micros(column)
        else:
            # Bytes as hexadecimal digits, each turned round; the end stands behind all digits, so a longer text comes before its beginning.
            turned = F.concat(F.translate(F.hex(F.to_binary(column.cast("string"), F.lit("utf-8"))), "0123456789ABCDEF", "fedcba9876543210"), F.lit("g"))
        return F.struct(column.isNull().alias("none"), turned.alias("turned"))

    def _collected(self, value: Column) -> Column:
        """Values in sort order, nulls kept."""
        if not self.order:
            return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda s: s["v"])
        keys = [c.alias(f"k{i}") for i, (c, _, _) in enumerate(self.order)]
        items = F.collect_list(F.struct(*keys, value.alias("v")))
        ups = [up for _, up, _ in self.order]
        if all(ups) or not any(ups):
            # The value is part of the struct but never decides, unless keys tie.
            ordered = F.sort_array(items, asc=ups[0])
        else:

            def compare(a: Column, b: Column) -> Column:
                out = F.lit(0)
                for i in reversed(range(len(ups))):
                    x, y = a[f"k{i}"], b[f"k{i}"]
                    less, more = (F.lit(-1), F.lit(1)) if ups[i] else (F.lit(1), F.lit(-1))
                    out = F.when(x.eqNullSafe(y), out).when(x.isNull(), less).when(y.isNull(), more).when(x < y, less).otherwise(more)
                return out

            ordered = F.array_sort(items, compare)
        return F.transform(ordered, lambda s: s["v"])

