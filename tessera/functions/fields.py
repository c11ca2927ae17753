"""Document paths as columns: typed columns, or one VARIANT column for schemaless documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 32
_UNSAFE = {"__proto__", "constructor", "prototype"}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def parts_of(path: str) -> list[str]:
    parts = path.split(".")
    if not path or any(not p for p in parts):
        raise ValueError(f"empty path segment in {path!r}")
    if len(parts) > MAX_DEPTH:
        raise ValueError(f"path is deeper than {MAX_DEPTH}: {path!r}")
    if _UNSAFE & set(parts):
        raise ValueError(f"forbidden name in path {path!r}")
    return parts


def kind_of(kind: T.DataType) -> str:
    """Comparison bracket of a type: values of different brackets never compare as equal or ordered."""
    if isinstance(kind, _NUMERIC):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return "other"


class Fields:
    """Columns of a frame by dotted path. A path that the schema lacks is a missing field: a NULL.

    In typed mode NULL stands for both a missing field and null. With `variant`, the name of a VARIANT column,
    paths outside the real columns are looked up in it, where the two stay distinct.
    """

    def __init__(self, df: DataFrame, variant: str | None = None) -> None:
        self.schema, self.variant = df.schema, variant

    def type_of(self, path: str) -> T.DataType | None:
        kind: T.DataType | None = self.schema
        for p in parts_of(path):
            if isinstance(kind, T.StructType):
                kind = next((f.dataType for f in kind.fields if f.name == p), None)
            elif isinstance(kind, T.ArrayType) and p.isdigit():
                kind = kind.elementType
            elif isinstance(kind, T.MapType):
                kind = kind.valueType
            elif isinstance(kind, T.VariantType):
                return T.VariantType()
            else:
                return None
        return kind

    def in_variant(self, path: str) -> bool:
        return bool(self.variant) and self.type_of(path) is None

    def _json_path(self, path: str) -> str:
        return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p.replace("'", "\\'") + "']" for p in parts_of(path))

    def variant_value(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(F.col(self.variant), self._json_path(path), kind)

    def col(self, path: str) -> Column:
        if self.in_variant(path):
            return self.variant_value(path)
        parts, kind = parts_of(path), self.schema
        if self.type_of(path) is None:
            return F.lit(None)
        out: Column | None = None
        for p in parts:
            if out is None:
                out = F.col(f"`{p}`")
            elif isinstance(kind, T.ArrayType):
                out = F.get(out, int(p))
            elif isinstance(kind, T.MapType):
                out = F.try_element_at(out, F.lit(p))
            else:
                out = out.getField(p)
            kind = next(f.dataType for f in kind.fields if f.name == p) if isinstance(kind, T.StructType) else getattr(kind, "elementType", getattr(kind, "valueType", None))
        return out

    def exists(self, path: str) -> Column:
        """Whether the field is there: in a VARIANT a null counts, in typed columns it can't be told."""
        return self.col(path).isNotNull()


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with the column or nested struct field set; missing parents become structs."""
    top, *rest = parts_of(path)
    if not rest:
        return df.withColumn(top, value)
    kind = next((f.dataType for f in df.schema.fields if f.name == top), None)

    def nested(kind, now: Column | None, rest: list[str]) -> Column:
        name, *more = rest
        if not isinstance(kind, T.StructType):
            return F.struct((nested(None, None, more) if more else value).alias(name))
        inner = next((f.dataType for f in kind.fields if f.name == name), None)
        made = nested(inner, now.getField(name) if inner is not None else None, more) if more else value
        return F.struct(*[now.getField(f.name).alias(f.name) for f in kind.fields if f.name != name], made.alias(name))

    return df.withColumn(top, nested(kind, F.col(f"`{top}`") if kind is not None else None, rest))


def drop_path(df: DataFrame, path: str) -> DataFrame:
    top, *rest = parts_of(path)
    if not rest:
        return df.drop(top)
    if Fields(df).type_of(path) is None:
        return df
    return df.withColumn(top, F.col(f"`{top}`").dropFields(".".join(rest)))
