"""Stages that change the shape of rows: projections, added and removed fields, new roots, unwinding, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expressions import Expressions, slice_of
from tessera.functions.fields import Fields, drop_path, parts_of, set_path
from tessera.functions.filters import compile_filter, true
from tessera.plans.validation import InvalidQuery, check_projection


def project(df: DataFrame, spec: dict, variables: dict | None = None) -> DataFrame:
    """Inclusion (`1`, true, `$slice`, `$elemMatch` or an expression), or exclusion (`0`, false). `_id` stays unless
    excluded; fields that don't exist are left out; dotted inclusions keep nested structs."""
    if not check_projection(spec):
        for path in (k for k, v in spec.items() if v in (0, False)):
            df = drop_path(df, path)
        return df
    fields, expressions = Fields(df), Expressions(Fields(df), variables)
    tree: dict = {}
    if "_id" in df.columns and spec.get("_id", 1) not in (0, False):
        tree["_id"] = F.col("_id")
    for path, value in spec.items():
        if path == "_id" and value in (0, False, 1, True) and not isinstance(value, str):
            continue
        if value in (1, True) and not isinstance(value, (str, dict, list)):
            if fields.type_of(path) is None:
                continue
            made = fields.col(path)
        elif isinstance(value, dict) and "$slice" in value and not isinstance(value["$slice"], list) or isinstance(value, dict) and "$slice" in value and all(isinstance(x, int) for x in value["$slice"]):
            args = value["$slice"] if isinstance(value["$slice"], list) else [value["$slice"]]
            made = slice_of(fields.col(path), args)
        elif isinstance(value, dict) and "$elemMatch" in value:
            from tessera.functions.filters import FilterCompiler

            kind = fields.type_of(path)
            if not isinstance(kind, T.ArrayType):
                continue
            made = F.get(F.filter(fields.col(path), _element_test(kind.elementType, value["$elemMatch"], FilterCompiler(fields))), 0)
        else:
            made = expressions(value)
        node = tree
        *parents, last = parts_of(path)
        for p in parents:
            node = node.setdefault(p, {})
        node[last] = made

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*build(tree))


def _element_test(kind: T.DataType, query: dict, outer):
    from tessera.functions.filters import _Element

    return lambda x: _Element(kind, x, outer).matches(query)


def add_fields(df: DataFrame, spec: dict, variables: dict | None = None) -> DataFrame:
    """Sets fields one after the other: later expressions see earlier fields."""
    for path, value in spec.items():
        df = set_path(df, path, Expressions(Fields(df), variables)(value))
    return df


def unset(df: DataFrame, names: str | list[str]) -> DataFrame:
    for path in [names] if isinstance(names, str) else names:
        df = drop_path(df, path)
    return df


def replace_root(df: DataFrame, spec: object) -> DataFrame:
    """The document at a path, or an object expression, becomes the row; a row without one raises."""
    fields = Fields(df)
    expressions = Expressions(fields)
    if isinstance(spec, str) and not isinstance(fields.type_of(spec.removeprefix("$")), T.StructType):
        raise InvalidQuery(f"{spec} is no document")
    found = expressions.struct_fields(spec)
    if not found:
        raise InvalidQuery("the new root is no document")
    out = [c.alias(n) for n, c in found.items()]
    if isinstance(spec, str):
        root = expressions(spec)
        df = df.where(F.when(root.isNull(), F.raise_error(F.lit("the new root is null")).cast("boolean")).otherwise(True))
    return df.select(*out)


def unwind(df: DataFrame, spec: str | dict) -> DataFrame:
    """A row for each item of an array. Without `preserveNullAndEmptyArrays` rows without items (and scalars)
    go; with it they stay, with null for an empty array. `includeArrayIndex` names a column for the place."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, keep, index = spec["path"].removeprefix("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    fields = Fields(df)
    if not isinstance(fields.type_of(path), T.ArrayType):
        if not keep:
            return df.where(F.lit(False))
        return df.withColumn(index, F.lit(None).cast("int")) if index else df
    make = F.posexplode_outer if keep else F.posexplode
    df = df.select("*", make(fields.col(path)).alias("_at", "_item"))
    df = set_path(df, path, F.col("_item")).drop("_item")
    return df.withColumnRenamed("_at", index) if index else df.drop("_at")


class _Redaction:
    """Redaction by recursion over the schema: at each document the expression keeps it whole, prunes it, or
    descends into its documents and arrays of documents."""

    def __init__(self, spec: object) -> None:
        self.spec = spec

    def decision(self, kind: T.StructType, fields: _Inner) -> Column:
        return self._decide(self.spec, Expressions(fields))

    def _decide(self, spec: object, expressions: Expressions) -> Column:
        if spec in ("$$KEEP", "$$PRUNE", "$$DESCEND"):
            return F.lit(spec[2:])
        if isinstance(spec, dict) and "$cond" in spec:
            c = spec["$cond"]
            test, yes, no = (c["if"], c["then"], c["else"]) if isinstance(c, dict) else c
            return F.when(true(expressions(test).cast("boolean")), self._decide(yes, expressions)).otherwise(self._decide(no, expressions))
        raise InvalidQuery("$redact gives $$KEEP, $$PRUNE or $$DESCEND")

    def apply(self, kind: T.StructType, at: Column | None) -> tuple[Column, dict[str, Column]]:
        """The decision for a document, and its fields as they are after a descent."""
        own = _Inner(kind, at)
        out = {}
        for f in kind.fields:
            col = own.col(f.name)
            if isinstance(f.dataType, T.StructType):
                col = self.nested(f.dataType, col)
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                col = self.items(f.dataType.elementType, col)
            out[f.name] = col
        return self.decision(kind, own), out

    def items(self, kind: T.StructType, array: Column) -> Column:
        return F.filter(F.transform(array, lambda x: self.nested(kind, x)), lambda x: x.isNotNull())

    def nested(self, kind: T.StructType, at: Column) -> Column:
        """The struct after redaction; NULL if pruned or missing."""
        decision, fields = self.apply(kind, at)
        descended = F.struct(*[c.alias(n) for n, c in fields.items()])
        return F.when(at.isNull() | (decision == "PRUNE"), F.lit(None)).when(decision == "KEEP", at).otherwise(descended)


class _Inner(Fields):
    """Fields of a struct column."""

    def __init__(self, kind: T.StructType, at: Column | None) -> None:
        self.schema, self.variant, self.at = kind, None, at

    def col(self, path: str) -> Column:
        if self.type_of(path) is None:
            return F.lit(None)
        out = self.at
        for p in path.split("."):
            out = F.col(f"`{p}`") if out is None else out.getField(p)
        return out


def redact(df: DataFrame, spec: object) -> DataFrame:
    decision, fields = _Redaction(spec).apply(df.schema, None)
    kept = df.withColumn("_decision", decision).where("_decision <> 'PRUNE'")
    return kept.select(*[F.when(F.col("_decision") == "KEEP", F.col(f"`{n}`")).otherwise(c).alias(n) for n, c in fields.items()])


def match(df: DataFrame, query: dict, variables: dict | None = None, variant: str | None = None, text: list[str] | None = None) -> DataFrame:
    """Rows that a filter lets through; `text` names the fields that its `$text` searches."""
    from tessera.operators.search import matches

    fields = Fields(df, variant)

    def searched(spec: dict) -> Column:
        return matches(spec["$search"], [fields.col(f) for f in text], bool(spec.get("$caseSensitive")), bool(spec.get("$diacriticSensitive", True)))

    return df.where(compile_filter(query, fields, Expressions(fields, variables), searched if text else None))
