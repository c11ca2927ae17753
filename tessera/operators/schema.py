"""Schemas: profiles of documents, promotion of fields to columns, evolution, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import materialize

_KINDS = {"bigint": "number", "double": "number", "decimal": "number", "int": "number", "float": "number", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "date", "binary": "binary", "void": "null"}
#: (least frequency, least share of the dominant type) of each promotion strategy (fixed values).
STRATEGIES = {"default": (0.8, 0.9), "conservative": (0.95, 0.99), "aggressive": (0.5, 0.7)}
_COLUMN = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "binary": T.BinaryType()}
#: Changes of a column's type that lose nothing (fixed values: these pairs are allowed, and anything scalar to VARIANT).
WIDENINGS = {
    ("int", "bigint"), ("int", "float"), ("int", "double"), ("bigint", "double"), ("float", "double"), ("date", "timestamp"),
    ("int", "variant"), ("bigint", "variant"), ("float", "variant"), ("double", "variant"), ("boolean", "variant"), ("string", "variant"),
    ("date", "variant"), ("timestamp", "variant"), ("binary", "variant"),
}


def profile(df: DataFrame, column: str, max_depth: int = 10, exclude: list[str] | None = None) -> DataFrame:
    """(path, count, frequency, dominant, dominant_share, nulls, types) of the fields of JSON texts or VARIANTs, nested ones by
    dotted path. A level of nesting is one pass of `variant_explode` over the objects of the level above, which are written before they are
    opened, so no level is parsed for those below it. Documents are never gathered."""
    import fnmatch

    spark = df.sparkSession
    if isinstance(df.schema[column].dataType, T.VariantType):
        rows = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    else:
        rows = df.select(F.try_parse_json(F.col(column)).alias("v")).where("v IS NOT NULL")
    level = rows.select(F.lit("").alias("path"), "v")
    total, counted = None, None
    for _ in range(max_depth):
        # A lateral join with the fields of each object, without a view of that name in the session.
        fields = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("key", F.col("value").alias("field")))
        fields = fields.where("key IS NOT NULL").select(F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"), F.col("field").alias("v"))
        shape = F.lower(F.regexp_extract(F.schema_of_variant("v"), r"^[A-Za-z]+", 0))
        kind = F.when(shape == "object", "object").when(shape == "array", "array")
        for name, short in _KINDS.items():
            kind = kind.when(shape == name, short)
        fields = fields.withColumn("kind", kind.otherwise("mixed"))
        found = materialize(fields.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")))
        counted = found if counted is None else counted.unionByName(found)
        if found.where("kind = 'object'").isEmpty():
            break
        level = materialize(fields.where("kind = 'object'").select("path", "v"))
    total = rows.count()
    for pattern in exclude or []:
        counted = counted.where(~F.col("path").rlike(fnmatch.translate(pattern)))
    by_path = counted.groupBy("path").agg(F.sum("n").alias("count"), F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("nulls"), F.max_by("kind", F.struct("n", "kind")).alias("dominant"), F.max("n").alias("top"), F.array_sort(F.collect_set("kind")).alias("types"))
    return by_path.select("path", "count", (F.col("count") / F.lit(float(max(total, 1)))).alias("frequency"), "dominant", (F.col("top") / F.col("count")).alias("dominant_share"), "nulls", "types")


def suggest_promotions(profiled: DataFrame, strategy: str = "default", arrays: bool = False, objects: bool = False, frequency: float | None = None, fields: list[str] | None = None, max_fields: int | None = None) -> DataFrame:
    """(path, type, frequency, confidence) of the fields frequent and uniform enough to be columns.

    Besides the named pairs of bounds: `frequency` takes what reaches `frequency` (0.8 unless given), however mixed the rest is; `manual` the named
    `fields` that occur; `adaptive` lowers the bound on frequency step by step, from 0.95 to 0.5, until at least one field in ten is taken.
    `max_fields` keeps the most frequent only.
    """
    bad = ["null", "mixed", *([] if arrays else ["array"]), *([] if objects else ["object"])]
    usable = profiled.where(~F.col("dominant").isin(bad))
    if strategy == "manual":
        found = usable.where(F.col("path").isin(fields or []))
    elif strategy == "frequency":
        found = usable.where(F.col("frequency") >= (0.8 if frequency is None else frequency))
    elif strategy == "adaptive":
        steps = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5]
        even = usable.where(F.col("dominant_share") >= 0.9)
        # One row: how many fields each step would take, of all.
        n = even.agg(*[F.coalesce(F.sum((F.col("frequency") >= x).cast("int")), F.lit(0)).alias(f"s{i}") for i, x in enumerate(steps)], F.count(F.lit(1)).alias("n")).first()
        found = even.where(F.col("frequency") >= next((x for i, x in enumerate(steps) if n[f"s{i}"] * 10 >= n.n), steps[-1]))
    else:
        least, share = STRATEGIES[strategy]
        found = usable.where((F.col("frequency") >= least) & (F.col("dominant_share") >= share))
    out = found.select("path", F.col("dominant").alias("type"), "frequency", F.col("dominant_share").alias("confidence")).orderBy(F.desc("frequency"), "path")
    return out.limit(max_fields) if max_fields is not None else out


def promote(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """df with fields of a JSON or VARIANT column as typed columns beside it; values of another type give NULL."""
    doc = F.col(column) if isinstance(df.schema[column].dataType, T.VariantType) else F.try_parse_json(F.col(column))
    for path, kind in paths.items():
        target = _COLUMN[kind].simpleString() if kind in _COLUMN else kind
        df = df.withColumn(path.replace(".", "_"), F.try_variant_get(doc, "$." + path, target))
    return df


def null_ratios(df: DataFrame) -> DataFrame:
    """(field, rows, nulls, ratio) for each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("nulls")) for i, c in enumerate(df.columns)])
    rows = counts.select("_rows", F.explode(items).alias("x"))
    return rows.select("x.field", F.col("_rows").alias("rows"), "x.nulls", F.coalesce(F.try_divide(F.col("x.nulls"), F.col("_rows")), F.lit(0.0)).alias("ratio"))


def _as_variant(value: Column, kind: T.DataType) -> Column:
    """The value alone as a VARIANT."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(value)
    return value.cast("variant")


def evolve(df: DataFrame, target: T.StructType, defaults: dict | None = None) -> DataFrame:
    """df read with another schema: new columns get defaults, dropped ones go, types widen; other changes raise."""
    out, have = [], {f.name: f.dataType for f in df.schema.fields}
    for f in target.fields:
        if f.name not in have:
            out.append(F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name))
            continue
        old, new = have[f.name].simpleString(), f.dataType.simpleString()
        if old != new and (old, new) not in WIDENINGS and not (new == "variant" and isinstance(have[f.name], (T.ArrayType, T.StructType, T.MapType))):
            raise ValueError(f"{f.name}: {old} can't become {new}")
        out.append(_as_variant(F.col(f"`{f.name}`"), have[f.name]).alias(f.name) if new == "variant" and old != "variant" else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
    return df.select(*out)


def compare(old: T.StructType, new: T.StructType) -> list[tuple[str, str, bool]]:
    """(field, what happened, whether it breaks readers) of two schemas."""
    a, b, out = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}, []
    for name in [*a, *(n for n in b if n not in a)]:
        if name not in b:
            out.append((name, "removed", True))
        elif name not in a:
            out.append((name, "added", not b[name].nullable))
        elif a[name].dataType != b[name].dataType:
            wide = (a[name].dataType.simpleString(), b[name].dataType.simpleString()) in WIDENINGS
            out.append((name, "widened" if wide else "retyped", not wide))
        elif a[name].nullable and not b[name].nullable:
            out.append((name, "required", True))
    return out


#: Named formats: e-mail with a dot in the domain, calendar dates and times of RFC 3339, UUIDs of RFC 9562 with their version and variant, URIs of RFC 3986.
_DAY = r"[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-9]))"
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FORMATS = {
    "email": r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+$",
    "date": f"^{_DAY}$",
    "time": f"^{_TIME}(?:[Zz]|[+-][0-9]{{2}}:[0-9]{{2}})?$",
    "date-time": f"^{_DAY}[Tt ]{_TIME}(?:[Zz]|[+-][0-9]{{2}}:[0-9]{{2}})?$",
    "uuid": r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$",
    "ipv4": rf"^{_OCTET}(?:\.{_OCTET}){{3}}$",
}


def _is_format(value: Column, name: str) -> Column:
    ok = value.rlike(FORMATS[name])
    if name in ("date", "date-time"):  # 29 February of common years
        ok = ok & F.coalesce(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))
    return ok


def validation_errors(df: DataFrame, schema: dict) -> Column:
    """An array of what is wrong with each row under a JSON schema (types, required, ranges, lengths, patterns, formats, enums)."""
    from tessera.functions.fields import Fields, kind_of

    fields, checks = Fields(df), []

    def add(bad: Column, text: str) -> None:
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(text)))

    def walk(spec: dict, prefix: str) -> None:
        for name in spec.get("required", []):
            add(fields.col(prefix + name).isNull(), f"{prefix}{name} is missing")
        for name, rule in spec.get("properties", {}).items():
            path = prefix + name
            kind, col = fields.type_of(path), fields.col(path)
            if kind is None:
                continue
            wanted = {"integer": "number"}.get(rule.get("type"), rule.get("type"))
            if wanted and kind_of(kind) != wanted:
                add(col.isNotNull(), f"{path} has another type than {rule['type']}")
                continue
            for key, bad, text in (
                ("minimum", lambda x, c=col: c < x, "at least"), ("maximum", lambda x, c=col: c > x, "at most"),
                ("minLength", lambda x, c=col: F.char_length(c) < x, "at least in length"), ("maxLength", lambda x, c=col: F.char_length(c) > x, "at most in length"),
                ("minItems", lambda x, c=col: F.size(c) < x, "at least in items"), ("maxItems", lambda x, c=col: F.size(c) > x, "at most in items"),
            ):
                if key in rule:
                    add(bad(rule[key]), f"{path} should be {text} {rule[key]}")
            if "pattern" in rule:
                add(~col.rlike(rule["pattern"]), f"{path} isn't matched by {rule['pattern']}")
            if "format" in rule and rule["format"] in FORMATS:
                add(~_is_format(col, rule["format"]), f"{path} isn't in the format {rule['format']}")
            if "enum" in rule:
                add(~col.isin(rule["enum"]), f"{path} isn't among {', '.join(map(str, rule['enum']))}")
            if rule.get("properties"):
                walk(rule, path + ".")

    walk(schema, "")
    return F.array_compact(F.array(*checks)) if checks else F.expr("cast(array() as array<string>)")
