"""Schemas that grow with the documents: widening, and VARIANT where kinds conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, VARIANT = T.LongType(), T.DoubleType(), T.VariantType()


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """null < bigint < double; documents by field, arrays by element; any other two kinds become VARIANT."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged_fields(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return LONG
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return DOUBLE
    return VARIANT


def merged_fields(a: T.StructType, b: T.StructType) -> T.StructType:
    other = {f.name: f.dataType for f in b}
    known = {f.name for f in a}
    both = [T.StructField(f.name, merged(f.dataType, other.get(f.name, T.NullType()))) for f in a]
    return T.StructType(both + [T.StructField(f.name, f.dataType) for f in b if f.name not in known])


def has_variant_below(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(isinstance(f.dataType, T.VariantType) or has_variant_below(f.dataType) for f in t)
    return isinstance(t, T.ArrayType) and (isinstance(t.elementType, T.VariantType) or has_variant_below(t.elementType))


def settled(s: T.StructType) -> T.StructType:
    """A conflict within a document or array makes the whole top-level field VARIANT."""
    return T.StructType([T.StructField(f.name, VARIANT if has_variant_below(f.dataType) else f.dataType) for f in s])


def inferred(value: object) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return LONG
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, dict):
        return T.StructType([T.StructField(str(k), inferred(x)) for k, x in value.items()])
    if isinstance(value, list | tuple):
        out: T.DataType = T.NullType()
        for x in value:
            out = merged(out, inferred(x))
        return T.ArrayType(out)
    return T.StringType()


def converted(sql: str, a: T.DataType, b: T.DataType, depth: int = 0) -> str:
    """sql of type a as type b, which a widens to."""
    if a == b:
        return sql
    if isinstance(a, T.NullType):
        return f"CAST(NULL AS {b.simpleString()})"
    if isinstance(b, T.VariantType):
        return f"to_variant_object({sql})" if isinstance(a, T.StructType | T.ArrayType | T.MapType) else f"CAST({sql} AS VARIANT)"
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        own = {f.name: f.dataType for f in a}
        fields = []
        for f in b:
            have = own.get(f.name)
            fields.append(f"'{f.name}', " + (f"CAST(NULL AS {f.dataType.simpleString()})" if have is None else converted(f"{sql}.`{f.name}`", have, f.dataType, depth)))
        return f"if({sql} IS NULL, NULL, named_struct({', '.join(fields)}))"
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return f"transform({sql}, x{depth} -> {converted(f'x{depth}', a.elementType, b.elementType, depth + 1)})"
    return f"CAST({sql} AS {b.simpleString()})"


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    own = {f.name: f.dataType for f in df.schema}
    columns = []
    for f in schema:
        name = "`" + f.name.replace("`", "``") + "`"
        said = converted(name, own[f.name], f.dataType) if f.name in own else f"CAST(NULL AS {f.dataType.simpleString()})"
        columns.append(F.expr(said).alias(f.name))
    return df.select(*columns)
