"""Spark SQL text with a static type, and the dialect's two-valued rules over it.

Comparisons never yield null: null equals null and differs from all else, and an order with null is false. In a positive place (a
filter's top level, where null means false anyway) the plain operator is written, so that filters reach the Parquet reader.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    sql: str
    type: T.DataType
    literal: bool = False

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, T.IntegralType):
            return "int"
        if isinstance(t, T.NumericType):
            return "float"
        if isinstance(t, T.StringType | T.CharType | T.VarcharType):
            return "str"
        if isinstance(t, T.VariantType):
            return "variant"
        if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
            return "time"
        if isinstance(t, T.ArrayType):
            return "list"
        return "doc" if isinstance(t, T.StructType | T.MapType) else "other"

    @property
    def number(self) -> bool:
        return self.kind in ("int", "float", "bool")


NULL = Value("NULL", T.NullType(), True)
TRUE, FALSE = Value("TRUE", T.BooleanType(), True), Value("FALSE", T.BooleanType(), True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(s: str) -> str:
    """A string literal. Spark puts variables in for ${...} before it parses, in literals too, so no such thing may stand there."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"


def literal(v: object) -> Value:
    if v is None:
        return NULL
    if isinstance(v, bool):
        return TRUE if v else FALSE
    if isinstance(v, int):
        return Value(f"{v}L" if v > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)", T.LongType(), True)
    if isinstance(v, float):
        return Value(f"CAST({text(repr(v))} AS DOUBLE)" if v != v or v in (float("inf"), float("-inf")) else f"{v!r}D", T.DoubleType(), True)
    return Value(text(str(v)), T.StringType(), True)


def boolean(sql: str) -> Value:
    return Value(sql, T.BooleanType())


def sure(sql: str, positive: bool) -> str:
    """sql without null: as it is where null means false."""
    return f"({sql})" if positive else f"coalesce({sql}, FALSE)"


#: Kinds of variant values that are numbers, as schema_of_variant says them.
_NUMBERS = "'^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)'"


def as_number(v: Value) -> str:
    if v.kind == "bool":
        return v.sql if v.literal and v.sql.isdigit() else f"CAST({v.sql} AS INT)"
    if v.kind == "variant":
        return f"if(schema_of_variant({v.sql}) RLIKE {_NUMBERS}, try_variant_get({v.sql}, '$', 'double'), if(schema_of_variant({v.sql}) = 'BOOLEAN', CAST(try_variant_get({v.sql}, '$', 'boolean') AS DOUBLE), NULL))"
    return v.sql


def as_double(v: Value) -> str:
    return v.sql if isinstance(v.type, T.DoubleType) else f"CAST({as_number(v)} AS DOUBLE)"


def as_string(v: Value) -> str:
    """The canonical string: whole doubles without a fraction; text as it is."""
    k = v.kind
    if k == "str":
        return v.sql
    if k == "null":
        return "CAST(NULL AS STRING)"
    if k == "float":
        d = as_double(v)
        return f"if({d} = rint({d}) AND abs({d}) < 1e15D, CAST(CAST({d} AS BIGINT) AS STRING), CAST({d} AS STRING))"
    if k == "doc" or k == "list":
        return f"to_json({v.sql})"
    return f"CAST({v.sql} AS STRING)"


def is_null(v: Value) -> str:
    if v.kind == "null":
        return "TRUE"
    return f"({v.sql} IS NULL OR is_variant_null({v.sql}))" if v.kind == "variant" else f"({v.sql} IS NULL)"


def variant_text(v: Value) -> str:
    """The text that a variant holds, null if it holds something else."""
    return f"if(schema_of_variant({v.sql}) = 'STRING', variant_get({v.sql}, '$', 'string'), NULL)"


def key(v: Value, other: str = "") -> str:
    """What equal values share: numbers and booleans by number, texts by text, null for null. Documents and arrays equal nothing: `other` is what stands for them, a text of its own on each side."""
    if v.kind == "str":
        return f"concat('t', {v.sql})"
    if v.number:
        return f"concat('n', CAST({as_double(v)} + 0D AS STRING))"
    return f"CASE WHEN {is_null(v)} THEN NULL WHEN schema_of_variant({v.sql}) = 'STRING' THEN {key(Value(variant_text(v), T.StringType()))} ELSE coalesce(concat('n', CAST({as_number(v)} + 0D AS STRING)), {text(other)}) END"


def identity(v: Value) -> str:
    """Kind and content of any value, as text: what DISTINCT tells rows apart by."""
    if v.kind != "variant":
        return as_string(v) if v.kind in ("doc", "list", "null") else v.sql
    return f"coalesce({key(v, 'o')}, '') || if({is_null(v)}, '', if(schema_of_variant({v.sql}) = 'BOOLEAN', 'b', if({key(v, 'o')} = 'o', to_json({v.sql}), '')))"


def rank(v: Value) -> list[str]:
    """Sort keys of a variant: nulls first, then numbers, then texts, then the rest by their JSON."""
    place = f"CASE WHEN {is_null(v)} THEN 0 WHEN {as_number(v)} IS NOT NULL THEN 1 WHEN schema_of_variant({v.sql}) = 'STRING' THEN 2 ELSE 3 END"
    return [place, as_number(v), f"if({as_number(v)} IS NULL, coalesce({variant_text(v)}, to_json({v.sql})), NULL)"]


def aligned(a: Value, b: Value) -> tuple[str, str] | None:
    """Both sides in a type that can be ordered; None if values of these kinds never compare."""
    ka, kb = a.kind, b.kind
    if a.number and b.number:
        return (a.sql, b.sql) if ka == kb == "bool" else (as_number(a), as_number(b))
    if "variant" in (ka, kb):
        other = kb if ka == "variant" else ka
        if a.number or b.number:
            return as_number(a), as_number(b)
        said = lambda v: variant_text(v) if v.kind == "variant" else v.sql
        return (said(a), said(b)) if other == "str" else None
    if ka == kb and ka in ("str", "time", "other"):
        return a.sql, b.sql
    if {ka, kb} == {"time", "str"}:  # a date written as text
        stamp = lambda v, o: f"try_cast({v.sql} AS {o.type.simpleString()})" if v.kind == "str" else v.sql
        return stamp(a, b), stamp(b, a)
    return None


def matched(a: Value, b: Value) -> tuple[str, str] | None:
    """Both sides so that they are equal, null-safely, just when the values are; None if they never are but for two nulls."""
    if "variant" in (a.kind, b.kind) and not (a.literal or b.literal):
        return (key(a, "a"), key(b, "b")) if all(v.number or v.kind in ("variant", "str") for v in (a, b)) else None
    return aligned(a, b)


def equal(a: Value, b: Value, positive: bool, joining: bool = False) -> str:
    """joining: keys that are null meet nothing."""
    if a.kind == "null" or b.kind == "null":
        return "FALSE" if joining else is_null(b if a.kind == "null" else a)
    both = matched(a, b)
    if both is None:
        return "FALSE" if joining or a.literal or b.literal or "doc" in (a.kind, b.kind) else f"({is_null(a)} AND {is_null(b)})"
    x, y = both
    if joining:
        return f"({x} = {y})"
    return f"({x} = {y})" if positive and (a.literal or b.literal) else f"({x} <=> {y})"


def ordered(op: str, a: Value, b: Value, positive: bool) -> str:
    if a.kind == b.kind == "variant":
        return sure(f"coalesce({as_number(a)} {op} {as_number(b)}, {variant_text(a)} {op} {variant_text(b)})", positive)
    both = None if "null" in (a.kind, b.kind) else aligned(a, b)
    return "FALSE" if both is None else sure(f"{both[0]} {op} {both[1]}", positive)


def between(x: Value, low: Value, high: Value, positive: bool) -> str:
    if "null" in (x.kind, low.kind, high.kind):
        return "FALSE"
    if x.kind == "str" and low.number and high.number:
        d = f"try_cast({x.sql} AS DOUBLE)"
        return sure(f"coalesce({d} BETWEEN {as_number(low)} AND {as_number(high)}, {x.sql} BETWEEN {as_string(low)} AND {as_string(high)})", positive)
    a, b = aligned(x, low), aligned(x, high)
    if a is None or b is None:
        s = as_string(x)
        return sure(f"{s} BETWEEN {as_string(low)} AND {as_string(high)}", positive)
    return sure(f"{a[0]} >= {a[1]} AND {b[0]} <= {b[1]}", positive)


def like(x: Value, pattern: str, negated: bool, positive: bool) -> str:
    if x.kind == "null":
        return "FALSE"
    said = f"{as_string(x)} ILIKE {text(pattern.replace(chr(92), chr(92) * 2))}"
    return f"({x.sql} IS NOT NULL AND NOT {said})" if negated else sure(said, positive)


def truthy(v: Value, positive: bool) -> str:
    k = v.kind
    if k == "null":
        return "FALSE"
    if k == "bool":
        return v.sql if positive else f"coalesce({v.sql}, FALSE)"
    if k in ("int", "float"):
        return sure(f"{v.sql} <> 0", positive)
    if k == "str":
        return sure(f"{v.sql} <> ''", positive)
    if k == "variant":
        return sure(f"coalesce({as_number(v)} <> 0, CAST({v.sql} AS STRING) <> '')", positive)
    return f"({v.sql} IS NOT NULL)"


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Whole numbers stay whole but for `/`; what isn't a number makes null; a zero divisor is an error."""
    if any(not (v.number or v.kind == "variant") for v in (a, b)):
        return Value("CAST(NULL AS DOUBLE)", T.DoubleType())
    if op != "/" and a.kind == b.kind == "int":
        long = lambda v: v.sql if isinstance(v.type, T.LongType) else f"CAST({v.sql} AS BIGINT)"
        return Value(f"({long(a)} {op} {long(b)})", T.LongType())
    return Value(f"({as_double(a)} {op} {as_double(b)})", T.DoubleType())


def common(types: list[T.DataType]) -> T.DataType | None:
    """One type for all branches, or None if they only meet as text."""
    kinds = {Value("", t).kind: t for t in types if not isinstance(t, T.NullType)}
    if not kinds:
        return T.NullType()
    if len(kinds) == 1:
        distinct = [t for t in types if not isinstance(t, T.NullType)]
        if all(t == distinct[0] for t in distinct):
            return distinct[0]
        return T.LongType() if "int" in kinds else T.DoubleType() if "float" in kinds else None
    return T.DoubleType() if set(kinds) <= {"int", "float"} else None
