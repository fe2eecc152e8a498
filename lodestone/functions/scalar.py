"""Scalar functions: name -> arity and how they are written in Spark SQL. Nothing runs in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T

from lodestone.plans import values as v
from lodestone.plans.values import Value

S, L, D = T.StringType(), T.LongType(), T.DoubleType()
#: White space that TRIM takes off on both sides; LTRIM and RTRIM take off the first four.
BLANKS = r"' \t\n\r\u000B\f\u0085 '"


class ArityError(ValueError):
    pass


def _string(template: str, type_: T.DataType = S) -> Callable[..., Value]:
    """A function of canonical strings, null if the first is."""
    return lambda *a: Value(template.format(*[v.as_string(x) for x in a]), type_)


def _number(x: Value, name: str) -> str:
    if not (x.number or x.kind in ("null", "variant")):
        raise ArityError(f"{name} needs a number")
    return "CAST(NULL AS DOUBLE)" if x.kind == "null" else v.as_number(x)


def _position(x: Value) -> str:
    return f"CAST({v.as_number(x)} AS INT)" if x.number or x.kind == "variant" else f"coalesce(CAST(try_cast({v.as_string(x)} AS DOUBLE) AS INT), 0)"


def _substr(x: Value, start: Value, n: Value | None = None) -> Value:
    s, at = v.as_string(x), f"greatest({_position(start)}, 1)"
    return Value(f"substring({s}, {at})" if n is None else f"substring({s}, {at}, greatest({_position(n)}, 0))", S)


def _instr(x: Value, part: Value) -> Value:
    """The place in UTF-8 bytes, from 1; 0 if the part isn't there."""
    s, p = v.as_string(x), v.as_string(part)
    return Value(f"CASE WHEN {s} IS NULL THEN NULL WHEN instr({s}, coalesce({p}, '')) > 0 THEN CAST(octet_length(substring({s}, 1, instr({s}, coalesce({p}, '')) - 1)) AS BIGINT) + 1L ELSE 0L END", L)


def _repeat(x: Value, n: Value) -> Value:
    s = v.as_string(x)
    times = f"coalesce({_position(n)}, 0)" if n.number or n.kind == "variant" else "0"
    return Value(f"repeat({s}, greatest({times}, 0))", S)


def _abs(x: Value) -> Value:
    s = _number(x, "ABS")
    return Value(f"abs({s})", L if x.kind == "int" and isinstance(x.type, T.LongType) else x.type if x.kind == "int" else D)


def _round(x: Value, digits: Value | None = None) -> Value:
    """Half away from zero; to whole numbers without digits, else by scaling."""
    d = f"CAST({_number(x, 'ROUND')} AS DOUBLE)"
    if digits is None or digits.sql == "0L":
        return Value(f"CAST(round({d}) AS BIGINT)", L)
    scale = f"power(10D, {v.as_number(digits)})"
    return Value(f"(round({d} * {scale}) / {scale})", D)


def _whole(name: str) -> Callable[[Value], Value]:
    return lambda x: Value(f"CAST({name}({_number(x, name.upper())}) AS BIGINT)", L)


def _coalesce(*a: Value) -> Value:
    type_ = v.common([x.type for x in a])
    if type_ is None:
        return Value(f"coalesce({', '.join(v.as_string(x) for x in a)})", S)
    return Value(f"coalesce({', '.join(x.sql for x in a)})", type_)


def _nullif(a: Value, b: Value) -> Value:
    if "null" in (a.kind, b.kind):
        return a
    return Value(f"CASE WHEN {v.as_string(a)} = {v.as_string(b)} THEN NULL ELSE {a.sql} END", a.type)


#: What TYPEOF says.
TYPE_NAMES = {"null": "null", "str": "text", "int": "integer", "float": "real", "bool": "boolean"}


def _typeof(x: Value) -> Value:
    if x.kind == "null":
        return v.literal("null")
    if x.kind == "variant":
        said = f"schema_of_variant({x.sql})"
        return Value(f"CASE WHEN {v.is_null(x)} THEN 'null' WHEN {said} = 'STRING' THEN 'text' WHEN {said} = 'BOOLEAN' THEN 'boolean' WHEN {said} = 'BIGINT' THEN 'integer' WHEN {said} RLIKE '^(DOUBLE|DECIMAL)' THEN 'real' ELSE 'unknown' END", S)
    return Value(f"if({x.sql} IS NULL, 'null', '{TYPE_NAMES.get(x.kind, 'unknown')}')", S)


FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "UPPER": (1, 1, _string("upper({0})")),
    "LOWER": (1, 1, _string("lower({0})")),
    "TRIM": (1, 1, _string(f"trim(BOTH {BLANKS} FROM {{0}})")),
    "LTRIM": (1, 1, _string(r"trim(LEADING ' \t\n\r' FROM {0})")),
    "RTRIM": (1, 1, _string(r"trim(TRAILING ' \t\n\r' FROM {0})")),
    "LENGTH": (1, 1, _string("CAST(length({0}) AS BIGINT)", L)),
    "SUBSTR": (2, 3, _substr),
    "SUBSTRING": (2, 3, _substr),
    "CONCAT": (1, 99, lambda *a: Value(f"concat_ws('', {', '.join(v.as_string(x) for x in a)})", S)),
    "REPLACE": (3, 3, lambda a, b, c: Value(f"replace({v.as_string(a)}, coalesce({v.as_string(b)}, ''), coalesce({v.as_string(c)}, ''))", S)),
    "INSTR": (2, 2, _instr),
    "REVERSE": (1, 1, _string("reverse({0})")),
    "REPEAT": (2, 2, _repeat),
    "HEX": (1, 1, _string("hex({0})")),
    "ABS": (1, 1, _abs),
    "ROUND": (1, 2, _round),
    "CEIL": (1, 1, _whole("ceil")),
    "FLOOR": (1, 1, _whole("floor")),
    "COALESCE": (1, 99, _coalesce),
    "IFNULL": (2, 2, _coalesce),
    "NULLIF": (2, 2, _nullif),
    "TYPEOF": (1, 1, _typeof),
    "SYSDATE": (0, 0, lambda: Value("date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')", S)),
    "NOW": (0, 0, lambda: Value("date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')", S)),
    "CURRENT_DATE": (0, 0, lambda: Value("date_format(current_timestamp(), 'yyyy-MM-dd')", S)),
    "CURRENT_TIMESTAMP": (0, 0, lambda: Value("date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")", S)),
}


def call(name: str, args: list[Value]) -> Value:
    if name not in FUNCTIONS:
        raise ArityError(f"no function {name}")
    least, most, build = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise ArityError(f"{name} takes {least if least == most else f'{least} to {most}'} arguments, not {len(args)}")
    return build(*args)
