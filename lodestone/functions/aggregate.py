"""Aggregate functions in Spark SQL; all are partially aggregated before a shuffle."""

from __future__ import annotations

from pyspark.sql import types as T

from lodestone.plans import values as v
from lodestone.plans.values import Value


def aggregate(name: str, arg: Value | None, distinct: bool, order: str | None = None) -> Value:
    """order: what rows were inserted by, if known. COUNT skips nulls; SUM and AVG take what isn't a number as nothing and are 0 over no rows; AVG divides by all rows of the group, nulls too, unless DISTINCT."""
    once = "DISTINCT " if distinct else ""
    if name == "COUNT":
        if arg is None:
            return Value("count(1)", T.LongType())
        if distinct and arg.kind in ("variant", "doc"):
            return Value(f"count(DISTINCT {v.as_string(arg)})", T.LongType())
        return Value(f"count({once}{arg.sql})", T.LongType())
    assert arg is not None
    number = arg.number or arg.kind == "variant"
    if name == "SUM":
        if not number:
            return v.literal(0)
        if arg.kind in ("int", "bool"):
            return Value(f"coalesce(sum({once}CAST({v.as_number(arg)} AS BIGINT)), 0L)", T.LongType())
        return Value(f"coalesce(sum({once}{v.as_double(arg)}), 0D)", T.DoubleType())
    if name == "AVG":
        if not number:
            return v.literal(0.0)
        whole = f"count(DISTINCT {v.as_double(arg)})" if distinct else "count(1)"
        total = f"sum({once}CAST({v.as_number(arg)} AS BIGINT))" if arg.kind in ("int", "bool") else f"sum({once}{v.as_double(arg)})"
        return Value(f"coalesce(coalesce({total}, 0) / nullif({whole}, 0), 0D)", T.DoubleType())
    if arg.kind in ("null", "doc", "list"):
        return v.NULL
    if arg.kind == "variant":
        # Unlike kinds don't compare: the kind that came first (else numbers, if there are any) is the one whose least or greatest value counts.
        tie = f"schema_of_variant({arg.sql})" if not order else order if name == "MIN" else f"-{order}"  # of equal values the first
        by = lambda x: f"{name.lower()}_by({arg.sql}, struct({x}, {tie})) FILTER (WHERE {x} IS NOT NULL)"
        number, said = by(v.as_number(arg)), by(v.variant_text(arg))
        kind = f"CASE WHEN {v.as_number(arg)} IS NOT NULL THEN 1 WHEN schema_of_variant({arg.sql}) = 'STRING' THEN 2 END"
        first = f"min(struct({order}, {kind})) FILTER (WHERE {kind} IS NOT NULL).col2" if order else f"min({kind})"
        return Value(f"if({first} = 1, {number}, {said})", T.VariantType())
    return Value(f"{name.lower()}({arg.sql})", arg.type)
