"""Filters compiled to one boolean column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.operators.values import Value, definite, every, some, true
from docquarry.plans.filters import RANGE, At, Branch, Condition, Expr, Op


def compile_filter(expr: Expr | None, root: Value) -> Column:
    """True for matches; may be NULL instead of false."""
    if expr is None:
        return true()
    if isinstance(expr, At):
        return compile_condition(expr.condition, root.at(expr.path))
    parts = [compile_filter(p, root) for p in expr.parts]
    if expr.kind == "all":
        return every(parts)
    return some(parts) if expr.kind == "any" else ~definite(some([definite(p) for p in parts]))


def compile_condition(condition: Condition, value: Value) -> Column:
    return every([_op(op, value) for op in condition.ops])


def _op(op: Op, value: Value) -> Column:
    name, x = op.name, op.operand
    if name in RANGE:
        return value.compare(name, x)
    if name in ("$prefix", "$suffix", "$contains"):
        return value.string(name, x)
    if name == "$eq":
        return value.eq(x)
    if name == "$ne":
        return value.ne(x)
    if name == "$in":
        return value.one_of(x)
    if name == "$nin":
        return value.exists() & ~definite(value.one_of(x))
    if name == "$exists":
        return value.exists() if x else ~value.exists()
    if name == "$type":
        return value.is_kind(x)
    if name == "$all":
        return every([value.is_kind(("array",)), *(definite(value.has(e)) for e in x)])
    if name == "$size":
        return value.length(x)
    if name == "$elemMatch":
        test = compile_condition if isinstance(x, Condition) else compile_filter
        return value.any(lambda element: test(x, element))
    return ~definite(compile_condition(x, value))


def truth(expr: Branch | None, root: Value) -> Column:
    """True or false, never NULL."""
    return definite(compile_filter(expr, root)) if expr is not None else F.lit(True)
