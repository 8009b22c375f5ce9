"""The filter language on Python values, written plainly: what the compiled filters are held against."""

from __future__ import annotations

from typing import Any

from docquarry.functions.kinds import kind_of, same
from docquarry.functions.paths import lookup
from docquarry.plans.filters import At, Branch, Condition, Op


def matches(expr, document: Any) -> bool:
    if isinstance(expr, At):
        return holds(expr.condition, *lookup(document, expr.path))
    found = [matches(p, document) for p in expr.parts]
    return all(found) if expr.kind == "all" else any(found) if expr.kind == "any" else not any(found)


def holds(condition: Condition, there: bool, value: Any) -> bool:
    return all(one(op, there, value) for op in condition.ops)


def one(op: Op, there: bool, v: Any) -> bool:
    name, x = op.name, op.operand
    if name == "$exists":
        return there == x
    if name == "$not":
        return not holds(x, there, v)
    if not there:
        return False
    kind = kind_of(v)
    if name in ("$gt", "$gte", "$lt", "$lte"):
        if kind != kind_of(x):
            return False
        a, b = (v.encode(), x.encode()) if kind == "string" else (float(v), float(x))
        return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[name]
    if name in ("$prefix", "$suffix", "$contains"):
        return kind == "string" and {"$prefix": v.startswith, "$suffix": v.endswith, "$contains": v.__contains__}[name](x)
    if name in ("$all", "$size", "$elemMatch"):
        if kind != "array":
            return False
        if name == "$size":
            return len(v) == x
        if name == "$all":
            return all(any(same(e, y) for e in v) for y in x)
        return any(holds(x, True, e) if isinstance(x, Condition) else matches(x, e) for e in v)
    return {
        "$eq": lambda: same(v, x),
        "$ne": lambda: not same(v, x),
        "$in": lambda: any(same(v, y) for y in x),
        "$nin": lambda: not any(same(v, y) for y in x),
        "$type": lambda: kind in x,
    }[name]()


__all__ = ["Branch", "matches"]
