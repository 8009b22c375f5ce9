"""The six JSON kinds, and JSON literals of requests. Integers and fractions stay apart: 1 is not 1.0."""

from __future__ import annotations

import json
from typing import Any

from docquarry.errors import Refused

#: Kind names in their order of rank.
KINDS = ("null", "bool", "number", "string", "array", "object")
#: In a position of an order: there is no value at the path, which is before null.
MISSING = object()


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int | float):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list | tuple) else "object"


def parse(text: str, what: str) -> Any:
    try:
        return json.loads(text)
    except ValueError as e:
        raise Refused(f"{what} is not JSON: {e}") from None


def canonical(value: Any) -> str:
    """Compact text with members in order, the same for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def same(a: Any, b: Any) -> bool:
    """Exact equality: kinds agree, and so do integer and fraction."""
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


def order_key(value: Any) -> tuple:
    """Sorts any two JSON values: by kind, then numbers as doubles, arrays by elements and length, objects by
    entries in the order of their names and number."""
    kind = kind_of(value)
    rank = KINDS.index(kind)
    if kind == "null":
        return (rank,)
    if kind in ("bool", "number"):
        return (rank, float(value))
    if kind == "string":
        return (rank, value.encode())
    if kind == "array":
        return (rank, tuple(map(order_key, value)))
    return (rank, tuple((k.encode(), order_key(value[k])) for k in sorted(value, key=str.encode)))
