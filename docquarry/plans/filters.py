"""The filter language: a JSON object of paths with conditions, and branches of such objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from docquarry.errors import Refused
from docquarry.functions.kinds import KINDS, kind_of, parse

MAX_DEPTH = 16


@dataclass(frozen=True)
class Op:
    """A field operator; ``operand`` is checked, and parsed where it is a condition or filter itself."""

    name: str
    operand: Any


@dataclass(frozen=True)
class Condition:
    ops: tuple[Op, ...]


@dataclass(frozen=True)
class At:
    path: str
    condition: Condition


@dataclass(frozen=True)
class Branch:
    """``kind``: all, any or none of the parts."""

    kind: str
    parts: tuple[Any, ...]


Expr = At | Branch

#: Document operators.
BRANCHES = {"$and": "all", "$or": "any", "$nor": "none"}


def _array(v: Any, depth: int) -> list:
    if not isinstance(v, list):
        raise ValueError("an array")
    return v


def _string(v: Any, depth: int) -> str:
    if not isinstance(v, str):
        raise ValueError("a string")
    return v


def _bound(v: Any, depth: int) -> Any:
    if kind_of(v) not in ("number", "string"):
        raise ValueError("a number or a string")
    return v


def _flag(v: Any, depth: int) -> bool:
    if not isinstance(v, bool):
        raise ValueError("a boolean")
    return v


def _length(v: Any, depth: int) -> int:
    if isinstance(v, bool) or not isinstance(v, int) or v < 0:
        raise ValueError("a non-negative integer")
    return v


def _kinds(v: Any, depth: int) -> tuple[str, ...]:
    names = [v] if isinstance(v, str) else v
    if not isinstance(names, list) or not names or not all(isinstance(n, str) and n in KINDS for n in names):
        raise ValueError(f"a type name or a non-empty array of them ({', '.join(KINDS)})")
    return tuple(names)


def _operators(v: Any, depth: int) -> Condition:
    if not isinstance(v, dict) or not v or not all(k.startswith("$") for k in v):
        raise ValueError("an object of operators")
    return _condition("$not", v, depth + 1)


def _element(v: Any, depth: int) -> Condition | Branch:
    if not isinstance(v, dict):
        raise ValueError("an object")
    if any(k.startswith("$") for k in v):
        return _condition("$elemMatch", v, depth + 1)
    return _branch(v, depth + 1)


def _anything(v: Any, depth: int) -> Any:
    return v


#: The field operators, with the check of their operands.
OPERATORS: dict[str, Callable[[Any, int], Any]] = {
    "$eq": _anything,
    "$ne": _anything,
    "$in": _array,
    "$nin": _array,
    "$gt": _bound,
    "$gte": _bound,
    "$lt": _bound,
    "$lte": _bound,
    "$exists": _flag,
    "$type": _kinds,
    "$prefix": _string,
    "$suffix": _string,
    "$contains": _string,
    "$all": _array,
    "$size": _length,
    "$elemMatch": _element,
    "$not": _operators,
}
RANGE = ("$gt", "$gte", "$lt", "$lte")


def _deep(depth: int) -> None:
    if depth > MAX_DEPTH:
        raise Refused(f"the filter is nested deeper than {MAX_DEPTH}")


def _condition(path: str, written: Any, depth: int) -> Condition:
    _deep(depth)
    marked = [k for k in written if k.startswith("$")] if isinstance(written, dict) else []
    if not marked:
        return Condition((Op("$eq", written),))
    if len(marked) < len(written):
        raise Refused(f"the condition on {path!r} mixes operators and members")
    ops = []
    for name, operand in written.items():
        if name not in OPERATORS:
            raise Refused(f"operator {name!r} on {path!r} is not supported; there are {', '.join(OPERATORS)}")
        try:
            ops.append(Op(name, OPERATORS[name](operand, depth)))
        except ValueError as needs:
            raise Refused(f"{name} on {path!r} takes {needs}") from None
    if len({kind_of(op.operand) for op in ops if op.name in RANGE}) > 1:
        raise Refused(f"the bounds on {path!r} are of different types")
    return Condition(tuple(ops))


def _branch(written: Any, depth: int) -> Branch:
    _deep(depth)
    if not isinstance(written, dict):
        raise Refused("a filter is a JSON object")
    parts: list[Expr] = []
    for name, operand in written.items():
        if name in BRANCHES:
            if not isinstance(operand, list) or not operand:
                raise Refused(f"{name} takes a non-empty array of filters")
            parts.append(Branch(BRANCHES[name], tuple(_branch(x, depth + 1) for x in operand)))
        elif name.startswith("$"):
            raise Refused(f"document operator {name!r} is not supported; there are {', '.join(BRANCHES)}")
        else:
            parts.append(At(name, _condition(name, operand, depth)))
    return Branch("all", tuple(parts))


def parse_filter(written: str | dict | None) -> Branch | None:
    if written is None:
        return None
    return _branch(parse(written, "the filter") if isinstance(written, str) else written, 0)


def conjuncts(expr: Expr) -> Iterator[At]:
    """The conditions that every match satisfies."""
    if isinstance(expr, At):
        yield expr
    elif expr.kind == "all":
        for part in expr.parts:
            yield from conjuncts(part)
