"""Projection: the listed paths in their nested objects, what is missing left out."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.operators.values import TypedValue, Value


def _tree(fields: list[str]) -> dict:
    """Names to subtrees, None for a whole value. A path inside one that is already whole adds nothing."""
    root: dict = {}
    for path in fields:
        *parents, last = path.split(".")
        at: dict | None = root
        for name in parents:
            at = at.setdefault(name, {}) if at is not None else None
        if at is not None:
            at[last] = None
    return root


def project_json(root: Value, fields: list[str]) -> Column:
    """JSON text with members in order; ``{}`` for documents that are no objects. No fields: the whole document."""
    if not fields:
        return root.json()

    def build(value: Value, tree: dict | None) -> Column:
        if tree is None:
            return value.json()
        members = [F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), build(value.member(name), tree[name])) for name in sorted(tree, key=str.encode)]
        inside = F.concat_ws(",", *members)
        return F.when(inside != "", F.concat(F.lit("{"), inside, F.lit("}")))

    return F.coalesce(build(root, _tree(fields)), F.lit("{}"))


def project_struct(root: TypedValue, fields: list[str]) -> list[Column]:
    """Typed columns by top-level name, nested paths as structs; paths that the schema lacks are left out."""

    def build(value: TypedValue, tree: dict | None) -> Column | None:
        if tree is None:
            return value.column if value.kind else None
        found = [c.alias(name) for name, sub in tree.items() if (c := build(value.member(name), sub)) is not None]
        return F.struct(*found) if found else None

    return [c.alias(name) for name, sub in _tree(fields).items() if (c := build(root.member(name), sub)) is not None]
