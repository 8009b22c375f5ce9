"""Grouped metrics: one ``groupBy().agg()``, so Spark combines within tasks before it shuffles."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.errors import Refused
from docquarry.operators.filtering import compile_filter
from docquarry.operators.paging import keyed
from docquarry.operators.values import TypedValue, Value
from docquarry.plans.filters import Branch
from docquarry.plans.requests import MAX_GROUPS, Metric


def _plain(value: Value) -> bool:
    """Whether Spark orders the values itself."""
    return isinstance(value, TypedValue) and value.kind not in ("array", "object")


def _sorted_by(df: DataFrame, root: Value, metrics: list[Metric]) -> tuple[DataFrame, dict[str, str]]:
    """The rows with the sort keys that minima and maxima need, and their columns by path."""
    paths = sorted({m.path for m in metrics if m.kind in ("min", "max") and not _plain(root.at(m.path))})
    if not paths:
        return df, {}
    rows, names = keyed(df, root, paths)
    return rows, dict(zip(paths, names, strict=True))


def _metric(m: Metric, root: Value, scale: int | None, by: dict[str, str]) -> dict[str, Column]:
    """The metric's columns by name. Sums come with the number of values summed, averages with both."""
    if m.kind == "count":
        return {}
    value = root.at(m.path)
    suffix = m.path.replace(".", "_")
    if m.kind in ("min", "max"):
        if _plain(value):
            best = (F.min if m.kind == "min" else F.max)(value.column)
        elif m.kind == "min":
            # Of equal values the first in key order.
            best = F.min_by(value.json(), F.when(value.exists(), F.struct(F.col(by[m.path]), F.col("key"))))
        else:
            best = F.max_by(value.json(), F.when(value.exists(), F.col(by[m.path])))
        return {f"{m.kind}_{suffix}": best}
    number = value.number()
    # Whole units add up exactly and as fast as doubles; a sum beyond 64 bits is an error, never a wrong one.
    total = F.sum(number) if scale is None else F.sum(F.rint(number * 10**scale).cast("bigint")).cast("double") / 10**scale
    sums = {f"sum_{suffix}": total, f"count_{suffix}": F.count(number)}
    return sums | ({f"avg_{suffix}": total / F.when(F.count(number) > 0, F.count(number))} if m.kind == "avg" else {})


def aggregate(df: DataFrame, root: Value, filter: Branch | None, group: list[str], metrics: list[Metric], *, budget: int | None = None, scale: int | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """A row per group: the group fields (NULL where missing), ``count``, then for each metric ``min_f``, ``max_f``,
    ``sum_f`` and ``count_f``, or those and ``avg_f``; dots in names become underscores.

    Without group fields there is one group, and none if nothing matches. ``budget``: only so many documents
    in key order are read. ``scale``: decimals to which numbers are rounded and then summed exactly, in any order; without
    it they are summed as doubles. ``names`` renames group fields.
    """
    if budget is not None:
        df = df.orderBy("key").limit(budget)
    if filter is not None:
        df = df.where(compile_filter(filter, root))
    keys = [root.at(f).group_key().alias((names or {}).get(f, f.replace(".", "_"))) for f in group]
    df, by = _sorted_by(df, root, metrics)
    columns = {name: c for m in metrics for name, c in _metric(m, root, scale, by).items()}
    return df.groupBy(*keys).agg(F.count("*").alias("count"), *(c.alias(name) for name, c in columns.items())).where("count > 0")


@dataclass
class Aggregate:
    """The answer as it is sent: ``groups`` in the order of their keys' text."""

    groups: list[dict]
    matched: int
    scanned: int
    partial: bool


def aggregate_page(df: DataFrame, root: Value, filter: Branch | None, group: list[str], metrics: list[Metric], budget: int, allow_partial: bool, scale: int | None = None) -> Aggregate:
    scanned = df.select("key").limit(budget + 1).count()
    partial = scanned > budget
    if partial and not allow_partial:
        raise Refused(f"the aggregation has to read more than max_docs ({budget}) documents; partial=true takes the first of them")
    read = df.orderBy("key").limit(budget) if partial else df
    if filter is not None:
        read = read.where(compile_filter(filter, root))
    keys = [root.at(f).json().alias(f"g{i}") for i, f in enumerate(group)]
    read, by = _sorted_by(read, root, metrics)
    columns = [c for m in metrics for c in _metric(m, root, scale, by).values()]
    named = [c.alias(f"m{i}") for i, c in enumerate(columns)]
    rows = read.groupBy(*keys).agg(F.count("*").alias("n"), *named).where("n > 0").limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise Refused(f"there are more than {MAX_GROUPS} groups")
    groups = []
    for r in rows:
        out: dict[str, Any] = {"count": r["n"], "metrics": {}}
        if group:
            out = {"key": {f: json.loads(r[f"g{i}"]) for i, f in enumerate(group) if r[f"g{i}"] is not None}} | out
        at = 0
        for m in metrics:
            if m.kind == "count":
                out["metrics"][m.label] = {"count": r["n"]}
                continue
            got = [r[f"m{at + k}"] for k in range({"sum": 2, "avg": 3}.get(m.kind, 1))]
            at += len(got)
            out["metrics"][m.label] = _published(m, got, root)
        groups.append(out)
    groups.sort(key=lambda g: json.dumps(g.get("key", {}), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode())
    return Aggregate(groups, sum(g["count"] for g in groups), min(scanned, budget), partial)


def _published(m: Metric, got: list, root: Value) -> dict:
    if m.kind in ("min", "max"):
        (value,) = got
        typed = isinstance(v := root.at(m.path), TypedValue) and v.kind not in ("array", "object")
        return {} if value is None else {m.kind: (value.isoformat() if hasattr(value, "isoformat") else value) if typed else json.loads(value)}
    out: dict[str, Any] = {"count": got[1]}
    if got[1]:
        out["sum"] = got[0]
    if m.kind == "avg" and got[1]:
        out["avg"] = got[2]
    return out
