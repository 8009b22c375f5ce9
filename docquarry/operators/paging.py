"""Ordered pages. Every order ends with the key, so it is total and a page can resume after its last row."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.errors import Refused
from docquarry.operators.filtering import compile_filter
from docquarry.operators.projecting import project_json
from docquarry.operators.values import Value, VariantValue, every, false, some
from docquarry.plans.filters import Branch
from docquarry.plans.requests import SortKey, encode_cursor


def key_range(df: DataFrame, start: str | None, end: str | None, after: str | None = None) -> DataFrame:
    """Both bounds inclusive, ``after`` exclusive; a reversed pair is empty."""
    for bound, test in ((start, lambda k, b: k >= b), (end, lambda k, b: k <= b), (after, lambda k, b: k > b)):
        if bound is not None:
            df = df.where(test(F.col("key"), F.lit(bound)))
    return df


def keyed(df: DataFrame, root: Value, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with a column of the sort key for each path, and the columns' names.

    Only arrays and objects are ordered by an encoding that Python makes: rows with one at such a path are read apart.
    """
    values, names = [root.at(p) for p in paths], [f"_sort{i}" for i in range(len(paths))]
    full = {n: v.sort_key() for n, v in zip(names, values, strict=True)}
    variants = [v for v in values if isinstance(v, VariantValue)]
    if not variants:
        return df.withColumns(full), names
    nested = some([v.nested() for v in variants])
    plain = {n: v.sort_key(plain=True) if isinstance(v, VariantValue) else full[n] for n, v in zip(names, values, strict=True)}
    return df.where(~nested).withColumns(plain).unionByName(df.where(nested).withColumns(full)), names


def ordered(df: DataFrame, root: Value, keys: list[SortKey], limit: int | None = None, tie: list[Column] | None = None) -> DataFrame:
    """Missing first ascending and last descending, null next to it; then by key, always ascending. Limited, a heap of so many rows in each task.

    ``tie``: columns whose order is that of the keys.
    """
    rows, names = keyed(df, root, [k.path for k in keys])
    by = [F.col(n).desc() if k.descending else F.col(n).asc() for k, n in zip(keys, names, strict=True)]
    found = rows.orderBy(*by, *(c.asc() for c in tie or [F.col("key")]))
    return (found if limit is None else found.limit(limit)).drop(*names)


def after_position(keys: list[SortKey], values: list[Any], key: str, root: Value) -> Column:
    """Rows strictly after a position: the first differing sort key decides, then the document key."""
    out, same = false(), []
    for k, v in zip(keys, values, strict=True):
        later, equal = root.at(k.path).after(v, k.descending)
        out = out | every([*same, later])
        same.append(equal)
    return out | every([*same, F.col("key") > key])


def top(df: DataFrame, root: Value, keys: list[SortKey], limit: int, position: tuple[list[Any], str] | None = None, tie: list[Column] | None = None) -> DataFrame:
    """The first rows in order, optionally after a position; a bounded heap per task, no full sort."""
    if position is not None:
        df = df.where(after_position(keys, *position, root))
    return ordered(df, root, keys, limit, tie)


@dataclass
class Page:
    """``items`` are documents, or ``{"id", "value"}`` objects with embedded keys; ``keys`` with parallel ones."""

    items: list[Any]
    next_cursor: str | None
    keys: list[str] | None = None

    def to_json(self) -> str:
        body = {"items": self.items, "next_cursor": self.next_cursor} | ({"keys": self.keys} if self.keys is not None else {})
        return json.dumps(body, ensure_ascii=False)


def _page(rows: list, cursor: str | None, mode: str) -> Page:
    values = [json.loads(r["item"]) for r in rows]
    if mode == "embed":
        return Page([{"id": r["key"], "value": v} for r, v in zip(rows, values, strict=True)], cursor)
    return Page(values, cursor, [r["key"] for r in rows] if mode == "parallel" else None)


def sorted_page(df: DataFrame, root: Value, filter: Branch | None, keys: list[SortKey], position, limit: int, budget: int | None, fields: list[str], mode: str) -> Page:
    """Refused if there are more candidates than ``budget``, if there is one: a page of some of them would not be the first."""
    if budget is not None and (filter is not None or position is None):
        if df.select("key").limit(budget + 1).count() > budget:
            raise Refused(f"the sort has to read more than max_docs ({budget}) documents")
    found = top(df.where(compile_filter(filter, root)) if filter is not None else df, root, keys, limit + 1, position)
    at = [root.at(k.path).json().alias(f"v{i}") for i, k in enumerate(keys)]
    rows = found.select("key", project_json(root, fields).alias("item"), *at).collect()
    cursor = None
    if len(rows) > limit:
        rows, last = rows[:limit], rows[limit - 1]
        values = [None if last[f"v{i}"] is None else json.loads(last[f"v{i}"]) for i in range(len(keys))]
        missing = [i for i in range(len(keys)) if last[f"v{i}"] is None]
        cursor = encode_cursor({"values": values, "key": last["key"]} | ({"missing": missing} if missing else {}))
    return _page(rows, cursor, mode)


def unsorted_page(df: DataFrame, root: Value, filter: Branch | None, limit: int, budget: int | None, fields: list[str], mode: str, layout: int | None = None) -> Page:
    """In key order. ``df`` holds the candidates from the cursor on; at most ``budget`` of them, if there is one, are judged.

    The cursor is the last candidate that was judged and did not overflow the page: it may lie past the
    last row of the page, and a page that found nothing within its budget still has one.
    """

    def cursor(key: str) -> str:
        return encode_cursor({"key": key} | ({"ring": layout} if layout is not None else {}))

    rows_of = lambda found: found.orderBy("key").select("key", project_json(root, fields).alias("item"))
    if filter is None:
        most = limit if budget is None else min(limit, budget)
        rows = rows_of(df).limit(most + 1).collect()
        more = len(rows) > most
        return _page(rows[:most], cursor(rows[most - 1]["key"]) if more else None, mode)
    boundary = None
    if budget is not None and df.select("key").limit(budget + 1).count() > budget:
        boundary = df.select("key").orderBy("key").limit(budget).agg(F.max("key")).first()[0]
    judged = df if boundary is None else df.where(F.col("key") <= boundary)
    rows = rows_of(judged.where(compile_filter(filter, root))).limit(limit + 1).collect()
    if len(rows) > limit:
        before = judged.where(F.col("key") < rows[limit]["key"]).agg(F.max("key")).first()[0]
        return _page(rows[:limit], cursor(before), mode)
    return _page(rows, cursor(boundary) if boundary is not None else None, mode)
