"""The other parts of a request: order, fields, groups, metrics, limits, key ranges, key modes, cursors, names."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from typing import Any

from docquarry.errors import Conflict, Forbidden, Refused
from docquarry.functions.kinds import MISSING

#: Limits of requests.
DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000
DEFAULT_BUDGET, MAX_BUDGET = 100_000, 1_000_000
MAX_SORT_KEYS, MAX_GROUP_FIELDS, MAX_METRICS, MAX_GROUPS = 8, 4, 16, 10_000
MAX_INDEXES, MAX_INDEX_NAME, MAX_INDEX_PATH, MAX_INDEX_SEGMENTS = 8, 64, 256, 16
METRICS = ("count", "sum", "avg", "min", "max")
CHANGE_OPS = ("insert", "update", "delete", "drop")
READ_MODES = ("any", "primary", "quorum", "replica")


@dataclass(frozen=True)
class SortKey:
    path: str
    descending: bool = False


@dataclass(frozen=True)
class Metric:
    label: str
    kind: str
    path: str | None = None


def bounded(n: int | None, what: str, default: int, most: int) -> int:
    if n is None:
        return default
    if n > most:
        raise Refused(f"{what} {n} is above the maximum of {most}")
    return max(1, n)


def parse_sort(written: str | None) -> list[SortKey] | None:
    if written is None:
        return None
    keys: list[SortKey] = []
    for part in map(str.strip, written.split(",")):
        path, colon, way = part.partition(":")
        way = way.lower() if colon else "asc"
        if not path or way not in ("asc", "desc"):
            raise Refused(f"sort key {part!r} is not a field, field:asc or field:desc")
        if any(k.path == path for k in keys):
            raise Refused(f"sort names {path!r} twice")
        keys.append(SortKey(path, way == "desc"))
    if len(keys) > MAX_SORT_KEYS:
        raise Refused(f"sort has {len(keys)} keys; the maximum is {MAX_SORT_KEYS}")
    return keys


def parse_fields(written: str | None) -> list[str]:
    return [f for f in map(str.strip, (written or "").split(",")) if f]


def parse_group(written: str | None) -> list[str]:
    if written is None:
        return []
    fields = [f.strip() for f in written.split(",")]
    if not all(fields) or len(set(fields)) < len(fields):
        raise Refused("group names an empty field, or one twice")
    if len(fields) > MAX_GROUP_FIELDS:
        raise Refused(f"group has {len(fields)} fields; the maximum is {MAX_GROUP_FIELDS}")
    return fields


def parse_metrics(written: str | None) -> list[Metric]:
    if written is None or not written.strip():
        return [Metric("count", "count")]
    metrics: list[Metric] = []
    for label in map(str.strip, written.split(",")):
        kind, colon, path = (x.strip() for x in label.partition(":"))
        if kind not in METRICS:
            raise Refused(f"metric {kind!r} is unknown; there are count, sum:field, avg:field, min:field, max:field")
        if bool(colon) if kind == "count" else not path:
            raise Refused("count takes no field, the other metrics take one")
        if any(m.label == label for m in metrics):
            raise Refused(f"metric {label!r} is asked for twice")
        metrics.append(Metric(label, kind, path or None))
    if len(metrics) > MAX_METRICS:
        raise Refused(f"{len(metrics)} metrics are asked for; the maximum is {MAX_METRICS}")
    return metrics


def check_range(start: str | None, end: str | None) -> None:
    if start is not None and end is not None and start.encode() > end.encode():
        raise Refused(f"start {start!r} is above end {end!r}")


def parse_keys(written: str | bool | None) -> str:
    """none, parallel or embed."""
    modes = {None: "none", False: "none", "false": "none", True: "parallel", "true": "parallel", "embed": "embed"}
    if written not in modes:
        raise Refused(f"keys is true, false or embed, not {written!r}")
    return modes[written]


def check_read(written: str | None) -> None:
    """Spelling only: there is one copy of the data."""
    if written is not None and written not in READ_MODES:
        raise Refused(f"read mode {written!r} is unknown; there are {', '.join(READ_MODES)}")


def parse_change_ops(written: str | None) -> tuple[str, ...]:
    if written is None:
        return CHANGE_OPS
    ops = tuple(o.strip() for o in written.split(","))
    if not all(o in CHANGE_OPS for o in ops):
        raise Refused(f"ops is a list of {', '.join(CHANGE_OPS)}")
    return ops


_STEMS = re.compile(r"(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?")


def check_name(name: str) -> str:
    if name.startswith("_"):
        raise Forbidden(f"collection {name!r} is the engine's own")
    if not re.fullmatch(r"[a-z0-9._-]{1,128}", name) or name[0] == "." or name.endswith((".", ".tmp", ".old")) or _STEMS.fullmatch(name):
        raise Refused(f"{name!r} is not a collection name")
    return name


def check_index(name: str, path: str) -> None:
    parts = path.split(".")
    if not re.fullmatch(rf"[A-Za-z0-9_-]{{1,{MAX_INDEX_NAME}}}", name):
        raise Refused(f"{name!r} is not an index name")
    if len(path.encode()) > MAX_INDEX_PATH or len(parts) > MAX_INDEX_SEGMENTS or not all(p and p[0] != "$" for p in parts):
        raise Refused(f"{path!r} can't be indexed")


def encode_cursor(position: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(position, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    """Reads both base64 alphabets, padded or not."""
    try:
        raw = base64.b64decode(cursor.translate(str.maketrans("-_", "+/")).rstrip("=") + "=" * (-len(cursor.rstrip("=")) % 4), validate=True)
        position = json.loads(raw)
    except ValueError:
        raise Refused("the cursor can't be read") from None
    if not isinstance(position, dict):
        raise Refused("the cursor can't be read")
    return position


def key_position(cursor: str | None, layout: int | None = None) -> str | None:
    """Where an unsorted page resumes: after this key. A cursor that was issued for another layout conflicts."""
    if cursor is None:
        return None
    position = decode_cursor(cursor)
    if not isinstance(position.get("key"), str) or "values" in position or "value" in position:
        raise Refused("the cursor is not of an unsorted query")
    if layout is not None and position.get("ring") not in (None, layout):
        raise Conflict("the layout has changed since the cursor was issued; start again")
    return position["key"]


def sort_position(cursor: str | None, keys: list[SortKey]) -> tuple[list[Any], str] | None:
    """Where a sorted page resumes: after these values and this key. ``missing`` lists the values that are not there; the others without one are null."""
    if cursor is None:
        return None
    position = decode_cursor(cursor)
    values = position.get("values", [position["value"]] if "value" in position else None)
    if not isinstance(values, list) or len(values) != len(keys) or not isinstance(position.get("key"), str):
        raise Refused("the cursor is not of this sorted query")
    missing = position.get("missing", [])
    if not isinstance(missing, list) or any(type(i) is not int or not 0 <= i < len(keys) or values[i] is not None for i in missing):
        raise Refused("the cursor is not of this sorted query")
    return [MISSING if i in missing else v for i, v in enumerate(values)], position["key"]
