"""Dotted paths. Only objects are traversed: a segment never indexes an array, and an empty segment is the empty name."""

from __future__ import annotations

from typing import Any


def segments(path: str) -> list[str]:
    return path.split(".")


def lookup(document: Any, path: str) -> tuple[bool, Any]:
    """Whether the path is there, and its value; an explicit null is there."""
    for name in segments(path):
        if not isinstance(document, dict) or name not in document:
            return False, None
        document = document[name]
    return True, document


def project(document: Any, fields: list[str]) -> dict:
    """Rebuilds the nested objects of the listed paths; what is missing is left out."""
    out: dict = {}
    for path in fields:
        there, value = lookup(document, path)
        if not there:
            continue
        *parents, last = segments(path)
        at = out
        for name in parents:
            inner = at.get(name)
            at[name] = at = dict(inner) if isinstance(inner, dict) else {}
        at[last] = value
    return out
