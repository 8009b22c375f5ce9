"""Boolean trigram queries, derived from regular expressions.

A query is an OR of branches, each a set of trigrams that a text must hold all of, in lower case, if the
expression matches anywhere in it. The expression is taken apart by Python's own parser: what can only be one of a
few strings is multiplied out along a sequence, up to ``STRINGS`` of them; a string gives all its trigrams, an
alternative gives an OR, a sequence an AND. Whatever is not understood, or not sure to mean the same to Spark's
expressions, constrains nothing; an expression that nothing constrains has no query and is run on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from re import _constants as c  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

Query = frozenset[frozenset[str]]
#: Most strings and characters of a class that are multiplied out, branches of a query, trigrams of a branch.
STRINGS, CHARACTERS, BRANCHES, TERMS = 64, 12, 64, 60
#: No constraint: one branch without trigrams.
ANY: Query = frozenset([frozenset()])
#: What Spark's expressions take otherwise than Python's: classes of classes, quotes, folding beyond ASCII, the rest of the escapes.
_OTHERWISE = re.compile(r"&&|\\[QEpPXRhHvVkGzZNu0-9]|\(\?[a-zA-Z-]*[uUdx]|\[[^\]]*\[(?!:)")


def _simpler(branches: Iterable[frozenset[str]]) -> Query:
    """Without branches that ask for more than another one."""
    kept: list[frozenset[str]] = []
    for b in sorted(set(branches), key=lambda b: (len(b), sorted(b))):
        if not any(k <= b for k in kept):
            kept.append(b)
    return frozenset(kept)


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > BRANCHES:
        # Either holds by itself; the one with longer branches tells more.
        return max(a, b, key=lambda q: (min(map(len, q)), -len(q)))
    return _simpler(x | y for x in a for y in b)


def _either(queries: Iterable[Query]) -> Query:
    found = _simpler(x for q in queries for x in q)
    return found if len(found) <= BRANCHES else ANY


def _of_strings(strings: frozenset[str]) -> Query:
    return _either(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings)


def _character(code: int) -> str | None:
    """In lower case; letters beyond ASCII are not folded alike everywhere."""
    return chr(code).lower() if code < 128 else None


def _characters(items: Sequence) -> frozenset[str] | None:
    found: set[str | None] = set()
    for kind, value in items:
        if kind is c.LITERAL:
            found.add(_character(value))
        elif kind is c.RANGE and value[1] - value[0] < 4 * CHARACTERS:
            found.update(map(_character, range(value[0], value[1] + 1)))
        else:
            return None
    return frozenset(found) if None not in found and len(found) <= CHARACTERS else None  # type: ignore[arg-type]


#: What an element can be: one of a few strings, or something with a query.
_Part = tuple[frozenset[str] | None, Query]
_NOTHING: _Part = (frozenset([""]), ANY)


def _sequence(parts: Iterable[_Part]) -> _Part:
    """A sequence is one of a few strings if all its elements are; else strings end where something unknown begins."""
    query, held, whole = ANY, frozenset([""]), True
    for strings, own in parts:
        if strings is not None and len(held) * len(strings) <= STRINGS:
            held = frozenset(a + b for a in held for b in strings)
            continue
        query, whole = _both(_both(query, _of_strings(held)), own), False
        held = strings if strings is not None else frozenset([""])
    return (held, ANY) if whole else (None, _both(query, _of_strings(held)))


def _alternatives(parts: Sequence[_Part]) -> _Part:
    if all(strings is not None for strings, _ in parts):
        strings = frozenset(s for x, _ in parts for s in x)  # type: ignore[union-attr]
        if len(strings) <= STRINGS:
            return strings, ANY
    return None, _either(q if strings is None else _of_strings(strings) for strings, q in parts)


def _repeated(low: int, high: int, inner: _Part) -> _Part:
    strings, query = inner
    if strings is not None and (low, high) == (0, 1):
        return strings | {""}, ANY
    if low == 0:
        return None, ANY
    if strings is not None and len(strings) ** min(low, 8) <= STRINGS and low <= 8:
        many = _sequence([inner] * low)
        return many if low == high else (None, _of_strings(many[0] or frozenset([""])))
    return None, query if strings is None else _of_strings(strings)


def _part(kind: object, value: object) -> _Part:
    if kind is c.LITERAL:
        found = _character(value)  # type: ignore[arg-type]
        return (None, ANY) if found is None else (frozenset([found]), ANY)
    if kind is c.IN:
        return _characters(value), ANY  # type: ignore[arg-type]
    if kind is c.SUBPATTERN:
        return _whole(value[-1])  # type: ignore[index]
    if kind is c.BRANCH:
        return _alternatives([_whole(x) for x in value[1]])  # type: ignore[index]
    if kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        low, high, inner = value  # type: ignore[misc]
        return _repeated(int(low), int(high) if high is not c.MAXREPEAT else 1 << 30, _whole(inner))
    if kind is c.ATOMIC_GROUP:
        return _whole(value)  # type: ignore[arg-type]
    if kind in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return _NOTHING
    return None, ANY


def _whole(parsed: Iterable) -> _Part:
    return _sequence(_part(kind, value) for kind, value in parsed)


def trigram_query(pattern: str) -> Query:
    """The query of an expression; without any branch if nothing is sure, so that every text is a candidate."""
    if _OTHERWISE.search(pattern):
        return frozenset()
    try:
        strings, query = _whole(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return frozenset()
    found = query if strings is None else _of_strings(strings)
    # To ask for fewer trigrams is sure too.
    found = reduce(lambda q, b: _simpler([*q, frozenset(sorted(b)[:TERMS])]), found, frozenset())
    return frozenset() if frozenset() in found else found
