"""The value at a place in a document, as columns: on typed Parquet columns and on VARIANT.

Predicates are true for matches; where a value is missing they may be NULL, which counts as false. That
keeps plain comparisons plain, so that Parquet filters are pushed down. ``definite`` makes NULL false
where a predicate is negated or tested for elements.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.errors import Refused
from docquarry.functions.encoding import encode, encode_json
from docquarry.functions.kinds import KINDS, MISSING, kind_of

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}
_BY: dict[str, Callable[[Column, Column], Column]] = {"==": lambda a, b: a == b} | {op: _COMPARE[name] for op, name in ((">", "$gt"), (">=", "$gte"), ("<", "$lt"), ("<=", "$lte"))}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampNTZType, T.TimestampType, T.DateType)


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


def definite(c: Column) -> Column:
    return F.coalesce(c, false())


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else true()


def some(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else false()


class Value:
    def member(self, name: str) -> Value:
        raise NotImplementedError

    def at(self, path: str) -> Value:
        return reduce(lambda v, name: v.member(name), path.split("."), self)


class TypedValue(Value):
    """A typed column; ``kind`` None: the schema has nothing there, so it is missing everywhere.

    SQL NULL is a missing value; an explicit null does not exist. Times are strings in ISO 8601.
    ``exact``: an integer literal is not equal to a fraction column, as JSON tells 1 from 1.0.
    """

    def __init__(self, column: Column, dtype: T.DataType | None, exact: bool = True):
        self.column, self.dtype, self.exact = column, dtype, exact

    @property
    def kind(self) -> str | None:
        for kinds, types in (("bool", T.BooleanType), ("number", (*_INTEGERS, *_FRACTIONS)), ("string", (T.StringType, *_TIMES)), ("array", T.ArrayType), ("object", (T.StructType, T.MapType))):
            if isinstance(self.dtype, types):
                return kinds
        return None

    def _is(self, *types: type) -> bool:
        return isinstance(self.dtype, types)

    def member(self, name: str) -> TypedValue:
        if isinstance(self.dtype, T.StructType) and name in self.dtype.names:
            return TypedValue(self.column.getField(name), self.dtype[name].dataType, self.exact)
        if isinstance(self.dtype, T.MapType):
            return TypedValue(self.column.getItem(name), self.dtype.valueType, self.exact)
        return TypedValue(F.lit(None), None, self.exact)

    def exists(self) -> Column:
        return false() if self.kind is None else self.column.isNotNull()

    def is_kind(self, names: tuple[str, ...]) -> Column:
        return self.exists() if self.kind in names else false()

    def eq(self, literal: Any) -> Column:
        kind = kind_of(literal)
        if self.kind != kind:
            return false()
        c = self.column
        if kind == "number":
            if self.exact and isinstance(literal, int) != self._is(*_INTEGERS):
                return false()
            return self._numeric("$eq", literal)
        if kind in ("bool", "string"):
            return self._time("$eq", literal) if self._is(*_TIMES) else c == F.lit(literal)
        if kind == "array":
            return every([F.size(c) == len(literal), *(definite(self._element(F.get(c, i)).eq(x)) for i, x in enumerate(literal))])
        if isinstance(self.dtype, T.MapType):
            names = F.sort_array(F.map_keys(c)) == F.array_sort(F.array(*map(F.lit, literal))) if literal else F.size(c) == 0
            return every([names, *(definite(self.member(k).eq(x)) for k, x in literal.items())])
        if not set(literal) <= set(self.dtype.names):
            return false()
        parts = [definite(self.member(n).eq(literal[n])) if n in literal else ~self.member(n).exists() for n in self.dtype.names]
        return every([c.isNotNull(), *parts])

    def ne(self, literal: Any) -> Column:
        if self.kind in ("bool", "number", "string") and self.kind == kind_of(literal) and not self._is(*_TIMES):
            if self.kind != "number" or not self.exact or isinstance(literal, int) == self._is(*_INTEGERS):
                return self.exists() & ~self.eq(literal)
            return self.exists()
        return self.exists() & ~definite(self.eq(literal))

    def one_of(self, literals: list[Any]) -> Column:
        if self._is(T.StringType) or self._is(*_INTEGERS) and self.exact:
            want = str if self._is(T.StringType) else int
            fit = [x for x in literals if isinstance(x, want) and not isinstance(x, bool) and (want is str or -(1 << 63) <= x < 1 << 63)]
            return self.column.isin(fit) if fit else false()
        return some([self.eq(x) for x in literals])

    def compare(self, op: str, literal: Any) -> Column:
        if self.kind != kind_of(literal):
            return false()
        if self.kind == "number":
            return self._numeric(op, literal)
        if self.kind != "string":
            return false()
        return self._time(op, literal) if self._is(*_TIMES) else _COMPARE[op](self.column, F.lit(literal))

    def _numeric(self, op: str, x: int | float) -> Column:
        """Against a literal of the column's own type, since a cast of the column is not pushed down."""
        c = self.column
        if self._is(T.DecimalType):
            return c == F.lit(Decimal(repr(x))) if op == "$eq" else _COMPARE[op](c, F.lit(Decimal(repr(x))))
        if self._is(*_FRACTIONS):
            return c == F.lit(float(x)) if op == "$eq" else _COMPARE[op](c, F.lit(float(x)))
        if math.isinf(x):
            return self.exists() if (x > 0) == (op in ("$lt", "$lte")) and op != "$eq" else false()
        if op == "$eq":
            return c == F.lit(int(x)) if x == int(x) and -(1 << 63) <= x < 1 << 63 else false()
        bound = math.floor(x) if op in ("$gt", "$lte") else math.ceil(x)
        if not -(1 << 63) <= bound < 1 << 63:
            return self.exists() if (bound > 0) == (op in ("$lt", "$lte")) else false()
        return _COMPARE[op](c, F.lit(bound))

    def text(self) -> Column:
        if self._is(T.DateType):
            return F.date_format(self.column, "yyyy-MM-dd")
        if self._is(*_TIMES):
            return F.replace(self.column.cast("string"), F.lit(" "), F.lit("T"))
        return self.column

    def _time(self, op: str, literal: str) -> Column:
        """By native comparison where the literal's text order is the order in time; otherwise as text."""
        name = {T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP_NTZ", T.TimestampType: "TIMESTAMP"}[type(self.dtype)]
        day, second = re.fullmatch(r"\d{4}-\d\d-\d\d", literal), re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", literal)
        try:
            datetime.fromisoformat(literal)
        except ValueError:
            day = second = None
        native = F.expr(f"{name} '{literal}'") if day or second else None
        if native is not None and (second and name != "DATE" or day and name == "DATE"):
            return self.column == native if op == "$eq" else _COMPARE[op](self.column, native)
        if native is not None and day and op != "$eq":
            # The text of a time on that day is longer than the day's, hence above it.
            return _COMPARE["$gte" if op in ("$gt", "$gte") else "$lt"](self.column, native)
        return self.text() == literal if op == "$eq" else _COMPARE[op](self.text(), F.lit(literal))

    def string(self, op: str, literal: str) -> Column:
        if self.kind != "string":
            return false()
        c = self.text()
        return {"$prefix": c.startswith, "$suffix": c.endswith, "$contains": c.contains}[op](literal)

    def _element(self, column: Column) -> TypedValue:
        return TypedValue(column, self.dtype.elementType, self.exact)

    def length(self, n: int) -> Column:
        return F.size(self.column) == n if self.kind == "array" else false()

    def has(self, literal: Any) -> Column:
        return self.any(lambda e: e.eq(literal))

    def any(self, test: Callable[[Value], Column]) -> Column:
        if self.kind != "array":
            return false()
        return F.exists(self.column, lambda e: definite(test(self._element(e))))

    def number(self) -> Column:
        return self.column.cast("double") if self.kind == "number" else F.lit(None).cast("double")

    def json(self) -> Column:
        """The value as JSON text; NULL where it is missing."""
        if self.kind is None:
            return F.lit(None).cast("string")
        if self._is(*_TIMES):
            return F.concat(F.lit('"'), self.text(), F.lit('"'))
        if self.kind in ("number", "bool"):
            return self.column.cast("string")
        if self.kind == "string":
            # An object of one member, without its braces and name.
            wrapped = F.to_json(F.struct(self.column.alias("v")))
            return F.when(self.column.isNotNull(), F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))
        return F.to_json(self.column)

    def group_key(self) -> Column:
        return self.column

    def sort_key(self) -> Column:
        """Orders as the values do, NULL first for what is missing."""
        if self.kind in ("array", "object"):
            return encode_json(F.to_json(self.column))
        return self.column if self.kind else F.lit(None).cast("string")

    def position(self, value: Any) -> Column | None:
        """A cursor's value to compare sort keys with; None for a missing one."""
        if value is None or value is MISSING or self.kind is None:
            return None
        if kind_of(value) != self.kind:
            raise Refused("the cursor is not of this sorted query")
        if self._is(*_TIMES):
            return F.lit(value.replace("T", " ")).cast(self.dtype)
        if self.kind in ("array", "object"):
            return F.lit(encode(value))
        return F.lit(value).cast(self.dtype)

    def key_kind(self, kind: str) -> Column:
        return F.lit(self.kind == kind)

    def compare_key(self, literal: Any, op: str) -> Column:
        """A postings table's ``value`` against the sort key of a literal; nothing equals one of another kind."""
        if kind_of(literal) != self.kind:
            return false()
        return _BY[op](F.col("value"), self.position(literal))

    def after(self, value: Any, descending: bool) -> tuple[Column, Column]:
        """Whether the sort key comes after that of ``value``, and whether it equals it."""
        key, bound = self.sort_key(), self.position(value)
        if bound is None:
            return (false() if descending else key.isNotNull()), key.isNull()
        return (definite(key < bound) | key.isNull() if descending else key > bound), definite(key == bound)


class VariantValue(Value):
    """A value of any kind. SQL NULL is a missing value, VARIANT null an explicit one."""

    def __init__(self, root: Column, path: tuple[str, ...] = (), exact: bool = True):
        self.root, self.path, self.exact = root, path, exact

    def member(self, name: str) -> VariantValue:
        if not name or re.search(r"['\"\\\[\]]", name):
            # Names that the path syntax has no way to write.
            return VariantValue(F.try_variant_get(self.column, "$", "map<string,variant>").getItem(name), (), self.exact)
        return VariantValue(self.root, (*self.path, name), self.exact)

    @property
    def column(self) -> Column:
        if not self.path:
            return self.root
        return F.try_variant_get(self.root, "$" + "".join(f'["{name}"]' for name in self.path), "variant")

    def _get(self, dtype: str) -> Column:
        """After a test of the kind only: it would cast other kinds."""
        return F.try_variant_get(self.column, "$", dtype)

    def _schema(self) -> Column:
        return F.schema_of_variant(self.column)

    def exists(self) -> Column:
        return self.column.isNotNull()

    def kind_column(self) -> Column:
        s = self._schema()
        return (
            F.when(self.column.isNull(), None)
            .when(s == "VOID", "null")
            .when(s == "BOOLEAN", "bool")
            .when(s.startswith("ARRAY"), "array")
            .when(s.startswith("OBJECT"), "object")
            .when(s == "STRING", "string")
            .otherwise("number")
        )

    def _kind(self, name: str) -> Column:
        s = self._schema()
        if name == "null":
            return F.is_variant_null(self.column)
        if name == "number":
            return (s == "BIGINT") | (s == "DOUBLE") | s.startswith("DECIMAL")
        return {"bool": s == "BOOLEAN", "string": s == "STRING", "array": s.startswith("ARRAY"), "object": s.startswith("OBJECT")}[name]

    def is_kind(self, names: tuple[str, ...]) -> Column:
        return some([self._kind(n) for n in names])

    def _whole(self) -> Column:
        """Written as an integer: 1.0 is stored as a decimal of scale 0 and few digits, larger integers as one of 19 or more."""
        s = self._schema()
        digits = F.regexp_extract(s, r"^DECIMAL\((\d+),0\)$", 1)
        return (s == "BIGINT") | ((digits != "") & (F.try_to_number(digits, F.lit("99")) >= 19))

    def eq(self, literal: Any) -> Column:
        kind = kind_of(literal)
        if kind == "null":
            return self._kind("null")
        if kind in ("bool", "string"):
            return self._kind(kind) & (self._get("boolean" if kind == "bool" else "string") == F.lit(literal))
        if kind == "number":
            if isinstance(literal, int):
                value = self._get("decimal(38,0)") == F.lit(Decimal(literal)).cast("decimal(38,0)") if abs(literal) < 10**38 else false()
            else:
                value = self._get("double") == F.lit(literal)
            if not self.exact:
                return self._kind("number") & (self._get("double") == F.lit(float(literal)))
            return self._kind("number") & (self._whole() if isinstance(literal, int) else ~self._whole()) & value
        if kind == "array":
            elements = self._get("array<variant>")
            return every([self._kind("array"), F.size(elements) == len(literal), *(definite(VariantValue(F.get(elements, i), (), self.exact).eq(x)) for i, x in enumerate(literal))])
        names = F.map_keys(self._get("map<string,variant>"))
        listed = F.array_sort(names) == F.array_sort(F.array(*map(F.lit, literal))) if literal else F.size(names) == 0
        return every([self._kind("object"), listed, *(definite(self.member(k).eq(x)) for k, x in literal.items())])

    def ne(self, literal: Any) -> Column:
        return self.exists() & ~definite(self.eq(literal))

    def one_of(self, literals: list[Any]) -> Column:
        return some([self.eq(x) for x in literals])

    def compare(self, op: str, literal: Any) -> Column:
        if kind_of(literal) == "number":
            return self._kind("number") & _COMPARE[op](self._get("double"), F.lit(float(literal)))
        return self._kind("string") & _COMPARE[op](self._get("string"), F.lit(literal))

    def string(self, op: str, literal: str) -> Column:
        c = self._get("string")
        return self._kind("string") & {"$prefix": c.startswith, "$suffix": c.endswith, "$contains": c.contains}[op](literal)

    def length(self, n: int) -> Column:
        return self._kind("array") & (F.size(self._get("array<variant>")) == n)

    def has(self, literal: Any) -> Column:
        return self.any(lambda e: e.eq(literal))

    def any(self, test: Callable[[Value], Column]) -> Column:
        return self._kind("array") & F.exists(self._get("array<variant>"), lambda e: definite(test(VariantValue(e, (), self.exact))))

    def number(self) -> Column:
        return F.when(self._kind("number"), self._get("double"))

    def json(self) -> Column:
        """The value as JSON text, explicit null included; NULL where it is missing. A fraction keeps its point."""
        text = F.to_json(self.column)
        return F.when(self._kind("null"), "null").when(self._kind("number") & ~self._whole() & ~text.rlike("[.eE]"), F.concat(text, F.lit(".0"))).otherwise(text)

    def group_key(self) -> Column:
        return self.json()

    def nested(self) -> Column:
        """Whether it is an array or an object, whose order takes an encoding."""
        return F.coalesce(self._kind("array") | self._kind("object"), F.lit(False))

    def sort_key(self, plain: bool = False) -> Column:
        """Kind, number, string, bytes; only the one that the kind calls for is filled. What is missing is below null.
        ``plain``: none is nested."""
        kind = self.kind_column()
        rank = F.coalesce(F.array_position(F.lit(list(KINDS)), kind).cast("int") - 1, F.lit(-1))
        nested = kind.isin("array", "object")
        number = F.when(kind == "bool", self._get("boolean").cast("double")).when(kind == "number", self._get("double"))
        return F.struct(
            rank.alias("rank"),
            F.coalesce(number, F.lit(0.0)).alias("num"),
            F.coalesce(F.when(kind == "string", self._get("string")), F.lit("")).alias("str"),
            (F.lit(b"") if plain else F.coalesce(encode_json(F.when(nested, F.to_json(self.column))), F.lit(b""))).alias("bin"),
        )

    @staticmethod
    def _bound(value: Any) -> Column:
        kind = "missing" if value is MISSING else kind_of(value)
        return F.struct(
            F.lit(KINDS.index(kind) if kind in KINDS else -1).alias("rank"),
            F.lit(float(value) if kind in ("bool", "number") else 0.0).alias("num"),
            F.lit(value if kind == "string" else "").alias("str"),
            F.lit(encode(value) if kind in ("array", "object") else b"").alias("bin"),
        )

    def key_kind(self, kind: str) -> Column:
        return F.col("value")["rank"] == KINDS.index(kind)

    def compare_key(self, literal: Any, op: str) -> Column:
        """By the part of the sort key that the literal's kind fills, a bare comparison that reaches the scan."""
        kind = kind_of(literal)
        if kind == "null":
            return self.key_kind(kind)
        part = "num" if kind in ("bool", "number") else "str" if kind == "string" else "bin"
        bound = float(literal) if part == "num" else literal if part == "str" else encode(literal)
        return self.key_kind(kind) & _BY[op](F.col("value")[part], F.lit(bound))

    def after(self, value: Any, descending: bool) -> tuple[Column, Column]:
        key, bound = self.sort_key(), self._bound(value)
        return (key < bound if descending else key > bound), key == bound
