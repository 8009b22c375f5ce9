"""Bytes whose unsigned order is the order of JSON values, for arrays and objects that Spark can't order itself."""

from __future__ import annotations

import json
import struct
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.kinds import KINDS, kind_of

_MORE, _END = b"\1", b"\0"


def _text(s: str) -> bytes:
    return s.encode().replace(b"\0", b"\0\xff") + b"\0\0"


def _double(x: float) -> bytes:
    (bits,) = struct.unpack(">Q", struct.pack(">d", x + 0.0))
    return (bits ^ ((1 << 64) - 1 if bits >> 63 else 1 << 63)).to_bytes(8, "big")


def encode(value: Any) -> bytes:
    kind = kind_of(value)
    head = bytes([KINDS.index(kind)])
    if kind == "null":
        return head
    if kind == "bool":
        return head + bytes([value])
    if kind == "number":
        return head + _double(float(value))
    if kind == "string":
        return head + _text(value)
    if kind == "array":
        return head + b"".join(_MORE + encode(x) for x in value) + _END
    return head + b"".join(_MORE + _text(k) + encode(value[k]) for k in sorted(value, key=str.encode)) + _END


def encode_json(text: Column) -> Column:
    """For a column of JSON text; empty bytes where it is null."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([b"" if t is None else encode(json.loads(t)) for t in texts], dtype=object)

    return run(text)
