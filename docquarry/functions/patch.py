"""JSON merge patch (RFC 7386): null removes, objects merge, anything else replaces."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_patch(target: Any, patch: Any) -> Any:
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for name, value in patch.items():
        if value is None:
            out.pop(name, None)
        else:
            out[name] = merge_patch(out.get(name), value)
    return out


def merge_patch_json(target: Column | str, patch: Column | str) -> Column:
    """The same on columns of JSON text; null where either text is null."""

    @F.pandas_udf("string")
    def run(targets: pd.Series, patches: pd.Series) -> pd.Series:
        done = [None if t is None or p is None else json.dumps(merge_patch(json.loads(t), json.loads(p)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t, p in zip(targets, patches, strict=True)]
        return pd.Series(done, dtype=object)

    return run(target, patch)
