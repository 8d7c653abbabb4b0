"""Nested JSON documents as Spark columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(base: object, patch: object) -> object:
    """patch over base: objects are merged key by key at any depth, anything else is replaced, null too."""
    if isinstance(base, dict) and isinstance(patch, dict):
        return base | {k: merged(base.get(k), v) for k, v in patch.items()}
    return patch


def deep_merge(base: Column, patch: Column) -> Column:
    """JSON of two JSON texts merged. A null patch leaves the base, a null base takes the patch; text that isn't JSON is an error."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        both = lambda x, y: y if x is None else x if y is None else json.dumps(merged(json.loads(x), json.loads(y)), sort_keys=True, ensure_ascii=False)
        return pd.Series([both(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b)], dtype=object)

    return run(base, patch)
