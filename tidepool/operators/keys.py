"""Joins and groups by text keys.

Spark sorts rows by the first eight bytes of the first key and looks at whole rows where these
are equal, which is nearly always so for keys such as ``order_1234``. A hash of the text keys, put before
them, decides nearly every comparison; the keys themselves stay part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_HASH = "_key_hash"


def text_hash(df: DataFrame, keys: list[str], *others: DataFrame) -> list[Column]:
    """The hash to put before ``keys``: of those that are text in all tables, none if there are none."""
    types = [dict(d.dtypes) for d in (df, *others)]
    text = [F.col(f"`{k}`") for k in keys if all(t.get(k) == "string" for t in types)]
    return [F.xxhash64(*text).alias(KEY_HASH)] if text else []


def key_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a.join(b, keys, how)`` with the hash of the text keys as first key; a table grouped by it and
    these keys may bring it along."""
    mark = text_hash(a, keys, b)
    if not mark:
        return a.drop(KEY_HASH).join(b.drop(KEY_HASH), keys, how)
    a, b = (d if KEY_HASH in d.columns else d.withColumn(KEY_HASH, mark[0]) for d in (a, b))
    return a.join(b, [KEY_HASH, *keys], how).drop(KEY_HASH)
