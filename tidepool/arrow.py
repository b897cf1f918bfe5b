"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def key_changes(keys: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before (null equals null); true at first."""
    coded = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], coded[1:] != coded[:-1]])[:len(keys)]


def key_texts(*columns: str):
    """Column texts that are equal only for equal values of ``columns`` (null is a value of its own)."""
    from pyspark.sql import functions as F

    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]))
