"""Nested field access by dotted path (MAP-9, MAP-10)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEG = re.compile(r"([^.\[\]]+)|\[(-?\d+)\]")


def parse_path(path: str) -> list[str | int]:
    """``a.b[0].c`` -> ``["a", "b", 0, "c"]``."""
    out: list[str | int] = []
    for name, idx in _SEG.findall(path):
        out.append(int(idx) if idx else name)
    return out


def get_path(path: str, root: Column | None = None) -> Column:
    """Value at ``path`` inside struct / array / map columns; any miss or bad index -> null.

    ``get`` on arrays returns null out of range (no ANSI error).
    """
    segs = parse_path(path)
    if not segs:
        return F.lit(None)
    if root is None:
        first = segs.pop(0)
        cur = F.col(f"`{first}`")
    else:
        cur = root
    for s in segs:
        cur = F.get(cur, F.lit(s)) if isinstance(s, int) else cur.getField(s)
    return cur


def json_path(c: Column, path: str) -> Column:
    """Same path rule on a JSON text column (dynamic records); text result."""
    p = "$"
    for s in parse_path(path):
        p += f"[{s}]" if isinstance(s, int) else f".{s}"
    return F.get_json_object(c, p)


def build_nested(assignments: list[tuple[str, Column]]) -> list[Column]:
    """MAP-10 for a whole output record: ``[("a.b.c", col), ...]`` -> top-level Columns.

    Intermediate structs are created; a later assignment replaces an earlier
    one at the same path; a non-struct parent is replaced by a struct.
    Array indices are not allowed in destination paths.
    """
    tree: dict = {}
    order: list[str] = []
    for path, col in assignments:
        parts = path.split(".")
        node = tree
        for p in parts[:-1]:
            nxt = node.get(p)
            if not isinstance(nxt, dict):
                nxt = {}
                node[p] = nxt
            node = nxt
        node[parts[-1]] = col
        if parts[0] not in order:
            order.append(parts[0])

    def emit(node):
        if isinstance(node, dict):
            return F.struct(*[emit(v).alias(k) for k, v in node.items()])
        return node

    return [emit(tree[k]).alias(k) for k in order]


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """MAP-10 on a DataFrame: write ``value`` at ``path``, keeping sibling fields.

    The longest existing struct prefix is kept (``withField``); the rest of
    the path is created as nested structs; a non-struct parent is replaced.
    """
    parts = path.split(".")
    if len(parts) == 1:
        return df.withColumn(parts[0], value)
    top = parts[0]
    dt = df.schema[top].dataType if top in df.columns else None
    if not isinstance(dt, T.StructType):
        nested = value
        for p in reversed(parts[1:]):
            nested = F.struct(nested.alias(p))
        return df.withColumn(top, nested)
    depth = 1  # parts[:depth] resolve to structs
    while depth < len(parts) - 1 and isinstance(dt, T.StructType) and parts[depth] in dt.fieldNames() \
            and isinstance(dt[parts[depth]].dataType, T.StructType):
        dt = dt[parts[depth]].dataType
        depth += 1
    nested = value
    for p in reversed(parts[depth + 1:]):
        nested = F.struct(nested.alias(p))
    base = F.col(f"`{top}`")
    # a null parent struct stays a struct holding the new field
    return df.withColumn(top, base.withField(".".join(parts[1:depth + 1]), nested))
