"""Configuration objects passed to operators (plain dataclasses, driver side only)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class FieldMapping:
    """One field mapping.

    ``transform``: ``identity`` (default), ``rename``, ``cast`` (uses
    ``cast_type``), ``expression`` (uses ``expression``), ``default`` (uses
    ``default_value``). ``coerce_type`` is the lenient workflow coercion target
    applied to ``dest_field``.
    """

    source_field: str
    dest_field: str
    transform: str = "identity"
    cast_type: str | None = None
    expression: str | None = None
    default_value: Any = None
    coerce_type: str | None = None


@dataclass
class StreamConfig:
    """A configured stream: name, key, cursor and modes."""

    name: str
    primary_key: list[str] = field(default_factory=list)
    cursor_field: str | None = None
    sync_mode: str = "full_refresh"  # or "incremental"
    destination_mode: str = "append"  # append | upsert | merge | soft_delete
    mappings: list[FieldMapping] = field(default_factory=list)


@dataclass
class SyncConfig:
    """Parameters of one sync run (SNK-15)."""

    sync_id: str
    stream: StreamConfig
    cursor_value: Any = None
    cursor_op: str = ">"
    order: str = "map_first"  # workflow order; "dedup_first" is the worker order
    dedup_order_by: list[str] = field(default_factory=list)
    mapping_mode: str = "strict"  # strict | lenient
