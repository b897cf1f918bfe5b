"""Schema operators on field tables (SCH-1..14).

A schema is a set of rows ``(stream, path, type, nullable, required,
ordinal)`` -- a *field table* -- so thousands of catalogs are compared,
versioned and flattened with joins and aggregates instead of a driver loop
per schema. JSON-Schema documents enter as text and are flattened into that
table, some levels at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .conflict import null_safe_join

# ------------------------------------------------------------- inference

def infer_fields(df: DataFrame, json_col: str, stream_col: str | None = None) -> DataFrame:
    """SCH-1: fields of a JSON-object text column over all rows (not one sample).

    Top-level keys typed bool, float64 (every number), string or json
    (object / array); a key seen with two types is json; all nullable. The
    object is read as ``map<string, variant>`` and each value typed with
    ``schema_of_variant``; then one aggregation per (stream, key).
    """
    keep = [stream_col] if stream_col else []
    kv = df.select(*keep, F.explode(F.from_json(F.col(json_col), "map<string, variant>")).alias("key", "_v"))
    t = F.schema_of_variant(F.col("_v"))
    typ = (F.when(t == "BOOLEAN", F.lit("bool"))
           .when(t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit("float64"))
           .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.lit("json"))
           .when(t == "VOID", F.lit(None))
           .otherwise(F.lit("string")))
    agg = kv.select(*keep, "key", typ.alias("_t")).groupBy(*keep, "key").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    return agg.select(*keep, F.col("key").alias("field"),
                      F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(F.col("_a").isNull(), F.lit("string"))
                      .otherwise(F.lit("json")).alias("type"),
                      F.lit(True).alias("nullable"))


# ---------------------------------------------------------- catalog build

def catalog_from_columns(columns: DataFrame, table: str = "table_name", column: str = "column_name",
                         ordinal: str = "ordinal", dtype: str = "type", nullable: str = "nullable") -> DataFrame:
    """SCH-3: column metadata rows -> one catalog entry per table, columns in ordinal order.

    The per-table column list is bounded by the table width, not the data.
    """
    cols = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("ordinal"), F.col(column).alias("name"),
                                                F.col(dtype).alias("type"), F.col(nullable).alias("nullable"))))
    return columns.groupBy(table).agg(cols.alias("columns")).select(
        table, F.size("columns").alias("n_columns"),
        F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("column_names"), "columns")


# Source type -> JSON schema type per system.
SNOWFLAKE_INT_NAMES = ("NUMBER", "DECIMAL", "NUMERIC")
BIGQUERY_TYPES = {
    "STRING": "string", "BYTES": "string", "DATE": "string", "DATETIME": "string", "TIME": "string",
    "TIMESTAMP": "string", "GEOGRAPHY": "string", "JSON": "string",
    "INTEGER": "integer", "INT64": "integer",
    "FLOAT": "number", "FLOAT64": "number", "NUMERIC": "number", "BIGNUMERIC": "number",
    "BOOLEAN": "boolean", "BOOL": "boolean",
    "RECORD": "object", "STRUCT": "object",
}
SALESFORCE_TYPES = {"int": "integer", "integer": "integer", "double": "number", "currency": "number",
                    "percent": "number", "boolean": "boolean"}
HUBSPOT_TYPES = {"number": "number", "bool": "boolean"}


def json_type_of(system: str, source_type: Column, mode: Column | None = None) -> Column:
    """SCH-4: JSON schema type of a source column type.

    Snowflake by pattern (``*INT*``/NUMBER/DECIMAL/NUMERIC integer;
    FLOAT/DOUBLE/REAL number; BOOLEAN; BINARY string; VARIANT/OBJECT/ARRAY
    object), BigQuery by table with REPEATED mode -> array, Salesforce and
    HubSpot by table; everything else is string.
    """
    if system == "snowflake":
        u = F.upper(source_type)
        return (F.when(u.contains("INT") | u.isin(*SNOWFLAKE_INT_NAMES), F.lit("integer"))
                .when(u.contains("FLOAT") | u.contains("DOUBLE") | (u == "REAL"), F.lit("number"))
                .when(u == "BOOLEAN", F.lit("boolean"))
                .when(u.contains("BINARY"), F.lit("string"))
                .when(u.contains("VARIANT") | u.contains("OBJECT") | u.contains("ARRAY"), F.lit("object"))
                .otherwise(F.lit("string")))
    table = {"bigquery": BIGQUERY_TYPES, "salesforce": SALESFORCE_TYPES, "hubspot": HUBSPOT_TYPES}[system]
    key = F.upper(source_type) if system == "bigquery" else source_type
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    base = F.coalesce(m[key], F.lit("string"))
    if system == "bigquery" and mode is not None:
        return F.when(F.upper(mode) == "REPEATED", F.lit("array")).otherwise(base)
    return base


# ----------------------------------------------------------- flattening

#: Levels of a document that one job walks.
LEVELS_PER_JOB = 4


def _part(node, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f"$.{path}", kind)


def _kind(node) -> Column:
    """STRING, BOOLEAN, ARRAY<...>, VOID, ...; null where there is nothing. For small values: it reads all of them."""
    return F.schema_of_variant(node)


def _with(value: Column, body) -> Column:
    """``body(value)``, the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _fields(properties: Column, needed=lambda name: F.lit(False)) -> Column:
    """Properties of a node (a map) as fields: (name, node, needed)."""
    return F.transform(F.map_entries(properties), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("node"), needed(e["key"]).alias("needed")))


def _found(node: Column, path: Column, depth: Column, levels: int, below, described) -> Column:
    """Fields below a node, ``levels`` deep, as one array, each with its ``_node`` where the walk has to go on."""
    def one(f: Column) -> Column:
        at = F.concat_ws(".", path, f["name"])
        rest = F.when(_part(f["node"], "properties").isNotNull() | _part(f["node"], "items").isNotNull(), f["node"]) if levels == 1 else F.lit(None).cast("variant")
        columns = [c.alias(k) for k, c in described(f["node"], f["needed"]).items()]
        itself = lambda at: F.array(F.struct(at.alias("path"), f["name"].alias("name"), depth.alias("depth"), *columns, rest.alias("_node")))
        if levels == 1:
            return itself(at)
        return _with(at, lambda at: F.concat(itself(at), _found(f["node"], at, depth + 1, levels - 1, below, described)))

    none = F.array().cast("array<struct<name:string,node:variant,needed:boolean>>")
    return F.flatten(F.transform(F.coalesce(below(node), none), one))


def _walk(schemas: DataFrame, schema_col: str, keys: list[str], root, below, described) -> DataFrame:
    """Every field of the documents: (*keys, path, name, depth) and what ``described(node, needed)`` gives by name.

    ``root(node)`` and ``below(node)`` are the fields of the document and of a field: an array of (name, node, needed).
    A job walks many levels of a document in one expression, which visits each field once and keeps no
    subtree, and writes the fields as a table; from those of its last level that may have fields the next job starts, until
    there are none. A text that is no JSON object has no fields.
    """
    none = F.lit(None).cast("string")
    start, first, tables = schemas.select(*keys, none.alias("_path"), F.lit(0).alias("_depth"), F.try_parse_json(schema_col).alias("_start")), True, []
    while True:
        top = [root] if first else []
        each = lambda node: top.pop()(node) if top else below(node)  # noqa: B023, E731
        found = _found(F.col("_start"), F.col("_path"), F.col("_depth"), LEVELS_PER_JOB, each, described)
        tables.append(materialize(start.select(*keys, F.explode(found).alias("_f")).select(*keys, "_f.*"), "schema-levels"))
        deepest, first = tables[-1].where("_node IS NOT NULL"), False
        if deepest.isEmpty():
            return reduce(DataFrame.unionByName, tables).drop("_node")
        start = deepest.select(*keys, F.col("path").alias("_path"), (F.col("depth") + 1).alias("_depth"), F.col("_node").alias("_start"))


def field_tree(schemas: DataFrame, schema_col: str, keys: list[str]) -> DataFrame:
    """SCH-6: every field of JSON-Schema documents with ``path, name, depth, type,
    required, nullable, description``; union types are joined by `` | ``; objects with
    properties and arrays of objects are descended, however deep."""
    def fields(home: Column, properties: Column) -> Column:
        texts = F.filter(_part(home, "required", "array<variant>"), lambda r: _kind(r) == "STRING")
        names = F.transform(texts, lambda r: F.try_variant_get(r, "$", "string"))
        return _with(names, lambda names: _fields(properties, lambda name: F.coalesce(F.array_contains(names, name), F.lit(False))))

    def below(node: Column) -> Column:
        properties = lambda home: _part(home, "properties", "map<string,variant>")  # noqa: E731 - null for anything but an object
        of_items = lambda items: _with(properties(items), lambda p: F.when(F.size(p) > 0, fields(items, p)))
        return _with(properties(node), lambda p: F.when(F.size(p) > 0, fields(node, p)).when(_part(node, "type", "string") == "array", _with(_part(node, "items"), of_items)))

    def described(node: Column, needed: Column) -> dict[str, Column]:
        # of a type that is an array
        union = lambda kinds: F.struct(F.array_join(F.filter(kinds, lambda k: k != "null"), " | ").alias("type"), F.coalesce(F.array_contains(kinds, "null"), F.lit(False)).alias("null"))
        kinds = lambda: F.when(_kind(_part(node, "type")).startswith("ARRAY"), _part(node, "type", "array<string>"))
        is_null = F.coalesce((_kind(_part(node, "nullable")) == "BOOLEAN") & _part(node, "nullable", "boolean"), F.lit(False))
        declared = _with(kinds(), lambda k: F.when(k.isNotNull(), union(k)).otherwise(F.struct(F.coalesce(_part(node, "type", "string"), F.lit("any")).alias("type"), F.lit(False).alias("null"))))
        return {"_type": declared, "required": needed, "nullable": is_null, "description": F.coalesce(_part(node, "description", "string"), F.lit(""))}

    rows = _walk(schemas, schema_col, keys, below, below, described)
    return rows.select(*keys, "path", "name", "depth", F.col("_type.type").alias("type"), "required", (F.col("_type.null") | F.col("nullable")).alias("nullable"), "description")


def flatten_fields(schemas: DataFrame, schema_col: str, keys: list[str]) -> DataFrame:
    """SCH-5: leaf paths of JSON-Schema documents; objects with properties are
    descended, however deep, an object without and an array are leaves; a missing or
    union type is ``string``."""
    kind = lambda node: F.when(_kind(_part(node, "type")) == "STRING", _part(node, "type", "string")).otherwise("string")
    fields = lambda node: _fields(_part(node, "properties", "map<string,variant>"))
    # the document itself is descended whatever its type
    below = lambda node: F.when(_part(node, "type", "string") == "object", fields(node))
    leaf = lambda node: (kind(node) != "object") | ~F.coalesce(F.size(_part(node, "properties", "map<string,variant>")) > 0, F.lit(False))
    rows = _walk(schemas, schema_col, keys, fields, below, lambda node, _: {"type": kind(node), "_leaf": leaf(node)})
    return rows.where("_leaf").select(*keys, "path", "type")


def field_count(tree: DataFrame, keys: list[str]) -> DataFrame:
    """SCH-7: recursive field count per schema."""
    return tree.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("field_count"))


def parse_type_decl(type_json: Column) -> tuple[Column, Column]:
    """SCH-10: ``"T"`` -> (T, false); ``["T", "null"]`` -> (T, true); anything else -> ("unknown", ...)."""
    arr = F.from_json(type_json, "array<string>")
    scalar = F.from_json(F.concat(F.lit("["), type_json, F.lit("]")), "array<string>")
    is_arr = F.trim(type_json).startswith("[")
    non_null = F.filter(arr, lambda x: x != "null")
    typ = F.when(is_arr, F.coalesce(F.element_at(non_null, -1), F.lit("unknown"))).otherwise(
        F.coalesce(F.element_at(scalar, 1), F.lit("unknown")))
    nullable = F.when(is_arr, F.coalesce(F.array_contains(arr, "null"), F.lit(False))).otherwise(F.lit(False))
    return typ, nullable


# ------------------------------------------------------------------ diff

def _both_sides(old: DataFrame, new: DataFrame, keys: list[str], field: str) -> tuple[DataFrame, list[Column]]:
    """The fields of two field tables side by side, and the cases that are a change each."""
    o = old.select(*keys, field, F.col("type").alias("_ot"), F.col("nullable").alias("_on"), F.lit(True).alias("_io"))
    n = new.select(*keys, field, F.col("type").alias("_nt"), F.col("nullable").alias("_nn"), F.lit(True).alias("_in"))
    j = null_safe_join(o, n, keys + [field], "full_outer")
    io, inn = F.col("_io").isNotNull(), F.col("_in").isNotNull()
    return j, [io & ~inn, ~io & inn, io & inn & ~F.col("_ot").eqNullSafe(F.col("_nt")), io & inn & ~F.col("_on").eqNullSafe(F.col("_nn"))]


def schema_diff(old: DataFrame, new: DataFrame, keys: list[str], field: str = "path") -> DataFrame:
    """SCH-8: changes between two field tables, one row per change.

    ``(keys, field, change, old_value, new_value, is_breaking)``: removed
    (breaking), added, type change (breaking), nullable change (breaking
    only when a nullable field becomes non-nullable). One full outer join on
    (keys, field), where null equals null, then an ``explode`` of the change array.
    """
    j, cases = _both_sides(old, new, keys, field)
    removed, added, retyped, loosened = cases

    def ch(kind, ov, nv, br):
        return F.struct(F.lit(kind).alias("change"), ov.cast("string").alias("old_value"), nv.cast("string").alias("new_value"),
                        br.alias("is_breaking"))

    nl = lambda c: F.concat(F.lit("nullable="), F.when(c, F.lit("true")).otherwise(F.lit("false")))
    changes = F.array_compact(F.array(
        F.when(removed, ch("removed_field", F.col("_ot"), F.lit(None), F.lit(True))),
        F.when(added, ch("added_field", F.lit(None), F.col("_nt"), F.lit(False))),
        F.when(retyped, ch("type_change", F.col("_ot"), F.col("_nt"), F.lit(True))),
        F.when(loosened,
               ch("nullable_change", nl(F.col("_on")), nl(F.col("_nn")), F.col("_on") & ~F.col("_nn"))),
    ))
    return j.select(*keys, field, F.explode(changes).alias("_c")).select(*keys, field, "_c.*")


def compatibility(diff: DataFrame, streams: DataFrame, keys: list[str]) -> DataFrame:
    """SCH-9: a stream is compatible when none of its changes breaks (no change = compatible)."""
    br = diff.groupBy(*keys).agg(F.bool_or("is_breaking").alias("_b"), F.count(F.lit(1)).cast("bigint").alias("changes"))
    return null_safe_join(streams.select(*keys).distinct(), br, keys, "left").select(
        *keys, F.coalesce(F.col("changes"), F.lit(0).cast("bigint")).alias("changes"),
        (~F.coalesce(F.col("_b"), F.lit(False))).alias("is_compatible"))


def change_events(diff: DataFrame, keys: list[str], field: str = "path") -> DataFrame:
    """SCH-14: schema-change event kind per field (nullable changes carry no event)."""
    kind = (F.when(F.col("change") == "added_field", F.lit("new_column"))
            .when(F.col("change") == "removed_field", F.lit("removed_column"))
            .when(F.col("change") == "type_change", F.lit("type_change")))
    return diff.select(*keys, field, kind.alias("event")).filter(F.col("event").isNotNull())


# ------------------------------------------------------------- versions

def append_versions(versions: DataFrame, fields: DataFrame, discovered: DataFrame, streams: DataFrame, keys: list[str],
                    field: str = "path") -> tuple[DataFrame, DataFrame, DataFrame]:
    """SCH-11: (versions, fields, changes) to append for the ``streams`` of a discovery.

    ``versions(keys, version)`` and ``fields(keys, version, field, type,
    nullable, ...)`` are the history, ``discovered`` the field table found
    now. A stream gets version latest + 1 when its fields differ from its
    latest version, also when none are left, and version 1 when it is new; a
    stream that was not discovered gets none. Appended versions carry
    ``n_fields`` and ``n_changes``, appended fields and changes their version
    (a first version has no changes).
    """
    last = versions.groupBy(*keys).agg(F.max("version").alias("version"))
    seen = streams.select(*keys).distinct()
    latest = null_safe_join(fields, null_safe_join(last, seen, keys, "left_semi"), keys + ["version"], "left_semi")
    diff = schema_diff(latest, discovered, keys, field)
    # counted without a row per change
    sides, cases = _both_sides(latest, discovered, keys, field)
    n = reduce(lambda a, b: a + b, [c.cast("long") for c in cases])
    changed = sides.groupBy(*keys).agg(F.sum(n).alias("n_changes")).where("n_changes > 0")
    width = discovered.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n_fields"))
    j = null_safe_join(null_safe_join(null_safe_join(seen, last, keys, "left"), changed, keys, "left"), width, keys, "left")
    new = j.where(F.col("version").isNull() | F.col("n_changes").isNotNull()).select(
        *keys, (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.coalesce("n_fields", F.lit(0).cast("bigint")).alias("n_fields"),
        F.when(F.col("version").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_changes")).alias("n_changes"))
    numbered = new.select(*keys, "version")
    changes = null_safe_join(diff, numbered.where("version > 1"), keys)
    return new, null_safe_join(discovered, numbered, keys), changes


def version_at(versions: DataFrame, keys: list[str], version: int) -> DataFrame:
    """SCH-12: the version row with this number, per stream that has it."""
    return versions.where(F.col("version") == version)


def list_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """SCH-12: all versions of every stream with their place ``newest`` (1 for the
    newest); a stream's versions are few."""
    return versions.withColumn("newest", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("version").desc())).cast("bigint"))


def latest_version(versions: DataFrame, keys: list[str]) -> DataFrame:
    """SCH-12: latest version row per stream (``max_by``)."""
    row = F.struct(*[F.col(c) for c in versions.columns])
    return versions.groupBy(*keys).agg(F.max_by(row, F.col("version")).alias("_r")).select("_r.*")
