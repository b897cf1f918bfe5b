"""Record mapping, mapping templates and validation, filters (MAP-1..14, FIL-1..4).

Every mapping compiles into a single ``select`` (one projection, no chained
``withColumn``), so Catalyst prunes unused source columns down to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import coerce, kind_of
from ..functions.paths import build_nested, get_path, parse_path
from ..model import FieldMapping
from ..session import materialize
from .keys import key_join, text_hash


def type_at(df: DataFrame, path: str) -> T.DataType | None:
    """Spark type of a struct / array path, or None when it does not resolve."""
    dt: T.DataType = df.schema
    for s in parse_path(path):
        if isinstance(s, int):
            if not isinstance(dt, T.ArrayType):
                return None
            dt = dt.elementType
        elif isinstance(dt, T.MapType):
            dt = dt.valueType
        elif isinstance(dt, T.StructType) and s in dt.fieldNames():
            dt = dt[s].dataType
        else:
            return None
    return dt


def expression_transform(val: Column, dtype: T.DataType, name: str) -> Column:
    """MAP-6: the named single-value transforms; a wrong type or unknown name leaves the value."""
    n = (name or "").strip().lower()
    is_str = isinstance(dtype, T.StringType)
    is_num = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType))
    if n == "upper" and is_str:
        return F.upper(val)
    if n == "lower" and is_str:
        return F.lower(val)
    if n == "trim" and is_str:
        return F.regexp_replace(val, r"(?U)^\s+|\s+$", "")
    if n == "negate" and is_num:
        return -val
    if n == "tostring":
        from ..functions.text import to_text

        return to_text(val)
    if n == "length" and is_str:
        return F.octet_length(val).cast("bigint")  # bytes, not characters
    if n == "length" and isinstance(dtype, T.ArrayType):
        return F.size(val).cast("bigint")
    return val


def mapping_column(df: DataFrame, m: FieldMapping, on_error: str = "raise") -> Column:
    """Value of one strict mapping; null when the source path does not resolve."""
    dtype = type_at(df, m.source_field)
    if dtype is None:
        val = F.lit(None).cast("string")  # an absent source is a null text value
        dtype = T.NullType()
    else:
        val = get_path(m.source_field)
    t = (m.transform or "identity").lower()
    if t == "cast" and m.cast_type and dtype is not None and not isinstance(dtype, T.NullType):
        return coerce(val, kind_of(dtype), m.cast_type, on_error)
    if t == "expression":
        return expression_transform(val, dtype, m.expression or "")
    if t == "default":
        if isinstance(dtype, T.NullType):
            return F.lit(m.default_value)
        return F.coalesce(val, F.lit(m.default_value).cast(dtype))
    return val


def map_strict(df: DataFrame, mappings: list[FieldMapping], keep: list[str] | None = None, on_error: str = "raise") -> DataFrame:
    """MAP-1 (+MAP-4..10): output holds only the mapped fields, in mapping order.

    A later mapping to the same destination wins. Dotted destinations build
    nested structs. ``keep`` passes envelope columns (stream, key, cursor)
    through unchanged, in front.
    """
    assigns = [(m.dest_field, mapping_column(df, m, on_error)) for m in mappings]
    cols = [F.col(f"`{k}`") for k in (keep or [])]
    return df.select(*cols, *build_nested(assigns))


def _lenient_columns(df: DataFrame, mappings: list[FieldMapping]) -> dict[str, Column]:
    present = set(df.columns)
    out: dict[str, Column] = {}
    for m in mappings:
        if m.source_field in present:
            out[m.dest_field] = F.col(f"`{m.source_field}`")
    mapped_sources = {m.source_field for m in mappings}
    for c in df.columns:
        if c not in mapped_sources and c not in out:
            out[c] = F.col(f"`{c}`")
    return out


def map_lenient(df: DataFrame, mappings: list[FieldMapping]) -> DataFrame:
    """MAP-2: rename top-level fields; unmapped fields stay unless their name is a destination.

    Sources absent from the schema are skipped; no mappings -> unchanged.
    """
    if not mappings:
        return df
    return df.select(*[v.alias(k) for k, v in _lenient_columns(df, mappings).items()])


def map_by_stream(df: DataFrame, stream_col: str, per_stream: dict[str, list[FieldMapping]], mode: str = "lenient") -> DataFrame:
    """MAP-3: a different mapping per stream of a mixed record table.

    One ``select`` over one scan: every destination is a ``when`` over the
    streams that have it, else null. Rows of other streams keep their columns.
    """
    is_stream = {s: F.col(f"`{stream_col}`") == F.lit(s) for s in per_stream}
    branch: dict[str, dict[str, Column]] = {}
    for s, ms in per_stream.items():
        if mode == "lenient":
            branch[s] = _lenient_columns(df, ms)
        else:
            cols = build_nested([(m.dest_field, mapping_column(df, m)) for m in ms])
            branch[s] = dict(zip(df.select(*cols).columns, cols))
        branch[s][stream_col] = F.col(f"`{stream_col}`")
    names = list(dict.fromkeys([stream_col, *df.columns, *(c for b in branch.values() for c in b)]))
    listed = F.coalesce(F.col(f"`{stream_col}`").isin(list(per_stream)), F.lit(False))
    out = []
    for name in names:
        value = F.when(~listed, F.col(f"`{name}`")) if name in df.columns else F.when(F.lit(False), F.lit(None))
        for s, cols in branch.items():
            if name in cols:
                value = value.when(is_stream[s], cols[name])
        out.append(value.alias(name))
    return df.select(*out)


# ------------------------------------------------------------- templates

# Built-in mapping templates of the source system, as
# (source field, destination field, transform, confidence).
SALESFORCE_TO_HUBSPOT_CONTACTS = [
    ("FirstName", "firstname", "", 1.0),
    ("LastName", "lastname", "", 1.0),
    ("Email", "email", "", 1.0),
    ("Phone", "phone", "", 1.0),
    ("MobilePhone", "mobilephone", "", 0.95),
    ("Title", "jobtitle", "", 0.85),
    ("Account.Name", "company", "", 0.9),
    ("MailingStreet", "address", "", 0.85),
    ("MailingCity", "city", "", 0.95),
    ("MailingState", "state", "", 0.95),
    ("MailingPostalCode", "zip", "", 0.8),
    ("MailingCountry", "country", "", 0.95),
]
BIGQUERY_TO_SNOWFLAKE = [
    ("STRING", "VARCHAR", "to_string", 1.0),
    ("INT64", "NUMBER", "to_int", 0.95),
    ("FLOAT64", "FLOAT", "to_float", 0.95),
    ("BOOL", "BOOLEAN", "", 1.0),
    ("TIMESTAMP", "TIMESTAMP_NTZ", "format_date", 0.9),
    ("DATE", "DATE", "", 1.0),
    ("BYTES", "BINARY", "", 0.9),
    ("JSON", "VARIANT", "", 0.85),
]
TEMPLATES = {"salesforce_to_hubspot_contacts": SALESFORCE_TO_HUBSPOT_CONTACTS, "bigquery_to_snowflake": BIGQUERY_TO_SNOWFLAKE}


def template_table(spark, name: str) -> DataFrame:
    """MAP-11: a built-in template as a table ``(template, source_field, dest_field, transform, confidence)``."""
    return spark.createDataFrame([(name, *row) for row in TEMPLATES[name]],
                                 "template string, source_field string, dest_field string, transform string, confidence double")


def template_mappings(name: str) -> list[FieldMapping]:
    """MAP-11: a field template as strict mappings (renames; nested sources allowed)."""
    return [FieldMapping(s, d, "rename") for s, d, _, _ in TEMPLATES[name]]


def save_template(mappings: DataFrame, root: str, name: str) -> None:
    """MAP-11 store: save a mapping table ``(source_field, dest_field, transform, confidence)``
    under ``root/template=<name>`` (replacing an earlier version of that template only)."""
    mappings.write.mode("overwrite").parquet(f"{root.rstrip('/')}/template={name}")


def load_template(spark, root: str, name: str) -> DataFrame:
    """MAP-11 store: a saved template (built-in names are served from the fixed tables)."""
    if name in TEMPLATES:
        return template_table(spark, name)
    return spark.read.parquet(f"{root.rstrip('/')}/template={name}").withColumn("template", F.lit(name))


def list_templates(spark, root: str) -> list[str]:
    """MAP-11 store: built-in and saved template names."""
    from ..session import fs_list

    saved = [n.split("=", 1)[1] for n, is_dir in fs_list(spark, root) if is_dir and n.startswith("template=")]
    return sorted(set(TEMPLATES) | set(saved))


def delete_template(spark, root: str, name: str) -> bool:
    """MAP-11 store: remove a saved template (built-ins cannot be removed)."""
    if name in TEMPLATES:
        raise ValueError(f"built-in template {name!r} cannot be deleted")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/template={name}")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def apply_type_template(df: DataFrame, types_col: str, template: DataFrame) -> DataFrame:
    """MAP-11 (type template): destination type and transform for each source type.

    The template holds eight rows, so it is broadcast (size fixed by construction).
    """
    t = template.select(F.col("source_field").alias("_tt_src"), F.col("dest_field").alias("dest_type"),
                        F.col("transform").alias("type_transform"))
    return df.join(F.broadcast(t), F.col(types_col) == F.col("_tt_src"), "left").drop("_tt_src")


# ------------------------------------------------------------ validation

def validate_mappings(src_fields: DataFrame, dst_fields: DataFrame, connections: DataFrame, key: str = "mapping_id") -> DataFrame:
    """MAP-12: validation errors of visual mappings, many mappings at once.

    Inputs are field tables: ``src_fields(key, path, type)``,
    ``dst_fields(key, path, type, required)``,
    ``connections(key, conn_id, seq, source_field, dest_field, transform)``.
    Output: ``(key, conn_id, field, kind, message)`` where kind is one of
    required_unmapped, unknown_source, unknown_dest, duplicate_dest,
    type_mismatch. All joins are equi-joins on (key, path).
    """
    # fixed values: the messages
    text = lambda message, *cols: F.format_string(message, *[F.col(c) for c in cols])
    s = src_fields.select(F.col(key), F.col("path").alias("source_field"), F.col("type").alias("_st"), F.lit(True).alias("_s"))
    d = dst_fields.select(F.col(key), F.col("path").alias("dest_field"), F.col("type").alias("_dt"), F.col("required").alias("_req"), F.lit(True).alias("_d"))
    # the first use of a destination is a min aggregate, combined map-side
    marked = connections.groupBy(*text_hash(connections, [key, "dest_field"]), key, "dest_field")
    first = marked.agg(F.min(F.struct("seq", "conn_id")).alias("_first"))
    used = materialize(key_join(d, first, [key, "dest_field"], "full_outer"), "mapping-used")  # read twice
    req = used.filter(F.col("_req") & F.col("_first").isNull()).select(
        key, F.lit(None).cast("string").alias("conn_id"), F.col("dest_field").alias("field"), F.lit("required_unmapped").alias("kind"),
        text('required destination field "%s" has no mapping', "dest_field").alias("message"))
    cj = key_join(key_join(connections, used, [key, "dest_field"], "left"), s, [key, "source_field"], "left")

    def error(kind, field, message, *cols):
        return F.struct(F.col(field).alias("field"), F.lit(kind).alias("kind"), text(message, *cols).alias("message"))

    no_source, no_dest = F.col("_s").isNull(), F.col("_d").isNull()
    mismatch = ~no_source & ~no_dest & (F.col("_st") != "") & (F.col("_dt") != "") & (F.col("_st") != F.col("_dt")) & (F.coalesce("transform", F.lit("")) == "")
    errors = F.array_compact(F.array(
        F.when(no_source, error("unknown_source", "source_field", 'source field "%s" does not exist', "source_field")),
        F.when(no_dest, error("unknown_dest", "dest_field", 'destination field "%s" does not exist', "dest_field")),
        F.when(F.col("_first") < F.struct("seq", "conn_id"), error("duplicate_dest", "dest_field", 'destination field "%s" has multiple source mappings', "dest_field")),
        F.when(mismatch, error("type_mismatch", "source_field", 'type mismatch "%s" -> "%s" without transform', "_st", "_dt")),
    ))
    found = cj.select(key, "conn_id", F.explode(errors).alias("_e")).select(key, "conn_id", "_e.*")
    return req.unionByName(found)


def unmapped_fields(fields: DataFrame, connections: DataFrame, side: str, key: str = "mapping_id") -> DataFrame:
    """MAP-13 / CON-8: fields of one side with no connection (``side`` = source or dest)."""
    col = "source_field" if side == "source" else "dest_field"
    used = connections.select(key, F.col(col).alias("path"))
    return key_join(fields, used, [key, "path"], "left_anti")


def connections_from_mappings(mappings: DataFrame, src_fields: DataFrame, dst_fields: DataFrame, key: str = "mapping_id") -> DataFrame:
    """MAP-14: field mappings -> connections with id ``src->dst`` and a validity flag (both ends known)."""
    s = src_fields.select(key, F.col("path").alias("source_field"), F.lit(True).alias("_s")).distinct()
    d = dst_fields.select(key, F.col("path").alias("dest_field"), F.lit(True).alias("_d")).distinct()
    return (
        key_join(key_join(mappings, s, [key, "source_field"], "left"), d, [key, "dest_field"], "left")
        .select(
            key,
            F.concat_ws("->", "source_field", "dest_field").alias("conn_id"),
            "source_field", "dest_field", "transform",
            (F.coalesce(F.col("_s"), F.lit(False)) & F.coalesce(F.col("_d"), F.lit(False))).alias("validated"),
        )
    )


# ---------------------------------------------------------------- filters

def audit_filter(df: DataFrame, time_col: str | None = None, start=None, end=None, **equals) -> DataFrame:
    """FIL-1: every non-empty criterion is an equality; time bounds inclusive on both ends."""
    conds = [F.col(k) == F.lit(v) for k, v in equals.items() if v not in (None, "")]
    if time_col and start is not None:
        conds.append(F.col(time_col) >= F.lit(start))
    if time_col and end is not None:
        conds.append(F.col(time_col) <= F.lit(end))
    if not conds:
        return df
    return df.filter(reduce(lambda a, b: a & b, conds))


def text_search(df: DataFrame, cols: list[str], query: str, **equals) -> DataFrame:
    """FIL-2: lower-cased substring over the concatenated columns, plus exact filters."""
    out = df
    if query:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
        out = out.filter(hay.contains(query.lower()))
    for k, v in equals.items():
        if v not in (None, ""):
            out = out.filter(F.col(k) == F.lit(v))
    return out


def categories(df: DataFrame, col: str) -> DataFrame:
    """FIL-3: distinct non-empty values, sorted."""
    return df.select(col).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct().orderBy(col)


def nested_field_search(fields: DataFrame, query: str, key: str = "schema_id") -> DataFrame:
    """FIL-4: a field matches when its name, description or any descendant matches.

    ``fields(key, path, name, description)`` is a flattened field tree. The
    matching fields are found first; each match then marks itself and all
    its ancestors, whose paths are the dotted prefixes of the match -- an
    ``explode`` of prefixes and an equi-join, not a self join on LIKE.
    """
    q = query.lower()
    hit = fields.filter(
        F.lower(F.col("name")).contains(q) | F.lower(F.coalesce(F.col("description"), F.lit(""))).contains(q)
    )
    parts = F.split(F.col("path"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    marked = hit.select(key, F.explode(prefixes).alias("path")).distinct()
    return fields.join(marked, [key, "path"], "left_semi")
