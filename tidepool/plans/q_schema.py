"""Registered queries: schema inference, catalogs, diff, versions (SCH-*), mapping
validation and templates (MAP-11..14, FIL-4, SET-3) and field matching (FUZ-*).

Field tables are derived from the driver tables so their size grows with
the data: every order is a stream whose fields are its line items' part
names (``lineitem`` joined to ``part``). Version 2 of each schema drops,
retypes, loosens and adds fields by rules on the line-item values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as NM
from ..operators import mapping as M
from ..operators import match as MT
from ..operators import runs as R
from ..operators import schema as S
from ..operators import writes as W
from ..operators.dedup import dedup_by_key, first_rows
from ..session import materialize
from ..sources.tables import load
from .registry import query

# Fixed values (derivation rule of the field catalog): part type -> JSON type.
PTYPE_JSON = {"ECONOMY": "string", "SMALL": "integer", "MEDIUM": "number", "LARGE": "boolean",
              "STANDARD": "object", "PROMO": "array"}


def field_rows(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                            "l_discount", "l_tax", "l_quantity")
    jt = F.when(F.lit(False), F.lit(None))
    for k, v in PTYPE_JSON.items():
        jt = jt.when(F.col("p_type") == k, F.lit(v))
    p = load(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("path"), jt.otherwise(F.lit("array")).alias("type"))
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("stream"), "path", "type",
                    (F.col("l_linestatus") == "O").alias("nullable"), (F.col("l_returnflag") == "N").alias("required"),
                    F.col("l_linenumber").alias("ordinal"), "l_discount", "l_tax", "l_quantity", "l_orderkey", "l_linenumber")


FIELD_COLS = ["stream", "path", "type", "nullable", "required", "ordinal"]
TIE_ORDER = ["ordinal", "type", "nullable", "required"]  # line numbers repeat within an order


def catalog_v1(spark, sf):
    return dedup_by_key(field_rows(spark, sf).select(*FIELD_COLS), ["stream", "path"], TIE_ORDER)


KEPT = "l_discount < 0.085"


def _v2_field():
    """A line item's field in version 2."""
    typ = F.when(F.col("l_tax") >= 0.065, F.when(F.col("type") == "string", F.lit("number")).otherwise(F.lit("string"))).otherwise(F.col("type"))
    nullable = F.when(F.col("l_quantity") > 40, ~F.col("nullable")).otherwise(F.col("nullable"))
    return {"stream": F.col("stream"), "path": F.col("path"), "type": typ, "nullable": nullable, "required": F.col("required"), "ordinal": F.col("ordinal")}


def _added(rows):
    return rows.filter(F.col("l_quantity") < 3).select(
        "stream", F.concat(F.lit("note_"), F.col("l_linenumber").cast("string")).alias("path"), F.lit("string").alias("type"),
        F.lit(True).alias("nullable"), F.lit(False).alias("required"), (F.col("ordinal") + 100).alias("ordinal")).distinct()


def catalog_v2(spark, sf):
    r = field_rows(spark, sf)
    kept = r.filter(KEPT).select(*[c.alias(n) for n, c in _v2_field().items()])
    return dedup_by_key(kept, ["stream", "path"], TIE_ORDER).unionByName(_added(r))


def catalogs(spark, sf):
    """Both catalogs as tables, for queries that read them in several places: one aggregate
    over the line items finds the fields of both."""
    r, v2 = field_rows(spark, sf), _v2_field()
    # a field is its keys and what orders it
    both = first_rows(r, ["stream", "path"], {"v1": (None, F.struct(*TIE_ORDER), None), "v2": (None, F.struct(*[v2[n].alias(n) for n in TIE_ORDER]), F.expr(KEPT))})
    both = materialize(both, "catalogs")
    fields = lambda v: both.where(f"{v} IS NOT NULL").select("stream", "path", *[f"{v}.{c}" for c in FIELD_COLS if c in TIE_ORDER])
    return fields("v1"), fields("v2").unionByName(materialize(_added(r), "catalog-added"))


CAT_SQL = """WITH fr AS (
  SELECT concat('order_', l_orderkey) AS stream, replace(p_name, ' ', '_') AS path,
    CASE p_type WHEN 'ECONOMY' THEN 'string' WHEN 'SMALL' THEN 'integer' WHEN 'MEDIUM' THEN 'number' WHEN 'LARGE' THEN 'boolean'
      WHEN 'STANDARD' THEN 'object' ELSE 'array' END AS type,
    l_linestatus = 'O' AS nullable, l_returnflag = 'N' AS required, l_linenumber AS ordinal, l_discount, l_tax, l_quantity,
    l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey),
v1 AS (SELECT stream, path, type, nullable, required, ordinal FROM fr
       QUALIFY row_number() OVER (PARTITION BY stream, path ORDER BY ordinal, type, nullable, required) = 1),
v2r AS (SELECT stream, path, CASE WHEN l_tax >= 0.065 THEN CASE WHEN type = 'string' THEN 'number' ELSE 'string' END ELSE type END AS type,
          CASE WHEN l_quantity > 40 THEN NOT nullable ELSE nullable END AS nullable, required, ordinal FROM fr WHERE l_discount < 0.085),
v2 AS (SELECT stream, path, type, nullable, required, ordinal FROM v2r
       QUALIFY row_number() OVER (PARTITION BY stream, path ORDER BY ordinal, type, nullable, required) = 1
       UNION ALL SELECT DISTINCT stream, concat('note_', l_linenumber), 'string', true, false, ordinal + 100 FROM fr WHERE l_quantity < 3),
diff AS (
  SELECT v1.stream, v1.path, 'removed_field' AS change, v1.type AS old_value, CAST(NULL AS VARCHAR) AS new_value, true AS is_breaking
    FROM v1 ANTI JOIN v2 ON v1.stream = v2.stream AND v1.path = v2.path
  UNION ALL SELECT v2.stream, v2.path, 'added_field', NULL, v2.type, false FROM v2 ANTI JOIN v1 ON v1.stream = v2.stream AND v1.path = v2.path
  UNION ALL SELECT v1.stream, v1.path, 'type_change', v1.type, v2.type, true FROM v1 JOIN v2 ON v1.stream = v2.stream AND v1.path = v2.path
    WHERE v1.type <> v2.type
  UNION ALL SELECT v1.stream, v1.path, 'nullable_change', 'nullable=' || CAST(v1.nullable AS VARCHAR), 'nullable=' || CAST(v2.nullable AS VARCHAR),
    v1.nullable AND NOT v2.nullable FROM v1 JOIN v2 ON v1.stream = v2.stream AND v1.path = v2.path WHERE v1.nullable <> v2.nullable)
"""


# ------------------------------------------------------------------- SCH

@query("sch01_infer_fields", """WITH kv AS (SELECT event_type, unnest(json_keys(props)) AS field, props FROM events),
t AS (SELECT event_type, field, CASE json_type(props, '$.' || field) WHEN 'BOOLEAN' THEN 'bool'
        WHEN 'UBIGINT' THEN 'float64' WHEN 'BIGINT' THEN 'float64' WHEN 'DOUBLE' THEN 'float64'
        WHEN 'OBJECT' THEN 'json' WHEN 'ARRAY' THEN 'json' WHEN 'NULL' THEN NULL ELSE 'string' END AS ty FROM kv)
SELECT event_type, field, CASE WHEN min(ty) = max(ty) THEN min(ty) WHEN min(ty) IS NULL THEN 'string' ELSE 'json' END AS type,
  true AS nullable FROM t GROUP BY event_type, field""")
def _sch01(spark, sf):
    return S.infer_fields(load(spark, sf, "events"), "props", "event_type")


@query("sch03_catalog_from_columns", CAT_SQL + """SELECT stream, CAST(count(*) AS INTEGER) AS n_columns,
  string_agg(path, ',' ORDER BY ordinal, path) AS column_names FROM v1 GROUP BY stream""")
def _sch03(spark, sf):
    cat = S.catalog_from_columns(catalog_v1(spark, sf), "stream", "path", "ordinal", "type", "nullable")
    return cat.select("stream", "n_columns", "column_names")


SF_TYPE_OF = ("CASE type WHEN 'string' THEN 'VARCHAR(255)' WHEN 'integer' THEN 'NUMBER' WHEN 'number' THEN 'FLOAT' "
              "WHEN 'boolean' THEN 'BOOLEAN' WHEN 'object' THEN 'VARIANT' ELSE 'ARRAY' END")
BQ_TYPE_OF = ("CASE type WHEN 'string' THEN 'STRING' WHEN 'integer' THEN 'INT64' WHEN 'number' THEN 'NUMERIC' "
              "WHEN 'boolean' THEN 'BOOL' WHEN 'object' THEN 'RECORD' ELSE 'STRING' END")


@query("sch04_source_type_to_json", CAT_SQL + """SELECT stream, path,
  CASE WHEN type = 'object' OR type = 'array' THEN 'object' ELSE type END AS snowflake_json,
  CASE WHEN type = 'array' THEN 'array' ELSE type END AS bigquery_json FROM v1""")
def _sch04(spark, sf):
    v = catalog_v1(spark, sf)
    sft = F.expr(SF_TYPE_OF)
    bqt = F.expr(BQ_TYPE_OF)
    mode = F.when(F.col("type") == "array", F.lit("REPEATED")).otherwise(F.lit("NULLABLE"))
    return v.select("stream", "path", S.json_type_of("snowflake", sft).alias("snowflake_json"),
                    S.json_type_of("bigquery", bqt, mode).alias("bigquery_json"))


@query("sch04_crm_types", CAT_SQL + """SELECT stream, path,
  CASE t WHEN 'int' THEN 'integer' WHEN 'double' THEN 'number' WHEN 'currency' THEN 'number' WHEN 'percent' THEN 'number' WHEN 'boolean' THEN 'boolean' ELSE 'string' END AS salesforce_json,
  CASE h WHEN 'number' THEN 'number' WHEN 'bool' THEN 'boolean' ELSE 'string' END AS hubspot_json
FROM (SELECT stream, path, CASE type WHEN 'integer' THEN 'int' WHEN 'number' THEN ['double', 'currency', 'percent'][1 + ordinal % 3] WHEN 'boolean' THEN 'boolean' ELSE 'picklist' END AS t,
  CASE type WHEN 'integer' THEN 'number' WHEN 'number' THEN 'number' WHEN 'boolean' THEN 'bool' ELSE 'enumeration' END AS h FROM v1)""")
def _sch04b(spark, sf):
    """CRM column types that stand for each field's type."""
    t, number = F.col("type"), F.element_at(F.array(*[F.lit(x) for x in ("double", "currency", "percent")]), (1 + F.col("ordinal") % 3).cast("int"))
    salesforce = F.when(t == "integer", "int").when(t == "number", number).when(t == "boolean", "boolean").otherwise("picklist")
    hubspot = F.when(t.isin("integer", "number"), "number").when(t == "boolean", "bool").otherwise("enumeration")
    return catalog_v1(spark, sf).select("stream", "path", S.json_type_of("salesforce", salesforce).alias("salesforce_json"), S.json_type_of("hubspot", hubspot).alias("hubspot_json"))


def schema_docs(spark, sf):
    """JSON-Schema text per stream built from the v1 field table: a path ``head_tail``
    becomes property ``tail`` of object ``head``; nullable types are ``["T","null"]``."""
    v = catalog_v1(spark, sf).withColumn("head", F.regexp_extract("path", r"^([^_]+)_", 1)) \
        .withColumn("tail", F.regexp_extract("path", r"^[^_]+_(.*)$", 1))
    ttxt = F.when(F.col("nullable"), F.concat(F.lit('["'), F.col("type"), F.lit('","null"]'))).otherwise(
        F.concat(F.lit('"'), F.col("type"), F.lit('"')))
    leaf = F.concat(F.lit('"'), F.col("tail"), F.lit('":{"type":'), ttxt, F.lit("}"))
    heads = v.groupBy("stream", "head").agg(
        F.array_join(F.collect_list(leaf), ",").alias("props"),
        F.array_join(F.collect_list(F.when(F.col("required"), F.concat(F.lit('"'), F.col("tail"), F.lit('"')))), ",").alias("req"))
    obj = F.concat(F.lit('"'), F.col("head"), F.lit('":{"type":"object","properties":{'), F.col("props"),
                   F.lit('},"required":['), F.col("req"), F.lit("]}"))
    return heads.groupBy("stream").agg(F.concat(F.lit('{"type":"object","properties":{'),
                                                F.array_join(F.collect_list(obj), ","), F.lit("}}")).alias("schema"))


DEEP = [f"l{i}" for i in range(10)]  # ten levels of objects with one leaf


def odd_schema_docs(spark, sf):
    """The v1 documents, each with a union, an untyped field, an array of
    objects and a field ten objects deep with a description."""
    deep = '{"type":"integer","description":"a Ring of values"}'
    for name in reversed(DEEP):
        deep = '{"type":"object","properties":{"%s":%s}}' % (name, deep)
    extra = ('"u":{"type":["integer","number","null"]},"x":{"title":"no type"},"list":{"type":"array","items":{"type":"object","properties":{"y":{"type":"integer"}},'
             '"required":["y"]}},"deep":' + deep + ",")
    start = '{"type":"object","properties":{'
    return schema_docs(spark, sf).withColumn("schema", F.concat(F.lit(start + extra), F.expr(f"substring(schema, {len(start) + 1})")))


DEEP_PATH = "deep." + ".".join(DEEP)


@query("sch05_flatten_fields", CAT_SQL + f"""SELECT stream, regexp_replace(path, '_', '.') AS path, CASE WHEN nullable THEN 'string' ELSE type END AS type FROM v1
UNION ALL SELECT stream, p, t FROM (SELECT DISTINCT stream FROM v1), (VALUES ('u', 'string'), ('x', 'string'), ('list', 'array'), ('{DEEP_PATH}', 'integer')) e(p, t)""")
def _sch05(spark, sf):
    return S.flatten_fields(odd_schema_docs(spark, sf), "schema", ["stream"])


_LEVELS = ", ".join(f"('{'.'.join(['deep', *DEEP[:i]])}', '{(['deep', *DEEP])[i]}', {i}, '{'object' if i < 10 else 'integer'}', false, false, '{'' if i < 10 else 'a Ring of values'}')" for i in range(11))
TREE_SQL = CAT_SQL + f""", tree AS (
  SELECT stream, regexp_replace(path, '_', '.') AS path, regexp_extract(path, '^[^_]+_(.*)$', 1) AS name, 1 AS depth, type,
    required, nullable, '' AS description FROM v1
  UNION ALL SELECT DISTINCT stream, regexp_extract(path, '^([^_]+)_', 1), regexp_extract(path, '^([^_]+)_', 1), 0, 'object', false, false, '' FROM v1
  UNION ALL SELECT stream, e.* FROM (SELECT DISTINCT stream FROM v1), (VALUES ('u', 'u', 0, 'integer | number', false, true, ''), ('x', 'x', 0, 'any', false, false, ''),
    ('list', 'list', 0, 'array', false, false, ''), ('list.y', 'y', 1, 'integer', true, false, ''), {_LEVELS}) e(p, n, d, t, r, nl, de))
"""


@query("sch06_field_tree", TREE_SQL + "SELECT * FROM tree")
def _sch06(spark, sf):
    return S.field_tree(odd_schema_docs(spark, sf), "schema", ["stream"])


@query("sch07_field_count", TREE_SQL + "SELECT stream, CAST(count(*) AS BIGINT) AS field_count FROM tree GROUP BY stream")
def _sch07(spark, sf):
    return S.field_count(S.field_tree(odd_schema_docs(spark, sf), "schema", ["stream"]), ["stream"])


def _diff(spark, sf):
    return S.schema_diff(catalog_v1(spark, sf), catalog_v2(spark, sf), ["stream"])


@query("sch08_schema_diff", CAT_SQL + "SELECT * FROM diff")
def _sch08(spark, sf):
    return _diff(spark, sf)


@query("sch09_compatibility", CAT_SQL + """, st AS (SELECT stream FROM v1 UNION SELECT stream FROM v2)
SELECT st.stream, CAST(count(diff.change) AS BIGINT) AS changes, NOT coalesce(bool_or(diff.is_breaking), false) AS is_compatible
FROM st LEFT JOIN diff ON st.stream = diff.stream GROUP BY st.stream""")
def _sch09(spark, sf):
    streams = catalog_v1(spark, sf).select("stream").union(catalog_v2(spark, sf).select("stream"))
    return S.compatibility(_diff(spark, sf), streams, ["stream"])


@query("sch10_nullable_parse", CAT_SQL + "SELECT stream, path, type, nullable FROM v1")
def _sch10(spark, sf):
    v = catalog_v1(spark, sf)
    decl = F.when(F.col("nullable"), F.concat(F.lit('["'), F.col("type"), F.lit('", "null"]'))).otherwise(
        F.concat(F.lit('"'), F.col("type"), F.lit('"')))
    t, n = S.parse_type_decl(decl)
    return v.select("stream", "path", t.alias("type"), n.alias("nullable"))


# the second discovery finds every stream but those whose key is divisible by 11; of those divisible by 7 all
# fields are gone; streams with a key divisible by 5 are new
VERS_SQL = CAT_SQL.rstrip() + """, num AS (SELECT DISTINCT stream, CAST(substr(stream, 7) AS BIGINT) AS k FROM v1 UNION SELECT DISTINCT stream, CAST(substr(stream, 7) AS BIGINT) FROM v2),
h1 AS (SELECT v1.* FROM v1 JOIN num USING (stream) WHERE k % 5 <> 0),
d2 AS (SELECT v2.* FROM v2 JOIN num USING (stream) WHERE k % 11 <> 0 AND k % 7 <> 0),
seen AS (SELECT stream FROM num WHERE k % 11 <> 0),
hd AS (
  SELECT coalesce(a.stream, b.stream) AS stream, coalesce(a.path, b.path) AS path,
    CAST(a.path IS NULL OR b.path IS NULL OR a.type <> b.type AS INT) + CAST(a.path IS NOT NULL AND b.path IS NOT NULL AND a.nullable <> b.nullable AS INT) AS n
  FROM (SELECT * FROM h1 WHERE stream IN (SELECT stream FROM seen)) a FULL OUTER JOIN d2 b ON a.stream = b.stream AND a.path = b.path),
appended AS (
  SELECT s.stream, CASE WHEN h.stream IS NULL THEN 1 ELSE 2 END AS version, CAST(coalesce(f.n, 0) AS BIGINT) AS n_fields,
    CAST(CASE WHEN h.stream IS NULL THEN 0 ELSE d.n END AS BIGINT) AS n_changes
  FROM seen s LEFT JOIN (SELECT DISTINCT stream FROM h1) h ON s.stream = h.stream
  LEFT JOIN (SELECT stream, count(*) AS n FROM d2 GROUP BY 1) f ON s.stream = f.stream
  LEFT JOIN (SELECT stream, sum(n) AS n FROM hd GROUP BY 1) d ON s.stream = d.stream
  WHERE h.stream IS NULL OR coalesce(d.n, 0) > 0),
versions AS (SELECT stream, 1 AS version, CAST(count(*) AS BIGINT) AS n_fields FROM h1 GROUP BY 1 UNION ALL SELECT stream, version, n_fields FROM appended)
"""


def _history(spark, sf):
    """(versions, fields) before the second discovery, what it found and in which streams."""
    v1, v2 = catalogs(spark, sf)
    k = F.substring("stream", 7, 20).cast("bigint")
    held = v1.where(k % 5 != 0)
    streams = v1.select("stream").union(v2.select("stream")).distinct().where(k % 11 != 0)
    versions = held.groupBy("stream").agg(F.lit(1).alias("version"), F.count(F.lit(1)).cast("bigint").alias("n_fields"))
    return versions, held.withColumn("version", F.lit(1)), v2.where((k % 11 != 0) & (k % 7 != 0)), streams


def _versions(spark, sf):
    versions, fields, found, streams = _history(spark, sf)
    new, _, _ = S.append_versions(versions.select("stream", "version"), fields, found, streams, ["stream"])
    return versions.unionByName(new.select("stream", "version", "n_fields"))


@query("sch11_append_versions", VERS_SQL + "SELECT * FROM appended")
def _sch11(spark, sf):
    versions, fields, found, streams = _history(spark, sf)
    return S.append_versions(versions, fields, found, streams, ["stream"])[0]


@query("sch11_stored_rows", VERS_SQL + """SELECT 'fields' AS kind, a.stream, version, CAST(count(*) AS BIGINT) AS rows FROM d2 JOIN appended a USING (stream) GROUP BY ALL
UNION ALL SELECT 'changes', stream, version, n_changes FROM appended WHERE version > 1""")
def _sch11b(spark, sf):
    versions, fields, found, streams = _history(spark, sf)
    _, new_fields, changes = S.append_versions(versions, fields, found, streams, ["stream"])
    count = lambda kind, df: df.groupBy("stream", "version").agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(F.lit(kind).alias("kind"), "stream", "version", "rows")
    return count("fields", new_fields).unionByName(count("changes", changes))


@query("sch12_latest_version", VERS_SQL + "SELECT stream, max(version) AS version, arg_max(n_fields, version) AS n_fields FROM versions GROUP BY stream")
def _sch12(spark, sf):
    return S.latest_version(_versions(spark, sf), ["stream"])


@query("sch12_version_by_number", VERS_SQL + "SELECT * FROM versions WHERE version = 2")
def _sch12b(spark, sf):
    return S.version_at(_versions(spark, sf), ["stream"], 2)


@query("sch12_list_versions", VERS_SQL + "SELECT *, row_number() OVER (PARTITION BY stream ORDER BY version DESC) AS newest FROM versions")
def _sch12c(spark, sf):
    return S.list_versions(_versions(spark, sf), ["stream"])


@query("sch13_stream_upsert", CAT_SQL + """SELECT coalesce(b.stream, a.stream) AS stream, coalesce(b.n_fields, a.n_fields) AS n_fields,
  coalesce(b.discovered, a.discovered) AS discovered FROM
  (SELECT stream, CAST(count(*) AS BIGINT) AS n_fields, 1 AS discovered FROM v1 GROUP BY stream) a FULL OUTER JOIN
  (SELECT stream, CAST(count(*) AS BIGINT) AS n_fields, 2 AS discovered FROM v2 GROUP BY stream) b ON a.stream = b.stream""")
def _sch13(spark, sf):
    cur = catalog_v1(spark, sf).groupBy("stream").agg(F.count(F.lit(1)).cast("bigint").alias("n_fields"), F.lit(1).alias("discovered"))
    new = catalog_v2(spark, sf).groupBy("stream").agg(F.count(F.lit(1)).cast("bigint").alias("n_fields"), F.lit(2).alias("discovered"))
    return W.upsert(cur, new, ["stream"], ["discovered"])


@query("sch14_change_events", CAT_SQL + """SELECT stream, path, CASE change WHEN 'added_field' THEN 'new_column'
  WHEN 'removed_field' THEN 'removed_column' ELSE 'type_change' END AS event FROM diff WHERE change <> 'nullable_change'""")
def _sch14(spark, sf):
    return S.change_events(_diff(spark, sf), ["stream"])


# ------------------------------------------------------------ MAP / SET

@query("map11_type_template", CAT_SQL + """SELECT stream, path, CASE bq WHEN 'STRING' THEN 'VARCHAR' WHEN 'INT64' THEN 'NUMBER'
  WHEN 'FLOAT64' THEN 'FLOAT' WHEN 'BOOL' THEN 'BOOLEAN' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' WHEN 'DATE' THEN 'DATE'
  WHEN 'BYTES' THEN 'BINARY' WHEN 'JSON' THEN 'VARIANT' END AS dest_type,
  CASE bq WHEN 'STRING' THEN 'to_string' WHEN 'INT64' THEN 'to_int' WHEN 'FLOAT64' THEN 'to_float' WHEN 'TIMESTAMP' THEN 'format_date'
  WHEN 'BOOL' THEN '' WHEN 'DATE' THEN '' WHEN 'BYTES' THEN '' WHEN 'JSON' THEN '' END AS type_transform
FROM (SELECT stream, path, CASE type WHEN 'string' THEN 'STRING' WHEN 'integer' THEN 'INT64' WHEN 'number' THEN 'FLOAT64'
  WHEN 'boolean' THEN 'BOOL' WHEN 'object' THEN 'JSON' ELSE 'RECORD' END AS bq FROM v1)""")
def _map11(spark, sf):
    """BigQuery column types of each field (RECORD has no template row) -> Snowflake types."""
    v = catalog_v1(spark, sf)
    bq = (F.when(F.col("type") == "string", "STRING").when(F.col("type") == "integer", "INT64")
          .when(F.col("type") == "number", "FLOAT64").when(F.col("type") == "boolean", "BOOL")
          .when(F.col("type") == "object", "JSON").otherwise("RECORD"))
    t = M.template_table(spark, "bigquery_to_snowflake")
    return M.apply_type_template(v.withColumn("bq", bq), "bq", t).select("stream", "path", "dest_type", "type_transform")


def connections(v):
    """Identity connections for every field of the v1 catalog plus a legacy source for second fields
    (unknown source, duplicate destination)."""
    ident = v.select(F.col("stream").alias("mapping_id"), F.concat(F.col("path"), F.lit("->"), F.col("path")).alias("conn_id"),
                     F.col("ordinal").alias("seq"), F.col("path").alias("source_field"), F.col("path").alias("dest_field"),
                     F.lit("").alias("transform"))
    legacy = v.filter(F.col("ordinal") == 2).select(
        F.col("stream").alias("mapping_id"), F.concat(F.lit("legacy_"), F.col("path"), F.lit("->"), F.col("path")).alias("conn_id"),
        (F.col("ordinal") + 100).alias("seq"), F.concat(F.lit("legacy_"), F.col("path")).alias("source_field"),
        F.col("path").alias("dest_field"), F.lit("").alias("transform"))
    return ident.unionByName(legacy)


CONN_SQL = CAT_SQL + """, conn AS (
  SELECT stream AS mapping_id, path || '->' || path AS conn_id, ordinal AS seq, path AS source_field, path AS dest_field, '' AS transform FROM v1
  UNION ALL SELECT stream, 'legacy_' || path || '->' || path, ordinal + 100, 'legacy_' || path, path, '' FROM v1 WHERE ordinal = 2)
"""


@query("map12_validate_mappings", CONN_SQL + """, cj AS (
  SELECT c.*, s.path AS sp, s.type AS st, d.path AS dp, d.type AS dt,
    row_number() OVER (PARTITION BY c.mapping_id, c.dest_field ORDER BY c.seq) > 1 AS dup
  FROM conn c LEFT JOIN v1 s ON c.mapping_id = s.stream AND c.source_field = s.path
  LEFT JOIN v2 d ON c.mapping_id = d.stream AND c.dest_field = d.path)
SELECT d.stream AS mapping_id, CAST(NULL AS VARCHAR) AS conn_id, d.path AS field, 'required_unmapped' AS kind,
  printf('required destination field "%s" has no mapping', d.path) AS message
FROM v2 d WHERE d.required AND NOT EXISTS (SELECT 1 FROM conn c WHERE c.mapping_id = d.stream AND c.dest_field = d.path)
UNION ALL SELECT mapping_id, conn_id, source_field, 'unknown_source', printf('source field "%s" does not exist', source_field) FROM cj WHERE sp IS NULL
UNION ALL SELECT mapping_id, conn_id, dest_field, 'unknown_dest', printf('destination field "%s" does not exist', dest_field) FROM cj WHERE dp IS NULL
UNION ALL SELECT mapping_id, conn_id, dest_field, 'duplicate_dest', printf('destination field "%s" has multiple source mappings', dest_field) FROM cj WHERE dup
UNION ALL SELECT mapping_id, conn_id, source_field, 'type_mismatch', printf('type mismatch "%s" -> "%s" without transform', st, dt)
  FROM cj WHERE sp IS NOT NULL AND dp IS NOT NULL AND st <> '' AND dt <> '' AND st <> dt AND coalesce(transform, '') = ''""")
def _map12(spark, sf):
    v1, v2 = catalogs(spark, sf)
    src = v1.select(F.col("stream").alias("mapping_id"), "path", "type")
    dst = v2.select(F.col("stream").alias("mapping_id"), "path", "type", "required")
    return M.validate_mappings(src, dst, connections(v1))


@query("map13_unmapped_dest", CONN_SQL + """SELECT stream AS mapping_id, path FROM v2
WHERE NOT EXISTS (SELECT 1 FROM conn c WHERE c.mapping_id = v2.stream AND c.dest_field = v2.path)""")
def _map13(spark, sf):
    v1, v2 = catalogs(spark, sf)
    dst = v2.select(F.col("stream").alias("mapping_id"), "path")
    return M.unmapped_fields(dst, connections(v1), "dest")


@query("map14_connections", CONN_SQL + """SELECT c.mapping_id, c.source_field || '->' || c.dest_field AS conn_id, c.source_field, c.dest_field,
  c.transform, (s.path IS NOT NULL AND d.path IS NOT NULL) AS validated
FROM conn c LEFT JOIN v1 s ON c.mapping_id = s.stream AND c.source_field = s.path
LEFT JOIN v2 d ON c.mapping_id = d.stream AND c.dest_field = d.path""")
def _map14(spark, sf):
    v1, v2 = catalogs(spark, sf)
    maps = connections(v1).select("mapping_id", "source_field", "dest_field", "transform")
    src = v1.select(F.col("stream").alias("mapping_id"), "path")
    dst = v2.select(F.col("stream").alias("mapping_id"), "path")
    return M.connections_from_mappings(maps, src, dst)


@query("fil04_nested_field_search", TREE_SQL + """, hit AS (SELECT stream, path FROM tree WHERE contains(lower(name), 'ring') OR contains(lower(description), 'ring'))
SELECT t.stream, t.path FROM tree t WHERE EXISTS (SELECT 1 FROM hit h WHERE h.stream = t.stream
  AND (h.path = t.path OR starts_with(h.path, t.path || '.')))""")
def _fil04(spark, sf):
    tree = S.field_tree(odd_schema_docs(spark, sf), "schema", ["stream"])
    return M.nested_field_search(tree, "ring", key="stream").select("stream", "path")


@query("set03_field_union", CAT_SQL + "SELECT stream, path FROM v1 UNION SELECT stream, path FROM v2")
def _set03a(spark, sf):
    return R.field_union(catalog_v1(spark, sf), catalog_v2(spark, sf), ["stream", "path"])


@query("set03_field_difference", CAT_SQL + "SELECT stream, path FROM v1 EXCEPT SELECT stream, path FROM v2")
def _set03b(spark, sf):
    return R.field_difference(catalog_v1(spark, sf), catalog_v2(spark, sf), ["stream", "path"])


# ------------------------------------------------------------------ FUZ

NORM_SQL = "lower(regexp_replace({x}, '[_\\-. ]', '', 'g'))"
SIM_SQL = ("CASE WHEN {na} = {nb} THEN 1.0 WHEN {na} = '' OR {nb} = '' THEN 0.0 "
           "ELSE 1.0 - levenshtein({na}, {nb}) / greatest(strlen({na}), strlen({nb})) END")


def _sim_sql(a, b):
    return SIM_SQL.format(na=NORM_SQL.format(x=a), nb=NORM_SQL.format(x=b))


TC_SQL = ("CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = 'string' AND {b} = 'number' THEN 0.3 WHEN {a} = 'number' AND {b} = 'string' THEN 0.5 "
          "WHEN {a} = 'string' AND {b} = 'integer' THEN 0.3 WHEN {a} = 'integer' AND {b} = 'string' THEN 0.5 "
          "WHEN {a} = 'integer' AND {b} = 'number' THEN 0.9 WHEN {a} = 'number' AND {b} = 'integer' THEN 0.7 "
          "WHEN {a} = 'boolean' AND {b} = 'string' THEN 0.4 WHEN {a} = 'string' AND {b} = 'boolean' THEN 0.3 "
          "WHEN {a} = 'boolean' AND {b} = 'integer' THEN 0.3 WHEN {a} = 'integer' AND {b} = 'boolean' THEN 0.3 ELSE 0.0 END")


@query("fuz01_normalize_name", f"SELECT p_partkey, {NORM_SQL.format(x='p_name')} AS normalized FROM part")
def _fuz01(spark, sf):
    return load(spark, sf, "part").select("p_partkey", NM.normalize_name("p_name").alias("normalized"))


@query("fuz02_name_similarity", f"""SELECT c_custkey, n_nationkey, {_sim_sql('c_name', 'n_name')} AS similarity
FROM customer JOIN nation ON n_nationkey IN (c_nationkey, (c_nationkey + 7) % 25)""")
def _fuz02(spark, sf):
    """Every customer against its nation's name and one other's."""
    c = load(spark, sf, "customer").withColumn("n_nationkey", F.explode(F.array("c_nationkey", ((F.col("c_nationkey") + 7) % 25).cast("int"))))
    return c.join(load(spark, sf, "nation"), "n_nationkey").select("c_custkey", "n_nationkey", NM.name_similarity("c_name", "n_name").alias("similarity"))


@query("fuz03_type_compat", CAT_SQL + f"""SELECT v1.stream, v1.path, {TC_SQL.format(a='v1.type', b='v2.type')} AS compat
FROM v1 JOIN v2 ON v1.stream = v2.stream AND v1.path = v2.path""")
def _fuz03(spark, sf):
    a = catalog_v1(spark, sf).select("stream", "path", F.col("type").alias("ta"))
    b = catalog_v2(spark, sf).select("stream", "path", F.col("type").alias("tb"))
    return a.join(b, ["stream", "path"]).select("stream", "path", NM.type_compat("ta", "tb").alias("compat"))


def match_sides(spark, sf):
    """Source fields = v1; destination fields = v1 renamed (upper case, dashes, or kept) with looser types."""
    v = catalog_v1(spark, sf)
    src = v.select("stream", "path", F.col("path").alias("name"), "type")
    m3 = F.col("ordinal") % 3
    dname = F.when(m3 == 0, F.upper("path")).when(m3 == 1, F.regexp_replace("path", "_", "-")).otherwise(F.col("path"))
    dtype = F.when(F.col("ordinal") % 2 == 0, F.lit("string")).otherwise(F.col("type"))
    dst = v.select("stream", dname.alias("path"), dname.alias("name"), dtype.alias("type"))
    return src, dst


SIDES_SQL = CAT_SQL + """, src AS (SELECT stream, path AS name, type FROM v1),
dst AS (SELECT stream, CASE ordinal % 3 WHEN 0 THEN upper(path) WHEN 1 THEN replace(path, '_', '-') ELSE path END AS name,
          CASE WHEN ordinal % 2 = 0 THEN 'string' ELSE type END AS type FROM v1),
pairs AS (SELECT s.stream, s.name AS src_path, d.name AS dst_path, s.type AS src_type, d.type AS dst_type,
    0.7 * (""" + _sim_sql("s.name", "d.name") + ") + 0.3 * (" + TC_SQL.format(a="s.type", b="d.type") + """) AS score
  FROM src s JOIN dst d ON s.stream = d.stream)
"""


def _pairs(spark, sf):
    src, dst = match_sides(spark, sf)
    return MT.score_pairs(src, dst, "stream")


@query("fuz04_score_pairs", SIDES_SQL + """SELECT stream, src_path, dst_path, src_type, dst_type, round(score, 9) AS score
FROM pairs WHERE score >= 0.3""")
def _fuz04(spark, sf):
    src, dst = match_sides(spark, sf)
    return MT.score_pairs(src, dst, "stream").withColumn("score", F.round("score", 9))


GREEDY_SQL = SIDES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (
  SELECT *, row_number() OVER (PARTITION BY stream ORDER BY score DESC, src_path, dst_path) AS k FROM pairs WHERE score >= 0.3),
g AS (
  SELECT stream, src_path, dst_path, src_type, dst_type, score, k, true AS pick, [src_path] AS us, [dst_path] AS ud FROM o WHERE k = 1
  UNION ALL
  SELECT o.stream, o.src_path, o.dst_path, o.src_type, o.dst_type, o.score, o.k,
    NOT list_contains(us, o.src_path) AND NOT list_contains(ud, o.dst_path),
    CASE WHEN NOT list_contains(us, o.src_path) AND NOT list_contains(ud, o.dst_path) THEN list_append(us, o.src_path) ELSE us END,
    CASE WHEN NOT list_contains(us, o.src_path) AND NOT list_contains(ud, o.dst_path) THEN list_append(ud, o.dst_path) ELSE ud END
  FROM g JOIN o ON o.stream = g.stream AND o.k = g.k + 1),
picked AS (SELECT stream, src_path, dst_path, src_type, dst_type, round(score, 2) AS confidence FROM g WHERE pick)
"""


@query("fuz05_assign_greedy", GREEDY_SQL + """SELECT stream, src_path, dst_path, confidence,
  CASE WHEN src_type <> dst_type AND src_type <> '' AND dst_type <> '' THEN
    CASE WHEN dst_type = 'string' THEN 'to_string' WHEN dst_type IN ('integer', 'number') AND src_type = 'string' THEN 'to_float'
         WHEN dst_type = 'integer' THEN 'to_int' WHEN dst_type = 'number' THEN 'to_float' WHEN dst_type = 'boolean' THEN 'to_bool' END
  END AS transform FROM picked""")
def _fuz05(spark, sf):
    return MT.assign_greedy(_pairs(spark, sf)).select("stream", "src_path", "dst_path", "confidence", "transform")


NULL_PATHS_SQL = """WITH RECURSIVE pairs AS (
  SELECT a.l_orderkey AS stream, CASE WHEN a.l_linenumber = 1 THEN '' ELSE 's' || a.l_linenumber END AS src_path, CASE WHEN b.l_linenumber = 2 THEN '' ELSE 'd' || b.l_linenumber END AS dst_path,
    'string' AS src_type, 'integer' AS dst_type, ((a.l_partkey * 7 + b.l_suppkey) % 10) / 10.0 AS score
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey), o AS (""" + GREEDY_SQL.split(", o AS (", 1)[1]


@query("fuz05_null_paths", NULL_PATHS_SQL + "SELECT stream, nullif(src_path, '') AS src_path, nullif(dst_path, '') AS dst_path, confidence FROM picked")
def _fuz05b(spark, sf):
    """Fields without a path are fields like others; the lines of an order are its source and destination fields."""
    li = load(spark, sf, "lineitem")
    side = lambda p, none, by: li.select(F.col("l_orderkey").alias("stream"), F.when(F.col("l_linenumber") != none, F.concat(F.lit(p[0]), "l_linenumber")).alias(f"{p}_path"), F.col(by).alias(f"_{p}"))
    pairs = side("src", 1, "l_partkey").join(side("dst", 2, "l_suppkey"), "stream")
    score = ((F.col("_src") * 7 + F.col("_dst")) % 10) / 10.0
    pairs = pairs.select("stream", "src_path", "dst_path", F.lit("string").alias("src_type"), F.lit("integer").alias("dst_type"), score.alias("score")).where("score >= 0.3")
    return MT.assign_greedy(pairs).select("stream", "src_path", "dst_path", "confidence")


@query("fuz06_suggest_transform", SIDES_SQL + """SELECT stream, src_path, dst_path,
  CASE WHEN src_type <> dst_type AND src_type <> '' AND dst_type <> '' THEN
    CASE WHEN dst_type = 'string' THEN 'to_string' WHEN dst_type IN ('integer', 'number') AND src_type = 'string' THEN 'to_float'
         WHEN dst_type = 'integer' THEN 'to_int' WHEN dst_type = 'number' THEN 'to_float' WHEN dst_type = 'boolean' THEN 'to_bool' END
  END AS transform FROM pairs WHERE score >= 0.3""")
def _fuz06(spark, sf):
    return _pairs(spark, sf).select("stream", "src_path", "dst_path", NM.suggested_transform("src_type", "dst_type").alias("transform"))


@query("fuz07_best_dest_stream", f"""SELECT s_suppkey, arg_max(n_name, (sim, -n_nationkey)) AS best_stream, max(sim) AS best_score FROM (
  SELECT s_suppkey, n_name, n_nationkey, {_sim_sql('s_name', 'n_name')} AS sim FROM supplier, nation)
GROUP BY s_suppkey HAVING max(sim) > 0""")
def _fuz07(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", "s_name")
    out = MT.best_dest_stream(s, "s_name", load(spark, sf, "nation"), "n_name", "n_nationkey", block=10)
    return out.filter(F.col("best_stream").isNotNull()).select("s_suppkey", "best_stream", "best_score")


@query("fuz08_mean_pair_score", SIDES_SQL + """SELECT stream, round(avg(score), 9) AS mean_score, CAST(count(*) AS BIGINT) AS pairs
FROM pairs WHERE score >= 0.3 GROUP BY stream""")
def _fuz08(spark, sf):
    return _pairs(spark, sf).groupBy("stream").agg(F.round(F.avg("score"), 9).alias("mean_score"),
                                                   F.count(F.lit(1)).cast("bigint").alias("pairs"))


@query("fuz08_overall_confidence", GREEDY_SQL + """SELECT stream, round(avg(confidence), 9) AS overall_confidence, CAST(count(*) AS BIGINT) AS mappings
FROM picked GROUP BY stream""")
def _fuz08b(spark, sf):
    out = MT.overall_confidence(MT.assign_greedy(_pairs(spark, sf)), "stream")
    return out.withColumn("overall_confidence", F.round("overall_confidence", 9))


FN_SQL = "trim(lower(replace(replace({x}, '-', ''), '_', '')))"


@query("fuz09_three_pass", SIDES_SQL + f""", p1 AS (
  SELECT s.stream, s.name AS source_field, d.name AS dest_field, CASE WHEN s.type = d.type THEN 1.0 ELSE 0.9 END AS confidence,
    CASE WHEN s.type = d.type THEN 'exact name and type match' ELSE 'exact name match' END AS reason
  FROM src s JOIN dst d ON s.stream = d.stream AND s.name = d.name),
s1 AS (SELECT * FROM src s WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.stream = s.stream AND p1.source_field = s.name)),
d1 AS (SELECT * FROM dst d WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.stream = d.stream AND p1.dest_field = d.name)),
s1r AS (SELECT *, {FN_SQL.format(x='name')} AS g, row_number() OVER (PARTITION BY stream, {FN_SQL.format(x='name')} ORDER BY name) AS r FROM s1),
d1r AS (SELECT *, {FN_SQL.format(x='name')} AS g, row_number() OVER (PARTITION BY stream, {FN_SQL.format(x='name')} ORDER BY name) AS r FROM d1),
p2 AS (SELECT s.stream, s.name AS source_field, d.name AS dest_field, CASE WHEN s.type = d.type THEN 0.8 ELSE 0.7 END AS confidence,
    CASE WHEN s.type = d.type THEN 'normalized name and type match' ELSE 'normalized name match' END AS reason
  FROM s1r s JOIN d1r d ON s.stream = d.stream AND s.g = d.g AND s.r = d.r),
s2 AS (SELECT * FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.stream = s.stream AND p2.source_field = s.name)),
d2 AS (SELECT * FROM d1 d WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.stream = d.stream AND p2.dest_field = d.name)),
s2r AS (SELECT *, row_number() OVER (PARTITION BY stream, type ORDER BY name) AS r FROM s2 WHERE type <> ''),
d2r AS (SELECT *, row_number() OVER (PARTITION BY stream, type ORDER BY name) AS r FROM d2 WHERE type <> ''),
p3 AS (SELECT s.stream, s.name AS source_field, d.name AS dest_field, 0.3 AS confidence, 'type match only' AS reason
  FROM s2r s JOIN d2r d ON s.stream = d.stream AND s.type = d.type AND s.r = d.r)
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""")
def _fuz09(spark, sf):
    src, dst = match_sides(spark, sf)
    return MT.match_three_pass(src.drop("path"), dst.drop("path"), "stream")


NULL_KEYS_SQL = """WITH f AS (SELECT DISTINCT nullif(o_orderpriority, '1-URGENT') AS namespace, o_custkey AS c, 'field ' || o_custkey AS path FROM orders),
old AS (SELECT namespace, path, 'string' AS type FROM f WHERE c % 7 <> 1), new AS (SELECT namespace, path, CASE WHEN c % 5 = 0 THEN 'integer' ELSE 'string' END AS type FROM f WHERE c % 7 <> 2),
diff AS (SELECT coalesce(o.namespace, n.namespace) AS namespace, coalesce(o.path, n.path) AS path,
    CASE WHEN n.path IS NULL THEN 'removed_field' WHEN o.path IS NULL THEN 'added_field' ELSE 'type_change' END AS change
  FROM old o FULL JOIN new n ON o.namespace IS NOT DISTINCT FROM n.namespace AND o.path = n.path WHERE o.type IS DISTINCT FROM n.type)
"""


def _null_key_fields(spark, sf):
    """Two field tables keyed by a namespace that is null for one order priority."""
    o = load(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("namespace"), F.col("o_custkey").alias("c")).distinct()
    f = o.withColumns({"path": F.concat(F.lit("field "), "c"), "nullable": F.lit(False)})
    old = f.where("c % 7 <> 1").select("namespace", "path", F.lit("string").alias("type"), "nullable")
    new = f.where("c % 7 <> 2").select("namespace", "path", F.when(F.col("c") % 5 == 0, "integer").otherwise("string").alias("type"), "nullable")
    return old, new


@query("sch08_null_keys", NULL_KEYS_SQL + "SELECT namespace, path, change FROM diff")
def _sch08_null(spark, sf):
    return S.schema_diff(*_null_key_fields(spark, sf), ["namespace"]).select("namespace", "path", "change")


@query("sch11_null_keys", NULL_KEYS_SQL + """SELECT coalesce(namespace, 'none') AS namespace, CAST(2 AS INTEGER) AS version, count(*)::BIGINT AS n_changes FROM diff GROUP BY namespace""")
def _sch11_null(spark, sf):
    """A second discovery of every namespace, the null one included, appends version 2; a third one nothing."""
    old, new = _null_key_fields(spark, sf)
    streams = new.select("namespace").distinct()
    empty = old.limit(0).withColumn("version", F.lit(1))
    first, rows, _ = S.append_versions(empty.select("namespace", "version"), empty, old, streams, ["namespace"])
    versions, fields = first.select("namespace", "version"), rows.select("namespace", "path", "type", "nullable", "version")
    second, more, _ = S.append_versions(versions, fields, new, streams, ["namespace"])
    third, _, _ = S.append_versions(versions.unionByName(second.select("namespace", "version")), fields.unionByName(more.select(*fields.columns)), new, streams, ["namespace"])
    return second.unionByName(third).select(F.coalesce("namespace", F.lit("none")).alias("namespace"), F.col("version").cast("int").alias("version"), "n_changes")
