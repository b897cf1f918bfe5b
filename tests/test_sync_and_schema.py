import json

import pytest

from tidepool.model import FieldMapping, StreamConfig, SyncConfig
from tidepool.operators import schema as S
from tidepool.operators import writes as W
from tidepool.plans.sync import execute_sync, read_runs, read_table
from tidepool.sources import files as FL


def deep(levels):
    node = {"type": "integer", "description": "the end"}
    for i in range(levels):
        node = {"type": "object", "properties": {f"n{i}": node}}
    return node


def test_schemas_of_any_depth(spark):
    doc = {"type": "object", "properties": {"a": deep(40), "u": {"type": ["string", "null"]}, "x": {}, "bad": 3, "list": {"type": "array", "items": {"type": "object", "properties": {"y": {"type": "number"}}}}, "empty": {"type": "object"}}}
    df = spark.createDataFrame([("s", json.dumps(doc)), ("none", None), ("text", "no json"), ("list", "[1]")], "stream string, doc string")
    path = "a." + ".".join(f"n{i}" for i in reversed(range(40)))
    leaves = {(r.stream, r.path): r.type for r in S.flatten_fields(df, "doc", ["stream"]).collect()}
    assert leaves == {("s", path): "integer", ("s", "u"): "string", ("s", "x"): "string", ("s", "bad"): "string", ("s", "list"): "array", ("s", "empty"): "object"}
    tree = {r.path: r for r in S.field_tree(df, "doc", ["stream"]).collect()}
    assert len(tree) == 41 + 6 and tree[path].depth == 40 and tree[path].description == "the end"
    assert tree["u"].nullable and tree["u"].type == "string" and tree["x"].type == "any" and tree["list.y"].type == "number"


def test_documents_are_walked_without_python(spark):
    """Odd documents against a plain walk; the plan holds no Python."""
    import random

    rng = random.Random(2)

    def node(depth):
        out = {}
        kind = rng.choice(["object", "array", "string", "integer", ["string", "null"], ["null", "object", "integer"], None])
        if kind is not None or rng.random() < 0.5:
            out["type"] = kind
        if depth < 9 and rng.random() < 0.75:
            below = {"properties": {n: node(depth + 1) for n in rng.sample(["a", "b", "c.d", "x y"], rng.randint(0, 2))}, "required": rng.choice([["a"], [], ["b", 3, None], "a"])}
            out |= {"items": {"type": "object", **below}} if kind == "array" else below
        if rng.random() < 0.3:
            out |= {"nullable": rng.choice([True, False, "true", 1]), "description": rng.choice(["text", "", None])}
        return rng.choice([out] * 12 + [3, None, "text", []])

    docs = [{"type": "object", "properties": {n: node(0) for n in "pqr"}, "required": ["p"]} for _ in range(40)] + [{}, {"properties": 3}, {"type": "array", "items": {"properties": {"i": {"type": "integer"}}}}]
    deepest = {"properties": {"l0": {"type": "object"}}}
    for i in range(1, 13):
        deepest = {"properties": {f"l{i}": {"type": "object", **deepest}}}
    docs.append(deepest)

    def below(n):
        props = n.get("properties")
        if not (isinstance(props, dict) and props) and n.get("type") == "array" and isinstance(n.get("items"), dict):
            n = n["items"]
            props = n.get("properties")
        needed = n.get("required")
        return (props if isinstance(props, dict) else {}), (needed if isinstance(needed, list) else [])

    def tree(n, prefix="", depth=0):
        props, needed = below(n)
        for name, sub in props.items():
            sub = sub if isinstance(sub, dict) else {}
            t = sub.get("type")
            kinds = [k for k in t if k != "null"] if isinstance(t, list) else None
            yield prefix + name, name, depth, " | ".join(kinds) if kinds is not None else t or "any", name in needed, isinstance(t, list) and "null" in t or sub.get("nullable") is True, sub.get("description") or ""
            yield from tree(sub, f"{prefix}{name}.", depth + 1)

    def leaves(n, prefix=""):
        for name, sub in (n.get("properties") if isinstance(n.get("properties"), dict) else {}).items():
            sub = sub if isinstance(sub, dict) else {}
            t = sub.get("type") if isinstance(sub.get("type"), str) else "string"
            if t == "object" and isinstance(sub.get("properties"), dict) and sub["properties"]:
                yield from leaves(sub, f"{prefix}{name}.")
            else:
                yield prefix + name, t

    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "[1]"), (901, None), (902, "{")], "i int, doc string").repartition(3)
    found = S.field_tree(df, "doc", ["i"])
    assert sorted(map(tuple, found.collect())) == sorted((i, *r) for i, d in enumerate(docs) for r in tree(d))
    assert sorted(map(tuple, S.flatten_fields(df, "doc", ["i"]).collect())) == sorted((i, *r) for i, d in enumerate(docs) for r in leaves(d))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and max(r.depth for r in found.collect()) >= 12


def test_emptied_and_undiscovered_streams(spark):
    fields = spark.createDataFrame([("a", 1, "x", "int", False), ("b", 1, "x", "int", False), ("c", 1, "x", "int", False)], "stream string, version int, path string, type string, nullable boolean")
    versions = fields.select("stream", "version")
    found = spark.createDataFrame([("c", "x", "int", False), ("d", "y", "int", True)], "stream string, path string, type string, nullable boolean")
    streams = spark.createDataFrame([("a",), ("c",), ("d",), ("e",)], "stream string")
    new, rows, changes = S.append_versions(versions, fields, found, streams, ["stream"])
    assert sorted(tuple(r) for r in new.collect()) == [("a", 2, 0, 1), ("d", 1, 1, 0), ("e", 1, 0, 0)]
    assert [r.path for r in rows.collect()] == ["y"] and [(r.stream, r.change) for r in changes.collect()] == [("a", "removed_field")]


def sync(mode, sync_mode="incremental", keys=("id",), maps=(("id", "id"), ("v", "v"), ("ts", "ts"))):
    return SyncConfig("s", StreamConfig("t", list(keys), "ts", sync_mode, mode, [FieldMapping(*m) for m in maps]), dedup_order_by=["ts"])


def test_sync_goes_on_from_its_checkpoint(spark, tmpdir_path):
    rows = lambda r: spark.createDataFrame(r, "id long, v string, ts long")
    home = tmpdir_path + "/home"
    execute_sync(rows([(1, "a", 1), (2, "b", 2)]), sync("upsert"), home)
    execute_sync(rows([(1, "a", 1), (2, "b", 2), (2, "c", 3)]), sync("upsert"), home)
    execute_sync(rows([(1, "old", 2)]), sync("upsert"), home)
    assert sorted((r.id, r.v) for r in read_table(spark, home).collect()) == [(1, "a"), (2, "c")]
    runs = sorted(tuple(r) for r in read_runs(spark, home).select("run", "status", "records_extracted", "records_loaded", "checkpoint").collect())
    assert runs == [(1, "completed", 2, 2, "2"), (2, "completed", 1, 1, "3"), (3, "completed", 0, 0, "3")]


def test_sync_refuses_soft_delete_of_partial_reads_and_unknown_modes(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a", 1)], "id long, v string, ts long")
    with pytest.raises(ValueError, match="full snapshot"):
        execute_sync(df, sync("soft_delete"), tmpdir_path + "/a")
    with pytest.raises(ValueError, match="unknown destination mode"):
        execute_sync(df, sync("replace"), tmpdir_path + "/b")
    with pytest.raises(ValueError, match="primary key"):
        execute_sync(df, sync("upsert", keys=()), tmpdir_path + "/c")


def test_null_streams_and_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (2, None)], "id long, stream string")
    routes = W.route_writes(df, "id", "stream", ["a"])
    assert {k: v.count() for k, v in routes.items()} == {"create": 1, "update": 1, "rejected": 1}
    keyed = spark.createDataFrame([(None, 1), (1, 1)], "k long, v int")
    assert W.soft_delete(keyed, keyed, ["k"], None).where("_deleted").count() == 0
    assert [r.confirmed for r in W.reconcile(keyed, keyed, "k").collect()] == [True, True]


def test_csv_and_json_corner_cases(spark, tmpdir_path):
    import os

    os.makedirs(tmpdir_path + "/c")
    with open(tmpdir_path + "/c/x.csv", "w") as f:
        f.write('a| b \n1|"say ""hi"" | now"\n2|"two\nlines"|3|4\n5\n')
    got = [tuple(r) for r in FL.read_csv(spark, tmpdir_path + "/c", "|").collect()]
    assert got == [("1", 'say "hi" | now', None, None), ("2", "two\nlines", "3", "4"), ("5", None, None, None)]
    assert FL.read_csv(spark, tmpdir_path + "/c", "|").columns == ["a", "b", "_col2", "_col3"]
    os.makedirs(tmpdir_path + "/j")
    with open(tmpdir_path + "/j/x.jsonl", "w") as f:
        f.write('{"a": 1}\n{"a": "x", "b": 2}\n\nnot json\n{"a": 3} x\n[1]\n[{"a": 4}, 5]\n')
    out = FL.read_json(spark, tmpdir_path + "/j", layout="auto", schema="a long, b long")
    assert sorted(((r.a, r.b) for r in out.collect()), key=str) == sorted([(1, None), (None, 2), (4, None)], key=str)


def test_levels_of_a_document_are_read_once(spark):
    """A job of the walk reads its input once, however many levels it walks."""
    from tidepool.operators.schema import field_tree

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    doc = '{"properties":{"a":{"properties":{"b":{"properties":{"c":{"type":"integer"}}}}}}}'
    docs = spark.range(7).selectExpr("id", f"'{doc}' AS doc").mapInArrow(count, "id long, doc string")
    assert field_tree(docs, "doc", ["id"]).count() == 21 and seen.value == 7


def test_catalogs_are_worked_out_once(spark):
    """Queries that read a field table in several places read it as written, not the line items again."""
    import __spark_entry__ as entry

    from .conftest import SF0001

    for name in ("sch11_append_versions", "sch11_stored_rows", "sch12_list_versions"):
        assert not [f for f in entry.queries()[name](spark, SF0001).inputFiles() if "lineitem" in f], name
