"""Array files cut into elements by blocks, against the whole file at once."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidepool.sources import files as FL
from tidepool.sources.json_arrays import array_elements


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind <= 1:
        return rng.choice([0, -1.5, 1e300, 12345678901234])
    if kind == 2:
        return rng.choice([True, None])
    if kind <= 4:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "a", "é", "\n", " ", "😀", ":"]) for _ in range(rng.randint(0, 12)))
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", 'q"', "x,y", "\\", "[", "ä"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}", "w", newline="") as f:
            f.write(text)


def loaded(text):
    try:
        found = json.loads(text)
    except ValueError:
        return []
    return found if isinstance(found, list) else []


BAD = {"open": "[1, 2", "tail": "[1] x", "two": "[1][2]", "comma": "[1,]", "lead": "[,1]", "both": "[1,,2]", "object": '{"a": 1}', "brace": "[1}", "quote": '["a]', "deep": "[[1, 2]", "below": "]1[", "word": "[1, nope]", "text": "hello", "empty": "", "blank": "  \n", "after": "[1]]", "mixed": '[{"a": 1, 2}]', "stray": '[1, "a" "b"]'}
GOOD = {"none": "[]", "spaced": " [\n ] \n", "one": "[{}]", "strings": '["a,b", "]", "[", "\\"", "\\\\", "\\\\\\",", ""]', "nested": '[[1, [2, {"a": [3, 4]}]], {"b": ",]}"}, null]', "numbers": "[1,2,3]"}


@pytest.mark.parametrize("block,split", [(1, 700), (40, 4096), (1 << 18, 1 << 20)])
def test_elements_of_any_block_and_split(spark, tmpdir_path, block, split):
    rng = random.Random(block)
    files = {f"{n}.json": t for n, t in (BAD | GOOD).items()}
    for i in range(12):
        rows = [value(rng) for _ in range(rng.randint(0, 40))]
        files[f"r{i}.json"] = json.dumps(rows, ensure_ascii=bool(i % 2), indent=rng.choice([None, None, 2]))
    write(tmpdir_path + "/in", files)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = array_elements(lambda **o: spark.read.options(**o).text(tmpdir_path + "/in"), block).select(F.regexp_extract("_source_file", r"([^/]+)$", 1).alias("f"), F.to_json("_v").alias("v"), "_source_modified").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    found = {}
    for r in got:
        assert r["_source_modified"] is not None
        found.setdefault(r["f"], []).append(json.dumps(json.loads(r["v"]), sort_keys=True))
    want = {name: sorted(json.dumps(json.loads(json.dumps(e)), sort_keys=True) for e in loaded(text)) for name, text in files.items()}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}


def test_a_file_of_one_long_line_equals_its_lines(spark, tmpdir_path):
    """One line of some MB in one file: read by many tasks, none of which holds it."""
    rows = [{"id": i, "t": "x,]\\\"" * (i % 7), "n": {"k": [i, i + 1]}} for i in range(30_000)]
    write(tmpdir_path + "/a", {"all.json": json.dumps(rows)})
    write(tmpdir_path + "/l", {"all.json": "\n".join(map(json.dumps, rows))})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        schema = "id long, t string, n struct<k: array<long>>"
        array = FL.read_json(spark, tmpdir_path + "/a", layout="array", schema=schema)
        assert spark.read.option("lineSep", ",").text(tmpdir_path + "/a").rdd.getNumPartitions() > 5
        lines = FL.read_json(spark, tmpdir_path + "/l", layout="lines", schema=schema)
        same = ["id", "t", "n"]
        assert array.count() == 30_000 and array.select(same).exceptAll(lines.select(same)).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_auto_layout_by_file(spark, tmpdir_path):
    write(tmpdir_path + "/x", {"a.json": '\n [{"a": 1},\n {"a": 2}]', "b.json": '{"a": 3}\n{"a": "no"}\nnot json\n', "c.json": '[{"a": 9}', "d.json": "", "e.json": '{"a": 5, "b": [1,2]}'})
    out = FL.read_json(spark, tmpdir_path + "/x", layout="auto", schema="a long")
    assert sorted(((r.a, r._source_file.split("/")[-1]) for r in out.collect()), key=str) == sorted([(1, "a.json"), (2, "a.json"), (3, "b.json"), (None, "b.json"), (5, "e.json")], key=str)
