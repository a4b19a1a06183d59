"""Structures and their differences on small documents, and properties that hold for any."""

import json
import random

import pytest

from keelson.functions.text import shown_path
from keelson.operators import structure


def drift(spark, old, new):
    frame = lambda x: structure.structures(spark.createDataFrame([(json.dumps(x),)], "json string"), [])
    found = structure.compare(frame(old), frame(new))
    return sorted((r.p, r.kind, r.old_type, r.new_type) for r in found.withColumn("p", shown_path(found.path)).collect())


@pytest.mark.parametrize(
    "old, new, want",
    [
        ({"a": 1}, {"a": 1.5}, []),
        ({"a": 1}, {"a": "1", "b": None}, [("a", "type_changed", "number", "string"), ("b", "added", None, "null")]),
        ({"a": {"b": 1}}, {"a": None}, [("a", "type_changed", "object", "null"), ("a.b", "absent", "number", None)]),
        ({"a": []}, {"a": [{"b": 1}]}, []),
        ({"a": [[], [1]]}, {"a": [["x"]]}, [("a[][]", "type_changed", "number", "string")]),
        ([{"a": 1}, {"b": True}], [{"a": 1}], [("[].b", "absent", "boolean", None)]),
        ({"a": [1, "x"]}, {"a": [1]}, [("a[]", "type_changed", "number|string", "number")]),
    ],
)
def test_small_documents(spark, old, new, want):
    assert drift(spark, old, new) == want


def test_rejections(spark):
    bad = ["3", "", None, '{"a":1,"a":2}', '{"[]":1}', "{", '{"a":NaN}', "[" * 100_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "id int, json string")
    codes = {r.id: r.rejection for r in structure.with_structure(docs).collect()}
    assert [codes[i] for i in range(8)] == [
        "scalar_root", "invalid_json", "invalid_json", "duplicate_key", "reserved_key", "invalid_json", "not_a_number", "too_deep",
    ]
    assert structure.structures(docs, []).count() == 0


def some(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 4:
        return [None, True, rng.random(), "x"][kind]
    if kind == 4:
        return [some(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice("abc"): some(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_properties(spark):
    rng = random.Random(4)
    pairs = [({"r": some(rng)}, {"r": some(rng)}) for _ in range(40)]
    frame = lambda k: structure.structures(
        spark.createDataFrame([(i, json.dumps(p[k])) for i, p in enumerate(pairs)], "id int, json string"), ["id"]
    )
    old, new = frame(0), frame(1)
    there = {(r.id, tuple(r.path), r.kind) for r in structure.compare(old, new, ["id"]).collect()}
    back = {(r.id, tuple(r.path), r.kind) for r in structure.compare(new, old, ["id"]).collect()}
    swap = {"added": "absent", "absent": "added", "type_changed": "type_changed"}
    assert there and back == {(i, p, swap[k]) for i, p, k in there}
    assert structure.compare(old, old, ["id"]).count() == 0
