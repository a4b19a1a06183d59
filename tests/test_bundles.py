"""Bundles, canonical forms, fingerprints and labelled cases in folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from keelson.sources import bundles

MEMBERS = "package string, path string, is_root boolean, content string"
ROOT = '{"openapi": "3.0.3", "servers": [{"url": "/"}], "paths": {}}'


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_put_once_and_read_back(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = [("p", "a/root.json", True, ROOT), ("p", "b.json", False, "{}"), ("q", "a/root.json", True, ROOT), ("q", "b.json", False, "{}"), ("r", "x", True, "é")]
    members, normalized = spark.createDataFrame(rows, MEMBERS), spark.createDataFrame([(p, "N", "1") for p in "pqr"], "package string, normalized string, version string")
    stored = {r.package: (r.fingerprint, r.new) for r in bundles.put(members, normalized, folder).collect()}
    assert stored["p"] == stored["q"] != stored["r"] and all(new for _, new in stored.values())
    manifest = {
        "documents": [{"path": p, "sha256": sha(c), "size": len(c)} for p, c in (("a/root.json", ROOT), ("b.json", "{}"))], "entry_point": "a/root.json", "format": 1,
        "normalization_version": "1", "normalized": {"sha256": sha("N"), "size": 1},
    }
    assert stored["p"][0] == sha(json.dumps(manifest, sort_keys=True, separators=(",", ":")))
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*") if f.is_file()}
    assert not any(r.new for r in bundles.put(members, normalized, folder).collect())
    assert {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*") if f.is_file()} == before
    found, problems = bundles.verified(bundles.files_in(spark, folder))
    assert problems.count() == 0
    assert {(r.bundle, r.path, r.is_root, bytes(r.content).decode()) for r in found.collect()} == {(stored[p][0], path, root, c) for p, path, root, c in rows if p != "q"}


def changed(manifest, **more):
    return json.dumps(json.loads(manifest) | more, sort_keys=True, separators=(",", ":"))


@pytest.mark.parametrize(
    "change, problem",
    [
        ({"format": 2}, "unsupported_format"), ({"documents": []}, "invalid_manifest"), ({"entry_point": "no"}, "invalid_manifest"), ({"normalization_version": None}, "invalid_manifest"), ({"normalized": {"sha256": "x"}}, "invalid_manifest"),
        ({"documents": [{"path": "../up", "sha256": sha(ROOT), "size": 1}], "entry_point": "../up"}, "invalid_manifest"), ({"documents": [{"path": "a", "sha256": "no"}], "entry_point": "a"}, "invalid_manifest"),
        ({"documents": [{"path": "a", "sha256": sha("x")}] * 2, "entry_point": "a"}, "invalid_manifest"), ({"documents": [{"path": "a", "sha256": sha("other")}], "entry_point": "a"}, "corrupted_file"),
        ({"documents": [{"path": "b", "sha256": sha(ROOT)}], "entry_point": "b"}, "missing_file"), ("not json", "unsupported_format"), ("[]", "unsupported_format"),
    ],
)
def test_damage_is_told(spark, change, problem):
    plain = json.dumps({"documents": [{"path": "a", "sha256": sha(ROOT), "size": len(ROOT)}], "entry_point": "a", "format": 1, "normalization_version": "1", "normalized": {"sha256": sha("N"), "size": 1}})
    manifest = change if isinstance(change, str) else changed(plain, **change)
    rows = [(sha(manifest), "manifest.json", manifest), (sha(manifest), "original/a", ROOT), (sha(manifest), "normalized", "N"), ("0" * 64, "original/a", ROOT), ("1" * 64, "manifest.json", plain)]
    files = spark.createDataFrame(rows, "bundle string, name string, content string").withColumn("content", F.col("content").cast("binary"))
    found = {r.bundle: r.problem for r in bundles.verified(files)[1].collect()}
    assert found == {sha(manifest): problem, "0" * 64: "missing_manifest", "1" * 64: "corrupted_manifest"}


def test_unsafe_paths_are_refused_before_writing(spark, tmp_path):
    members = spark.createDataFrame([("p", "../x", True, "{}")], MEMBERS)
    with pytest.raises(ValueError):
        bundles.put(members, spark.createDataFrame([("p", "N", "1")], "package string, normalized string, version string"), str(tmp_path / "s"))
    assert not list(tmp_path.rglob("manifest.json"))


def test_fingerprints_ignore_layout_servers_and_order(spark):
    again = "servers:\n- url: /\npaths: {}\nopenapi: 3.0.3\n"
    rows = [("a", "r", True, ROOT), ("a", "x", False, "{}"), ("a", "y", False, "[1]"), ("b", "q", True, again), ("b", "y", False, "[ 1 ]"), ("b", "x", False, "{ }"), ("c", "r", True, ROOT.replace('[{"url": "/"}]', "[]")), ("c", "x", False, "{}"), ("c", "y", False, "[1]"),
            ("d", "r", True, ROOT), ("d", "x", False, "{}"), ("d", "x2", False, "{}"), ("d", "y", False, "[1]"), ("e", "r", True, "{ no"), ("f", "r", True, ROOT.replace('"paths": {}', '"paths": {"/1": true}'))]
    found = {r.package: (r.fingerprint, r.loose_fingerprint, r.has_servers) for r in bundles.package_fingerprints(spark.createDataFrame(rows, MEMBERS)).collect()}
    assert found["a"] == found["b"] and found["a"][0] != found["c"][0] and found["a"][1] == found["c"][1] and (found["a"][2], found["c"][2]) == (True, False)
    assert found["d"][0] != found["a"][0] and found["f"][1] != found["a"][1]
    assert found["e"][0] == found["e"][1] == hashlib.sha256(bytes.fromhex(sha("{ no"))).hexdigest()


def test_canonical_forms(spark):
    large = json.dumps({"k": "x" * (4 << 20)})
    rows = [r.f for r in spark.createDataFrame([('{"b": 1.0, "a": "é", "c": [true, null, 1e3]}',), (large,), ("{",)], "t string").select(bundles.canonical_forms(F.col("t")).alias("f")).collect()]
    assert (rows[0].normalized, rows[0].identity, rows[0].record) == ('{"a":"é","b":1.0,"c":[true,null,1000.0]}', '{"a":"\\u00e9","b":1.0,"c":[true,null,1000.0]}', '{"a": "é", "b": 1.0, "c": [true, null, 1000.0]}')
    assert rows[1].record is None and rows[1].normalized is not None and rows[2].rejection == "not_json_or_yaml" and rows[2].identity is None


def test_labelled_cases_of_a_folder(spark, tmp_path):
    for name, meta in (("one", None), ("two", '{"rationale": "r"}')):
        folder = tmp_path / "cases" / name
        folder.mkdir(parents=True)
        (folder / "before.json").write_text('{"n": 1}')
        (folder / "after.json").write_text('{"n": 2}')
        (folder / "expected.json").write_text(json.dumps({"findings": [{"rule_id": "x", "category": "c", "parameter": name}], "limitations": []}))
        if meta:
            (folder / "meta.json").write_text(meta)
    cases = bundles.cases_in(spark, str(tmp_path / "cases"))
    assert {(r.name, r.before, r.after, r.meta) for r in cases.collect()} == {("one", '{"n": 1}', '{"n": 2}', None), ("two", '{"n": 1}', '{"n": 2}', '{"rationale": "r"}')}
    assert {tuple(r) for r in bundles.expected_findings(cases).collect()} == {(n, "x", "", "", n, "c") for n in ("one", "two")}
