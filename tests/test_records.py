"""Readers and writers on small files."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from keelson.operators import structure
from keelson.sources import records


def test_baselines(spark, tmp_path):
    docs = spark.createDataFrame([("u1", '{"a":[1,"x"],"b":[]}'), ("u2", '{"c":null}')], "url string, json string")
    found = structure.structures(docs, ["url"])
    records.save_baselines(records.baseline_rows(found, ["url"], "url", "2026-01-01T00:00:00Z"), f"{tmp_path}/b")
    back = records.load_baselines(spark, f"{tmp_path}/b")
    assert back.where("problem IS NOT NULL").count() == 0
    assert structure.compare(found, back.select("url", "path", "type"), ["url"]).count() == 0 and back.count() == found.count()
    with pytest.raises(AnalysisException):
        records.save_baselines(records.baseline_rows(found, ["url"], "url", "x"), f"{tmp_path}/b")
    bad = {"version": 1, "url": "u", "captured_at": "x", "structure": [{"path": ["a"], "type": "number"}, {"path": ["a"], "type": "number"}, {"path": ["b"], "type": "unknown|null"}]}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    assert {r.problem for r in records.load_baselines(spark, f"{tmp_path}/bad.json").collect()} == {"repeated_path", "type"}


def test_registry(spark, tmp_path):
    provider = {"id": "p", "hosts": ["a.com", "b.com"], "spec_url": "s", "provenance_url": "v"}
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 1, "providers": [provider, provider | {"id": "q", "hosts": ["a.com"], "max_document_bytes": 9}]}, indent=1))
    targets = spark.createDataFrame([("a.com",), ("x.a.com",)], "host string")
    got = records.providers_of(targets, records.load_registry(spark, f"{tmp_path}/r.json")).collect()
    assert sorted((r.id, r.allowance) for r in got) == [("p", 9), ("q", 9)]


def test_ledger(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"timestamp":"2026-01-01T00:00:00Z","outcome":"ok","total_usd":0.5}\nnot json\n')
    rows = records.read_ledger(spark, f"{tmp_path}/l.jsonl").cache()
    assert rows.where("unreadable IS NOT NULL").count() == 1 and rows.agg(F.sum("total_usd")).first()[0] == 0.5
    records.append_ledger(rows.where("unreadable IS NULL").drop("unreadable"), f"{tmp_path}/out")
    records.append_ledger(rows.where("unreadable IS NULL").drop("unreadable"), f"{tmp_path}/out")
    assert records.read_ledger(spark, f"{tmp_path}/out").count() == 2
    assert spark.range(1).select(records.worst_case_usd(F.lit(3000), 1000, 2.0, 10.0)).first()[0] == pytest.approx(0.012)


def test_linkset_and_kinds(spark):
    text = json.dumps({"linkset": [{"anchor": "https://a", "service-desc": [{"href": "/o.json", "type": "x"}], "item": [{"href": "/i"}]}]})
    docs = spark.createDataFrame([("u", text), ("v", "{"), ("w", '{"linkset":[]}')], "url string, content string")
    assert {(r.url, r.relation, r.href) for r in records.linkset_links(docs).collect()} == {("u", "service-desc", "/o.json"), ("u", "item", "/i")}
    kinds = ['{"openapi":"3.1.0"}', '{"swagger":"2.0"}', '{"asyncapi":"2"}', '{"kind":"discovery#restDescription"}', '{"a":1}', "no"]
    frame = spark.createDataFrame([(k,) for k in kinds], "t string").select(records.described_as(F.col("t")).alias("k"))
    assert [r.k for r in frame.collect()] == ["openapi3", "swagger2", "asyncapi", "google_discovery", None, None]


def test_paths_of_bundles(spark):
    paths = ["a/b", "a", "A/b", "../x", "/abs", "ok/c.json", "sp ace"]
    got = records.unsafe_paths(spark.createDataFrame([("b", p) for p in paths] + [("c", "a/b")], "bundle string, path string")).collect()
    assert {(r.bundle, r.path, r.problem) for r in got} == {("b", "A/b", "case"), ("b", "a", "folder"), ("b", "../x", "form"), ("b", "/abs", "form"), ("b", "sp ace", "form")}
