"""How work is dealt: what would go to one task, or to the driver, once tables are large."""

import json
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from keelson.operators import contract_diff, references, search, staging
from keelson.operators.staging import known_bytes, spread, staged
from keelson.plans import contract_cases
from keelson.sources import contracts, documents


def one_file(spark, folder, rows):
    spark.range(rows).coalesce(1).write.parquet(f"{folder}/t")
    return spark.read.parquet(f"{folder}/t")


def test_documents_made_by_a_join_are_dealt_to_all_cores(spark, tmp_path):
    """The planner multiplies the sides of a join and knows nothing of rows that the driver made."""
    made = spark.createDataFrame([(0, '{"a":1}'), (1, '{"b":[2]}')], "n long, content string")
    own = one_file(spark, tmp_path, 4000).withColumn("n", F.col("id") % 2).join(F.broadcast(made), "n").select("id", "content")
    assert own.rdd.getNumPartitions() == 1 and spread(own).rdd.getNumPartitions() >= 4
    assert known_bytes(made) is None and spread(made).rdd.getNumPartitions() == made.rdd.getNumPartitions()
    assert documents.read_nodes(own).rdd.getNumPartitions() >= 4


def test_rows_of_many_small_documents_are_handed_on_together(spark):
    contents = [json.dumps({"k": i, "l": list(range(i % 5))}) if i % 7 else "{" for i in range(3000)]
    given = spark.createDataFrame([*enumerate(contents)], "id long, content string").coalesce(1)
    found = documents.read_nodes(given)
    want = sorted((i, *row) for i, text in enumerate(contents) for piece in documents.rows_of(text) for row in piece)
    got = sorted(tuple(r) for r in found.collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]

    def sizes(batches):
        for batch in batches:
            yield batch.select(["id"]).slice(0, 1)

    assert found.mapInArrow(sizes, "id long").count() < 20


def joins(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_what_was_exploded_before_a_checkpoint_is_not_broadcast(spark):
    large = staged(spark.range(10).select(F.explode(F.sequence(F.lit(0), F.lit(99_999))).alias("k"), F.concat(F.lit("a text that takes room "), "id").alias("t")))
    asked = spark.range(100).select(F.col("id").cast("int").alias("k"))
    assert "Broadcast" not in joins(asked.join(large, "k", "left_anti")) and large.count() == 1_000_000
    assert "Broadcast" in joins(asked.join(F.broadcast(large), "k"))  # what is counted may still be
    small = staged(spark.range(10).select(F.col("id").cast("int").alias("k")))
    assert "Broadcast" in joins(large.join(small, "k")) and large.join(small, "k").count() == 100


def test_places_are_read_by_all_cores(spark, tmp_path):
    own = one_file(spark, tmp_path, 1000).select(F.col("id").cast("string").alias("url"), F.lit('{"a":{"$ref":"#/b"}}').alias("content"))
    found = references.places(own)
    assert own.rdd.getNumPartitions() == 1 and found.rdd.getNumPartitions() >= 4 and found.count() == 3000


def test_requests_for_one_contract_do_not_meet_in_one_task(spark, tmp_path):
    spark.range(500).select(
        F.col("id").alias("request_id"), F.lit("c").alias("contract"), F.lit("GET").alias("method"), F.concat(F.lit("/v1/a/"), "id").alias("path")
    ).write.parquet(f"{tmp_path}/asked")
    asked = spark.read.parquet(f"{tmp_path}/asked")
    operations = spark.createDataFrame([("c", "GET", "/a/{id}"), ("c", "GET", "/v1/a/7")], "contract string, method string, template string")
    contracts = spark.createDataFrame([("c", ["/v1"], False), ("d", [], True)], "contract string, bases array<string>, hidden boolean")
    found = search.operation_checks(asked, operations, contracts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [contract" not in plan and "BroadcastHashJoin [contract" in plan
    assert {(r.outcome, r.template) for r in found.collect()} == {("match", "/a/{id}")} and found.count() == 500


def labelled(spark, *names):
    """Both versions of labelled cases."""
    rows = [(name, side, text) for name, *texts in contract_cases.documents() if name in names for side, text in zip(("before", "after"), texts)]
    return spark.createDataFrame(rows, "pair string, side string, content string")


CASES = ("shared_component", "property_removed_deep", "chain_of_references", "item_by_reference", "parameter_by_reference", "cycle")


def test_objects_that_are_many_are_dealt_once_for_all_lookups(spark, monkeypatch):
    def found(read):
        findings, limits = contract_diff.compare(read)
        return sorted(map(str, findings.collect())), sorted(map(str, limits.collect()))

    given = labelled(spark, *CASES)
    want = found(contracts.read_contracts(given))
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)  # as if they were too many to be broadcast
    read = contracts.read_contracts(given)
    frontier = given.select("pair", "side", F.concat(F.lit("#/"), "pair").alias("place"))
    plan = contracts.opened(frontier, read.objects.hint("merge"), read.keys)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert found(read) == want and len(want[0]) > 5


def test_the_bound_of_a_schema_is_not_that_of_all_schemas(spark, monkeypatch):
    """Only where one schema may be beyond its bound are the nodes of each counted, over all waves so far."""
    put = []
    monkeypatch.setattr(contracts, "staged", lambda df: put.append(df.columns) or staged(df))
    read = contracts.read_contracts(labelled(spark, "shared_component", "property_removed_deep", "enum_lost", "required"))
    roots = read.rows.where("part = 'schema'").select(*read.keys, F.col("fields")["root"].alias("root")).distinct()
    monkeypatch.setattr(contracts, "MOST_NODES", 6)
    nodes, bad = contracts.expanded(roots, read.objects, read.keys)
    assert nodes.count() > 12 and bad.count() == 0 and [*read.keys, "root"] not in put
    monkeypatch.setattr(contracts, "MOST_NODES", 3)
    nodes, bad = contracts.expanded(roots, read.objects, read.keys)
    assert {r.pair for r in bad.collect()} == {"property_removed_deep"} and [*read.keys, "root"] in put


def test_findings_are_not_worked_out_for_limitations(spark, monkeypatch):
    put = []
    monkeypatch.setattr(contract_diff, "staged", lambda df: put.append(df.columns) or staged(df))
    findings, limits = contract_diff.compare(contracts.read_contracts(labelled(spark, "cycle", "required")))
    assert {(r.pair, r.code) for r in limits.collect()} == {("cycle", "schema_construct_not_classified"), ("cycle", "scope_not_assessed"), ("required", "scope_not_assessed")}
    assert put and not any("key" in columns for columns in put)
    want = [(name, rule) for name, rule, _, _ in contract_cases.expected_findings() if name in ("cycle", "required")]
    assert sorted((r.pair, r.rule_id) for r in findings.collect()) == sorted(want)


def folders(spark):
    """Folders of checkpoints that are there."""
    root = pathlib.Path(staging.staging_folder(spark).removeprefix("file:"))
    return {f.name for f in root.iterdir() if not f.name.startswith(".")}


def test_what_a_portion_stages_is_gone_after_it(spark, monkeypatch):
    """Of pairs that are many, only results stay on disk; each pair is compared once, in one portion."""
    given = labelled(spark, *CASES, "required", "nullable")
    of = lambda found, limits: found.select("pair", "key").unionByName(limits.select("pair", F.col("code").alias("key")))
    want = sorted(map(tuple, contract_diff.compared(given, of).collect()))
    seen, compare = [], contract_diff.compare
    monkeypatch.setattr(contract_diff, "compare", lambda read: seen.append({r.pair for r in read.nodes.select("pair").distinct().collect()}) or compare(read))
    monkeypatch.setattr(contract_diff, "PORTION_BYTES", 2000)
    before = folders(spark)
    found = contract_diff.compared(given, of)
    assert len(seen) > 1 and set().union(*seen) == {*CASES, "required", "nullable"} and sum(map(len, seen)) == len(CASES) + 2
    assert len(folders(spark) - before) == len(seen)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 10


def test_portions_hold_all_rows_once_and_a_failed_one_leaves_nothing(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), F.lit("x" * 10).alias("t"))

    def work(part):
        return staged(part).groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    want = sorted(map(str, work(rows).collect()))
    for most in (100, 3000, 10_000, 1 << 30):
        assert sorted(map(str, staging.in_portions(rows, ["k"], F.octet_length("t"), most, work).collect())) == want
    assert staging.in_portions(rows.where("id < 0"), ["k"], F.octet_length("t"), 100, work).count() == 0
    before = folders(spark)
    with pytest.raises(ZeroDivisionError):
        staging.in_portions(rows, ["k"], F.octet_length("t"), 3000, lambda part: 1 // 0 if staged(part) else part)
    assert folders(spark) == before and spark.conf.get(staging.SHUFFLES_GO) == "false"


def test_shuffles_of_a_checkpoint_are_removed(spark):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()
    given = spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.max("id").alias("m"))
    before = held()
    kept = [staged(given.withColumn("i", F.lit(i)).groupBy("k", "i").agg(F.max("m").alias("m"))) for i in range(8)]
    for _ in range(100):
        if held() < before + 8:
            break
        time.sleep(0.1)
    assert held() < before + 8 and sum(k.count() for k in kept) == 8000


def test_only_values_where_references_end_are_moved_for_them(spark):
    nodes = staged(documents.read_nodes(spark.createDataFrame([(1, '{"a":{"$ref":"#/b"},"b":{"c":1},"d":{"$ref":"#/no"}}')], "id long, content string")))
    refs = staged(nodes.where("ref IS NOT NULL").select("id", "at", F.col("ref").alias("target"), F.lit(None).cast("string").alias("problem")))
    found = contracts.resolved(refs, nodes, ["id"])
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.at, r.place_kind, r.problem) for r in found.collect()} == {("#/a", "object", None), ("#/d", None, "target_missing")}
