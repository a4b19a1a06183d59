"""Checks as keyed state: rules, replays, double delivery and batches that are cut off; decisions that feed back."""

import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson.operators import folding
from keelson.streaming import store

NAMES = [c.split()[0] for c in store.REQUESTS.split(", ")]


def request(source, seq, kind, check, at, **more):
    return tuple({"source_id": source, "seq": seq, "kind": kind, "check_id": check, "at": at, "version": "1", **more}.get(n) for n in NAMES)


def complete(source, seq, check, at, before, snapshot, outcome="changed", content="x", **more):
    return request(source, seq, "complete", check, at, outcome=outcome, before_snapshot_id=before, snapshot_id=snapshot, content=content, **more)


LOG = [
    request(1, 1, "begin", "a", 10), complete(1, 2, "a", 20, None, "s1", "initial", "c1", documents='["d1","d2"]'),
    request(1, 3, "begin", "b", 30), request(1, 4, "begin", "c", 31), complete(1, 5, "b", 40, "s1", "s2", content="c2", changes='["m","n"]', documents='["d3"]'),
    complete(1, 6, "c", 41, "s1", "s3", content="c3"), complete(1, 7, "c", 42, "s2", "s4", "unchanged", "c2"), complete(1, 8, "c", 43, "s4", "s5"),
    request(1, 9, "fail", "zz", 50, outcome="failed"), request(1, 10, "begin", "d", 60), request(1, 11, "fail", "d", 59, outcome="failed"), request(1, 12, "fail", "d", 61, outcome="changed"),
    complete(1, 13, "d", 62, None, "s6", "initial"), complete(1, 14, "d", 62, None, "s6", "changed"), complete(1, 15, "d", 62, "s4", "s6", "unchanged", "c9"), complete(1, 16, "d", 62, "s4", "s6", "unchanged", "c2", changes='["q"]'),
    request(1, 17, "fail", "d", 63, outcome="ambiguous"), request(1, 18, "begin", "e", 70), request(1, 19, "begin", "e", 71),
    request(2, 1, "begin", "f", 5), request(2, 2, "fail", "f", 6, outcome="failed"),
]
WANT = [
    "accepted", "accepted", "accepted", "accepted", "accepted", "conflict", "accepted", "not_running", "not_running", "accepted", "finished_before_start", "unknown_outcome",
    "conflict", "reference_does_not_fit", "outcome_does_not_fit", "changes_without_change", "accepted", "accepted", "already_running", "accepted", "accepted",
]


def frame(spark, rows):
    return spark.createDataFrame(rows, store.REQUESTS)


def test_each_rule_has_its_decision(spark):
    found = store.decisions(frame(spark, LOG[::-1])).orderBy("source_id", "seq").collect()
    assert [r.decision for r in found] == WANT
    assert [r.reference for r in found][:8] == [None, None, "s1", "s1", "s1", "s2", "s2", "s4"] and found[4].started_at == 30


def plain(found):
    return {name: sorted(map(str, rows.collect())) for name, rows in store.tables_of(found).items()}


def published(spark, folder):
    return {name: sorted(map(str, store.published(spark, folder, name).collect())) for name in (store.CHECKS, store.SNAPSHOTS, store.DOCUMENTS, store.CHANGES)}


def test_a_stream_in_pieces_delivered_twice_gives_the_batch_result(spark, tmp_path):
    want = plain(store.decisions(frame(spark, LOG)))
    assert len(want[store.SNAPSHOTS]) == 3 and len(want[store.DOCUMENTS]) == 3 and len(want[store.CHANGES]) == 2
    folder, state, requests = str(tmp_path / "tables"), str(tmp_path / "state"), tmp_path / "requests"
    # The first piece again among later ones, and all of it once more at the end, with restarts between.
    for name, rows in (("a", LOG[:6]), ("b", LOG[3:14]), ("c", LOG[:6] + LOG[14:]), ("d", LOG)):
        frame(spark, rows).coalesce(1).write.parquet(str(requests / name))
        source = spark.readStream.schema(store.REQUESTS).option("recursiveFileLookup", "true").parquet(str(requests))
        store.run(source, folder, state).awaitTermination()
    assert published(spark, folder) == want
    # A batch that was cut off before its marker counts for nothing, and written again it counts once.
    late = store.decisions(frame(spark, [request(3, 1, "begin", "g", 1), complete(3, 2, "g", 2, None, "s9", "initial", documents='["d"]')]))
    publish = store.publish_to(folder)
    publish(late, 99)
    shutil.rmtree(f"{folder}/markers/number=99")
    assert published(spark, folder) == want
    publish(late, 99)
    assert len(published(spark, folder)[store.SNAPSHOTS]) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_refused_calls_add_nothing(spark, seed):
    import random

    rng = random.Random(seed)
    calls = [(rng.choice([None, 1, 2]), k, k, rng.randrange(900), rng.choice([None, rng.randrange(400)]), rng.randrange(500)) for k in range(300)]
    want, runs = {}, {}
    for run, _, seq, chars, usd, worst in calls:
        n, spent = runs.get(run, (0, 0))
        d = "prompt_too_large" if chars > 800 else "call_limit" if n >= 30 else "budget_exhausted" if spent >= 3000 else "budget_would_be_exceeded" if spent + worst > 3000 else "allowed"
        want[seq] = (spent, d)
        runs[run] = (n + 1, spent + (worst if usd is None else usd)) if d == "allowed" else (n, spent)
    rows = spark.createDataFrame(calls, "run_id long, ts long, seq long, prompt_chars long, micro_usd long, worst_micro_usd long").orderBy(F.rand(3))
    found = {r.seq: (r.spent_before, r.decision) for r in folding.authorised(rows, 3000, 30, 800).collect()}
    assert found == want and len({d for _, d in want.values()}) >= 4
    assert folding.authorised(rows.limit(0), 1, 1, 1).count() == 0


def test_one_group_holds_many_sources_each_with_its_own_state():
    """Groups of the stream cost more than their rows, so neighbouring sources share one; pieces in any order give the decisions of the log."""

    class Entries(dict):
        updateValue = dict.__setitem__

        def iterator(self):
            return iter(list(self.items()))

    class Handle:
        def getMapState(self, *_):
            return Entries()

    processor, found = store.Store(), []
    processor.init(Handle())
    for piece in (LOG[:5] + LOG[-1:], LOG[5:14], LOG[3:-1]):
        given = pd.DataFrame(piece[::-1], columns=NAMES).assign(bucket=0)
        found += [r for made in processor.handleInputRows((0,), iter([given]), None) for r in made.itertuples(index=False) if r.decision != "repeated"]
    decided = {(r.source_id, r.seq): r.decision for r in found}
    want = {(r[0], r[1]): d for r, d in zip(LOG, WANT)} | {(2, 1): "repeated"}
    assert len(found) == len(decided) and decided == {k: v if k != (2, 2) else "not_running" for k, v in want.items() if v != "repeated"}
    assert set(processor.heads) == {(1,), (2,)}
