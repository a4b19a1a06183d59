"""The store of checks: requests to begin, fail or complete a check are decided by their source's state, and published at once.

Requests of a source come in the order of seq.  A check can be completed only while it
runs, and only if it was compared with the source's reference of that moment; it then
becomes the reference.  A request that breaks a rule changes nothing and is told why.

As a batch this is an ordered fold; as a stream it is keyed state (``transformWithState``):
the reference, the last seq and the running checks of each source.  A request that comes
again has a seq that is behind, and gives nothing.  Each micro-batch is published by one
marker after its checks, snapshots, documents and changes are written, so a reader sees
all of a completed check or none of it, and a batch that was cut off is written over.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keelson.operators.folding import folded
from keelson.operators.staging import near

#: How a check may end without and with a snapshot.
FAILURES = ("failed", "ambiguous", "unconfirmed")
SUCCESSES = ("initial", "unchanged", "changed")
#: A request; documents and changes are JSON arrays that a completed check brings.
REQUESTS = (
    "source_id long, seq long, kind string, check_id string, at long, outcome string, before_snapshot_id string, snapshot_id string, "
    "content string, version string, documents string, changes string"
)
#: Sources whose numbers differ only in so many last bits are one group of the stream.
BUCKET_BITS = 4
READ = ["seq", "kind", "check_id", "at", "outcome", "before_snapshot_id", "snapshot_id", "content", "version", "changes"]
#: What a decision adds: accepted or what was wrong, when the check began, and the reference that applied.
MADE = {"decision": "string", "started_at": "long", "reference": "string"}


class Source:
    """State of a source: its reference with content and version of normalisation, and when its running checks began."""

    def __init__(self) -> None:
        self.seq, self.reference, self.content, self.version = -1, None, None, None
        self.running: dict[str, int] = {}


def decided(source: Source, seq, kind, check, at, outcome, before, snapshot, content, version, changes) -> tuple[str, int | None, str | None]:
    """The decision of one request (see MADE); an accepted one changes the state."""
    if seq <= source.seq:
        return "repeated", None, source.reference
    source.seq = seq
    started, reference = source.running.get(check), source.reference
    if kind == "begin":
        if started is not None:
            return "already_running", started, reference
        source.running[check] = at
        return "accepted", at, reference
    if kind not in ("fail", "complete") or outcome not in (FAILURES if kind == "fail" else SUCCESSES):
        return "unknown_outcome", started, reference
    if kind == "complete" and (outcome == "initial") != (before is None):
        return "reference_does_not_fit", started, reference
    if kind == "complete" and changes not in (None, "[]") and outcome != "changed":
        return "changes_without_change", started, reference
    if started is None:
        return "not_running", None, reference
    if at < started:
        return "finished_before_start", started, reference
    if kind == "complete":
        if before != reference:
            return "conflict", started, reference
        same = (content, version) == (source.content, source.version)
        if reference is not None and (outcome == "unchanged") != same:
            return "outcome_does_not_fit", started, reference
        source.reference, source.content, source.version = snapshot, content, version
    del source.running[check]
    return "accepted", started, reference


def decisions(requests: DataFrame) -> DataFrame:
    """Requests with MADE, as a batch."""
    return folded(requests, "source_id", ["seq"], READ, Source, decided, MADE)


class Store(StatefulProcessor):
    """The same decisions as a stream.

    A group costs several calls and a batch of its own, more than the few requests of a
    source, so neighbouring sources (see BUCKET_BITS) are one group.  Each source keeps an
    entry of its own in the state; entries of sources that a micro-batch lacks stay as they are.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getMapState("heads", "source_id long", "seq long, reference string, content string, version string, running string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch brings the requests of a source in any order; it is as large as the trigger lets it be.
        frame = pd.concat(list(rows)).drop(columns="bucket").sort_values("seq", kind="stable", ignore_index=True)
        plain = frame.astype(object).where(frame.notna(), None)
        known = {k[0]: v for k, v in self.heads.iterator()}
        sources, found = {}, []
        for name, *request in zip(*(plain[c].tolist() for c in ("source_id", *READ))):
            source = sources.get(name)
            if source is None:
                source = sources[name] = Source()
                if name in known:
                    source.seq, source.reference, source.content, source.version, running = known[name]
                    source.running = json.loads(running)
            found.append(decided(source, *(v if c not in ("seq", "at") or v is None else int(v) for c, v in zip(READ, request))))
        for name, source in sources.items():
            self.heads.updateValue((name,), (source.seq, source.reference, source.content, source.version, json.dumps(source.running)))
        made = pd.DataFrame(found, columns=list(MADE)).astype({"started_at": "Int64"})
        yield pd.concat([plain.astype({"source_id": "int64", "seq": "int64", "at": "Int64"}), made], axis=1)

    def close(self) -> None:
        pass


#: Tables of a store, each with the decisions that it is made of.
CHECKS, SNAPSHOTS, DOCUMENTS, CHANGES = "checks", "snapshots", "documents", "changes"


def tables_of(found: DataFrame) -> dict[str, DataFrame]:
    """The rows that accepted decisions add: finished checks, snapshots, their documents and the changes, in order."""
    accepted = found.where("decision = 'accepted'")
    ended, whole = accepted.where("kind <> 'begin'"), accepted.where("kind = 'complete'")
    members = lambda c: F.posexplode(F.from_json(c, "array<string>")).alias("ordinal", "value")
    return {
        CHECKS: ended.select("check_id", "source_id", "started_at", F.col("at").alias("finished_at"), F.col("outcome").alias("status"), F.col("reference").alias("before_snapshot_id"), F.when(F.col("kind") == "complete", F.col("snapshot_id")).alias("snapshot_id")),
        SNAPSHOTS: whole.select("snapshot_id", "source_id", "content", "version"),
        DOCUMENTS: whole.select("snapshot_id", members("documents")),
        CHANGES: whole.select("check_id", "source_id", F.col("reference").alias("before_snapshot_id"), F.col("snapshot_id").alias("after_snapshot_id"), members("changes")),
    }


def publish_to(folder: str):
    """A function for ``foreachBatch``: all tables of a batch under its number, then one marker."""

    def publish(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, rows in tables_of(batch).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.sparkSession.range(1).select(F.lit(number).alias("published")).write.mode("overwrite").parquet(f"{folder}/markers/number={number}")
        batch.unpersist()

    return publish


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table from batches whose marker is there."""
    markers = spark.read.parquet(f"{folder}/markers").select(F.col("number").alias("batch")).distinct()
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows.join(near(markers, 64 * markers.count()), "batch", "left_semi").drop("batch")


def run(requests: DataFrame, folder: str, state: str):
    """Start deciding a stream of requests and publishing under ``folder``; ``state`` holds offsets and keyed state.

    Keyed state needs the RocksDB provider, which is set for the session.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = ", ".join([REQUESTS, *(f"{n} {t}" for n, t in MADE.items())])
    found = requests.withColumn("bucket", F.shiftright("source_id", BUCKET_BITS)).groupBy("bucket").transformWithStateInPandas(Store(), schema, "Append", "None")
    return found.writeStream.foreachBatch(publish_to(folder)).option("checkpointLocation", state).trigger(availableNow=True).start()


for _name in (__name__, "keelson.operators.folding"):
    cloudpickle.register_pickle_by_value(sys.modules[_name])
