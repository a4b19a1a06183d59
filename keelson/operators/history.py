"""Append-only check history: the reference each check had, outcomes, listings, spending.

Windows here run over one source or one run, whose history a task must hold; sources
and runs are many and their histories short (a check every few minutes for a year is
some hundred thousand rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a finished check whose snapshot becomes the source's reference.
VALID = ("first", "unchanged", "changed")


def with_reference(checks: DataFrame) -> DataFrame:
    """``checks`` (source_id, finished_at, seq, status, snapshot_id) with before_snapshot_id.

    That is the snapshot of the last valid check that finished before; a failed check
    moves nothing, but records what applied.
    """
    before = Window.partitionBy("source_id").orderBy("finished_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    valid = F.when(F.col("status").isin(*VALID), F.col("snapshot_id"))
    return checks.withColumn("before_snapshot_id", F.last(valid, ignorenulls=True).over(before))


def outcome(before_hash, after_hash, before_version, after_version):
    """first, unchanged (same version and same hash) or changed."""
    return (
        F.when(before_hash.isNull(), "first")
        .when((before_version == after_version) & (before_hash == after_hash), "unchanged")
        .otherwise("changed")
    )


def latest(checks: DataFrame, most: int) -> DataFrame:
    """The last ``most`` checks of each source, newest first (rank 1)."""
    newest = Window.partitionBy("source_id").orderBy(F.col("finished_at").desc(), F.col("seq").desc())
    return checks.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most)


def summary(calls: DataFrame) -> DataFrame:
    """Spending by model, by day and in all in one pass: level, model, day, calls, errors, cached, refused, usd.

    ``calls`` has ts, model, outcome (ok, error, cached, refused), input_tokens and usd.
    """
    counted = calls.withColumn("day", F.to_date("ts")).withColumn("model", F.coalesce("model", F.lit("unknown")))
    of = lambda name: F.count(F.when(F.col("outcome") == name, 1))
    ok = F.col("outcome") == "ok"
    level = F.when(F.grouping("model") == 0, "model").when(F.grouping("day") == 0, "day").otherwise("all")
    return counted.groupingSets([["model"], ["day"], []], "model", "day").agg(
        level.alias("level"), of("ok").alias("calls"), of("error").alias("errors"), of("cached").alias("cached"),
        of("refused").alias("refused"), F.coalesce(F.sum(F.when(ok, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("micro_usd"))), F.lit(0)).alias("micro_usd"),
    )


def budget_audit(calls: DataFrame, budget: int) -> DataFrame:
    """For each call of a run: what was spent before it, and the decision that its budget gives.

    ``calls``: run_id, ts, seq, micro_usd, worst_micro_usd.  An audit of calls that were
    made: a refused call would have added nothing, so decisions after the first refusal
    tell what the recorded spending says, not a replay.
    """
    before = Window.partitionBy("run_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("micro_usd").over(before), F.lit(0))
    return calls.withColumn("spent_before", spent).withColumn(
        "decision",
        F.when(F.col("spent_before") >= budget, "budget_exhausted")
        .when(F.col("spent_before") + F.col("worst_micro_usd") > budget, "budget_would_be_exceeded")
        .otherwise("allowed"),
    )


#: Statuses that a check may end with, those of them that have a snapshot, and the stages at which one fails.
FINAL = ("initial", "unchanged", "changed", "failed", "ambiguous", "unconfirmed")
CAPTURED = ("initial", "unchanged", "changed")


def check_states(events: DataFrame) -> DataFrame:
    """What the events of checks come to: check_id, source_id, started_at, finished_at, status and problem.

    ``events`` (check_id, source_id, kind begun or finished, at, status, snapshot_id,
    before_snapshot_id).  A check runs until its first finish; a second one changes
    nothing and is a problem, as is a finish without a beginning or before it.
    """
    done = F.col("kind") == "finished"
    first = F.struct("at", "status", "snapshot_id", "before_snapshot_id")
    found = events.groupBy("check_id").agg(
        F.min("source_id").alias("source_id"), F.min(F.when(~done, F.col("at"))).alias("started_at"), F.min(F.when(done, first)).alias("end"),
        F.count_if(done).alias("finishes"), F.count_distinct("source_id").alias("sources"),
    )
    problem = (
        F.when(F.col("started_at").isNull(), "never_begun").when(F.col("sources") > 1, "several_sources").when(F.col("finishes") > 1, "finished_twice")
        .when(F.col("end.at") < F.col("started_at"), "finished_before_start").when(~F.col("end.status").isin(*FINAL), "unknown_status")
        .when(F.col("end.status").isin(*CAPTURED) != F.col("end.snapshot_id").isNotNull(), "snapshot_does_not_fit")
    )
    return found.select(
        "check_id", "source_id", "started_at", F.col("end.at").alias("finished_at"), F.coalesce("end.status", F.lit("running")).alias("status"),
        F.col("end.snapshot_id").alias("snapshot_id"), F.col("end.before_snapshot_id").alias("before_snapshot_id"), problem.alias("problem"),
    )


def conflicts(checks: DataFrame) -> DataFrame:
    """Finished checks (with seq) that were compared with something else than their source's reference at that time."""
    derived = with_reference(checks.withColumnRenamed("before_snapshot_id", "compared_with"))
    return derived.where(~F.col("compared_with").eqNullSafe(F.col("before_snapshot_id"))).drop("before_snapshot_id")


def integrity(checks: DataFrame, snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows that break a rule of the history: kind, id and rule; empty for a sound one.

    Checks (id, source_id, status, snapshot_id, before_snapshot_id) may refer to snapshots
    (id, source_id) of their own source only, and have those that their status asks for;
    changes (id, check_run_id, source_id, before_snapshot_id, after_snapshot_id) repeat
    exactly what their check says, which must be a changed one.  All by equi-joins.
    """
    known = snapshots.select(F.col("id").alias("ref"), "source_id")
    refers = checks.select("id", "source_id", F.explode(F.array_compact(F.array("snapshot_id", "before_snapshot_id"))).alias("ref"))
    foreign = refers.join(known, ["ref", "source_id"], "left_anti").select(F.lit("check").alias("kind"), "id", F.lit("snapshot_of_another_source").alias("rule")).distinct()
    status, has, before = F.col("status"), F.col("snapshot_id").isNotNull(), F.col("before_snapshot_id").isNotNull()
    rule = (
        F.when(status.isin(*CAPTURED) != has, "snapshot_does_not_fit").when((status == "initial") & before, "initial_with_reference")
        .when(status.isin("unchanged", "changed") & ~before, "no_reference")
    )
    shaped = checks.select(F.lit("check").alias("kind"), "id", rule.alias("rule")).where("rule IS NOT NULL")
    theirs = checks.where("status = 'changed'").select(
        F.col("id").alias("check_run_id"), "source_id", "before_snapshot_id", F.col("snapshot_id").alias("after_snapshot_id")
    )
    loose = changes.join(theirs, theirs.columns, "left_anti").select(F.lit("change").alias("kind"), "id", F.lit("change_without_its_check").alias("rule"))
    return foreign.unionByName(shaped).unionByName(loose)


def changes_of_sources(changes: DataFrame, checks: DataFrame) -> DataFrame:
    """Changes with their check's source and time, to be listed by source: an inner join on the check."""
    runs = checks.select(F.col("id").alias("check_run_id"), "source_id", "finished_at")
    return changes.join(runs, "check_run_id")


def snapshot_rollup(documents: DataFrame) -> DataFrame:
    """snapshot_id, documents, total_size and last_retrieved of the documents (snapshot_id, size, retrieved_at) of snapshots."""
    return documents.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("size").cast("long").alias("total_size"), F.max("retrieved_at").alias("last_retrieved")
    )


def last_wins(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Of rows with equal keys the last by ``order``: an aggregate, so no window sorts a long group."""
    chosen = rows.groupBy(*keys).agg(F.max(order).alias(order), F.max_by(F.struct(*values), F.col(order)).alias("_last"))
    return chosen.select(*keys, order, *(F.col(f"_last.{v}").alias(v) for v in values))


def first_wins(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``."""
    chosen = rows.groupBy(*keys).agg(F.min(order).alias(order), F.min_by(F.struct(*values), F.col(order)).alias("_first"))
    return chosen.select(*keys, order, *(F.col(f"_first.{v}").alias(v) for v in values))


def configured(sources: DataFrame, updates: DataFrame) -> DataFrame:
    """Sources (source_id, locator, config) with the last configuration of updates (source_id, seq, config); the locator never changes."""
    newest = updates.groupBy("source_id").agg(F.max_by("config", "seq").alias("new_config"))
    return sources.join(newest, "source_id", "left").withColumn("config", F.coalesce("new_config", "config")).drop("new_config")


def new_bundles(bundles: DataFrame, stored: DataFrame) -> DataFrame:
    """Bundles (fingerprint, ...) that the store lacks, each once: contents are written once and never replaced."""
    return bundles.dropDuplicates(["fingerprint"]).join(stored.select("fingerprint"), "fingerprint", "left_anti")


def provenance_json(method: Column, source: Column, kind: Column, evidence: Column) -> Column:
    """How a snapshot was found, as JSON: method, source, source kind and evidence (an array of structs)."""
    return F.to_json(F.struct(method.alias("discovery_method"), source.alias("discovery_source"), kind.alias("source_kind"), evidence.alias("evidence")))


def outcome_json(url: Column, content: Column, status: Column) -> Column:
    """A search's outcome as JSON; a contract's text is never in it, only its size and digest."""
    return F.to_json(F.struct(status.alias("status"), url.alias("source_url"), F.octet_length(content).alias("size"), F.sha2(content, 256).alias("sha256")))
