"""Check history and spending, replayed from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.text import utc_text
from keelson.operators import folding, history
from keelson.plans.registry import query, table

#: Events as checks: the user is the source, some events fail, the value's whole part is the content.
_CHECKS = """
c AS (SELECT event_id AS seq, user_id AS source_id, ts AS finished_at,
             CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN 'failed' ELSE 'changed' END AS status,
             'snap_' || event_id::VARCHAR AS snapshot_id, floor(value)::BIGINT AS content FROM events),
h AS (SELECT *, last_value(CASE WHEN status = 'changed' THEN snapshot_id END IGNORE NULLS) OVER before AS before_snapshot_id,
             last_value(CASE WHEN status = 'changed' THEN content END IGNORE NULLS) OVER before AS before_content FROM c
      WINDOW before AS (PARTITION BY source_id ORDER BY finished_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
_CALLS = """
k AS (SELECT event_id AS seq, ts, user_id % 50 AS run_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'm' || (event_id % 3)::VARCHAR END AS model,
             CASE event_id % 10 WHEN 7 THEN 'error' WHEN 8 THEN 'cached' WHEN 9 THEN 'refused' ELSE 'ok' END AS outcome,
             event_id % 1000 AS input_tokens, (event_id % 997) * 3 AS micro_usd, 1500 + event_id % 500 AS worst_micro_usd FROM events)
"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("event_type") == "error") | (F.col("event_id") % 5 == 0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("source_id"), F.col("ts").alias("finished_at"),
        F.when(failed, "failed").otherwise("changed").alias("status"),
        F.concat(F.lit("snap_"), "event_id").alias("snapshot_id"), F.floor("value").cast("long").alias("content"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    outcome = F.when(event % 10 == 7, "error").when(event % 10 == 8, "cached").when(event % 10 == 9, "refused").otherwise("ok")
    return table(spark, sf_dir, "events").select(
        event.alias("seq"), "ts", (F.col("user_id") % 50).alias("run_id"),
        F.when(event % 11 != 0, F.concat(F.lit("m"), event % 3)).alias("model"), outcome.alias("outcome"),
        (event % 1000).alias("input_tokens"), (event % 997 * 3).alias("micro_usd"), (event % 500 + 1500).alias("worst_micro_usd"),
    )


@query("w2_reference_of_checks", f"WITH {_CHECKS} SELECT seq, source_id, status, snapshot_id, before_snapshot_id FROM h")
def w2_reference_of_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_reference(checks(spark, sf_dir)).select("seq", "source_id", "status", "snapshot_id", "before_snapshot_id")


@query(
    "j11_outcome_of_checks",
    f"""WITH {_CHECKS} SELECT seq, CASE WHEN before_content IS NULL THEN 'first' WHEN before_content = content THEN 'unchanged'
        ELSE 'changed' END AS outcome FROM h WHERE status = 'changed'""",
)
def j11_outcome_of_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome each valid check should have: its content against that of its reference."""
    found = history.with_reference(checks(spark, sf_dir))
    reference = found.select(F.col("snapshot_id").alias("before_snapshot_id"), F.col("content").alias("before_content"))
    one = F.lit(1)
    return (
        found.where("status = 'changed'")
        .join(reference, "before_snapshot_id", "left")
        .select("seq", history.outcome(F.col("before_content"), F.col("content"), one, one).alias("outcome"))
    )


@query(
    "l3_latest_checks",
    f"""WITH {_CHECKS} SELECT source_id, rank, snapshot_id, status FROM (SELECT *, row_number() OVER
        (PARTITION BY source_id ORDER BY finished_at DESC, seq DESC) AS rank FROM c) WHERE rank <= 3""",
)
def l3_latest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(checks(spark, sf_dir), 3).select("source_id", F.col("rank").cast("long").alias("rank"), "snapshot_id", "status")


@query(
    "a3_spending_summary",
    f"""WITH {_CALLS} SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(day) = 0 THEN 'day' ELSE 'all' END AS level,
        model, day, count(*) FILTER (outcome = 'ok') AS calls, count(*) FILTER (outcome = 'error') AS errors,
        count(*) FILTER (outcome = 'cached') AS cached, count(*) FILTER (outcome = 'refused') AS refused,
        coalesce(sum(input_tokens) FILTER (outcome = 'ok'), 0)::BIGINT AS input_tokens,
        coalesce(sum(micro_usd) FILTER (outcome = 'ok'), 0)::BIGINT AS micro_usd
        FROM (SELECT outcome, input_tokens, micro_usd, coalesce(model, 'unknown') AS model, strftime(ts, '%Y-%m-%d') AS day FROM k)
        GROUP BY GROUPING SETS ((model), (day), ())""",
)
def a3_spending_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.summary(calls(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(
    "t4_budget_audit",
    f"""WITH {_CALLS}, s AS (SELECT *, coalesce(sum(micro_usd) OVER (PARTITION BY run_id ORDER BY ts, seq ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM k)
        SELECT seq, run_id, spent_before, CASE WHEN spent_before >= 100000 THEN 'budget_exhausted'
        WHEN spent_before + worst_micro_usd > 100000 THEN 'budget_would_be_exceeded' ELSE 'allowed' END AS decision FROM s""",
)
def t4_budget_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.budget_audit(calls(spark, sf_dir), 100_000).select("seq", "run_id", "spent_before", "decision")


@query(
    "a10_snapshot_rollup",
    """SELECT user_id AS source_id, count(*) AS documents, sum(strlen(props))::BIGINT AS total_size,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS last_retrieved FROM events GROUP BY 1""",
)
def a10_snapshot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "events").select(F.col("user_id").alias("snapshot_id"), F.octet_length("props").alias("size"), F.col("ts").alias("retrieved_at"))
    found = history.snapshot_rollup(documents)
    return found.select(F.col("snapshot_id").alias("source_id"), "documents", "total_size", utc_text(F.col("last_retrieved")).alias("last_retrieved"))


@query(
    "j10_changes_of_source",
    """SELECT o_custkey AS source_id, count(*) AS changes, min(o_orderdate)::TIMESTAMP AS first_at, max(l_linenumber)::BIGINT AS last_ordinal
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def j10_changes_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes joined to their checks and counted by source (lines are changes, orders are checks)."""
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("check_run_id"), F.col("l_linenumber").alias("ordinal"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("finished_at"))
    return history.changes_of_sources(changes, runs).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("changes"), F.min("finished_at").alias("first_at"), F.max("ordinal").cast("long").alias("last_ordinal")
    )


@query(
    "j19_orphaned_rows",
    """SELECT 'orders' AS child, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
       UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def j19_orphaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity: rows whose parent is missing, by anti-joins."""
    found = []
    for child, key, parent, parent_key in (
        ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("labels", "doc_id", "documents", "doc_id"),
    ):
        rows = table(spark, sf_dir, child).select(F.col(key).alias("k"))
        orphans = rows.join(table(spark, sf_dir, parent).select(F.col(parent_key).alias("k")), "k", "left_anti")
        found.append(orphans.agg(F.count(F.lit(1)).alias("n")).select(F.lit(child).alias("child"), "n"))
    return found[0].unionByName(found[1]).unionByName(found[2])


_RUNS = """
c AS (SELECT event_id AS id, user_id AS source_id, (['initial', 'unchanged', 'changed', 'failed', 'ambiguous'])[event_id % 5 + 1] AS status,
      CASE WHEN event_id % 5 < 3 AND event_id % 11 <> 0 THEN event_id END AS snapshot_id, CASE WHEN event_id % 5 IN (1, 2) AND event_id % 13 <> 0 THEN event_id - event_id % 5 END AS before_snapshot_id FROM events)
"""


@query(
    "j19_history_integrity",
    f"""WITH {_RUNS}, f AS (SELECT id, source_id, unnest([snapshot_id, before_snapshot_id]) AS ref FROM c)
        SELECT 'check' AS kind, id, 'snapshot_of_another_source' AS rule FROM (SELECT DISTINCT f.id FROM f LEFT JOIN events s ON s.event_id = ref AND s.user_id = f.source_id WHERE ref IS NOT NULL AND s.event_id IS NULL)
        UNION ALL SELECT 'check', id, CASE WHEN (status IN ('initial', 'unchanged', 'changed')) <> (snapshot_id IS NOT NULL) THEN 'snapshot_does_not_fit'
          ELSE 'no_reference' END FROM c WHERE (status IN ('initial', 'unchanged', 'changed')) <> (snapshot_id IS NOT NULL) OR (status IN ('unchanged', 'changed') AND before_snapshot_id IS NULL)
        UNION ALL SELECT 'change', id, 'change_without_its_check' FROM c WHERE NOT coalesce(status = 'changed' AND before_snapshot_id IS NOT NULL AND snapshot_id IS NOT NULL, false)""",
)
def j19_history_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the history over every event as a check, a snapshot and a change, with all kinds of faults among them."""
    event = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ("initial", "unchanged", "changed", "failed", "ambiguous"))), (event % 5).cast("int"))
    events = table(spark, sf_dir, "events")
    runs = events.select(
        event.alias("id"), F.col("user_id").alias("source_id"), status.alias("status"), F.when((event % 5 < 3) & (event % 11 != 0), event).alias("snapshot_id"),
        F.when((event % 5).isin(1, 2) & (event % 13 != 0), event - event % 5).alias("before_snapshot_id"),
    )
    snapshots = events.select(event.alias("id"), F.col("user_id").alias("source_id"))
    changes = runs.select("id", F.col("id").alias("check_run_id"), "source_id", "before_snapshot_id", F.col("snapshot_id").alias("after_snapshot_id"))
    return history.integrity(runs, snapshots, changes)


@query(
    "t11_states_of_checks",
    """SELECT event_id AS check_id, user_id AS source_id, CASE event_id % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'changed' END AS status,
       CASE event_id % 7 WHEN 2 THEN 'never_begun' WHEN 3 THEN 'finished_twice' WHEN 4 THEN 'finished_before_start' WHEN 5 THEN 'snapshot_does_not_fit' END AS problem FROM events""",
)
def t11_states_of_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a check that begins and finishes in one of seven ways, five of them against the rules."""
    n, at = F.col("event_id") % 7, F.col("ts")
    none = F.lit(None).cast("long")
    begun = F.struct(F.lit("begun").alias("kind"), at.alias("at"), F.lit(None).cast("string").alias("status"), none.alias("snapshot_id"), none.alias("before_snapshot_id"))
    end = lambda status, when, snapshot: F.struct(F.lit("finished").alias("kind"), when.alias("at"), F.lit(status).alias("status"), snapshot.alias("snapshot_id"), none.alias("before_snapshot_id"))
    late, early, own = at + F.expr("INTERVAL 1 SECOND"), at - F.expr("INTERVAL 1 SECOND"), F.col("event_id").cast("long")
    good = end("changed", late, own)
    ways = (
        F.when(n == 0, F.array(begun)).when(n == 1, F.array(begun, end("failed", late, none))).when(n == 2, F.array(good))
        .when(n == 3, F.array(begun, good, end("failed", late + F.expr("INTERVAL 1 SECOND"), none))).when(n == 4, F.array(begun, end("changed", early, own)))
        .when(n == 5, F.array(begun, end("changed", late, none))).otherwise(F.array(begun, good))
    )
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("check_id"), F.col("user_id").alias("source_id"), F.explode(ways).alias("e"))
    return history.check_states(log.select("check_id", "source_id", "e.*")).select("check_id", "source_id", "status", "problem")


@query(
    "k7_conflicting_checks",
    f"""WITH {_CHECKS}, g AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'snap_0' ELSE before_snapshot_id END AS compared_with FROM h)
        SELECT seq, compared_with FROM g WHERE compared_with IS DISTINCT FROM before_snapshot_id""",
)
def k7_conflicting_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that were compared with something else than the reference of their time: every fourth claims another one."""
    own = history.with_reference(checks(spark, sf_dir))
    claimed = own.withColumn("before_snapshot_id", F.when(F.col("seq") % 4 == 0, F.lit("snap_0")).otherwise(F.col("before_snapshot_id")))
    return history.conflicts(claimed).select("seq", "compared_with")


@query(
    "k4_configurations",
    """WITH u AS (SELECT o_custkey AS source_id, arg_max(o_orderpriority, o_orderkey) AS config FROM orders GROUP BY 1)
       SELECT c_custkey AS source_id, c_name AS locator, coalesce(config, c_mktsegment) AS config FROM customer LEFT JOIN u ON c_custkey = source_id""",
)
def k4_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources (customers) with the last configuration that an update (an order) gave them."""
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("locator"), F.col("c_mktsegment").alias("config"))
    updates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("config"))
    return history.configured(sources, updates)


@query(
    "k2_new_bundles",
    """SELECT DISTINCT sha256(text) AS fingerprint FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de')""",
)
def k2_new_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents to be put, each once: those of documents that the store (the German ones) lacks."""
    bundles = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("fingerprint"), "lang")
    return history.new_bundles(bundles.select("fingerprint"), bundles.where("lang = 'de'"))


@query(
    "k9_outcomes_as_json",
    """SELECT page_id, '{"status":"validated","source_url":"' || url || '","size":' || strlen(html) || ',"sha256":"' || sha256(html) || '"}' AS outcome FROM pages""",
)
def k9_outcomes_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes for reading: a content is never in them, only its size and digest."""
    return table(spark, sf_dir, "pages").select("page_id", history.outcome_json(F.col("url"), F.col("html"), F.lit("validated")).alias("outcome"))


@query(
    "p13_provenance_as_json",
    """SELECT page_id, '{"discovery_method":"directory","discovery_source":"' || url || '","source_kind":"' || CASE WHEN page_id % 2 = 0 THEN 'provider' ELSE 'directory_copy' END
       || '","evidence":[{"criterion":"provenance","outcome":"match"}]}' AS provenance FROM pages""",
)
def p13_provenance_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 2 == 0, "provider").otherwise("directory_copy")
    evidence = F.array(F.struct(F.lit("provenance").alias("criterion"), F.lit("match").alias("outcome")))
    return table(spark, sf_dir, "pages").select("page_id", history.provenance_json(F.lit("directory"), F.col("url"), kind, evidence).alias("provenance"))


#: Events as calls of runs: prompts as long as the event's properties, costs as its value.
_PRICED = """
k AS (SELECT event_id AS seq, user_id AS run_id, strlen(props) * (1 + floor(value)::BIGINT % 40) AS prompt_chars, CASE WHEN event_type <> 'error' THEN floor(value * 100)::BIGINT END AS micro_usd,
             (strlen(props) * (1 + floor(value)::BIGINT % 40) + 3) // 4 * 20 + 4000 AS worst_micro_usd, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
"""
_DECIDE = """CASE WHEN prompt_chars > 700 THEN 'prompt_too_large' WHEN calls >= 12 THEN 'call_limit' WHEN spent >= 60000 THEN 'budget_exhausted'
             WHEN spent + worst_micro_usd > 60000 THEN 'budget_would_be_exceeded' ELSE 'allowed' END"""


@query(
    "t4_decisions_of_runs",
    f"""WITH RECURSIVE {_PRICED}, f AS (
        SELECT run_id, n, seq, spent AS spent_before, d AS decision, calls + (d = 'allowed')::BIGINT AS calls, CASE WHEN d = 'allowed' THEN spent + coalesce(micro_usd, worst_micro_usd) ELSE spent END AS spent
        FROM (SELECT *, {_DECIDE} AS d FROM (SELECT *, 0::BIGINT AS calls, 0::BIGINT AS spent FROM k WHERE n = 1))
        UNION ALL
        SELECT run_id, n, seq, spent, d, calls + (d = 'allowed')::BIGINT, CASE WHEN d = 'allowed' THEN spent + coalesce(micro_usd, worst_micro_usd) ELSE spent END
        FROM (SELECT *, {_DECIDE} AS d FROM (SELECT k.*, f.calls, f.spent FROM f JOIN k ON k.run_id = f.run_id AND k.n = f.n + 1)))
        SELECT seq, run_id, spent_before, decision FROM f""",
)
def t4_decisions_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every run (a user's events) decided in its order: a refused one adds nothing to what later ones find spent."""
    chars = F.octet_length("props") * (F.floor("value") % 40 + 1)
    priced = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), "ts", chars.cast("long").alias("prompt_chars"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100)).cast("long").alias("micro_usd"), (F.floor((chars + 3) / 4) * 20 + 4000).cast("long").alias("worst_micro_usd"),
    )
    return folding.authorised(priced, budget=60_000, most_calls=12, most_chars=700).select("seq", "run_id", "spent_before", "decision")
