"""The events table run through the check log stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.staging import staging_folder
from keelson.plans.registry import query, table
from keelson.streaming import checks, store


@query(
    "t11_streamed_check_log",
    "SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2",
)
def t11_streamed_check_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events appended to the log by a stream that ends when nothing new is there, then counted."""
    folder = f"{staging_folder(spark)}/log-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    # A file source lists a folder; a table that is one file is read through its name as a pattern.
    stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/event[s].parquet")
    stream.writeStream.foreachBatch(checks.append_to(folder)).option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True
    ).start().awaitTermination()
    return checks.published(spark, folder).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")
    )


@query(
    "w5_events_in_windows",
    "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def w5_events_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed count as a batch; a test holds the stream against it."""
    found = checks.counts_in_windows(table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 day")
    return found.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")


#: Orders as checks of their customers, one request to begin and one to end each; some end badly, some were compared with what isn't the reference.
_REQUESTED = """
c AS (SELECT o_custkey AS source_id, o_orderkey AS check_id, 's' || o_orderkey AS snapshot_id, o_orderstatus AS content, epoch_us(o_orderdate::TIMESTAMP) AS moment,
             o_orderpriority LIKE '5%' AS fails, o_orderpriority LIKE '4%' AS strays FROM orders),
h AS (SELECT *, last_value(CASE WHEN NOT fails AND NOT strays THEN snapshot_id END IGNORE NULLS) OVER before AS reference,
             last_value(CASE WHEN NOT fails AND NOT strays THEN content END IGNORE NULLS) OVER before AS held FROM c
      WINDOW before AS (PARTITION BY source_id ORDER BY check_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, CASE WHEN fails THEN 'failed' WHEN reference IS NULL AND NOT strays THEN 'initial' WHEN held = content AND NOT strays THEN 'unchanged' ELSE 'changed' END AS outcome FROM h)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that the orders stand for, in the form of ``store.REQUESTS``.

    A caller knows its source's reference, so it is put in by a window; one in five (by
    priority) is mistaken, and its check stays running.
    """
    from pyspark.sql import Window

    earlier = Window.partitionBy("source_id").orderBy("check").rowsBetween(Window.unboundedPreceding, -1)
    fails, strays = F.startswith("o_orderpriority", F.lit("5")), F.startswith("o_orderpriority", F.lit("4"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("check"), F.concat(F.lit("s"), "o_orderkey").alias("snapshot_id"), F.col("o_orderstatus").alias("content"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), fails.alias("fails"), strays.alias("strays"), F.col("o_totalprice").cast("string").alias("price"),
    )
    good = ~F.col("fails") & ~F.col("strays")
    known = orders.withColumns({c: F.last(F.when(good, F.col(v)), ignorenulls=True).over(earlier) for c, v in (("reference", "snapshot_id"), ("held", "content"))})
    outcome = (
        F.when(F.col("fails"), "failed").when(F.col("reference").isNull() & ~F.col("strays"), "initial").when((F.col("held") == F.col("content")) & ~F.col("strays"), "unchanged").otherwise("changed")
    )
    none = F.lit(None).cast("string")
    changes = F.when(outcome == "changed", F.to_json(F.array(F.concat_ws(" to ", "held", "content")))).otherwise("[]")
    begin = F.struct((2 * F.col("check")).alias("seq"), F.lit("begin").alias("kind"), (F.col("at") - 1).alias("at"), none.alias("outcome"), none.alias("before_snapshot_id"), none.alias("documents"), none.alias("changes"))
    end = F.struct(
        (2 * F.col("check") + 1).alias("seq"), F.when(F.col("fails"), "fail").otherwise("complete").alias("kind"), F.col("at"), outcome.alias("outcome"),
        F.when(F.col("strays"), F.lit("s-1")).otherwise(F.col("reference")).alias("before_snapshot_id"), F.to_json(F.array("price")).alias("documents"), changes.alias("changes"),
    )
    rows = known.withColumn("r", F.explode(F.array(begin, end)))
    return rows.select(
        "source_id", "r.seq", "r.kind", F.col("check").cast("string").alias("check_id"), "r.at", "r.outcome", "r.before_snapshot_id", "snapshot_id", "content", F.lit("1").alias("version"), "r.documents", "r.changes"
    )


@query(
    "k7_decisions_of_requests",
    f"""WITH {_REQUESTED} SELECT source_id, check_id::VARCHAR AS check_id, 'begin' AS kind, 'accepted' AS decision, reference FROM d
        UNION ALL SELECT source_id, check_id::VARCHAR, CASE WHEN fails THEN 'fail' ELSE 'complete' END, CASE WHEN strays AND NOT fails THEN 'conflict' ELSE 'accepted' END, reference FROM d""",
)
def k7_decisions_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request to begin, fail or complete a check, decided in the order of its source."""
    return store.decisions(requests(spark, sf_dir)).select("source_id", "check_id", "kind", "decision", "reference")


@query(
    "t11_checks_from_stream",
    f"""WITH {_REQUESTED} SELECT check_id::VARCHAR AS check_id, source_id, moment - 1 AS started_at, moment AS finished_at, outcome AS status, reference AS before_snapshot_id, CASE WHEN NOT fails THEN snapshot_id END AS snapshot_id,
        CASE WHEN outcome = 'changed' THEN held || ' to ' || content END AS change FROM d WHERE fails OR NOT strays""",
)
def t11_checks_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a stream with keyed state: the published checks, each with the change published with it."""
    folder = f"{staging_folder(spark)}/store-{uuid.uuid4().hex}"
    requests(spark, sf_dir).write.parquet(f"{folder}/requests")
    source = spark.readStream.schema(store.REQUESTS).parquet(f"{folder}/requests")
    store.run(source, f"{folder}/tables", f"{folder}/state").awaitTermination()
    found = store.published(spark, f"{folder}/tables", store.CHECKS)
    changes = store.published(spark, f"{folder}/tables", store.CHANGES).select(F.col("check_id").alias("of_check"), F.col("value").alias("change"))
    return found.join(changes, F.col("check_id") == F.col("of_check"), "left").drop("of_check")
