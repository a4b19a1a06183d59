"""Structural drift of JSON documents that are made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import structure
from keelson.operators.staging import staged, staging_folder
from keelson.plans.registry import query, table
from keelson.sources import records

#: The same expression builds the documents in both engines: closed orders have an object, some arrays are empty.
_JSON = """concat('{"id":', o_orderkey, ',"status":"', o_orderstatus, '"',
  CASE WHEN o_orderstatus = 'F' THEN ',"closed":{"by":"desk","codes":[]}'
       WHEN o_orderstatus = 'O' THEN ',"closed":null' ELSE ',"closed":{"by":7,"codes":[1]}' END,
  CASE WHEN o_orderpriority LIKE '1%' THEN ',"tags":["urgent",{"level":1}]' ELSE ',"tags":[]' END,
  CASE WHEN o_orderkey % 7 = 0 THEN ',"note~/x":true' ELSE '' END, '}')"""
_TREE = f"""
d AS (SELECT o_orderstatus AS status, {_JSON} AS j FROM orders),
t AS (SELECT status, regexp_replace(replace(substr(fullkey, 3), '"', ''), '\\[[0-9]+\\]', '[]', 'g') AS path,
             CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
                       WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
             type = 'ARRAY' AND json_array_length(value) > 0 AS filled
      FROM d, json_tree(d.j::JSON) WHERE fullkey <> '$'),
s AS (SELECT status, path, string_agg(DISTINCT type, '|' ORDER BY type) AS type FROM t GROUP BY 1, 2
      UNION ALL SELECT status, path || '[]', 'unknown' FROM t WHERE type = 'array' GROUP BY 1, 2 HAVING NOT bool_or(filled))
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.expr(_JSON).alias("json"))


@query("p1_structure_of_orders", f"WITH {_TREE} SELECT status, path, type FROM s")
def p1_structure_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.structures(documents(spark, sf_dir), ["status"])
    return found.select("status", text.shown_path(F.col("path")).alias("path"), "type")


@query(
    "p1_structure_of_events",
    """SELECT event_type, k AS path, string_agg(DISTINCT CASE json_type(props::JSON, '$.' || k) WHEN 'VARCHAR' THEN 'string'
              WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
              ELSE 'number' END, '|') AS type
       FROM (SELECT event_type, props, unnest(json_keys(props::JSON)) AS k FROM events) GROUP BY 1, 2""",
)
def p1_structure_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", F.col("props").alias("json"))
    found = structure.structures(events, ["event_type"])
    return found.select("event_type", text.shown_path(F.col("path")).alias("path"), "type")


@query(
    "j1_structure_drift",
    f"""WITH {_TREE},
b AS (SELECT coalesce(o.path, n.path) AS path, o.type AS old_type, n.type AS new_type
      FROM (SELECT * FROM s WHERE status = 'F') o FULL JOIN (SELECT * FROM s WHERE status = 'O') n ON o.path = n.path),
u AS (SELECT path FROM b WHERE old_type = 'unknown' OR new_type = 'unknown')
SELECT path, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'absent' ELSE 'type_changed' END AS kind,
       old_type, new_type
FROM b WHERE old_type IS DISTINCT FROM new_type
  AND NOT EXISTS (SELECT 1 FROM u WHERE b.path = u.path OR starts_with(b.path, u.path || '.') OR starts_with(b.path, u.path || '[]'))
""",
)
def j1_structure_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift between the documents of closed and of open orders."""
    found = staged(structure.structures(documents(spark, sf_dir), ["status"]))
    old, new = found.where("status = 'F'").drop("status"), found.where("status = 'O'").drop("status")
    return structure.compare(old, new).withColumn("path", text.shown_path(F.col("path")))


@query(
    "k13_drift_lines",
    f"""WITH {_TREE},
b AS (SELECT coalesce(o.path, n.path) AS path, o.type AS old_type, n.type AS new_type
      FROM (SELECT * FROM s WHERE status = 'O') o FULL JOIN (SELECT * FROM s WHERE status = 'P') n ON o.path = n.path),
u AS (SELECT path FROM b WHERE old_type = 'unknown' OR new_type = 'unknown')
SELECT CASE WHEN old_type IS NULL THEN '+ ' || path || ' (added, ' || new_type || ')'
            WHEN new_type IS NULL THEN '- ' || path || ' (absent, ' || old_type || ')'
            ELSE '~ ' || path || ' (' || old_type || ' -> ' || new_type || ')' END AS line
FROM b WHERE old_type IS DISTINCT FROM new_type
  AND NOT EXISTS (SELECT 1 FROM u WHERE b.path = u.path OR starts_with(b.path, u.path || '.') OR starts_with(b.path, u.path || '[]'))
""",
)
def k13_drift_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as lines for reading."""
    found = staged(structure.structures(documents(spark, sf_dir), ["status"]))
    old, new = found.where("status = 'O'").drop("status"), found.where("status = 'P'").drop("status")
    path = text.shown_path(F.col("path"))
    line = (
        F.when(F.col("kind") == structure.ADDED, F.concat(F.lit("+ "), path, F.lit(" (added, "), "new_type", F.lit(")")))
        .when(F.col("kind") == structure.ABSENT, F.concat(F.lit("- "), path, F.lit(" (absent, "), "old_type", F.lit(")")))
        .otherwise(F.concat(F.lit("~ "), path, F.lit(" ("), "old_type", F.lit(" -> "), "new_type", F.lit(")")))
    )
    return structure.compare(old, new).select(line.alias("line"))


@query("k1_baselines_saved_and_loaded", f"WITH {_TREE} SELECT 'https://shop.example/' || status AS url, path, type FROM s")
def k1_baselines_saved_and_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures written as baselines, one for each URL, and read back with their checks."""
    url = F.concat(F.lit("https://shop.example/"), "status").alias("url")
    found = structure.structures(documents(spark, sf_dir).select(url, "json"), ["url"])
    folder = f"{staging_folder(spark)}/baselines-{uuid.uuid4().hex}"
    records.save_baselines(records.baseline_rows(found, ["url"], "url", "2026-01-01T00:00:00Z"), folder)
    kept = records.load_baselines(spark, folder).where("problem IS NULL")
    return kept.select("url", text.shown_path(F.col("path")).alias("path"), "type")


@query(
    "j1_drift_by_priority",
    f"""WITH d AS (SELECT o_orderpriority AS prio, o_orderstatus AS status, {_JSON} AS j FROM orders),
t AS (SELECT prio, status, regexp_replace(replace(substr(fullkey, 3), '"', ''), '\\[[0-9]+\\]', '[]', 'g') AS path,
             CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
                       WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
             type = 'ARRAY' AND json_array_length(value) > 0 AS filled
      FROM d, json_tree(d.j::JSON) WHERE fullkey <> '$'),
s AS (SELECT prio, status, path, string_agg(DISTINCT type, '|' ORDER BY type) AS type FROM t GROUP BY 1, 2, 3
      UNION ALL SELECT prio, status, path || '[]', 'unknown' FROM t WHERE type = 'array' GROUP BY 1, 2, 3 HAVING NOT bool_or(filled)),
b AS (SELECT coalesce(o.prio, n.prio) AS prio, coalesce(o.path, n.path) AS path, o.type AS old_type, n.type AS new_type
      FROM (SELECT * FROM s WHERE status = 'P') o FULL JOIN (SELECT * FROM s WHERE status = 'O') n ON o.path = n.path AND o.prio = n.prio),
u AS (SELECT prio, path FROM b WHERE old_type = 'unknown' OR new_type = 'unknown')
SELECT prio, path, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'absent' ELSE 'type_changed' END AS kind,
       old_type, new_type FROM b WHERE old_type IS DISTINCT FROM new_type AND NOT EXISTS (SELECT 1 FROM u WHERE b.prio = u.prio
       AND (b.path = u.path OR starts_with(b.path, u.path || '.') OR starts_with(b.path, u.path || '[]')))
""",
)
def j1_drift_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of many pairs of structures at once, keyed by the order priority."""
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"), F.expr(_JSON).alias("json")
    )
    found = staged(structure.structures(docs, ["prio", "status"]))
    old, new = found.where("status = 'P'").drop("status"), found.where("status = 'O'").drop("status")
    return structure.compare(old, new, ["prio"]).withColumn("path", text.shown_path(F.col("path")))
