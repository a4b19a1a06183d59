"""The check log as a stream: events are appended batch by batch, and a batch counts once its marker is there.

Plain Parquet has no transaction over two writes.  A batch writes its rows under
its own number first and its marker last; readers keep the rows of marked batches
only, so a batch that was cut off, or written twice after a restart, is never seen
in part or twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.operators.staging import near


def read_log(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def append_to(folder: str):
    """A function for ``foreachBatch`` that publishes a batch under ``folder``."""

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batch.sparkSession.range(1).select(F.lit(number).alias("published")).write.mode("overwrite").parquet(
            f"{folder}/markers/number={number}"
        )

    return publish


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all published batches."""
    rows, markers = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/markers")
    markers = markers.select(F.col("number").alias("batch")).distinct()
    return rows.join(near(markers, 64 * markers.count()), "batch", "left_semi").drop("batch")


def counts_in_windows(events: DataFrame, at: str, key: str, width: str, lateness: str) -> DataFrame:
    """Events of each key in tumbling windows; later ones than ``lateness`` are left out when it runs as a stream."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))
