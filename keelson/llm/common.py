"""Column expressions and small job helpers shared by the operators."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of the alphanumeric word rule: every ASCII character that is no digit and no lower-case letter.
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators of the blank-separated word rule.
BLANKS = r"[\x20\x09-\x0D]+"


def by_value(module_name: str) -> None:
    """Ship the functions of a module to executors inside the pickled task."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is the fast path where the text is pure ASCII and both agree."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def alnum_words(text: Column) -> Column:
    """Words of digits, ASCII letters and non-ASCII characters, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_BREAK), "")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or it with underscores before it, so that it is no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="keelson-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Tables of up to so many counted bytes are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def near(df: DataFrame, size: int) -> DataFrame:
    """``df`` to be broadcast, if the size that was counted for it allows it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: Rows and bytes of one Arrow batch; a Python worker's memory follows these, not the table.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches; whole texts are long, so the defaults hold too many."""
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows > BATCH_ROWS or rows <= 0:  # zero and less mean no bound
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
