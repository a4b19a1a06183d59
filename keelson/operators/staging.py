"""Stage boundaries: results that are read more than once are written once, in the folder all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def staging_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="keelson-checkpoint-"))
    return sc.getCheckpointDir()


#: Bytes of a checkpoint, which may be compressed, beyond which the planner's estimate for it is dropped.
GUESSED_BYTES = 1 << 20
#: Has Spark remove the shuffles of a job once it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the checkpoints made in the portion that is being worked out.
_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _checkpoint(df: DataFrame) -> tuple[DataFrame, object]:
    """``df`` behind a checkpoint, and its folder; what was shuffled for it goes, as nothing reads it again."""
    spark = df.sparkSession
    staging_folder(spark)
    with _set(spark, SHUFFLES_GO, "true"):
        kept = df.select("*").checkpoint()  # a frame keeps the settings that it was made under
    folder = spark._jvm.org.apache.hadoop.fs.Path(kept._jdf.logicalPlan().rdd().getCheckpointFile().get())
    if (made := _made.get()) is not None:
        made.append(folder)
    return kept, folder


def staged(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint: later plans start here, and a lost executor costs no recomputation.

    A checkpoint keeps the size that the planner had guessed, which knows nothing of what
    was exploded or parsed, so that millions of rows would be sent to the driver to be
    broadcast.  Where the written bytes are many, the guess is dropped: such rows are
    joined by shuffles, unless their bytes are counted and ``near`` lets them.
    """
    spark = df.sparkSession
    kept, folder = _checkpoint(df)
    written = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    if written <= GUESSED_BYTES:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.logicalPlan().rdd(), kept._jdf.schema(), False), spark)


def in_portions(df: DataFrame, by: list[str], size: Column, most: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(df)``, worked out for so many rows at a time that their ``size`` adds up to about ``most`` bytes.

    What ``work`` stages is removed before the next portion begins, so the disk that is
    needed on the way doesn't grow with ``df``; only results stay.  Rows that have ``by``
    in common are in one portion: each row of the result must follow from such rows only.
    """
    spark = df.sparkSession
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("n")).first()["n"]
    n = -(-total // most)
    if n <= 1:
        return work(df)
    found = None
    for i in range(n):
        made: list = []
        token = _made.set(made)
        try:
            done = staged(work(df.where(F.pmod(F.xxhash64(*by), F.lit(n)) == i)))
            made.pop()  # the result itself
        finally:
            _made.reset(token)
            for folder in made:
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        found = done if found is None else found.unionByName(done)
    return found


#: Bytes of rows, as counted, that one part of a table that is laid out should hold.
LAID_BYTES = 64 << 20


def laid_parts(spark: SparkSession, size: int) -> int:
    """Into how many parts a table of ``size`` bytes is to be dealt by ``repartition`` before it is laid out."""
    return max(spark.sparkContext.defaultParallelism, size // LAID_BYTES)


def laid_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, dealt by ``keys`` already, behind a checkpoint that stays dealt and sorted: joins on them move only their other side.

    For a table that is looked up again and again.  AQE would merge the parts, and a
    checkpoint would no longer count as dealt; it is off for this one job, so ``df``
    should be one shuffle away from what is staged.  No later join can split a part:
    ``keys`` should be nearly unique.
    """
    with _set(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return _checkpoint(df.sortWithinPartitions(*keys))[0]


#: Tables of up to so many bytes are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 96 << 20


def near(df: DataFrame, size: int) -> DataFrame:
    """``df`` to be broadcast, if the size that was counted for it allows it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: Bytes of files that one part should have at least, parts that a core gets at most, and bytes a core beyond which the splits of files are enough.
PART_BYTES, PARTS_A_CORE, SPLIT_BYTES = 128 << 10, 4, 128 << 20
#: The planner gives sizes beyond this to what it knows nothing about, such as rows that the driver made.
UNKNOWN_BYTES = 1 << 62


def known_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that ``df`` reads, where the planner knows them; nothing runs to find them.

    The estimate for ``df`` as a whole is of no use here: a join multiplies those of its sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = [s for s in sizes if s < UNKNOWN_BYTES]
    return sum(known) if known else None


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that costs far more than moving a row: dealt evenly to all cores, unless its files have full splits for all.

    A file of few megabytes is one split, however many documents are made of its rows.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, known_bytes(df)
    if size is None or size >= cores * SPLIT_BYTES:
        return df
    return df.repartition(min(max(cores, size // PART_BYTES), PARTS_A_CORE * cores))
