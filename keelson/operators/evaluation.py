"""Measuring findings against labels: matching, confusion matrix, precision, recall, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import ratio


def matched(expected: DataFrame, returned: DataFrame, identity: list[str]) -> DataFrame:
    """Full outer join on the identity: expected and returned categories, null where one side lacks it."""
    return expected.withColumnRenamed("category", "expected").join(
        returned.withColumnRenamed("category", "returned"), identity, "full"
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """expected, returned (none where absent) and n."""
    named = pairs.select(F.coalesce("expected", F.lit("none")).alias("expected"), F.coalesce("returned", F.lit("none")).alias("returned"))
    return named.groupBy("expected", "returned").agg(F.count(F.lit(1)).alias("n"))


def report(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Counts and ratios of each group; a ratio over nothing is null, never 1."""
    both = F.col("expected").isNotNull() & F.col("returned").isNotNull()
    counted = pairs.groupBy(*by).agg(
        F.count("expected").alias("n_expected"), F.count("returned").alias("n_returned"),
        F.count(F.when(both, 1)).alias("n_found"),
        F.count(F.when(both & (F.col("expected") == F.col("returned")), 1)).alias("n_right"),
    )
    return counted.select(
        *by, "n_expected", "n_returned", "n_found", "n_right",
        ratio(F.col("n_found"), F.col("n_returned")).alias("precision"), ratio(F.col("n_found"), F.col("n_expected")).alias("recall"),
        ratio(F.col("n_right"), F.col("n_found")).alias("accuracy"),
    )
