"""Content identity: digests, fingerprints of packages, bundles that hold equal bytes once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def bundle_path(content: Column) -> Column:
    """Where a referenced document is kept in a bundle; equal bytes have the same path."""
    return F.concat(F.lit("refs/"), F.left(digest(content), F.lit(32)))


def package_fingerprint(documents: DataFrame, package: str, is_root: str, content: str) -> DataFrame:
    """One fingerprint for each package: of its root's digest and the sorted digests of the rest."""
    own = digest(F.col(content))
    parts = documents.groupBy(package).agg(
        F.max(F.when(F.col(is_root), own)).alias("root"),
        F.array_sort(F.collect_set(F.when(~F.col(is_root), own))).alias("rest"),
    )
    return parts.select(package, F.sha2(F.unhex(F.concat("root", F.array_join("rest", ""))), 256).alias("fingerprint"))


def stored_once(documents: DataFrame, content: str, origin: str) -> DataFrame:
    """Each content once: digest, path, bytes, number of origins and the first of them."""
    return documents.groupBy(digest(F.col(content)).alias("digest")).agg(
        F.max(F.octet_length(content)).cast("long").alias("bytes"),
        F.count(F.lit(1)).alias("origins"),
        F.min(origin).alias("first_origin"),
    ).withColumn("path", F.concat(F.lit("refs/"), F.left("digest", F.lit(32))))


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries that don't hold: path and problem (missing, unexpected, altered). Both have path and digest."""
    both = manifest.withColumnRenamed("digest", "wanted").join(files.withColumnRenamed("digest", "found"), "path", "full")
    problem = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("found") != F.col("wanted"), "altered")
    )
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")
