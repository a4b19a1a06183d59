"""Smaller readers and writers: baselines, provider registries, cost ledgers, link sets, bundles of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASELINE = "version INT, url STRING, captured_at STRING, structure ARRAY<STRUCT<path: ARRAY<STRING>, type: STRING>>"
REGISTRY = (
    "schema_version INT, providers ARRAY<STRUCT<id: STRING, hosts: ARRAY<STRING>, spec_url: STRING, provenance_url: STRING, "
    "product: STRING, api_version: STRING, max_document_bytes: BIGINT>>"
)
LEDGER = (
    "timestamp STRING, purpose STRING, outcome STRING, prompt_fingerprint STRING, model STRING, vendor STRING, "
    "response_id STRING, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT, cost_usd DOUBLE, fee_usd DOUBLE, "
    "total_usd DOUBLE, estimated BOOLEAN, error STRING, unreadable STRING"
)
LINKSET = (
    "linkset ARRAY<STRUCT<anchor: STRING, `service-desc`: ARRAY<STRUCT<href: STRING, type: STRING>>, "
    "`service-doc`: ARRAY<STRUCT<href: STRING, type: STRING>>, item: ARRAY<STRUCT<href: STRING, type: STRING>>, "
    "`api-catalog`: ARRAY<STRUCT<href: STRING, type: STRING>>>>"
)
#: Names that a structure's type may have; ``unknown`` stands alone.
TYPES = ("array", "boolean", "null", "number", "object", "string")


def baseline_rows(structures: DataFrame, keys: list[str], url: str, captured_at: str) -> DataFrame:
    """Structures (keys, path, type) as one baseline for each key: version, url, captured_at, structure."""
    entry = F.struct("path", "type")
    found = structures.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("structure"))
    others = [k for k in keys if k != "url"]
    return found.select(*others, F.lit(1).alias("version"), F.col(url).alias("url"), F.lit(captured_at).alias("captured_at"), "structure")


def save_baselines(baselines: DataFrame, folder: str, replace: bool = False) -> None:
    """Write baselines as JSON lines; an existing folder is refused unless it is to be replaced."""
    baselines.select("version", "url", "captured_at", "structure").write.mode("overwrite" if replace else "errorifexists").json(folder)


def load_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """url, path, type and problem (null if the entry holds) of every entry of baselines of version 1."""
    rows = spark.read.schema(BASELINE).json(folder).select("version", "url", F.explode("structure").alias("e")).select("version", "url", "e.*")
    counted = rows.groupBy("url", "path").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("n"), F.min("type").alias("type"))
    parts = F.split("type", r"\|")
    known = F.forall(parts, lambda t: t.isin(*TYPES)) & (F.size(F.array_distinct(parts)) == F.size(parts))
    problem = (
        F.when(F.col("version") != 1, "version").when(F.col("n") > 1, "repeated_path")
        .when((F.col("type") != "unknown") & ~known, "type")
    )
    return counted.select("url", "path", "type", problem.alias("problem"))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row for each provider and exact host: host, id, spec_url, provenance_url, product, api_version, allowance."""
    providers = spark.read.schema(REGISTRY).option("multiLine", "true").json(path).where("schema_version = 1")
    one = providers.select(F.explode("providers").alias("p"))
    return one.select(
        F.explode("p.hosts").alias("host"), "p.id", "p.spec_url", "p.provenance_url", "p.product", "p.api_version",
        F.col("p.max_document_bytes").alias("allowance"),
    )


def providers_of(targets: DataFrame, registry: DataFrame) -> DataFrame:
    """All mappings of each target's exact host, with the largest allowance of each contract's URL."""
    largest = registry.groupBy("spec_url").agg(F.max("allowance").alias("allowance"))
    return targets.join(registry.drop("allowance"), "host").join(largest, "spec_url")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON-lines ledgers; a line that can't be read has it in ``unreadable`` and nothing else."""
    return spark.read.schema(LEDGER).option("columnNameOfCorruptRecord", "unreadable").json(path)


def append_ledger(entries: DataFrame, path: str) -> None:
    """Append entries to a ledger."""
    entries.write.mode("append").json(path)


def worst_case_usd(chars: Column, most_output: int, input_rate: float, output_rate: float) -> Column:
    """The most that a call may cost: three characters a token in, all tokens out; rates are for a million tokens."""
    return (F.ceil(chars / 3) * F.lit(input_rate) + F.lit(most_output * output_rate)) / F.lit(1e6)


def linkset_links(documents: DataFrame, content: str = "content", contexts: int = 200, links: int = 20) -> DataFrame:
    """Links of RFC 9727 link sets: the other columns, anchor, relation, href, type; bounds are those of the format's reader."""
    kept = [c for c in documents.columns if c != content]
    parsed = documents.select(*kept, F.from_json(content, LINKSET).alias("parsed"))
    context = parsed.select(*kept, F.explode(F.slice("parsed.linkset", 1, contexts)).alias("c"))
    relations = F.create_map(
        *(x for r in ("service-desc", "service-doc", "item", "api-catalog") for x in (F.lit(r), F.slice(F.col(f"c.`{r}`"), 1, links)))
    )
    of_relation = context.select(*kept, "c.anchor", F.explode(relations).alias("relation", "targets"))
    return of_relation.select(*kept, "anchor", "relation", F.explode("targets").alias("t")).select(*kept, "anchor", "relation", "t.href", "t.type")


def unsafe_paths(files: DataFrame) -> DataFrame:
    """Paths of a bundle (bundle, path) that can't be kept: path and problem.

    Absolute or climbing paths, odd characters, two paths that differ in case only,
    and a file where another path needs a folder; the last two by grouping and an
    equi-join on the exploded folders.
    """
    form = F.when(~F.col("path").rlike(r"^[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*$") | F.col("path").rlike(r"(?:^|/)\.\.?(?:/|$)"), "form")
    shaped = files.select("bundle", "path", form.alias("problem")).where("problem IS NOT NULL")
    lower = files.withColumn("lower", F.lower("path"))
    twice = lower.groupBy("bundle", "lower").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    parts = F.split("path", "/")
    folders = files.withColumn("depth", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))))
    folders = folders.where(F.size(parts) > 1).select("bundle", F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("path")).distinct()
    clash = files.join(folders, ["bundle", "path"], "left_semi")
    return shaped.unionByName(twice.where("n > 1").select("bundle", "path", F.lit("case").alias("problem"))).unionByName(
        clash.select("bundle", "path", F.lit("folder").alias("problem"))
    )


def described_as(content: Column) -> Column:
    """The kind of API description that a JSON text is, or null: by the members that each format must have."""
    has = lambda path: F.get_json_object(content, path).isNotNull()
    return (
        F.when(F.startswith(F.get_json_object(content, "$.openapi"), F.lit("3.")), "openapi3")
        .when(F.startswith(F.get_json_object(content, "$.swagger"), F.lit("2")), "swagger2")
        .when(has("$.asyncapi"), "asyncapi")
        .when(has("$.smithy"), "smithy")
        .when(F.get_json_object(content, "$.kind") == "discovery#restDescription", "google_discovery")
        .when(F.contains(F.get_json_object(content, "$.info.schema"), F.lit("getpostman.com")), "postman")
    )
