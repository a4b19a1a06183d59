"""Structures of JSON documents: field paths with their types, and how two structures differ.

A small Arrow function turns one document into its (path, type) pairs; merging the
pairs of many documents, the rule for empty arrays and the comparison of versions
are aggregations and joins.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from keelson.operators.staging import spread, staged

ELEMENT = "[]"
UNKNOWN = "unknown"
ADDED, ABSENT, TYPE_CHANGED = "added", "absent", "type_changed"

SEEN = ArrayType(
    StructType(
        [StructField("path", ArrayType(StringType())), StructField("type", StringType()), StructField("filled", BooleanType())]
    )
)
SEEN_ARROW = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("type", pa.string()), ("filled", pa.bool_())]))


def type_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def _unique(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("duplicate_key")
    if ELEMENT in found:
        raise ValueError("reserved_key")
    return found


def _no_constant(name: str) -> None:
    raise ValueError("not_a_number")


def found_in(text: str | None) -> tuple[set | None, str | None]:
    """Distinct (path, type, whether an array there had elements) of one document, or the code of its rejection."""
    try:
        value = json.loads(text or "", object_pairs_hook=_unique, parse_constant=_no_constant)
    except json.JSONDecodeError:
        return None, "invalid_json"
    except RecursionError:
        return None, "too_deep"
    except ValueError as error:
        return None, str(error).split(":")[0].replace(" ", "_").lower()
    if not isinstance(value, (dict, list)):
        return None, "scalar_root"
    found: set[tuple[tuple[str, ...], str, bool]] = set()
    todo: list[tuple[tuple[str, ...], object]] = [((), value)]
    while todo:
        path, value = todo.pop()
        kind = type_of(value)
        found.add((path, kind, bool(value) if kind == "array" else False))
        if kind == "object":
            todo += [((*path, key), child) for key, child in value.items()]
        elif kind == "array":
            todo += [((*path, ELEMENT), child) for child in value]
    return found, None


def seen_in(text: str | None) -> tuple[list[dict] | None, str | None]:
    """``found_in`` as rows."""
    found, code = found_in(text)
    return None if found is None else [{"path": list(p), "type": t, "filled": f} for p, t, f in found], code


def with_structure(docs: DataFrame, json_column: str = "json") -> DataFrame:
    """``docs`` with ``seen`` (an array of path, type, filled; null if rejected) and ``rejection`` (its code)."""
    result = StructType([StructField("seen", SEEN), StructField("rejection", StringType())])

    @F.arrow_udf(result)
    def parse(texts: pa.Array) -> pa.Array:
        rows = [seen_in(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], SEEN_ARROW), pa.array([r[1] for r in rows], pa.string())], ["seen", "rejection"]
        )

    if clash := {c.lower() for c in docs.columns} & {"seen", "rejection"}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    result_of_row = parse(F.col(json_column))
    return docs.select(*docs.columns, F.struct(result_of_row.alias("r")).alias("_parsed_structure")).select(
        *docs.columns, F.col("_parsed_structure.r.seen").alias("seen"), F.col("_parsed_structure.r.rejection").alias("rejection")
    )


def seen_pairs(docs: DataFrame, keys: list[str], json_column: str = "json") -> DataFrame:
    """keys, path, type and filled of all documents that can be read; what documents of one batch share comes once."""
    kept = docs.select(*keys).schema.fields
    types = [f.dataType for f in kept]
    names = [*keys, "path", "type", "filled"]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, texts = (c.to_pylist() for c in batch.columns)
            found = {(*key, *pair) for *key, text in zip(*own, texts) for pair in found_in(text)[0] or ()}
            if found:
                columns = list(zip(*found))
                arrays = [pa.array(c, batch.schema.field(i).type) for i, c in enumerate(columns[: len(keys)])]
                arrays += [pa.array(map(list, columns[-3]), pa.list_(pa.string())), pa.array(columns[-2], pa.string()), pa.array(columns[-1], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join([*(f"`{f.name}` {t.simpleString()}" for f, t in zip(kept, types)), "path array<string>, type string, filled boolean"])
    return docs.select(*keys, json_column).mapInArrow(collect, schema)


def structures(docs: DataFrame, keys: list[str], json_column: str = "json") -> DataFrame:
    """The merged structure of each group of documents: keys, path, type (a sorted union joined by |).

    Documents that can't be read are left out; ``with_structure`` names them.  Types
    are collected map-side, at most seven for a path, so a group may be of any size.
    """
    pairs = seen_pairs(spread(docs), keys, json_column)
    merged = pairs.groupBy(*keys, "path").agg(
        F.collect_set("type").alias("types"), F.max(F.when(F.col("type") == "array", F.col("filled"))).alias("filled")
    )
    own = F.struct("path", F.array_join(F.array_sort("types"), "|").alias("type"))
    empty = F.when(F.col("filled") == F.lit(False), F.struct(F.concat("path", F.array(F.lit(ELEMENT))).alias("path"), F.lit(UNKNOWN).alias("type")))
    rows = merged.select(*keys, F.explode(F.array_compact(F.array(F.when(F.size("path") > 0, own), empty))).alias("r"))
    return rows.select(*keys, "r.path", "r.type")


def prefixes(path: Column) -> Column:
    """All prefixes of a path that aren't empty, itself included."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))


def compare(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Findings between two structures: keys, path, kind, old_type, new_type.

    A path below an array that one side only saw empty is no finding: prefixes are
    exploded and met by an equi-join, so no path is compared with every other.
    """
    keys = keys or []
    side = lambda df, n: df.select(*keys, "path", F.lit(n).alias("side"), "type")
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("type")))
    # One aggregate pairs both sides; it is staged, as it is read three times below.
    both = staged(side(old, 0).unionByName(side(new, 1)).groupBy(*keys, "path").agg(of(0).alias("old_type"), of(1).alias("new_type")))
    unseen = both.where((F.col("old_type") == UNKNOWN) | (F.col("new_type") == UNKNOWN)).select(*keys, F.col("path").alias("prefix"))
    hidden = both.select(*keys, "path", F.explode(prefixes(F.col("path"))).alias("prefix")).join(
        unseen, [*keys, "prefix"], "left_semi"
    )
    kind = (
        F.when(F.col("old_type").isNull(), ADDED)
        .when(F.col("new_type").isNull(), ABSENT)
        .when(F.col("old_type") != F.col("new_type"), TYPE_CHANGED)
    )
    found = both.withColumn("kind", kind).where("kind IS NOT NULL")
    return found.join(hidden.select(*keys, "path").distinct(), [*keys, "path"], "left_anti").select(
        *keys, "path", "kind", "old_type", "new_type"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
