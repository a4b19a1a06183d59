"""Operator 12: a Merkle manifest of a dataset, with proofs by coordinate lookup.

1. Every row becomes a leaf: SHA-256 over its fields, each ``-`` if null, else byte
   count, ``:`` and value.  From here on only digests move, no texts.
2. Leaves get their index within their tree (one for each source) from a range
   partitioning by source and id: position in the part, less where the source begins
   there, plus the source's rows in earlier parts.  No window holds a whole source.
3. Sixteen neighbours are a run, and a run's digest is a node of the next level.  The
   node table holds one row for each run: tree, level, number, digests in order.  The
   roots of the sources are the leaves of one more tree, over the sources in order.
4. A proof is looked up by coordinates: from index and tree size follow level, run and
   slot of every sibling.  The leaves of one run need the same coordinates above
   themselves, so a run explodes them once; they are joined with the node table,
   ordered by level, and each leaf folds them.

Cases: null fields are ``-``; an empty text is ``0:``; a text of any length is hashed
where it is read; a null source is a tree of its own and comes first; a null id comes
first in its tree; rows of the same id are ordered by their leaves, and repeated rows
are leaves of their own; a tree of one leaf has that leaf as root and adds no sibling;
a proof without siblings is the hash of nothing; an empty table has no root and no
proofs; columns beyond the fields are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import near, settle

#: Children of a node, and the bits that a slot among them takes.
ARITY, BITS = 16, 4
#: What a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes that a row of the small tables takes at least when it is broadcast.
ROW_BYTES = 64


class Manifest(NamedTuple):
    """The materialised trees: level-0 runs with their leaves, runs of higher levels, trees with their place and root."""

    leaf_runs: DataFrame  # tree, size, run, members: array of (slot, doc_id, leaf, claim)
    runs: DataFrame  # tree, level, run, digests
    trees: DataFrame  # tree, subroot, top_path: array of (slot, digests)
    root: str | None


def digest_of(*fields: Column) -> Column:
    """Leaf over fields in order: each ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def indexed(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (tree, ...) with index (from 0, by ``order``) and size of their tree."""
    keys = ["tree", *order]
    dealt = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = settle(dealt.withColumn("part", F.shiftright("at", 33)))
    own = Window.partitionBy("tree")
    starts = settle(
        dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("size", F.sum("n").over(own))
        .select(F.col("tree").alias("its_tree"), F.col("part").alias("its_part"), "size", (F.col("before") - F.col("first")).alias("shift"))
    )
    same = F.col("tree").eqNullSafe(F.col("its_tree")) & (F.col("part") == F.col("its_part"))
    found = dealt.join(near(starts, ROW_BYTES * starts.count()), same)
    return found.withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "its_tree", "its_part", "shift")


def gathered(nodes: DataFrame, *kept: str) -> DataFrame:
    """Runs of neighbouring nodes: tree, size, run, members (slot and the kept columns, in order)."""
    member = F.struct((F.col("index") % ARITY).cast("int").alias("slot"), *kept)
    return nodes.groupBy("tree", "size", F.shiftright("index", BITS).alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"))


def grown(leaf_runs: DataFrame, digests: Column) -> tuple[DataFrame, DataFrame]:
    """All runs of all levels (tree, level, run, digests), and the root of each tree (tree, digest)."""
    largest, lone = leaf_runs.agg(F.max("size")).head()[0] or 0, F.col("size") == 1
    runs = leaf_runs.select("tree", "size", F.lit(0).alias("level"), "run", digests.alias("digests"))
    roots, levels, level = [runs.where(lone).select("tree", F.col("digests")[0].alias("digest"))], [], 0
    runs = runs.where(~lone)
    while largest > 1:
        levels.append(runs.drop("size"))
        above = runs.select("tree", F.shiftright(F.col("size") + (ARITY - 1), BITS).alias("size"), F.col("run").alias("index"), joined(F.col("digests")).alias("digest"))
        above = settle(above)
        roots.append(above.where(lone).select("tree", "digest"))
        level, largest = level + 1, -(-largest // ARITY)
        runs = gathered(above.where(~lone), "digest").select("tree", "size", F.lit(level).alias("level"), "run", F.col("members.digest").alias("digests"))
        runs = settle(runs)
    united = lambda frames: frames[0] if len(frames) == 1 else united([frames[0].unionByName(frames[1]), *frames[2:]])
    return united(levels or [runs.drop("size")]), united(roots)


def looked_up(wanted: DataFrame, runs: DataFrame, depth: Column, index: Column, first: int, *keys: str) -> DataFrame:
    """``keys`` and path: the runs that lie above ``index`` (of level ``first``) in the node table, by their coordinates.

    ``depth`` is the number of levels that the tree has runs in; a run's place in the
    path is its level, the slot says which of its digests the path comes from.
    """
    levels = F.when(depth > first, F.sequence(F.lit(first), depth - 1))
    at = wanted.select(*keys, "tree", index.alias("node"), F.explode(levels).alias("level"))
    node = F.expr(f"shiftright(node, {BITS} * (level - {first}))")
    at = at.select(
        *[F.col(k).alias(f"of_{k}") for k in keys], F.col("tree").alias("of"), F.col("level").alias("at_level"),
        F.shiftright(node, BITS).alias("at_run"), (node % ARITY).cast("int").alias("slot"),
    )
    same = F.col("of").eqNullSafe(F.col("tree")) & (F.col("at_level") == F.col("level")) & (F.col("at_run") == F.col("run"))
    found = at.join(runs, same).select(*[f"of_{k}" for k in keys], F.struct("level", "slot", "digests").alias("step"))
    steps = F.transform(F.sort_array(F.collect_list("step")), lambda s: F.struct(s["slot"].alias("slot"), s["digests"].alias("digests")))
    return settle(found.groupBy(*[f"of_{k}" for k in keys]).agg(steps.alias("path")))


def depth_of(size: Column) -> Column:
    """Levels that have runs in a tree of so many leaves: how often it can be cut to a sixteenth until one node is left."""
    digits = F.length(F.hex(size - 1))  # 16 leaves need one level, 17 need two
    return F.when(size > 1, digits).otherwise(0)


def build(leaves: DataFrame) -> Manifest:
    """The trees over ``leaves``: tree, doc_id, leaf, claim (the digest that a proof is to be folded from)."""
    leaves = settle(leaves)
    leaf_runs = settle(gathered(indexed(leaves, "doc_id", "leaf"), "doc_id", "leaf", "claim"))
    runs, roots = grown(leaf_runs, F.col("members.leaf"))
    runs = settle(runs)
    # The trees are leaves of one tree, in the order of their names.
    tops = roots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest")
    top_runs = settle(gathered(indexed(settle(tops), "name"), "name", "digest"))
    above, top = grown(top_runs, F.col("members.digest"))
    root = top.head()
    names = top_runs.select("tree", "size", "run", F.explode("members").alias("m")).select(
        "tree", "size", "m.name", F.col("m.digest").alias("subroot"), (F.col("run") * ARITY + F.col("m.slot")).alias("index")
    )
    paths = looked_up(names, settle(above), depth_of(F.col("size")), F.col("index"), 0, "index")
    trees = names.join(paths, F.col("index") == F.col("of_index"), "left").select(F.col("name").alias("tree"), "subroot", F.col("path").alias("top_path"))
    return Manifest(leaf_runs, runs, settle(trees), root["digest"] if root else None)


def proofs(manifest: Manifest) -> DataFrame:
    """For each leaf: doc_id, leaf, claim, subroot and path (the runs on its way to the root, in order, each with its slot)."""
    runs = manifest.leaf_runs
    own = looked_up(runs, manifest.runs, depth_of(F.col("size")), F.col("run"), 1, "tree", "run")
    trees = manifest.trees.withColumnRenamed("tree", "named")
    width = manifest.trees.agg(F.sum(ROW_BYTES * (1 + F.coalesce(F.size(F.flatten("top_path.digests")), F.lit(0))))).head()[0] or 0
    same = F.col("tree").eqNullSafe(F.col("of_tree")) & (F.col("run") == F.col("of_run"))
    found = (
        runs.join(own, same, "left").join(near(trees, width), F.col("tree").eqNullSafe(F.col("named")))
        .select("size", F.col("members.leaf").alias("digests"), "path", "top_path", "subroot", F.explode("members").alias("m"))
    )
    none = F.array().cast("array<struct<slot:int,digests:array<string>>>")
    first = F.when(F.col("size") > 1, F.array(F.struct(F.col("m.slot").alias("slot"), "digests"))).otherwise(none)
    whole = F.concat(first, F.coalesce("path", none), F.coalesce("top_path", none))
    return found.select("m.doc_id", "m.leaf", "m.claim", "subroot", whole.alias("path"))


def siblings(path: Column) -> Column:
    """The digests of a proof in order, without the slots that the path itself comes from."""
    return F.flatten(F.transform(path, lambda p: F.filter(p["digests"], lambda d, i: i != p["slot"])))


def fold(start: Column, path: Column) -> Column:
    """The root that a digest leads to along a path."""
    replaced = lambda p, held: F.transform(p["digests"], lambda d, i: F.when(i == p["slot"], held).otherwise(d))
    return F.aggregate(path, start, lambda held, p: joined(replaced(p, held)))
