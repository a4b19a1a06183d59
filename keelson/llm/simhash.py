"""Operator 1: SimHash near-duplicates, linked through vantage-point trees.

1. Each whole text gets a 64-bit fingerprint; equal fingerprints become one row.
2. A vantage-point tree over a bounded sample of fingerprints deals them into
   shards.  At a node, what lies within the radius of the vantage point goes left;
   what lies beyond goes right, and so does the rim: by the triangle inequality
   only points at distance radius + 1 - k or more can have a link at k differing
   bits on the other side.  So any two linked fingerprints meet in some shard.
3. Within a shard the same splits go on in memory until few are left, and these are
   compared exactly.  A shard returns a spanning forest of the groups it finds, never
   all pairs of a group.
4. Connected components of the forests give each fingerprint, and so each row, its
   group.

Nothing is capped: a shard that stays large because its fingerprints lie too close
to be split is dealt into blocks, and every pair of blocks is compared.

Cases: a null, empty or blank text has fingerprint zero and links like any other; a
text of one or two words has one shingle, its whole sequence; ties (exactly half)
leave a bit unset; rows with equal texts are one group, also when a doc_id is
repeated; a null doc_id is never a component_id unless no row of the group has one;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from keelson.llm.common import by_value, fresh, settle, small_batches
from keelson.llm.components import components

LINK_BITS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints the routing tree is fitted on, at most; it decides only how evenly rows are dealt.
SAMPLE = 1 << 17
#: Distinct fingerprints a shard should hold; it grows when the sample allows no finer tree.
SHARD_ROWS = 2_500
#: A shard beyond this is dealt into blocks of half as many.
SHARD_MOST = 1_000_000
#: Within a shard, so few are compared directly.
LEAF = 192


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text as an unsigned number."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and splits at \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # in pieces, so that memory doesn't follow 64 times the text
        upto = min(n, at + (1 << 16))
        spans = zip(starts[at:upto].tolist(), ends[at + SHINGLE - 1 : upto + SHINGLE - 1].tolist())
        hashes = np.array([digest(view[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """SimHash of a text column as a signed long."""
    return _fingerprints(text)


def hex_of(bits: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def split(points: np.ndarray, link_bits: int, tries: int = 12) -> tuple[int, int] | None:
    """The vantage point and radius whose larger side is smallest; none if neither side loses a fifth."""
    rng = np.random.default_rng(len(points))
    picked = points[rng.integers(0, len(points), tries)]
    noise = rng.integers(0, 1 << 64, tries, dtype=np.uint64)
    best, most = None, 0.8 * len(points)
    seen = points if len(points) <= 4096 else points[rng.integers(0, len(points), 4096)]
    scale = len(points) / len(seen)
    for vantage in [*picked, *noise, *(picked ^ np.uint64((1 << 32) - 1))]:
        inside = np.cumsum(np.bincount(np.bitwise_count(seen ^ vantage), minlength=65 + link_bits)) * scale
        for radius in range(64):
            outside = len(points) - (inside[radius - link_bits] if radius >= link_bits else 0)
            side = max(inside[radius], outside)
            if side < most:
                best, most = (int(vantage), radius), side
    return best


def sides(points: np.ndarray, vantage: int, radius: int, link_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go left and which right; the rim goes both ways."""
    far = np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)
    return np.flatnonzero(far <= radius), np.flatnonzero(far > radius - link_bits)


def grow(sample: np.ndarray, leaf_points: float, link_bits: int = LINK_BITS) -> list[tuple[int, int, int, int]]:
    """A routing tree as nodes (vantage, radius, left, right); a child below zero is leaf ``-child - 1``."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def build(points: np.ndarray) -> int:
        nonlocal leaves
        found = split(points, link_bits) if len(points) > max(leaf_points, 2) else None
        if found is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        left, right = sides(points, *found, link_bits)
        nodes[at] = (*found, build(points[left]), build(points[right]))
        return at

    build(sample)
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], link_bits: int = LINK_BITS):
    """(index of the point, leaf) for every leaf that a point belongs to."""
    todo, rows, leaves = [(0 if nodes else -1, np.arange(len(points)))], [], []
    while todo:
        at, index = todo.pop()
        if not len(index):
            continue
        if at < 0:
            rows.append(index)
            leaves.append(np.full(len(index), -at - 1, dtype=np.int32))
            continue
        vantage, radius, left, right = nodes[at]
        a, b = sides(points[index], vantage, radius, link_bits)
        todo += [(left, index[a]), (right, index[b])]
    empty = [np.empty(0, dtype=np.int64)]
    return np.concatenate(rows or empty), np.concatenate(leaves or empty)


def forest(points: np.ndarray, link_bits: int = LINK_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the groups that links make among a shard's distinct points, as pairs of indexes."""
    found: list[tuple[int, int]] = []
    root = list(range(len(points)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(a: int, b: int) -> None:
        low, high = sorted((find(a), find(b)))
        if low != high:
            root[high] = low
            found.append((a, b))

    todo = [np.arange(len(points))]
    while todo:
        index = todo.pop()
        cut = split(points[index], link_bits) if len(index) > LEAF else None
        if cut is not None:
            a, b = sides(points[index], *cut, link_bits)
            todo += [index[a], index[b]]
            continue
        own = points[index]
        if len(index) <= 2048:
            near = np.bitwise_count(own[:, None] ^ own[None, :]) <= link_bits
            if near.sum() == len(index):
                continue
        # Points leave the rest as soon as they are reached, so a dense group costs no pair list.
        rest = np.arange(len(index))
        while len(rest) > 1:
            first, rest = rest[0], rest[1:]
            frontier = [first]
            while frontier and len(rest):
                reached = np.bitwise_count(own[rest] ^ own[frontier.pop()]) <= link_bits
                if reached.any():
                    new = rest[reached]
                    rest = rest[~reached]
                    for x in new:
                        join(int(index[first]), int(index[x]))
                    frontier += new.tolist()
    return found


def links(prints: DataFrame, link_bits: int = LINK_BITS, shard_rows: int = SHARD_ROWS, most: int = SHARD_MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect what links connect; ``prints`` is settled: bits."""
    total = prints.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = prints if share == 1.0 else prints.where(F.pmod(F.xxhash64("bits"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = np.array([r[0] for r in picked.limit(2 * SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    nodes = grow(np.sort(sample), max(16, shard_rows * len(sample) / max(total, 1)), link_bits)

    @F.arrow_udf("array<int>")
    def leaves_of(bits: pa.Array) -> pa.Array:
        points = bits.to_numpy(zero_copy_only=False).view(np.uint64)
        rows, leaves = route(points, nodes, link_bits)
        order = np.argsort(rows, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(points)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaves[order], pa.int32()))

    dealt = settle(prints.select("bits", F.explode(leaves_of("bits")).alias("leaf")))
    large = {r["leaf"]: -(-2 * r["n"] // most) for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()}
    block = F.lit(1)
    for leaf, n in large.items():
        block = F.when(F.col("leaf") == leaf, n).otherwise(block)
    own = F.pmod(F.xxhash64("bits", "leaf"), F.col("blocks")).cast("int")
    dealt = (
        dealt.withColumn("blocks", block)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "bits")
    )

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        bits = np.unique(shard["bits"].to_numpy())
        pairs = np.array(forest(bits.view(np.uint64), link_bits), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": bits[pairs[:, 0]], "b": bits[pairs[:, 1]]})

    return dealt.groupBy("leaf", "low", "high").applyInPandas(link, "a long, b long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link_bits: int = LINK_BITS) -> DataFrame:
    """For each row: doc_id, text_hash, bits (the fingerprint), group (its least fingerprint) and component_id."""
    whole = F.col(f"`{text}`")
    marked = settle(
        small_batches(docs).select(
            F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), fingerprint_column(whole).alias("bits")
        )
    )
    prints = settle(marked.groupBy("bits").agg(F.min("doc_id").alias("least_id")))
    found = settle(components(links(prints.select("bits"), link_bits)))
    members = settle(
        prints.join(found.withColumnRenamed("vertex", "bits"), "bits").select("bits", "least_id", "component")
    )
    least = settle(members.groupBy("component").agg(F.min("least_id").alias("component_id")))
    named = members.join(least, "component").select("bits", F.col("component").alias("group"), "component_id")
    alone = prints.join(members.select("bits"), "bits", "left_anti").select(
        "bits", F.col("bits").alias("group"), F.col("least_id").alias("component_id")
    )
    classes = settle(named.unionAll(alone))
    return marked.join(classes, "bits").select("doc_id", "text_hash", "bits", "group", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link_bits: int = LINK_BITS) -> DataFrame:
    """One row of ``docs`` for each group: that of the least doc_id; of equal rows one stays."""
    grouped = groups(docs, doc_id, text, link_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays_id, stays_hash = fresh("stays_id", docs), fresh("stays_hash", docs)
    stays = settle(
        grouped.groupBy("group")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("k"), F.count(F.lit(1)).alias("n"))
        .select(F.col("k.doc_id").alias(stays_id), F.col("k.text_hash").alias(stays_hash), "n")
    )
    key = F.col(f"`{doc_id}`").eqNullSafe(F.col(stays_id)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(stays_hash))
    kept = docs.join(stays.drop("n"), key, "left_semi")
    # Only a repeated row can still be there twice; where none is, the texts needn't be shuffled again.
    return kept if stays.where("n > 1").isEmpty() else kept.dropDuplicates([doc_id, text])


by_value(__name__)
