"""Operator 13: vectors as short codes, found by partial-distance search.

A vector's components become integers, floor(scale * x), and its parts (equal,
consecutive) are each replaced by the index of the nearest entry of that part's
codebook.  Codebooks begin as the parts of the first vectors by id and are refined by
rounds of assigning and averaging, all in integers, so results don't depend on the
order of rows.

Partial-distance search: a task holds blocks of vectors against all entries of a part.
Dimensions are summed in descending variance over the codebook, some at a time; the
entry that is nearest after the first step gives the first complete distance, and a
mask drops every entry whose sum strictly exceeds the best complete distance so far.
Entries that stay to the end, ties included, have complete distances; the lowest index
among the nearest wins.

A round moves no vectors: each task sums the parts of each entry for its batches, and
the sums, at most parts x entries rows, are aggregated and come to the driver, where
the codebooks (their size is bounded by entries x dimension) are held.

Cases: a null vector, one with a null or non-finite component, and one with an integer
beyond 64 bits is dropped, as is one whose length isn't that of the first vector by id
whose length is a positive multiple of the number of parts; an empty or fully dropped
table gives no rows; fewer vectors than entries make smaller codebooks; of rows of the
same id the lesser vector comes first, and a null id comes last; repeated rows count as
often as they are there; ties go to the lower index; errors beyond a long are the
largest long; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import by_value, near, settle

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Dimensions summed before entries are dropped again, and vectors held against a codebook at once.
STEP, BLOCK = 8, 1024
MOST = (1 << 63) - 1


class Codebooks(NamedTuple):
    """Integer entries of each part: parts x entries x width nested lists; none where the table has no usable vector."""

    parts: list[list[list[int]]]
    dimension: int

    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.parts for entry in part for x in entry).encode()).hexdigest()


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where one is null, not finite or beyond 64 bits."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(1 << 63))
    return F.when(F.forall(vector, sound), scaled)


def kept(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, ints) of usable vectors, and their length (0 where there is none)."""
    rows = vectors.select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), integers(F.col(f"`{vector}`"), scale).alias("ints")
    )
    rows = rows.where((F.size("ints") > 0) & (F.size("ints") % parts == 0))
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "ints")).alias("k")).select(F.size("k.ints").alias("n")).head()
    dimension = max(first["n"] or 0, 0)
    return rows.where(F.size("ints") == dimension), dimension


def table_of(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column as a matrix: of 64-bit integers, or of Python's where distances could leave 64 bits."""
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)
    return found if safe(found) else found.astype(object)


def safe(*arrays: np.ndarray, within: int = MOST) -> bool:
    """Whether sums of squared differences of rows stay below a bound, by default that of 64 bits."""
    largest = max((int(max(a.max(), -int(a.min()))) for a in arrays if a.size), default=0)
    return 4 * largest * largest * max((a.shape[-1] for a in arrays), default=1) < within


def partial(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors from all entries over the dimensions given, exact."""
    if vectors.dtype == object or not safe(vectors, entries, within=1 << 53):
        gap = vectors[:, None, :] - entries[None, :, :]
        return (gap * gap).sum(axis=2)
    v, e = vectors.astype(float), entries.astype(float)  # whole numbers below 2 ** 53 stay exact
    return ((v * v).sum(axis=1)[:, None] - 2 * (v @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)


def nearest(vectors: np.ndarray, entries: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each vector's nearest entry, the lowest index among equals."""
    if vectors.dtype == object or entries.dtype == object or not safe(vectors, entries):
        vectors, entries = vectors.astype(object), entries.astype(object)
    spread = np.array(entries, dtype=float).var(axis=0)
    order = np.argsort(-spread, kind="stable")
    vectors, entries = vectors[:, order], entries[:, order]  # in descending variance
    chosen, errors = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors), dtype=vectors.dtype)
    for at in range(0, len(vectors), BLOCK):
        block = vectors[at : at + BLOCK]
        sums = partial(block[:, :step], entries[:, :step])
        off = block - entries[sums.argmin(axis=1)]
        best = (off * off).sum(axis=1)
        rows, names = np.nonzero(sums <= best[:, None])
        sums = sums[rows, names]
        for done in range(step, vectors.shape[1], step):
            gap = block[rows, done : done + step] - entries[names, done : done + step]
            sums = sums + (gap * gap).sum(axis=1)
            stays = sums <= best[rows]
            rows, names, sums = rows[stays], names[stays], sums[stays]
        # What stays is complete, sorted by vector and entry, and has the first guess or something nearer for each vector.
        begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        least = np.minimum.reduceat(sums, begins)
        hit = sums == np.repeat(least, np.diff(np.concatenate([begins, [len(rows)]])))
        picked, where = np.unique(rows[hit], return_index=True)
        chosen[at + picked], errors[at + picked] = names[hit][where], least
    return chosen, errors


def matrices(books: Codebooks) -> list[np.ndarray]:
    found = [np.array(part, dtype=np.int64) for part in books.parts]
    return [x if safe(x) else x.astype(object) for x in found]


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: parts go to their nearest entries, and an entry becomes the floored mean of its parts."""
    width = books.dimension // len(books.parts)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = matrices(books), {}
        for batch in batches:
            table = table_of(batch.column(0), books.dimension)
            for p, entries in enumerate(own):
                part = table[:, p * width : (p + 1) * width]
                chosen, _ = nearest(part, entries)
                order = np.argsort(chosen, kind="stable")
                names, begins, counts = np.unique(chosen[order], return_index=True, return_counts=True)
                wide = part[order].astype(object) if not len(part) * max(abs(int(part.max())), abs(int(part.min()))) < MOST else part[order]
                for name, n, total in zip(names.tolist(), counts.tolist(), np.add.reduceat(wide, begins, axis=0).tolist()):
                    n0, t0 = totals.get((p, name), (0, [0] * width))
                    totals[p, name] = n0 + n, [a + b for a, b in zip(t0, total)]
        keys = [(p, e, d) for p, e in totals for d in range(width)]
        columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [totals[k[:2]][0] for k in keys]]
        arrays = [*[pa.array(c, pa.int32()) for c in columns[:3]], pa.array(columns[3], pa.int64())]
        arrays.append(pa.array([Decimal(totals[p, e][1][d]) for p, e, d in keys], pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "place", "n", "total"])

    found = rows.select("ints").mapInArrow(sums, "part int, entry int, place int, n long, total decimal(38,0)")
    found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    after = [[list(entry) for entry in part] for part in books.parts]
    for r in found.collect():  # at most entries x dimension rows
        after[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(after, books.dimension)


def fit(rows: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks over all rows (vec_id, ints), from the first vectors by id."""
    if not dimension:
        return Codebooks([], 0)
    firsts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    width = dimension // parts
    books = Codebooks([[r["ints"][p * width : (p + 1) * width] for r in firsts] for p in range(parts)], dimension)
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (vec_id, label, ints) as vec_id, label, code (bytes of two hex digits for each part) and error."""
    count, width = len(books.parts), books.dimension // max(len(books.parts), 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matrices(books)
        for batch in batches:
            table = table_of(batch.column(2), books.dimension)
            found = [nearest(table[:, p * width : (p + 1) * width], own[p]) for p in range(count)]
            codes = ["".join(f"{x:02x}" for x in row) for row in np.stack([x[0] for x in found], axis=1).tolist()]
            errors = [min(sum(int(x) for x in row), MOST) for row in zip(*(x[1].tolist() for x in found))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select("vec_id", "label", "ints").mapInArrow(code, schema)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: the error summed over the rows of the same label, nulls together."""
    codes = settle(codes)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    totals = settle(codes.groupBy(F.col("label").alias("its_label")).agg(total.alias("label_error")))
    size = 64 * totals.count()
    return codes.join(near(totals, size), F.col("label").eqNullSafe(F.col("its_label"))).drop("its_label")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with approx: the integer vector that a code stands for."""
    if not books.parts:
        return codes.withColumn("approx", F.array().cast("array<long>"))
    table = F.array(*[F.array(*[F.array(*[F.lit(x).cast("long") for x in entry]) for entry in part]) for part in books.parts])
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approx", F.concat(*[F.get(F.get(table, F.lit(p)), index(p)) for p in range(len(books.parts))]))


by_value(__name__)
