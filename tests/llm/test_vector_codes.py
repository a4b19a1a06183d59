"""Codes against plain search over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(x * scale) for x in v], k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((far(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for j, xs in own.items():
                book[j] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found, totals = [], {}
    for i, v, k in kept:
        hits = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in hits)
        totals[k] = totals.get(k, 0) + error
        found.append((i, "".join(f"{j:02x}" for _, j in hits), error, k))
    return sorted(((i, c, e, totals[k]) for i, c, e, k in found), key=str), sha


def got(spark, rows, schema=SCHEMA):
    table = spark.createDataFrame(rows, schema).withColumns({c: F.lit(7) for c in ("ints", "code", "error", "its_label")}).repartition(3)
    kept, dimension = V.kept(table, "vec_id", "embedding", "label", V.SCALE, V.PARTS)
    books = V.fit(kept, dimension)
    out = V.with_label_errors(V.encode(kept, books))
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str), books


@pytest.mark.parametrize("n", [1, 40, 400])
def test_codes_are_the_plain_ones(spark, n):
    rng = random.Random(n)
    rows = [(k, [rng.choice([0.0, rng.gauss(0, 0.2), 0.25]) for _ in range(12)], rng.choice([None, 1, 2])) for k in rng.sample(range(1000), n)]
    rows += [(1001, None, 1), (1002, [0.1] * 11 + [None], 1), (1003, [0.1] * 11 + [float("nan")], 1), (1004, [float("-inf")] * 12, 1), (1005, [], 1)]
    rows += [rows[0], rows[0], (rows[0][0], [0.5] * 12, None)]
    found, books = got(spark, rows)
    assert (found, books.sha256()) == plain(rows)


def test_other_lengths_go_and_large_numbers_stay_exact(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([1e12, -3e9, 2.5, 0.1]) for _ in range(8)], 1) for k in range(30)]
    found, books = got(spark, rows + [(-1, [1.0] * 7, 1), (50, [1.0] * 12, 1), (51, [1e300] * 8, 1)])
    want, sha = plain(rows)
    most = (1 << 63) - 1
    assert books.sha256() == sha
    assert [r[:2] for r in found] == [r[:2] for r in want] and all(a[2] == min(b[2], most) for a, b in zip(found, want))


def test_empty_tables_and_only_unusable_vectors(spark):
    assert got(spark, [])[0] == [] and got(spark, [(1, None, 1), (2, [float("nan")] * 4, None)])[0] == []


@pytest.mark.parametrize("kind", [np.int64, object])
def test_partial_distances_find_the_nearest_and_the_lowest_index(kind):
    rng = np.random.default_rng(1)
    vectors, entries = rng.integers(-3, 3, (2500, 10)), rng.integers(-3, 3, (60, 10))
    entries[40] = entries[7]
    chosen, errors = V.nearest(vectors.astype(kind), entries.astype(kind))
    every = ((vectors[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (chosen == every.argmin(axis=1)).all() and (errors == every.min(axis=1)).all()


def test_codes_stand_for_their_entries(spark):
    rows = [(k, [k / 7, -k / 3, 0.5, k * k / 11], k % 2) for k in range(20)]
    kept, dimension = V.kept(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 1024, 4)
    books = V.fit(kept, dimension)
    for r in V.decode(V.encode(kept, books), books).collect():
        ints = [math.floor(x * 1024) for x in rows[r["vec_id"]][1]]
        assert sum((a - b) ** 2 for a, b in zip(ints, r["approx"])) == r["error"]
