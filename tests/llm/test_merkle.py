"""Manifests and proofs against plain trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from keelson.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels_of(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([H(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def path(levels, i):
    siblings = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        siblings += run[: i % 16] + run[i % 16 + 1 :]
        i //= 16
    return siblings


def folded(levels, i, digest):
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        digest, i = H(*run[: i % 16], digest, *run[i % 16 + 1 :]), i // 16
    return digest


def plain(rows):
    first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x)
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=first)
    ordered = {n: sorted(trees[n], key=lambda r: (first(r[0]), plain_leaf(r))) for n in names}
    built = {n: levels_of([plain_leaf(r) for r in ordered[n]]) for n in names}
    top = levels_of([built[n][-1][0] for n in names]) if names else []
    found = []
    for j, n in enumerate(names):
        for i, r in enumerate(ordered[n]):
            leaf = claim = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                claim = plain_leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            end = folded(top, j, folded(built[n], i, claim))
            found.append((r[0], leaf, built[n][-1][0], top[-1][0], H(*path(built[n], i), *path(top, j)), end, end == top[-1][0]))
    return sorted(found, key=str)


def got(spark, monkeypatch, rows, **names):
    from keelson.llm import entries

    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("tree", "leaf", "at", "index", "size")})
    monkeypatch.setattr(entries, "table", lambda *_: docs)
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in entries.op12_merkle(spark, "").select(*columns).collect()), key=str)


def rows_of(counts, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), sum(counts.values()))
    return [(ids.pop(), name, rng.choice(["en", None, "é"]), rng.choice([None, 5]), rng.choice([None, "", "Text É", "TEXT of it"])) for name, n in counts.items() for _ in range(n)]


@pytest.mark.parametrize(
    "counts",
    [{"one": 1}, {"a": 16, "b": 17, None: 1}, {"big": 300, "é": 2, "z": 33, "A": 256, "": 15}, {f"s{k}": 1 + k % 3 for k in range(40)}],
    ids=["lone leaf", "at the arity", "three levels", "many trees"],
)
def test_proofs_are_the_plain_ones(spark, monkeypatch, counts):
    rows = rows_of(counts)
    assert got(spark, monkeypatch, rows) == plain(rows)


def test_repeated_rows_null_ids_and_long_texts(spark, monkeypatch):
    rows = [(1, "a", "en", 3, "Abc")] * 3 + [(None, "a", None, None, None), (None, "a", "en", 1, "X"), (1, "a", "en", 3, "abd"), (2, "b", "en", 10**6, "Long " * 200_000)]
    assert got(spark, monkeypatch, rows) == plain(rows)


def test_empty_table(spark, monkeypatch):
    assert got(spark, monkeypatch, []) == []


def test_broadcasts_are_bounded(spark, monkeypatch):
    """Beyond the bound the same rows come from shuffles."""
    from keelson.llm import common

    rows = rows_of({"a": 40, "b": 20, None: 3})
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert got(spark, monkeypatch, rows) == plain(rows)
