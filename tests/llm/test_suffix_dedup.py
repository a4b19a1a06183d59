"""Repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import suffix_dedup as S


def plain(rows, length=50):
    """(doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, sha256 of what stays), by a table of all passages."""
    held = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, b in held:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(least.get(w, float("inf")), order(i))
    found = []
    for i, b in held:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < order(i):
                gone[k : k + length] = b"\x01" * length
        n = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        found.append((i, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def got(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = S.digested(docs, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed):
    """Texts that share passages at all offsets, short periods, copies, passages of 49 to 51 bytes, and two-byte characters."""
    rng = random.Random(seed)
    word = lambda n, letters="ab cd": "".join(rng.choice(letters) for _ in range(n))
    shared = [word(rng.choice([49, 50, 51, 60, 90, 200]), "abcdefgh ") for _ in range(12)]
    rows = []
    for i in range(60):
        t = "".join(rng.choice([lambda: rng.choice(shared), lambda: word(rng.randint(0, 90), "xyzuvw é"), lambda: "ab" * rng.randint(0, 60), lambda: "=" * rng.randint(0, 130)])() for _ in range(rng.randint(0, 7)))
        rows.append((i * 7 % 61, t))
    return rows + [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (5, "q" * 50), (204, "q" * 49), (205, "q" * 51), (206, "\x00" * 120), (207, "\x00" * 60)]


@pytest.mark.parametrize("seed", range(3))
def test_whole_job_is_the_plain_one(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("bucket_rows", [3, 40])
def test_hot_tokens_are_split_and_runs_straddle_buckets(spark, monkeypatch, bucket_rows):
    """Buckets of a few rows, and chunks of a few documents, so that runs are in many chunks."""
    monkeypatch.setattr(S, "CHUNK_BYTES", 400)
    monkeypatch.setattr(S, "LEAST_CHUNK_BYTES", 100)
    monkeypatch.setattr(S, "LEAST_BUCKET_ROWS", 5)
    rows, plans, plan_for = corpus(9), [], S.plan_for
    monkeypatch.setattr(S, "plan_for", lambda *args: plans.append(plan_for(*args)) or plans[0])
    assert got(spark, rows, bucket_rows=bucket_rows) == plain(rows)
    (plan,) = plans
    assert plan.hot and len(plan.splitters) > 20
    assert bucket_rows == 40 or any(S.CHILDREN[n] is None for n in plan.hot)


def test_repeated_rows_and_null_ids(spark):
    text = "a passage of more than fifty bytes that stands in several rows of the table"
    rows = [(3, text), (3, text), (3, text + " and more"), (None, text), (None, "x" + text), (4, "y" + text)]
    assert got(spark, rows) == plain(rows)


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 100)
    rng = random.Random(1)
    long = "".join(rng.choice("abcde fgh") for _ in range(3000))
    rows = [(1, long), (2, long[100:180] + "-" + long[1111:1190] + long[90:141]), (3, "z" + long)]
    assert got(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "t" * 70)], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("chunk", "bucket", "payload", "drawn", "ids")})
    row = S.cut(docs).collect()[0]
    assert (row["chunk"], row["bucket"], row["ids"], row["n_removed"], bytes(row["kept"])) == (7, 7, 7, 0, b"t" * 70)
    assert S.cut(docs.limit(0)).count() == 0


def test_order_of_rows_is_that_of_their_bytes():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, shared = S.multikey(words)
    assert [tuple(r) for r in words[order].tolist()] == sorted(map(tuple, words.tolist()))
    for k in range(1, 500):
        a, b = words[order[k - 1]], words[order[k]]
        assert shared[k] == next((j for j in range(4) if a[j] != b[j]), 4)
