import random

import numpy as np
import pytest
import xxhash

from keelson.llm import simhash


def plain_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Component by brute force: index -> least index reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One TWO", "a b c", "é É Ä b\x0bc d e f", "x y z " * 50])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_routing_and_forests_lose_no_link():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(1500)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:400]]
    chain = [base[0]]
    for k in range(0, 60, 2):
        chain.append(chain[-1] ^ (3 << k))
    points = np.unique(np.array(base + near + chain, dtype=np.uint64))
    want = plain_groups([int(p) for p in points])
    nodes = simhash.grow(points, 100)
    rows, leaves = simhash.route(points, nodes)
    assert leaves.max() > 8 and np.bincount(leaves).max() < 700
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for leaf in np.unique(leaves):
        own = rows[leaves == leaf]
        for a, b in simhash.forest(points[own]):
            a, b = find(own[a]), find(own[b])
            root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(points))] == want


def test_dense_shard_stays_exact():
    points = np.unique(np.array([(1 << a) | (1 << b) for a in range(64) for b in range(64)], dtype=np.uint64))
    pairs = simhash.forest(points)
    assert len({x for p in pairs for x in p}) == len(points) and len(pairs) == len(points) - 1


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(80, 200))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:15] + [None, "", " ", "a", "A", "a b"]
    rows = [(i * 7 % 1000, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (None, "only null here ok", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    got = simhash.groups(docs).collect()
    assert len(got) == len(rows)
    prints = [plain_print(t) for _, t, _ in rows]
    classes = plain_groups(prints)
    least = {}
    for (i, _, _), c in zip(rows, classes):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((i is not None, i or 0, f"{p:016x}", least.get(c)) for (i, _, _), p, c in zip(rows, prints, classes))
    mine = sorted(
        (r.doc_id is not None, r.doc_id or 0, f"{r.bits & (1 << 64) - 1:016x}", r.component_id) for r in got
    )
    assert str(mine) == str(want)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(classes))


def test_small_shards_and_blocks_give_the_same(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(300)]
    points = sorted({p ^ (1 << rng.randrange(60)) for p in base for _ in range(3)} | set(base))
    prints = simhash.settle(spark.createDataFrame([(p,) for p in points], "bits long"))
    from keelson.llm.components import components

    def classes(**how):
        return {r.vertex: r.component for r in components(simhash.links(prints, **how)).collect()}

    whole = classes()
    assert whole == classes(shard_rows=40) == classes(shard_rows=10**6, most=100)
    want = plain_groups(points)
    assert {p: points[c] for p, c in zip(points, want) if want.count(c) > 1} == whole


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(docs).count() == 0 and simhash.deduplicate(docs).count() == 0
