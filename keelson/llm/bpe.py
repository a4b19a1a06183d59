"""Operator 3: byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own.  A segment tree over the
piece's byte positions keeps the smallest pair rank, leftmost on ties; one merge
is three point updates of logarithmic cost, so a piece of n bytes takes
O(n log n) whatever its content.  A long piece has a tree of its own, whose nodes have
sixteen children, as their minimum is one call; pieces of up to 17 bytes are merged
many at a time: each is a row that holds a binary tree of sixteen leaves, and a step
merges one pair of every row, with point updates along the paths as array operations.

Cases: a null text encodes to no ids (and decodes to empty bytes); an empty text
likewise; very long texts are split lazily, so memory follows the ids only; equal
rows get equal ids; extra columns pass through and a clashing output name is
refused; an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from keelson.llm.common import by_value, small_batches

#: Characters split at a time; a longer text is split lazily.
CHARS_AT_ONCE = 1 << 20
#: Distinct pieces remembered by one task; beyond it the memory starts afresh (results don't depend on it).
PIECE_MEMORY = 200_000
#: Pieces of up to so many bytes are merged many at a time, in trees of LEAVES leaves and LEVELS levels above them.
SHORT_PIECE, LEAVES, LEVELS = 17, 16, 4
ROWS_AT_ONCE = 8192
NEVER = 1 << 62


def load_ranks(rank_file: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64-token rank``."""
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


#: Children of a node of the segment tree, as a power of two; their minimum is taken by one call.
FAN = 4


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the pair of least rank, leftmost first, until no pair has a rank."""
    n = len(piece)
    rank = ranks.get
    whole = rank(piece)
    if whole is not None:
        return [whole]
    if n < 2:
        return [ranks[piece]] if n else []
    # A leaf's key is rank * n + position: the least key is the least rank, leftmost on ties.
    leaves = []
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        leaves.append(NEVER if r is None else r * n + i)
    levels = [leaves]
    while len(levels[-1]) > 1 << FAN:
        below = levels[-1]
        levels.append([min(below[i : i + (1 << FAN)]) for i in range(0, len(below), 1 << FAN)])
    top, inner = levels[-1], len(levels) > 1
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    while (least := min(top)) < NEVER:
        i = least % n
        gone = after[i]
        after[i] = end = after[gone]
        p = before[i]
        if end < n:
            leaves[gone] = NEVER
            before[end] = i
            r = rank(piece[i : after[end]])
            leaves[i] = NEVER if r is None else r * n + i
        else:
            leaves[i] = NEVER
            if gone < n - 1:
                leaves[gone] = NEVER
        if p >= 0:
            r = rank(piece[p:end])
            leaves[p] = NEVER if r is None else r * n + p
        if inner:
            changed = (p if p >= 0 else i, i, gone)
            for below, above in zip(levels, levels[1:]):
                changed = tuple({x >> FAN for x in changed})
                for x in changed:
                    if x < len(above):
                        above[x] = min(below[x << FAN : (x + 1) << FAN])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Merger:
    """Merges pieces by given ranks: long ones each in a tree of its own, short ones many at a time.

    Each step merges the least pair of every row that has one left.  Only pairs of
    tokens occur, so a pair's rank is looked up by the ids of its tokens.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        get = ranks.get
        pairs = [
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if (left := get(token[:at])) is not None and (right := get(token[at:])) is not None
        ]
        found = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pairs = np.append(found[:, 0], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(found[:, 1], -1)
        self.bytes = np.array([get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of pairs at their places; NEVER where the pair has no rank."""
        wanted = left << 32 | right
        found = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[found] == wanted, self.pair_ranks[found] << 5 | at, NEVER)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as int32 bytes."""
        out: list[bytes | None] = [None] * len(pieces)
        short = []
        for at, piece in enumerate(pieces):
            if len(piece) <= SHORT_PIECE and piece not in self.ranks:
                short.append(at)
            else:
                out[at] = np.array(merge_piece(piece, self.ranks), dtype=np.int32).tobytes()
        for at in range(0, len(short), ROWS_AT_ONCE):
            chosen = short[at : at + ROWS_AT_ONCE]
            for row, ids in zip(chosen, self._merge_short([pieces[x] for x in chosen])):
                out[row] = ids
        return out

    def _merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces at once: a row is one piece's tree, node x of it above 2x and 2x + 1, its leaves from LEAVES on."""
        wide, n = SHORT_PIECE, len(pieces)
        sizes = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(n, wide)
        token = self.bytes[text]
        place = np.arange(wide)
        tree = np.full((n, 2 * LEAVES), NEVER)
        leaves = tree[:, LEAVES:]
        leaves[:] = self.keys(token[:, :-1], token[:, 1:], place[:-1])
        leaves[place[1:] >= sizes[:, None]] = NEVER
        for x in range(LEAVES - 1, 0, -1):
            np.minimum(tree[:, 2 * x], tree[:, 2 * x + 1], out=tree[:, x])
        alive = place < sizes[:, None]
        after = np.tile(np.arange(1, wide + 2, dtype=np.int8), (n, 1))
        before = np.tile(np.arange(-1, wide, dtype=np.int8), (n, 1))
        row = np.arange(n)
        while len(row):
            top = tree[row, 1]
            some = top < NEVER
            row, top = row[some], top[some]
            i, merged = top & 31, top >> 5
            gone = after[row, i].astype(np.int64)
            end = after[row, gone]
            left = before[row, i].astype(np.int64)
            token[row, i] = merged
            alive[row, gone] = False
            after[row, i] = end
            before[row, end] = i
            # Three leaves change: that of the byte that went, that of the merged pair, that of the pair before it.
            inner = gone < LEAVES
            leaves[row[inner], gone[inner]] = NEVER
            new = np.full(len(row), NEVER)
            more = end < sizes[row]
            new[more] = self.keys(merged[more], token[row[more], end[more]], i[more])
            leaves[row, i] = new
            more = left >= 0
            r, x = row[more], left[more]
            leaves[r, x] = self.keys(token[r, x], merged[more], x)
            # Point updates along the paths to the root, a level at a time for all rows.
            trees = np.concatenate([row, row[inner], r])
            at = np.concatenate([i, gone[inner], x]) + LEAVES
            for _ in range(LEVELS):
                at = at >> 1
                tree[trees, at] = np.minimum(tree[trees, 2 * at], tree[trees, 2 * at + 1])
        ends = np.concatenate([[0], np.cumsum(alive.sum(axis=1))]) * 4
        ids = token[alive].astype(np.int32).tobytes()
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


class Encoder:
    """Encodes whole texts; remembers the ids of the pieces that one task has seen, within a bound."""

    def __init__(self, merger: Merger, pattern: str) -> None:
        self.merger, self.pattern, self.known = merger, regex.compile(pattern, regex.V1), {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) > PIECE_MEMORY:
            self.known = {}
        new = list(set(pieces).difference(self.known))
        self.known.update(zip(new, self.merger.merge([p.encode() for p in new])))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as int32 bytes."""
        out, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= CHARS_AT_ONCE):
                chars += len(texts[end])
                end += 1
            if chars > CHARS_AT_ONCE:
                out.append(b"".join(self._long(texts[start])))
            else:
                split = [self.pattern.findall(t) for t in texts[start:end]]
                self._learn(list(chain.from_iterable(split)))
                known = self.known.__getitem__
                out += [b"".join(map(known, pieces)) for pieces in split]
            start = end
        return out

    def _long(self, text: str) -> Iterator[bytes]:
        found = (m.group() for m in self.pattern.finditer(text))
        while pieces := list(islice(found, CHARS_AT_ONCE >> 3)):
            self._learn(pieces)
            yield b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()


def encode_column(text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """Array of ids of a text column, by the given ranks and split pattern."""
    merger = Merger(ranks)
    state: dict[str, Encoder] = {}

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        if "encoder" not in state:
            state["encoder"] = Encoder(merger, pattern)
        rows = state["encoder"].encode_all([t or "" for t in texts.to_pylist()])
        ends = np.cumsum([0, *(len(r) >> 2 for r in rows)])
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32))
        )

    return encode(text)


def decode_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of an id column; null ids decode to nothing.  An unknown id fails the task."""
    state: dict[str, pa.Array] = {}
    packed = (list(ranks), list(ranks.values()))

    @F.arrow_udf(BinaryType())
    def decode(rows: pa.Array) -> pa.Array:
        if "table" not in state:
            table = [None] * (max(packed[1], default=-1) + 1)
            for token, rank in zip(*packed):
                table[rank] = token
            state["table"] = pa.array(table, pa.large_binary())
        # The tokens taken in order lie one after another in one buffer; a text is the range of its tokens.
        rows = pa.concat_arrays([rows, pa.array([], rows.type)])
        tokens = state["table"].take(rows.values)
        if tokens.null_count:
            raise ValueError("an id is in no rank")
        if not len(rows):
            return pa.array([], pa.binary())
        ends = np.zeros(len(rows) + 1)
        if len(tokens):
            ends = np.frombuffer(tokens.buffers()[1], np.int64)[rows.offsets.to_numpy()]
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), tokens.buffers()[2]]
        )

    # Were one Python function called on the other's column directly, Spark would chain them and encode twice.
    return decode(F.coalesce(ids, F.array().cast("array<int>")))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "token_ids"
) -> DataFrame:
    """``docs`` with the ids of every whole text added as ``out``."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} is there already")
    return small_batches(docs).withColumn(out, encode_column(F.col(f"`{text}`"), ranks, pattern))


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the decoded bytes of the id column added as ``out``."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} is there already")
    return small_batches(docs).withColumn(out, decode_column(F.col(f"`{ids}`"), ranks))


def digests(ids: str = "token_ids", decoded: str = "decoded") -> list[Column]:
    """Length and digests of an encoding, computed by the JVM."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]


by_value(__name__)
