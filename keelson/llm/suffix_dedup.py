"""Operator 11: removal of repeated passages through a distributed, sparse suffix array.

A passage is any string of LENGTH bytes; a byte goes if such a string covers it that also
starts in a document of a smaller doc_id.

1. **Suffixes.**  Of the starts of 16-byte tokens in a passage the one of least hash is its
   anchor, so equal passages have equal anchors at equal offsets.  Only suffixes that start
   at anchors matter, about one in seventeen.
2. **Leading tokens.**  Documents are dealt into chunks by a hash, and each chunk asks which of
   its anchors' tokens are in another document too, by their hashes alone (a false yes only
   costs work).  The others' suffixes go no further.  A suffix that does carries what its
   passages cover: up to 50 bytes after its start and 34 before it.  Equal suffixes with equal
   surroundings of one chunk are sorted together, and only the smallest document's goes on;
   the others' passages are already known to be repeated.
3. **Splitters** are sampled; suffixes are range-partitioned by their leading token.  A token
   that alone would fill much of a bucket is followed further: its passages are split by the
   offset of the anchor, half and half, and each half is dealt by the longer string that all
   of its passages share, down to single passages if need be.  Single passages that are still
   too many are also dealt by document, so a run of equal ones may straddle buckets.
4. **Buckets** sort their suffixes by multikey quicksort, on eight bytes a step, and their
   surroundings likewise; with the lengths of common prefixes in both orders, the passages
   at one offset that are equal are those that share enough on both sides.  In each such run
   all but the smallest document's are repeated.
5. **Boundaries.**  For runs that may straddle, a bucket reports its smallest document
   instead of judging it, and the smallest over all buckets decides.
6. Spans go back to their chunks, are united and cut out of the texts.

Chunks are read three times (ask, sort, cut) from one shuffle, which Spark reuses.  Hashes
choose anchors and deal rows; what is equal is decided on bytes alone.

Cases: a null text is empty; texts under 50 bytes lose nothing; very long texts are taken
in pieces that overlap; copies lose everything but the smallest doc_id's; repeated rows of
one doc_id take nothing from each other; a null doc_id counts as larger than all others;
strings are judged on the input, and matches never cross documents; an empty table gives
an empty result; extra columns stay, but for those named like the results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import by_value, fresh, settle, small_batches

#: Bytes of a passage and of a token; a passage has OFFSETS places for its anchor.
LENGTH, TOKEN = 50, 16
OFFSETS = LENGTH - TOKEN + 1
#: Eight-byte words after and before an anchor.
AFTER, BEFORE = 7, 5
WORDS = AFTER + BEFORE
#: Text of a chunk, about, and the pieces that anchors are found in.
CHUNK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Smaller chunks give each shuffle partition as many as this, but none of less text, as each may write a row to each bucket.
CHUNKS_EACH, LEAST_CHUNK_BYTES = 4, 256 << 10
#: Suffixes that a bucket should hold; chunks and rows that splitters are sampled from; splitters at most.
BUCKET_ROWS, SAMPLE_CHUNKS, SAMPLE_ROWS, MOST_RANGES = 200_000, 12, 120_000, 8192
#: A key with more than this share of a bucket is followed further.
HOT_SHARE = 0.25
#: Smaller buckets give each shuffle partition as many as this, so that partitions even out, but none of fewer suffixes.
SPREAD, LEAST_BUCKET_ROWS = 8, 10_000
NO_ID = np.iinfo(np.int64).max
#: Low bits of a token's hash that aren't asked about: 48 are left, so of 10 ** 12 tokens one in 280 is kept in vain.
UNASKED = np.uint64(16)

_HIGH = np.uint64(0xFFFFFFFF00000000)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
#: Masks that keep the first n bytes of a word.
_FIRST = np.array([(1 << 64) - (1 << (64 - 8 * n)) for n in range(9)], dtype=np.uint64)


class Suffixes(NamedTuple):
    """Suffixes at anchors: words (rows x WORDS), bytes after and before, document (row of the chunk) and start."""

    words: np.ndarray
    after: np.ndarray
    before: np.ndarray
    doc: np.ndarray
    start: np.ndarray

    def take(self, rows: np.ndarray) -> Suffixes:
        return Suffixes(*(x[rows] for x in self))


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of rows of words, and how many leading words each shares with the row before it.

    Multikey quicksort with a word as character: rows are parted by one word, and only
    those that are equal so far are parted by the next; all segments of a level at once.
    """
    order = np.argsort(words[:, 0], kind="stable")
    key = words[order, 0]
    shared = np.zeros(len(order), dtype=np.int8)
    shared[1:] = key[1:] == key[:-1]
    for level in range(1, words.shape[1]):
        tied = shared == level
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        segment = np.cumsum(~tied[at])
        key = words[order[at], level]
        by = np.lexsort((key, segment))
        order[at], key = order[at][by], key[by]
        equal = tied[at][1:] & (key[1:] == key[:-1])
        shared[at[1:][equal]] = level + 1
    return order, shared


def windows_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    held, n = values, 1
    while 2 * n <= width:
        held, n = np.minimum(held[:-n], held[n:]), 2 * n
    return np.minimum(held[: len(values) - width + 1], held[width - n :]) if n < width else held


class Piece:
    """The anchors of a piece of text; ``doc`` tells which document a byte is of."""

    def __init__(self, text: np.ndarray, doc: np.ndarray):
        pad = 8 * BEFORE
        wide = np.zeros(len(text) + pad + 8 * AFTER + 8, dtype=np.uint64)
        wide[pad : pad + len(text)] = text
        for step in (1, 2, 4):  # after these, each element holds the eight bytes that begin there
            wide = (wide[:-step] << np.uint64(8 * step)) | wide[step:]
        mixed = wide[pad : pad + len(text) - TOKEN + 1] * _MIX[0]
        mixed ^= mixed >> np.uint64(32)
        mixed += wide[pad + 8 : pad + 8 + len(mixed)]
        mixed *= _MIX[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[2]
        anchor = windows_least((mixed & _HIGH) | np.arange(len(mixed), dtype=np.uint64), OFFSETS) & ~_HIGH
        anchor = anchor.astype(np.int64)
        anchor[doc[: len(anchor)] != doc[LENGTH - 1 :]] = -1
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        place = anchor[first]
        whole = place >= 0
        self.place, self.first, self.last, self.wide, self.pad = place[whole], first[whole], last[whole], wide, pad
        # Anchors are least hashes, so mostly small; mixed once more, one to one, they spread over all numbers.
        hashes = mixed[self.place] * _MIX[0]
        hashes ^= hashes >> np.uint64(32)
        self.doc, self.hashes = doc[self.place], hashes * _MIX[1] & ~((np.uint64(1) << UNASKED) - np.uint64(1))

    def suffixes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, bytes after and bytes before of some anchors."""
        place, wide, pad = self.place[rows], self.wide, self.pad
        after, before = self.last[rows] + LENGTH - place, place - self.first[rows]
        words = np.empty((len(place), WORDS), dtype=np.uint64)
        for j in range(AFTER):
            words[:, j] = wide[pad + place + 8 * j] & _FIRST[np.clip(after - 8 * j, 0, 8)]
        for j in range(BEFORE):
            words[:, AFTER + j] = wide[pad + place - 8 - 8 * j].byteswap() & _FIRST[np.clip(before - 8 * j, 0, 8)]
        return words, after.astype(np.uint8), before.astype(np.uint8)


def pieces(texts: pa.Array) -> Iterator[tuple[Piece, np.ndarray]]:
    """The pieces of a chunk's texts, and the start of each anchor in its document."""
    texts = texts.cast(pa.large_binary())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    begin = int(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset]) if len(texts) else 0
    total = int(ends[-1]) if len(ends) else 0
    text = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[begin : begin + total] if total else np.empty(0, dtype=np.uint8)
    for at in range(0, max(total - LENGTH + 1, 0), PIECE_BYTES):
        upto = min(at + PIECE_BYTES + LENGTH - 1, total)
        low, high = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, upto - 1, side="right")
        cut = np.clip(ends[low : high + 1], at, upto) - at
        piece = Piece(text[at:upto], np.repeat(np.arange(low, high + 1, dtype=np.int64), np.diff(np.concatenate([[0], cut]))))
        yield piece, piece.place + at - (ends - lengths)[piece.doc]


def suffixes(texts: pa.Array, wanted: np.ndarray | None = None) -> Suffixes:
    """The suffixes of a chunk's texts; of ``wanted`` tokens (sorted hashes) only, if given."""
    found = [Suffixes(np.empty((0, WORDS), np.uint64), *(np.empty(0, t) for t in (np.uint8, np.uint8, np.int64, np.int64)))]
    for piece, start in pieces(texts):
        rows = np.arange(len(start)) if wanted is None else np.flatnonzero(among(piece.hashes, wanted))
        found.append(Suffixes(*piece.suffixes(rows), piece.doc[rows], start[rows]))
    return Suffixes(*(np.concatenate(x) for x in zip(*found)))


def among(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which values are among sorted names."""
    if not len(names):
        return np.zeros(len(values), dtype=bool)
    return names[np.minimum(np.searchsorted(names, values), len(names) - 1)] == values


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the anchors' tokens, and which are in two documents of the chunk."""
    found = [(piece.hashes, piece.doc) for piece, _ in pieces(texts)]
    if not found:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    hashes, doc = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[begins], np.maximum.reduceat(doc, begins) != np.minimum.reduceat(doc, begins)


def with_lengths(words: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Words and a last one for the lengths, so that rows are equal only if nothing but padding is padding."""
    return np.column_stack([words, after.astype(np.uint64) << np.uint64(8) | before.astype(np.uint64)])


def united(*keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal spans: keys, start and end, sorted; spans that touch are one."""
    order = np.lexsort((start, *reversed(keys)))
    keys, start, end = tuple(k[order] for k in keys), start[order], end[order]
    if not len(start):
        return (*keys, start, end)
    other = np.zeros(len(start), dtype=bool)
    other[0] = True
    for k in keys:
        other[1:] |= k[1:] != k[:-1]
    # Ends grow within a key once each key's spans are lifted above those before it.
    lift = (np.cumsum(other) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    opens = np.concatenate([[True], (start + lift)[1:] > reach[:-1]])
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return (*(k[first] for k in keys), start[first], (reach - lift)[last])


# --- Keys: what suffixes are dealt by -------------------------------------------------------------------------------

#: Ranges of offsets, each halved until one offset is left; children follow their parents.
NODES: list[tuple[int, int]] = [(0, OFFSETS - 1)]
CHILDREN: list[tuple[int, int] | None] = []
for _low, _high in NODES:
    if _low == _high:
        CHILDREN.append(None)
        continue
    CHILDREN.append((len(NODES), len(NODES) + 1))
    NODES += [(_low, (_low + _high) // 2), ((_low + _high) // 2 + 1, _high)]


def key_words(words: np.ndarray, node: int) -> np.ndarray:
    """The bytes that all passages of a suffix whose anchor's offset is in a node's range share."""
    low, high = NODES[node]
    masks = [min(max(LENGTH - high - 8 * j, 0), 8) for j in range(AFTER)] + [min(max(low - 8 * j, 0), 8) for j in range(BEFORE)]
    return words & _FIRST[masks]


def key_hash(keys: np.ndarray, node: int) -> np.ndarray:
    held = np.full(len(keys), node + 1, dtype=np.uint64) * _MIX[2]
    for j in range(WORDS):
        held = (held ^ keys[:, j]) * _MIX[0]
        held ^= held >> np.uint64(31)
    return held


def dealt(s: Suffixes, hot_of) -> Iterator[tuple[np.ndarray, int, np.ndarray, bool]]:
    """(rows, node, keys, straddles) of suffixes; ``hot_of(node, hashes)`` tells which keys are followed further."""
    held = {0: np.arange(len(s.start))}
    for node, (low, high) in enumerate(NODES):
        rows = held.pop(node, None)
        if rows is None or not len(rows):
            continue
        keys = key_words(s.words[rows], node)
        hot = hot_of(node, key_hash(keys, node))
        if CHILDREN[node] is None:
            for straddles in (False, True):
                if (own := hot == straddles).any():
                    yield rows[own], node, keys[own], straddles
            continue
        if not hot.all():
            yield rows[~hot], node, keys[~hot], False
        for child in CHILDREN[node]:
            first, last = NODES[child]
            more = rows[hot]
            more = more[(LENGTH - s.after[more].astype(np.int64) <= last) & (s.before[more] >= first)]
            held[child] = np.concatenate([held.get(child, more[:0]), more])


def key_bytes(keys: np.ndarray, node: int, ids: np.ndarray | None) -> np.ndarray:
    """Keys as byte strings in their order: the leading token, what else is shared, the node and, where runs straddle, the document."""
    found = np.zeros((len(keys), 8 * WORDS + 9), dtype=np.uint8)
    found[:, : 8 * WORDS] = keys.astype(">u8").view(np.uint8).reshape(len(keys), -1)
    found[:, 8 * WORDS] = node
    if ids is not None:
        found[:, 8 * WORDS + 1 :] = (ids.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(len(keys), 8)
    return found.view(f"S{found.shape[1]}").ravel()


class Plan(NamedTuple):
    """How suffixes are dealt: splitters (sorted byte strings), parts of each range, hot keys' hashes by node, and where tokens are asked for."""

    splitters: np.ndarray
    parts: int
    hot: dict[int, np.ndarray]
    asks: int

    def hot_of(self, node: int, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes, self.hot[node]) if node in self.hot else np.zeros(len(hashes), dtype=bool)

    def buckets(self, keys: np.ndarray, node: int, ids: np.ndarray | None) -> np.ndarray:
        names = key_bytes(keys, node, ids)
        ranges = np.searchsorted(self.splitters, names, side="right").astype(np.int64)
        if self.parts == 1:
            return ranges
        held = key_hash(keys, node) if ids is None else key_hash(keys, node) ^ (ids.astype(np.uint64) * _MIX[1])
        return ranges * self.parts + (held >> np.uint64(33)).astype(np.int64) % self.parts


def planned(samples: list[Suffixes], ids: list[np.ndarray], rows: float, partitions: int, bucket_rows: int = BUCKET_ROWS) -> Plan:
    """Splitters and hot keys from sampled suffixes that stand for ``rows``."""
    s = Suffixes(*(np.concatenate(x) for x in zip(*samples))) if samples else suffixes(pa.array([], pa.string()))
    own = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
    scale, hot = rows / max(len(s.start), 1), {}

    def count(node: int, hashes: np.ndarray) -> np.ndarray:
        names, times = np.unique(hashes, return_counts=True)
        most = max(HOT_SHARE * bucket_rows / scale, 4 if scale > 1 else 1)
        if (names := names[times > most]).size:
            hot[node] = names
        return np.isin(hashes, names)

    keys = [key_bytes(k, node, own[at] if straddles else None) for at, node, k, straddles in dealt(s, count)]
    keys = np.sort(np.concatenate(keys)) if keys else np.empty(0, dtype="S1")
    wanted = max(math.ceil(rows / bucket_rows), min(SPREAD * partitions, math.ceil(rows / LEAST_BUCKET_ROWS)))
    wanted = max(wanted, 1)
    ranges = max(1, min(wanted, MOST_RANGES, len(keys)))
    splitters = np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]) if ranges > 1 else keys[:0]
    return Plan(splitters, -(-wanted // MOST_RANGES), hot, wanted)


# --- Payloads: many suffixes or spans in one row --------------------------------------------------------------------

_CODEC = "zstd"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed string."""
    found = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        found.append(np.array([x.size], dtype=np.int64).tobytes() + x.tobytes())
    whole = b"".join(found)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec=_CODEC, asbytes=True)


def unpacked(payload: bytes, *types) -> list[np.ndarray]:
    whole = pa.decompress(payload[8:], decompressed_size=int.from_bytes(payload[:8], "little"), codec=_CODEC, asbytes=True)
    found, at = [], 0
    for t in types:
        n = int(np.frombuffer(whole, np.int64, 1, at)[0])
        found.append(np.frombuffer(whole, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return found


def steps_of(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes as what each adds to the one before it."""
    return np.diff(hashes >> UNASKED, prepend=np.uint64(0))


def hashes_of(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64) << UNASKED


#: Of a payload of suffixes: words, bytes after and before, ids, then how many places each has, and their document and start.
SUFFIX_TYPES = (np.uint64, np.uint8, np.uint8, np.int64, np.int32, np.int32, np.int64)
#: Of a payload of spans: document, start, end.
SPAN_TYPES = (np.int32, np.int64, np.int64)
ASKED = "ask long, chunk long, payload binary"
ROWS = "bucket long, node int, straddles boolean, chunk long, payload binary"
FOUND = "chunk long, passage binary, least long, payload binary"


class Sorted(NamedTuple):
    """A chunk's suffixes in order: all of them, which lead a group of equal ones, the group's number of each, and its leader's id."""

    s: Suffixes
    ids: np.ndarray
    leads: np.ndarray
    group: np.ndarray
    least: np.ndarray


def in_order(s: Suffixes, ids: np.ndarray) -> Sorted:
    """Suffixes sorted by bytes, equal ones by id."""
    s = s.take(np.argsort(ids, kind="stable")) if len(ids) else s
    ids = np.sort(ids, kind="stable")
    order, shared = multikey(with_lengths(s.words, s.after, s.before))
    s, ids = s.take(order), ids[order]
    leads = shared <= WORDS
    if len(leads):
        leads[0] = True
    group = np.cumsum(leads) - 1
    return Sorted(s, ids, leads, group, ids[leads][group] if len(leads) else ids)


def shipped(ids: np.ndarray, texts: pa.Array, wanted: np.ndarray, plan: Plan) -> Iterator[tuple[int, int, bool, bytes]]:
    """A chunk's rows: suffixes that have to be compared, and the spans that the chunk itself shows to be repeated (node -1)."""
    found = suffixes(texts, wanted)
    o = in_order(found, ids[found.doc])
    s = o.s
    behind = o.ids > o.least
    if behind.any():
        at = s.take(np.flatnonzero(behind))
        yield -1, -1, False, packed(*span_arrays(at.doc, at.start - at.before, at.start + at.after))
    # Places of a leader: its own and those of equal suffixes in rows of the same id.
    equal = np.flatnonzero(~behind)
    times = np.bincount(o.group[equal], minlength=int(o.leads.sum())).astype(np.int32)
    upto = np.cumsum(times)
    lead = np.flatnonzero(o.leads)
    leaders = s.take(lead)
    for rows, node, keys, straddles in dealt(leaders, plan.hot_of):
        bucket = plan.buckets(keys, node, o.ids[lead[rows]] if straddles else None)
        by = np.argsort(bucket, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            own = rows[at]
            n = times[own]
            places = equal[np.repeat(upto[own] - np.cumsum(n), n) + np.arange(int(n.sum()))]
            yield int(bucket[at[0]]), node, straddles, packed(
                leaders.words[own], leaders.after[own], leaders.before[own], o.ids[lead[own]], n, s.doc[places].astype(np.int32), s.start[places]
            )


def span_arrays(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(x.astype(t) for x, t in zip(united(doc, start=start, end=end), SPAN_TYPES))


# --- Buckets --------------------------------------------------------------------------------------------------------


def common(words: np.ndarray, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it in order."""
    n = words.shape[1]
    level = np.minimum(shared, n - 1)[1:]
    a, b = words[order[1:], level], words[order[:-1], level]
    differ = a ^ b
    zeros = np.full(len(differ), 8, dtype=np.int64)
    rest = differ.copy()
    for k in range(8):  # bytes before the first that differs
        high = (rest >> np.uint64(56)) != 0
        zeros[high & (zeros == 8)] = k
        rest = rest << np.uint64(8)
    return np.concatenate([[-1], np.where(shared[1:] >= n, 8 * n, 8 * level.astype(np.int64) + zeros)])


def repeated(words: np.ndarray, after: np.ndarray, before: np.ndarray, ids: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset at which a smaller id has the passage too (least above largest: none); rows are distinct, sorted by words."""
    low, high = NODES[node]
    n = len(ids)
    first, last = np.full(n, OFFSETS, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    order, shared = multikey(words[:, :AFTER])
    ahead = common(words[:, :AFTER], order, shared)
    back_order, back_shared = multikey(words[:, AFTER:])
    behind = common(words[:, AFTER:], back_order, back_shared)
    front, back = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for offset in range(low, high + 1):
        has = np.flatnonzero((LENGTH - after.astype(np.int64) <= offset) & (before >= offset))
        if len(has) < 2:
            continue
        front[order] = np.cumsum(ahead < LENGTH - offset)
        back[back_order] = np.cumsum(behind < offset)
        name = front[has] * (n + 1) + back[has]
        by = np.argsort(name, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(name[by]) != 0]))
        least = np.repeat(np.minimum.reduceat(ids[has[by]], begins), np.diff(np.concatenate([begins, [len(by)]])))
        hit = has[by][ids[has[by]] > least]
        first[hit] = np.minimum(first[hit], offset)
        last[hit] = np.maximum(last[hit], offset)
    return first, last


def bucket_spans(parts: list[tuple[int, list[np.ndarray]]], node: int, straddles: bool) -> Iterator[tuple[int, bytes | None, int | None, bytes]]:
    """Rows of FOUND for the suffixes of one node in a bucket; ``parts`` are (chunk, payload)."""
    words = np.concatenate([p[0].reshape(-1, WORDS) for _, p in parts])
    after, before, ids, times, docs, starts = (np.concatenate([p[k] for _, p in parts]) for k in range(1, 7))
    chunk = np.repeat([c for c, _ in parts], [len(p[4]) for _, p in parts])
    upto = np.cumsum(times)
    # Only tokens that documents share go on; where runs straddle, another bucket may hold the other document.
    order, shared = multikey(words[:, :2])
    token = np.cumsum(shared < 2) - 1
    begins = np.flatnonzero(shared < 2)
    mixed = np.maximum.reduceat(ids[order], begins) > np.minimum.reduceat(ids[order], begins)
    rows = order[mixed[token] | straddles]
    if not len(rows):
        return
    o = in_order(Suffixes(words[rows], after[rows], before[rows], rows, rows), ids[rows])
    lead = np.flatnonzero(o.leads)
    s, (low, high) = o.s, NODES[node]
    first, last = repeated(s.words[lead], s.after[lead], s.before[lead], o.ids[lead], node)
    first, last = first[o.group], last[o.group]
    # Rows behind their leader have all of their passages in a smaller document.
    least, most = np.maximum(LENGTH - s.after.astype(np.int64), low), np.minimum(s.before.astype(np.int64), high)
    later = o.ids > o.least
    first, last = np.where(later, least, first), np.where(later, most, last)

    def by_chunk(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, bytes]]:
        source = s.doc[at]
        n = times[source]
        places = np.repeat(upto[source] - np.cumsum(n), n) + np.arange(int(n.sum()))
        home, doc, start, end = united(
            np.repeat(chunk[source], n), docs[places], start=starts[places] - np.repeat(last[at], n), end=starts[places] - np.repeat(first[at], n) + LENGTH
        )
        cuts = np.flatnonzero(np.diff(home)) + 1
        for own in np.split(np.arange(len(home)), cuts):
            if len(own):
                yield int(home[own[0]]), packed(*(x[own].astype(t) for x, t in zip((doc, start, end), SPAN_TYPES)))

    for home, payload in by_chunk(np.flatnonzero(first <= last), first, last):
        yield home, None, None, payload
    if straddles:
        # One offset and one key: all that aren't repeated here have this bucket's smallest id for their passage.
        wait = np.flatnonzero(first > last)
        keys = key_bytes(key_words(s.words[wait], node), node, None)
        by = np.argsort(keys, kind="stable")
        for own in np.split(by, np.flatnonzero(keys[by][1:] != keys[by][:-1]) + 1):
            for home, payload in by_chunk(wait[own], least, most):
                yield home, bytes(keys[own[0]]), int(o.ids[wait[own[0]]]), payload


# --- The jobs -------------------------------------------------------------------------------------------------------


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def of_chunk(table: pa.Table, doc_id: str, text: str) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """A chunk in the order of its ids (null last) and texts, which doesn't depend on how it was read; its ids and texts."""
    ids = pc.fill_null(table[doc_id].cast(pa.int64()), int(NO_ID))
    keys = pa.table({"id": ids, "text": table[text].cast(pa.large_string())})
    order = pc.sort_indices(keys, [("id", "ascending"), ("text", "ascending")])
    keys = keys.take(order).combine_chunks()
    texts = pa.concat_arrays(keys["text"].chunks or [pa.array([], pa.large_string())])
    return table.take(order), keys["id"].to_numpy(), texts


def plan_for(chunked: DataFrame, doc_id: str, text: str, size: int, partitions: int, bucket_rows: int) -> Plan:
    """Splitters from documents that a hash picks; they are sorted by chunk-sized groups, and at most SAMPLE_ROWS suffixes come to the driver."""
    groups = max(1, min(SAMPLE_CHUNKS, -(-size // CHUNK_BYTES)))
    share = min(1.0, groups * CHUNK_BYTES / max(size, 1))
    each = SAMPLE_ROWS // groups
    schema = "n long, bytes long, payload binary"

    def sample(table: pa.Table) -> pa.Table:
        _, ids, texts = of_chunk(table, doc_id, text)
        found = suffixes(texts)
        o = in_order(found, ids[found.doc])
        lead = np.flatnonzero(o.leads)
        picked = lead[:: max(1, -(-len(lead) // each))]
        s = o.s.take(picked)
        weight = pc.sum(pc.binary_length(texts)).as_py() or 0
        return pa.Table.from_batches([batch_of([(len(lead), weight, packed(s.words, s.after, s.before, o.ids[picked]))], schema)])

    drawn = F.xxhash64(F.lit("sample"), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    picked = chunked.select(doc_id, text, F.pmod(drawn, F.lit(1 << 30)).alias("drawn")).where(F.col("drawn") < int(share * (1 << 30)))
    group = (F.col("drawn") % groups).alias("group")
    rows = picked.groupBy(group).applyInArrow(sample, schema).collect()
    samples, ids = [], []
    for r in rows:
        words, after, before, own = unpacked(r["payload"], *SUFFIX_TYPES[:4])
        samples.append(Suffixes(words.reshape(-1, WORDS), after, before, own, own))
        ids.append(own)
    total = sum(r["n"] for r in rows) * size / max(sum(r["bytes"] for r in rows), 1)
    return planned(samples, ids, total, partitions, bucket_rows)


def spans(chunked: DataFrame, plan: Plan, doc_id: str, text: str, chunk: str) -> DataFrame:
    """(chunk, payload): the spans that documents lose, by their place in their chunk."""
    asks = plan.asks

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        hashes, twice = tokens(of_chunk(table, doc_id, text)[2])
        name = ((hashes >> np.uint64(33)) * np.uint64(asks) >> np.uint64(31)).astype(np.int64)
        rows = []
        for at in np.split(np.arange(len(hashes)), np.flatnonzero(np.diff(name)) + 1):
            if len(at):
                rows.append((int(name[at[0]]), key[0].as_py(), packed(steps_of(hashes[at]), np.packbits(twice[at]))))
        return pa.Table.from_batches([batch_of(rows, ASKED)])

    def answer(table: pa.Table) -> pa.Table:
        """Of the tokens that each chunk asked for those that are in two documents."""
        own = [unpacked(p, np.uint64, np.uint8) for p in table["payload"].to_pylist()]
        own = [(hashes_of(h), np.unpackbits(t)[: len(h)].astype(bool)) for h, t in own]
        names, times = np.unique(np.concatenate([h for h, _ in own]), return_counts=True)
        often = names[times > 1]
        rows = []
        for key, chunk_id, (hashes, twice) in zip(table["ask"].to_pylist(), table["chunk"].to_pylist(), own):
            stay = hashes[twice | among(hashes, often)]
            if len(stay):
                rows.append((key, chunk_id, packed(steps_of(stay))))
        return pa.Table.from_batches([batch_of(rows, ASKED)])

    def ship(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return pa.Table.from_batches([batch_of([], ROWS)])
        _, ids, texts = of_chunk(docs, doc_id, text)
        wanted = np.sort(np.concatenate([hashes_of(unpacked(p, np.uint64)[0]) for p in answers["payload"].to_pylist()]))
        home = key[0].as_py()
        rows = [(-1 - home if node < 0 else bucket, node, straddles, home, payload) for bucket, node, straddles, payload in shipped(ids, texts, wanted, plan)]
        return pa.Table.from_batches([batch_of(rows, ROWS)])

    def judge(table: pa.Table) -> pa.Table:
        held: dict[tuple[int, bool], list[tuple[int, list[np.ndarray]]]] = {}
        rows = []
        for _, node, straddles, home, payload in zip(*(c.to_pylist() for c in table.columns)):
            if node < 0:
                rows.append((home, None, None, payload))
            else:
                held.setdefault((node, straddles), []).append((home, unpacked(payload, *SUFFIX_TYPES)))
        for (node, straddles), parts in held.items():
            rows += bucket_spans(parts, node, straddles)
        return pa.Table.from_batches([batch_of(rows, FOUND)])

    asked = chunked.groupBy(chunk).applyInArrow(ask, ASKED).groupBy("ask").applyInArrow(answer, ASKED)
    rows = chunked.groupBy(chunk).cogroup(asked.groupBy("chunk")).applyInArrow(ship, ROWS)
    found = rows.groupBy("bucket").applyInArrow(judge, FOUND)
    if any(CHILDREN[node] is None for node in plan.hot):
        found = settle(found)
        waiting = found.where(F.col("passage").isNotNull())
        least = waiting.groupBy(F.col("passage").alias("its_passage")).agg(F.min("least").alias("of_all"))
        late = waiting.join(settle(least), F.col("passage") == F.col("its_passage")).where(F.col("least") > F.col("of_all"))
        found = found.where(F.col("passage").isNull()).select("chunk", "payload").unionAll(late.select("chunk", "payload"))
    return found.select("chunk", "payload")


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "kept", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``out``, the remaining bytes."""
    return _applied(docs, doc_id, text, bucket_rows, out, bytes, "binary")


def digested(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_sha256, without holding the remaining bytes in the result."""
    return _applied(docs, doc_id, text, bucket_rows, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest(), "string")


def _applied(docs: DataFrame, doc_id: str, text: str, bucket_rows: int, out: str, final, kind: str) -> DataFrame:
    docs = small_batches(docs).drop("n_bytes", "n_removed", "n_spans", out)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).head()["n"] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = fresh("chunk", docs)
    count = max(-(-size // CHUNK_BYTES), min(CHUNKS_EACH * partitions, -(-size // LEAST_CHUNK_BYTES)), 1)
    chunked = docs.withColumn(chunk, F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(count)))
    plan = plan_for(chunked, doc_id, text, size, partitions, bucket_rows)
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", out: kind}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` {k}" for n, k in kinds.items()])

    def without(_key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        table, _, texts = of_chunk(table, doc_id, text)
        parts = [unpacked(p, *SPAN_TYPES) for p in found["payload"].to_pylist()] or [[np.empty(0, t) for t in SPAN_TYPES]]
        own, start, end = (np.concatenate(x) for x in zip(*parts))
        own, start, end = united(own, start=start, end=end)
        cuts = np.searchsorted(own, np.arange(len(texts) + 1))
        rows = []
        for k, t in enumerate(texts.cast(pa.large_binary())):
            whole = memoryview(t.as_buffer()) if t.is_valid else memoryview(b"")
            a, b = cuts[k], cuts[k + 1]
            kept = whole
            if a < b:
                edges = np.concatenate([[0], np.column_stack([start[a:b], end[a:b]]).ravel(), [len(whole)]]).reshape(-1, 2)
                kept = b"".join(whole[x:y] for x, y in edges.tolist())
            rows.append((len(whole), len(whole) - len(kept), int(b - a), final(kept)))
        made = zip(*rows) if rows else [[]] * 4
        types = [pa.int64()] * 3 + [pa.string() if kind == "string" else pa.binary()]
        table = table.drop_columns([chunk])
        for name, column, t in zip(kinds, made, types):
            table = table.append_column(name, pa.array(column, t))
        return table

    found = spans(chunked, plan, doc_id, text, chunk)
    return chunked.groupBy(chunk).cogroup(found.groupBy("chunk")).applyInArrow(without, schema)


by_value(__name__)
