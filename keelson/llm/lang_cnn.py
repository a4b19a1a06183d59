"""Operator 8: language ID by a byte convolutional network.

A text's UTF-8 bytes are cut into fixed-length windows, all of them, the last one
padded.  Each byte has a learned vector; filters of several widths slide over the
window, their largest responses are pooled, and a softmax names the language.  A
text's probabilities are the mean over its windows, weighted by their bytes.

The network is trained in numpy on windows of a bounded sample of labelled texts
(``PER_LANG`` a language, drawn over all rows by a hash of doc_id).  Only text and
label are used; rows of the held-out fold never are.

Cases: a null text or one without a letter is ``und`` with score 0; empty and blank
texts likewise; very long texts are handled a block of windows at a time; of equal
probabilities the first language in sort order wins; equal rows get equal results;
extra columns pass through and clashing output names are refused; an empty table
gives an empty result, and where no row is labelled every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from keelson.llm.common import by_value, fresh, small_batches

UNKNOWN = "und"
WINDOW = 256
#: Labelled texts a language that training draws, at most about; the bound of the fitted sample.
PER_LANG = 600
WINDOWS_A_TEXT = 3
#: Filter widths and filters of each.
WIDTHS = (2, 3, 4)
FILTERS = 12
BYTE_DIM = 8
EPOCHS = 6
#: Windows scored at a time, which bounds a worker's memory whatever the text.
WINDOWS_AT_ONCE = 256
HELD_OUT_FOLD, FOLDS = 2, 4


@dataclass
class Network:
    langs: list[str]
    vectors: np.ndarray  # 256 x BYTE_DIM
    filters: list[np.ndarray]  # for each width: (width * BYTE_DIM) x FILTERS
    offsets: list[np.ndarray]
    weights: np.ndarray  # (widths * FILTERS) x langs
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width: the largest response of each filter, and where it is."""
        x = self.vectors[windows]  # n x WINDOW x BYTE_DIM
        n, length, dim = x.shape
        flat = np.ascontiguousarray(x).reshape(n, length * dim)
        out = []
        for width, f, b in zip(WIDTHS, self.filters, self.offsets):
            patches = sliding_window_view(flat, width * dim, axis=1)[:, ::dim]
            responses = np.matmul(patches.reshape(-1, width * dim), f).reshape(n, -1, f.shape[1])
            at = responses.argmax(axis=1)
            out.append((np.take_along_axis(responses, at[:, None], axis=1)[:, 0] + b, at))
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """n x langs; the hot path keeps no positions."""
        x = self.vectors[windows]
        n, length, dim = x.shape
        flat = np.ascontiguousarray(x).reshape(n, length * dim)
        features = []
        for width, f, b in zip(WIDTHS, self.filters, self.offsets):
            patches = sliding_window_view(flat, width * dim, axis=1)[:, ::dim]
            responses = np.matmul(patches.reshape(-1, width * dim), f).reshape(n, -1, f.shape[1])
            features.append(np.maximum(responses.max(axis=1) + b, 0))
        return softmax(np.concatenate(features, axis=1) @ self.weights + self.bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one padded with zero bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """Fit a network on windows (of at most WINDOW bytes) and their labels by Adam on the cross-entropy."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x = np.concatenate([windows_of(t[:WINDOW]) for t in texts])
    y = np.array([langs.index(lab) for lab in labels])
    share = np.bincount(y, minlength=len(langs)) / len(y)
    net = Network(
        langs,
        rng.normal(0, 0.5, (256, BYTE_DIM)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * BYTE_DIM), (w * BYTE_DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    params = [net.vectors, *net.filters, *net.offsets, net.weights, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            own, truth = x[pick], y[pick]
            pooled = net.pooled(own)
            hidden = np.concatenate([np.maximum(p, 0) for p, _ in pooled], axis=1)
            p = softmax(hidden @ net.weights + net.bias)
            p[np.arange(len(own)), truth] -= 1
            p *= (1 / share[truth] / len(langs))[:, None] / len(own)
            back = (p @ net.weights.T) * (hidden > 0)
            d_vectors = np.zeros_like(net.vectors)
            d_filters, d_offsets = [], []
            for k, (width, f) in enumerate(zip(WIDTHS, net.filters)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                places = pooled[k][1][:, :, None] + np.arange(width)  # n x FILTERS x width
                read = own[np.arange(len(own))[:, None, None], places]
                patch = net.vectors[read].reshape(len(own), FILTERS, -1)
                d_filters.append(np.einsum("nf,nfd->df", g, patch))
                d_offsets.append(g.sum(axis=0))
                d_patch = (g[:, :, None] * f.T[None]).reshape(*read.shape, BYTE_DIM)
                np.add.at(d_vectors, read, d_patch)
            grads = [d_vectors, *d_filters, *d_offsets, hidden.T @ p, p.sum(axis=0)]
            step += 1
            for param, grad, m, v in zip(params, grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo FOLDS; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Network | None:
    """Train on about ``per_lang`` labelled texts of each language, drawn by hash over all rows outside the held-out fold."""
    named = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    ).where((F.coalesce(fold(F.col("doc_id")), F.lit(0)) != HELD_OUT_FOLD) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, int(min(1.0, per_lang / n) * (1 << 20)) + 1).otherwise(share)
    drawn = named.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share) & F.col("text").rlike(r"\p{L}"))
    start = lambda k: 1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1)))
    pieces = F.array(*(F.substring("text", start(k).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_A_TEXT)))
    rows = drawn.select("lang", F.explode(pieces).alias("piece")).limit(4 * per_lang * WINDOWS_A_TEXT * len(counts)).collect()
    rows = sorted((r["lang"], r["piece"]) for r in rows)
    return train([p.encode() for _, p in rows], [name for name, _ in rows]) if rows else None


def predict_column(text: Column, net: Network | None) -> Column:
    """Struct(lang, score) of a text column."""

    @F.arrow_udf(StructType([StructField("lang", StringType()), StructField("score", DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        # Texts go together until WINDOWS_AT_ONCE windows are there; a longer text goes block by block.
        batch: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        sums = np.zeros((len(texts), len(net.langs)))
        held = 0

        def flush() -> None:
            nonlocal held
            if held:
                block, owner = np.concatenate(batch), np.concatenate(owners)
                used = np.count_nonzero(block, axis=1)[:, None]
                np.add.at(sums, owner, net.probabilities(block) * used)
                batch.clear(), owners.clear()
                held = 0

        for i, t in enumerate(texts):
            raw = t.as_py()
            if not raw:
                continue
            all_windows = windows_of(raw.encode())
            for at in range(0, len(all_windows), WINDOWS_AT_ONCE):
                part = all_windows[at : at + WINDOWS_AT_ONCE]
                batch.append(part)
                owners.append(np.full(len(part), i))
                held += len(part)
                if held >= WINDOWS_AT_ONCE:
                    flush()
        flush()
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        for i in range(len(texts)):
            names.append(net.langs[best[i]] if total[i] > 0 else UNKNOWN)
            scores.append(float(sums[i, best[i]] / total[i]) if total[i] > 0 else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if net is None:
        return nothing
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), predict(text)).otherwise(nothing)


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    if {c.lower() for c in docs.columns} & {"lang_pred", "score"}:
        raise ValueError("columns lang_pred or score are there already")
    held = fresh("prediction", docs)
    got = small_batches(docs).withColumn(held, predict_column(F.col(f"`{text}`"), net))
    return got.select(
        *(F.col(f"`{c}`") for c in docs.columns), F.col(f"{held}.lang").alias("lang_pred"), F.col(f"{held}.score").alias("score")
    )


by_value(__name__)
