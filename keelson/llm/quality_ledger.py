"""Operator 10: quality rules as a bitmask ledger.

Every text is measured once; every rule turns measurements into one failure bit.
The ledger (bits and measurements) is what is kept: policies are versioned masks
applied to the bits later, and ablations are bitwise counts over the distinct bit
patterns, so neither reads a text again.

Cases: a null text counts as empty (no words, so it fails ``few_words``); equal
rows get equal entries; ties don't arise, as every measure is of one text; very
long texts are measured whole in memory proportional to the text; extra columns
pass through, and a clashing name of a measure is refused; an empty table gives an
empty ledger, and its ablation counts are zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keelson.llm.common import by_value, fresh, small_batches

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_exclaims",
)


@dataclass(frozen=True)
class Rule:
    """One rule: its bit never changes once published; ``fails`` is SQL over the measures."""

    bit: int
    name: str
    fails: str


#: Shares are written as products of whole numbers, so no rounding decides a document.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines"),
    Rule(4, "shouting", "n_upper + n_lower >= 20 AND 2 * n_upper > n_upper + n_lower"),
    Rule(5, "exclamations", "5 * n_exclaims > n_words"),
    Rule(6, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule(7, "long_words", "word_chars > 20 * n_words"),
)
BASE_MASK = 0b11
#: Version of a policy -> mask of the rules it enforces.
POLICIES = {"base-1": BASE_MASK, "prose-1": 0b11111111}


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one whole text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at exactly \x20 \x09-\x0D
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(BLANK_CHARS)]
    repeated = 0
    if n >= 4:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        k = len(seen)
        pairs = ids[:-1] * k + ids[1:]
        if k >= 1 << 20:  # three ids no longer fit into 63 bits
            pairs, k = np.unique(pairs, return_inverse=True)[1].astype(np.int64), k
        windows = pairs[:-1] * k + ids[2:]
        _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
        often = counts[where] > 1
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift : shift + len(often)] |= often
        repeated = int(covered.sum())
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    return (
        n,
        len(text) - sum(map(text.count, BLANK_CHARS)),
        int(codes[[ord(c) for c in SYMBOLS]].sum()),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(codes[65:91].sum()),
        int(codes[97:123].sum()),
        int(codes[33]),
    )


@F.pandas_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One long whose bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures and ``failed_bits``; the text is read once."""
    clash = {c.lower() for c in docs.columns} & {*MEASURES, "failed_bits"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    held = fresh("measures", docs)
    out = small_batches(docs).withColumn(held, _measures(F.col(f"`{text}`")))
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{held}.{m}").alias(m) for m in MEASURES))
    return out.withColumn("failed_bits", failure_bits(rules))


def passes(version: str, bits: str = "failed_bits") -> Column:
    """Whether a ledger entry passes the policy of that version."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablation(entries: DataFrame, version: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: how many entries fail it, fail only it, and are kept with and without it.

    Entries are first counted by bit pattern, so what follows handles at most 2^rules rows.
    """
    mask = POLICIES[version]
    patterns = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    out = []
    for rule in rules:
        if mask >> rule.bit & 1:
            one = F.lit(1 << rule.bit).cast("long")
            out += [
                F.sum(F.when(bits.bitwiseAND(one) != 0, F.col("n")).otherwise(0)),
                F.sum(F.when(bits == one, F.col("n")).otherwise(0)),
            ]
    enforced = [r for r in rules if mask >> r.bit & 1]
    row = patterns.agg(
        F.coalesce(F.sum(F.when(bits == 0, F.col("n"))), F.lit(0)).alias("kept"),
        *(F.coalesce(c, F.lit(0)).alias(f"c{i}") for i, c in enumerate(out)),
    )
    return row.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(version).alias("policy"),
                        F.lit(r.name).alias("rule"),
                        F.col(f"c{2 * i}").alias("n_fail"),
                        F.col(f"c{2 * i + 1}").alias("n_fail_only_this"),
                        F.col("kept").alias("n_kept"),
                        (F.col("kept") + F.col(f"c{2 * i + 1}")).alias("n_kept_without"),
                    )
                    for i, r in enumerate(enforced)
                )
            )
        ).alias("r")
    ).select("r.*")


by_value(__name__)
