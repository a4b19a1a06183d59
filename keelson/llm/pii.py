"""Operator 9: personal data by weak-supervision aggregation.

1. Patterns propose candidate spans: the four base kinds, and looser forms and
   further kinds (masked e-mail addresses, national phone numbers, card-like numbers
   without a valid check digit, IBANs, social security numbers, titled names, dates,
   and access secrets such as tokens and passwords).
2. Labelers vote for, against or not at all on each: format, checksum, context
   words before, gazetteer, adverse context, clean boundaries.
3. Candidates are counted over the whole corpus by pattern: kind, votes, and features
   of the span (length, shape) and of its surroundings (the characters beside it, the
   form of the word before).
4. Expectation-maximisation on the counts of votes estimates each labeler's
   reliability and a posterior; a logistic span classifier is then trained on the
   most frequent patterns (at most MOST_PATTERNS), weighted by count, with the
   posteriors as soft labels.  Two spans with equal votes differ by their features, and
   only the classifier's weights go to the tasks that judge.
5. The spans that the classifier accepts are kept.  Base spans stay always; an added
   span never overlaps a base one.  Candidates may overlap each other: all are
   judged, and of the accepted ones that overlap the most probable stays, then the
   longest.  Redaction covers every accepted one.

``find`` searches each text once: the candidates are written to the shared folder,
counted there, and judged there.  ``redact`` searches twice, to learn and to replace,
as it would otherwise have to write or shuffle the texts.

A secret is the whole run that a word for secrets is given, dots and all, whatever its
length (from four characters with a digit, twelve without), or a key of an issuer's form.

Cases: a null text counts as empty and has no spans; equal rows get equal spans;
spans of one kind never overlap, and of two kinds at the same start the order of
``KINDS`` decides; very long texts are searched whole by patterns of linear cost;
extra columns pass through and clashing output names are refused; an empty table
gives an empty result (nothing is learned then, and no span is added).
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from keelson.llm.common import by_value, fresh, settle, small_batches

#: Base kinds in the order that decides ties, then the kinds that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "name", "birth", "secret")
LABELERS = ("format", "checksum", "context", "gazetteer", "adverse", "boundary")
ACCEPT = 0.5

# Possessive repeats where giving back can't help, so that no text costs more than linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63})+")
_NATIONAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
# Strict forms inside a longer run, which the base patterns take as a whole and drop.
_STRICT_PHONE = re.compile(r"\+[0-9]{1,3} ?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
# A card may begin in any group of a run, so these are looked for at every place.
_STRICT_CARDS = (
    re.compile(r"(?<![0-9])(?=([0-9]{4}([ -]?)[0-9]{4}\2[0-9]{4}\2[0-9]{4})(?![0-9]))"),
    re.compile(r"(?<![0-9])(?=(3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9]))"),
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])")
_NAME = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?")
# What a sign of assignment gives to a word for secrets, and forms that issuers give their keys.
_ASSIGNED = re.compile(r"[:=][ \t]{0,3}[\"']?([^\s\"'<>,;:()\[\]{}]++)")
_SECRET_WORD = re.compile(r"(?i)(?:token|secret|passwd|password|pwd|(?:api|access|auth|private)[ _-]?key|bearer)[\"']?[ \t]{0,3}\Z")
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|xox[abp]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){1,4})(?![A-Za-z0-9])")
_ISSUED_SIGNS = ("AKIA", "gho_", "ghp_", "ghs_", "ghu_", "sk-", "xox", "eyJ")
#: A value given to a word for secrets counts from so many characters on, one without digits from so many.
SECRET_LEAST, WORDLIKE_LEAST = 4, 12
_DIGIT = re.compile("[0-9]")

#: Words that speak for a kind when they stand shortly before it.
CONTEXT = {
    "email": ("mail", "contact", "correo", "kontakt", "write to"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "carte", "karte", "tarjeta", "credit", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "insurance"),
    "name": ("name", "dear", "contact", "signed", "by "),
    "birth": ("born", "birth", "dob", "geboren", "naissance", "nacimiento", "né le", "née le"),
    "secret": ("token", "secret", "passw", "pwd", "key", "auth", "bearer"),
}
#: Words that speak against personal data.
ADVERSE = ("version", "isbn", "issn", "order", "invoice", "section", "build", "release", "serial", "page")
#: Gazetteers: first words of names, and country codes of IBANs and phone numbers.
GIVEN_NAMES = frozenset(
    "Adam Alice Amy Andrea Andrew Anna Anne Antonio Barbara Ben Brian Carlos Carmen Carol Charles Chen Chris Christian Claire Clara "
    "Daniel David Diana Diego Donald Edward Elena Elizabeth Emily Emma Eric Eva Fatima Francis Frank Gabriel George Grace Hanna Hans "
    "Helen Henry Ian Ingrid Isabel Ivan Jack James Jan Jane Jason Jean Jennifer Jessica Johann John Jorge Jose Joseph Juan Julia Karen "
    "Karl Kate Kevin Klaus Laura Lea Lena Leon Linda Lisa Louis Lucas Lucia Luis Maria Marie Mark Martin Mary Max Michael Miguel "
    "Mohammed Monica Nancy Nicolas Nina Noah Olga Oliver Oscar Pablo Patricia Paul Pedro Peter Philip Pierre Rachel Ralf Raul Rebecca "
    "Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Simon Sofia Sophie Stefan Stephen Steven Susan Teresa Thomas Tim Ursula Victor "
    "Walter Wei William Yuki".split()
)
IBAN_COUNTRIES = frozenset("AD AE AT BA BE BG BH BR CH CY CZ DE DK EE ES FI FR GB GE GI GR HR HU IE IL IS IT KW LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK TN TR".split())
DIAL_CODES = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 233 234 254 351 352 353 354 356 357 358 359 370 371 372 375 380 381 385 386 420 421 852 886 961 962 965 966 971 972 974".split()
)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the base e-mail pattern, found from each @ outwards."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        if (m := _DOMAIN.match(text, at + 1)) is not None:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _octets(parts: list[str]) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start and then by kind as listed."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group().split("."))]
        for m in _NUMBER.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Further candidates."""
    found = [("name", *m.span()) for m in _NAME.finditer(text)]
    for m in _ASSIGNED.finditer(text):
        if m.end(1) - m.start(1) >= SECRET_LEAST and _SECRET_WORD.search(text, max(0, m.start() - 24), m.start()):
            value = m[1].rstrip(".!?")  # the end of a sentence isn't part of it
            if len(value) >= (SECRET_LEAST if _DIGIT.search(value) else WORDLIKE_LEAST):
                found.append(("secret", m.start(1), m.start(1) + len(value)))
    if any(sign in text for sign in _ISSUED_SIGNS):
        found += [("secret", *m.span()) for m in _ISSUED.finditer(text)]
    if "at)" in text or "at]" in text:
        found += [("email", *m.span()) for m in _MASKED.finditer(text)]
    if _DIGIT.search(text):
        found += [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
        found += [("phone", *m.span()) for m in _STRICT_PHONE.finditer(text)]
        found += [("card", *m.span(1)) for strict in _STRICT_CARDS for m in strict.finditer(text)]
        found += [("iban", *m.span()) for m in _IBAN.finditer(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        found += [("birth", *m.span()) for m in _DATE.finditer(text)]
        for m in _NUMBER.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(_DIGIT.findall(m.group())) <= 19:
                found.append(("card", *m.span()))
    return found


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One character a labeler: + for, - against, 0 abstains."""
    span = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    digits = "".join(_DIGIT.findall(span))
    checksum = gazetteer = "0"
    if kind == "card":
        checksum = "+" if luhn(digits) else "-"
        gazetteer = "+" if digits[0] in "3456" else "0"
    elif kind == "iban":
        compact = span.replace(" ", "")
        number = int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4]))
        checksum = "+" if number % 97 == 1 else "-"
        gazetteer = "+" if compact[:2] in IBAN_COUNTRIES else "-"
    elif kind == "ssn":
        checksum = "-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else "+"
    elif kind == "ip":
        checksum = "+" if span.split(".")[0].lstrip("0") else "-"
    elif kind == "phone":
        checksum = "+" if 10 <= len(digits) <= 15 else "-"
        gazetteer = "+" if span[0] == "+" and digits.startswith(DIAL_CODES) else "0"
    elif kind == "email":
        gazetteer = "+" if span.rpartition(".")[2].lower() in ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk") else "0"
    elif kind == "name":
        gazetteer = "+" if GIVEN_NAMES & set(span.split()[1:]) else "0"
    elif kind == "secret":  # letters and digits mixed, or one of the issued forms
        checksum = "+" if digits and len(digits) < len(span) else "-"
        gazetteer = "+" if _ISSUED.fullmatch(span) else "0"
    strict = kind == "phone" and span[0] == "+" or kind == "card" and checksum == "+" and len(digits) >= 14
    edges = text[start - 1 : start] + text[end : end + 1]
    return "".join(
        (
            "+" if base or strict or kind in ("ssn", "iban", "secret") else "0",
            checksum,
            "+" if any(w in before for w in CONTEXT[kind]) else "-" if kind == "birth" else "0",
            gazetteer,
            "-" if any(w in before for w in ADVERSE) else "0",
            "-" if any(c.isalnum() for c in edges) else "+",
        )
    )


def side(char: str) -> str:
    """The class of a character beside a span."""
    return "e" if not char else "s" if char.isspace() else "d" if char.isdigit() else "a" if char.isalpha() else "p" if char in ".,;:!?" else "q"


def surroundings(text: str, start: int, end: int) -> str:
    """Features of a span and its context, one class each: length, separators, digits, the sides, the word before."""
    span = text[start:end]
    separators = {c for c in span if not c.isalnum()}
    shape = "0" if not separators else next((c for c in " -.@()" if separators == {c}), "m")
    digits = sum(map(str.isdigit, span))
    share = "0" if not digits else "1" if digits == len(span) else "h" if 2 * digits >= len(span) else "l"
    before = text[max(0, start - 24) : start].rstrip()
    word = before.rpartition(" ")[2]
    form = "e" if not word else "c" if word[-1] in ":=#" else "d" if word[-1].isdigit() else "u" if word[0].isupper() else "w"
    return f"{min((end - start) // 8, 5)}{shape}{share}{side(text[start - 1 : start])}{side(text[end : end + 1])}{form}"


def clear(taken: list[tuple[int, int]], start: int, end: int) -> int | None:
    """Where a span goes among sorted disjoint ones, or None if it overlaps one."""
    at = bisect_left(taken, (end, 0))
    return None if at and taken[at - 1][1] > start else at


def candidates(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, is_base, pattern), base ones first; none that isn't base overlaps a base one."""
    base = base_spans(text)
    taken: list[tuple[int, int]] = []
    for start, end in sorted((a, b) for _, a, b in base):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    added = sorted(set(loose_spans(text)), key=lambda x: (x[1], -x[2], KINDS.index(x[0])))
    out = []
    for kind, start, end, is_base in [(*x, True) for x in base] + [(*x, False) for x in added if clear(taken, *x[1:]) is not None]:
        said = votes(text, kind, start, end, is_base)
        out.append((kind, start, end, is_base, f"{kind}|{said}|{surroundings(text, start, end)}"))
    return out


def votes_of(pattern: str) -> str:
    return pattern.rpartition("|")[0]


def estimate(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior that a pattern (kind and votes) is personal data, by EM over labelers that err independently given the truth."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    cast = np.array([["+-0".index(v) for v in p.split("|")[1]] for p in patterns])  # patterns x labelers
    hot = np.eye(3)[cast]
    # It starts from the majority of votes; smoothing keeps a labeler that never errs from ruling alone.
    posterior = 1 / (1 + np.exp(-((cast == 0).sum(axis=1) - 1.5 * (cast == 1).sum(axis=1) - 0.5)))
    for _ in range(rounds):
        log = []
        for weight in (n * posterior, n * (1 - posterior)):
            share = (weight.sum() + 1) / (n.sum() + 2)
            table = np.einsum("p,plv->lv", weight, hot) + np.array([1.0, 1.0, 1.0])
            log.append(np.log(share) + np.einsum("plv,lv->p", hot, np.log(table / table.sum(axis=1, keepdims=True))))
        posterior = 1 / (1 + np.exp(np.clip(log[1] - log[0], -30, 30)))
    return dict(zip(patterns, posterior.tolist()))


#: Classes of each feature of ``surroundings``.
CLASSES = ("012345", "0 -.@()m", "01hl", "esdapq", "esdapq", "ecduw")


def features(pattern: str) -> list[float]:
    kind, said, around = pattern.split("|")
    return [
        1.0, *(float(kind == k) for k in KINDS), *(float(v == w) for v in said for w in "+-"),
        *(float(c == x) for c, classes in zip(around, CLASSES) for x in classes),
    ]


class Model(dict):
    """Probability of patterns that a candidate is personal data; those not held yet follow from the classifier's weights."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights

    def __missing__(self, pattern: str) -> float:
        if self.weights is None:
            raise KeyError(pattern)
        if len(self) >= REMEMBERED:
            self.clear()
        self[pattern] = p = float(probability(np.array(features(pattern)) @ self.weights))
        return p

    def __reduce__(self):
        return Model, (self.weights,)  # tasks get the weights only


#: Patterns whose probability is remembered.
REMEMBERED = 1 << 16
#: The classifier is fitted on so many patterns at most, the most frequent; the labelers' reliabilities on all.
MOST_PATTERNS = 100_000


def probability(score):
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def train(counts: dict[str, int], by_votes: dict[str, int] | None = None, steps: int = 400) -> Model:
    """The span classifier: weighted logistic regression on the EM posteriors, which rest on ``by_votes`` (of ``counts`` if not given)."""
    if not counts:
        return Model()
    if by_votes is None:
        by_votes = {}
        for p, n in counts.items():
            by_votes[votes_of(p)] = by_votes.get(votes_of(p), 0) + n
    soft = estimate(by_votes)
    patterns = sorted(counts)
    x = np.array([features(p) for p in patterns])
    y = np.array([soft[votes_of(p)] for p in patterns])
    w = np.log1p([counts[p] for p in patterns])
    w = w / w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = probability(x @ beta)
        grad = x.T @ (w * (p - y)) + 1e-4 * beta
        curve = (x.T * (w * p * (1 - p))) @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(curve, grad)
        beta -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Model(beta)


CANDIDATE = StructType(
    [
        StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
        StructField("is_base", BooleanType()), StructField("pattern", StringType()),
    ]
)
CANDIDATE_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("is_base", pa.bool_()), ("pattern", pa.string())])
)


def candidates_column(text: Column) -> Column:
    """Array of the candidates of a text column."""

    @F.arrow_udf(ArrayType(CANDIDATE))
    def search(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "end", "is_base", "pattern")
        return pa.array([[dict(zip(names, c)) for c in candidates(t.as_py() or "")] for t in texts], CANDIDATE_ARROW)

    return search(text)


def learned(found: Column, rows: DataFrame) -> Model:
    """The model trained on the counts of the patterns of a candidate column, counted over all rows."""
    patterns = rows.select(F.explode(F.transform(found, lambda c: c["pattern"])).alias("pattern"))
    counted = settle(patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    votes = counted.groupBy(F.regexp_extract("pattern", r"^(.*)\|", 1).alias("votes")).agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.col("n").desc(), "pattern").limit(MOST_PATTERNS)
    # Kinds x three votes of each labeler bound the first, MOST_PATTERNS the second.
    return train({r["pattern"]: r["n"] for r in most.collect()}, {r["votes"]: r["n"] for r in votes.collect()})


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Count the patterns of all candidates of all texts, and train on the counts."""
    return learned(candidates_column(F.col(f"`{text}`")), small_batches(docs))


SPAN = StructType(
    [
        StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
        StructField("is_base", BooleanType()),
    ]
)


def judged(found: list[tuple], model: Model) -> list[tuple[str, int, int, bool, float]]:
    """Of candidates, base spans and all that the classifier accepts, with its probability, by start and then kind; added ones may overlap."""
    kept = []
    for c in found:
        try:
            kept.append((*c[:4], model[c[4]]))
        except KeyError:  # nothing is known of it
            kept.append((*c[:4], 0.0))
    return sorted((c for c in kept if c[3] or c[4] >= ACCEPT), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def accepted(found: list[tuple], model: Model) -> list[tuple[str, int, int, bool]]:
    """Spans of a text by start, then by kind as listed; of added ones that overlap the most probable, then the longest."""
    all_of_them = judged(found, model)
    kept = [c[:4] for c in all_of_them if c[3]]
    taken: list[tuple[int, int]] = []
    for kind, start, end, is_base, _ in sorted((c for c in all_of_them if not c[3]), key=lambda x: (-x[4], x[1] - x[2], x[1], KINDS.index(x[0]))):
        if (at := clear(taken, start, end)) is not None:
            taken.insert(at, (start, end))
            kept.append((kind, start, end, is_base))
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))


def spans_column(found: Column, model: Model) -> Column:
    """Array of struct(kind, start, end, is_base) of a candidate column; places in code points, end exclusive."""

    @F.arrow_udf(ArrayType(SPAN))
    def choose(rows: pa.Array) -> pa.Array:
        out = [
            [dict(zip(("kind", "start", "end", "is_base"), s)) for s in accepted([tuple(c.values()) for c in r.as_py() or []], model)]
            for r in rows
        ]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("is_base", pa.bool_())])))

    return choose(found)


def find(docs: DataFrame, text: str = "text", out: str = "pii_spans", model: Model | None = None) -> DataFrame:
    """``docs`` without the text, with the accepted spans; the model is learned from the same texts unless given."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} is there already")
    held = fresh("candidates", docs)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    searched = settle(small_batches(docs).select(*others, candidates_column(F.col(f"`{text}`")).alias(held)))
    model = learned(F.col(held), searched) if model is None else model
    return searched.select(*others, spans_column(F.col(held), model).alias(out))


def redact_text(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each stretch that spans cover replaced by the first span's kind in angle brackets."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", model: Model | None = None) -> DataFrame:
    """``docs`` with the spans of every text replaced, and its length column brought in line; null stays null."""
    model = learn(docs, text) if model is None else model

    @F.arrow_udf(StringType())
    def replaced(texts: pa.Array) -> pa.Array:
        rows = [t.as_py() for t in texts]
        return pa.array([None if t is None else redact_text(t, [c[:4] for c in judged(candidates(t), model)]) for t in rows], pa.string())

    out = small_batches(docs).withColumn(text, replaced(F.col(f"`{text}`")))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast(dict(docs.dtypes)[n_chars]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


by_value(__name__)
