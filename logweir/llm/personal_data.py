"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay; wider patterns give
candidates besides. Labelers (patterns, checks, gazetteers, contexts) vote
yes, no or nothing on each candidate. Votes are counted by pattern, of which
there are a fixed number, and expectation-maximisation estimates from the
counts over all candidates how reliable each labeler is for each kind. The
posteriors train a logistic classifier of spans on votes, shape and context,
drawn toward the labelers' own weights where it has seen little; what it
accepts is added.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .scratch import Scratch, Sealed

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "shape", "gazetteer", "cue", "edges", "digits")
HASHED = 256
Span = tuple[int, int, int, bool]  # kind, start, end, base

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Quantifiers don't give back what another start would have to read again, so every text takes linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

AT = re.compile(r"\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?")
DOTTED = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?)[A-Za-z0-9-]++)++")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
CARD_WIDE = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/  ‐-–-]{1,3}[0-9]{4}){3}(?![0-9])")
PHONE_WIDE = re.compile(r"(?<![0-9A-Za-z+./-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z/]|[.-][0-9])")

# Common top-level domains, calling codes by zone, first digits of card networks, words around personal data and around other numbers.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai app dev eu de fr es it nl be at ch uk us ca au jp cn in br ru pl se no fi dk cz pt ie nz za mx ar kr sg".split())
CALLING = ("1", "2", "30", "31", "32", "33", "34", "35", "36", "37", "38", "39", "40", "41", "42", "43", "44", "45", "46", "47", "48", "49", "5", "6", "7", "81", "82", "84", "85", "86", "88", "90", "91", "92", "93", "94", "95", "96", "97", "98", "99")
NETWORKS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "60", "64", "65", "35", "30", "36", "38", "62", "50", "56", "57", "58")
CUES = {
    "email": frozenset("mail email e-mail address contact write correo courriel adresse kontakt".split()),
    "ip": frozenset("ip ipv4 ipv6 address addr host server client from login adresse".split()),
    "card": frozenset("card credit debit visa mastercard amex payment pay karte kreditkarte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon handy téléphone teléfono móvil whatsapp".split()),
}
AGAINST = frozenset("version release build isbn issn order invoice serial sku token hash sha commit section chapter figure page ratio part model ticket".split())


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def numbers(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0  # of the last match
    for m in DOMAIN.finditer(text):
        at = m.start()
        low = max(end, text.rfind("@", end, at) + 1)
        start = low + len(text[low:at].rstrip(LOCAL))
        if start < at:
            yield start, (end := m.end())


def base_spans(text: str) -> list[Span]:
    """By kind, then start; ends are exclusive, in code points."""
    found = [(0, *s, True) for s in emails(text)] if "@" in text else []
    found += [(1, *m.span(), True) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span(), True) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := numbers(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, *m.span(), True) for m in PHONE.finditer(text) if 9 <= len(numbers(m[0])) <= 15]
    return found


def wide_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that overlap neither a base span nor one another: addresses that spell their marks out, IPv6, cards and phone numbers with other separators."""
    found: list[Span] = []
    for m in AT.finditer(text):
        low = max(0, m.start() - 128)
        start = low + len(text[low : m.start()].rstrip(LOCAL))
        after = DOTTED.match(text, m.end())
        if start < m.start() and after:
            found.append((0, start, after.end(), False))
    for m in IP6.finditer(text) if "::" in text or text.count(":") > 6 else ():
        if len(m[0]) > 5 and any(c.isdigit() for c in m[0]):
            try:
                IPv6Address(m[0])
            except ValueError:
                continue
            found.append((1, *m.span(), False))
    found += [(2, *m.span(), False) for m in CARD_WIDE.finditer(text) if luhn(numbers(m[0]))]
    found += [(3, *m.span(), False) for m in PHONE_WIDE.finditer(text) if 9 <= len(numbers(m[0])) <= 15]
    kept: list[Span] = []
    if found:
        taken = sorted((s, e) for _, s, e, _ in base)
        k, end = 0, 0
        for span in sorted(found, key=lambda x: (x[1], x[0], x[2])):
            while k < len(taken) and taken[k][1] <= span[1]:
                k += 1
            if span[1] >= end and not any(s < span[2] and e > span[1] for s, e in taken[k : k + len(KINDS)]):
                kept.append(span)
                end = span[2]
    return kept


def gazetteer_vote(kind: int, span: str) -> int:
    if kind == 0:
        return 1 if re.split(r"[.\])}\x20]", span)[-1].lower() in TOP_LEVEL else -1
    if kind == 1:
        if ":" in span:
            return -1 if IPv6Address(span).is_reserved or IPv6Address(span).is_unspecified else 1
        parts = [int(p) for p in span.split(".")]
        return -1 if parts[0] in (0, 127, 255) or parts[0] >= 240 or max(parts) < 20 else 1
    digits = numbers(span)
    if kind == 2:
        return 1 if digits.startswith(NETWORKS) else -1
    code = digits if span[0] == "+" else digits[2:] if digits.startswith("00") else ""
    return 0 if not code else 1 if code.startswith(CALLING) else -1


def shape_vote(kind: int, span: str) -> int:
    if kind == 0:
        return 1 if re.search(r"[A-Za-z]{2,}$", span) and span[0].isalnum() else -1
    if kind == 1:
        return -1 if re.search(r"(?:^|\.)0[0-9]", span) else 1
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    if kind == 2:
        return 1 if len(groups) == 1 or max(groups) == 4 and min(groups[:-1]) == 4 else -1
    return 1 if len(groups) > 1 and groups[-1] in (2, 3, 4) and span.count("(") == span.count(")") else -1


def votes(text: str, span: Span) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 for nothing."""
    kind, start, end, base = span
    found = text[start:end]
    words = re.findall(r"[^\W\d_][\w-]*", text[max(0, start - 40) : start].lower())[-4:]
    cue = 1 if any(w in CUES[KINDS[kind]] for w in words) else -1 if any(w in AGAINST for w in words) else 0
    before, after = text[start - 1 : start] if start else " ", text[end : end + 1] or " "
    edges = -1 if before.isalnum() or before in "_=/#\\" or after.isalnum() or after in "_=/\\" else 1
    digits = numbers(found)
    spread = -1 if kind >= 2 and len(set(digits)) <= 2 else 1 if kind >= 2 else 0
    return 1 if base else 0, shape_vote(kind, found), gazetteer_vote(kind, found), cue, edges, spread


def features(text: str, span: Span) -> str:
    """Shape and context of a span, as words."""
    _, start, end, _ = span
    shape = re.sub("[0-9]", "9", re.sub("[^\\W\\d_]+", "a", text[start : min(end, start + 80)]))
    before = re.findall(r"\w+|[^\w\s]", text[max(0, start - 40) : start].lower())[-3:]
    after = re.findall(r"\w+|[^\w\s]", text[end : end + 20].lower())[:1]
    return "\x1f".join([f"s{shape}", f"l{end - start}", *(f"b{re.sub('[0-9]+', '9', w)}" for w in before), *(f"a{re.sub('[0-9]+', '9', w)}" for w in after)])


def vector(cast: tuple[int, ...], words: str) -> np.ndarray:
    x = np.zeros(1 + len(LABELERS) + HASHED)
    x[0], x[1 : 1 + len(LABELERS)] = 1, cast
    for w in words.split("\x1f"):
        x[1 + len(LABELERS) + zlib.crc32(w.encode()) % HASHED] += 0.5
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def reliabilities(cast: np.ndarray, counts: np.ndarray, prior: float = 0.5, start: float = 0.8, strength: float = 10, rounds: int = 200) -> np.ndarray:
    """Each labeler's share of right votes by expectation-maximisation over vote patterns (rows of cast) and how often they occur.

    Votes are right independently given the truth; a labeler that doesn't vote
    says nothing. The share of true candidates is given, as among candidates
    without false ones it would leave no doubt about anything. ``strength``
    imaginary votes are right at the rate of ``start``.
    """
    right = np.full(cast.shape[1], start)
    for _ in range(rounds):
        p = posterior(cast, right, prior)
        agree = (counts * p) @ (cast > 0) + (counts * (1 - p)) @ (cast < 0)
        new = (agree + start * strength) / (counts @ (cast != 0) + strength)
        new = np.clip(new, 0.5, 0.99)
        if np.abs(new - right).max() < 1e-9:
            break
        right = new
    return right


def posterior(cast: np.ndarray, right: np.ndarray, prior: float = 0.5) -> np.ndarray:
    return sigmoid(cast @ np.log(right / (1 - right)) + math.log(prior / (1 - prior)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, centre: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights for soft labels y by Newton's steps, drawn toward centre."""
    w = centre.copy()
    for _ in range(25):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * (w - centre)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Of each kind: the labelers' reliabilities, and the span classifier's weights."""

    right: np.ndarray
    weights: np.ndarray

    def probability(self, text: str, span: Span) -> float:
        return float(sigmoid(vector(votes(text, span), features(text, span)) @ self.weights[span[0]]))


def train(docs: DataFrame, text_col: str = "text", sample: int = 4000, prior: float = 0.5) -> Model:
    """Reliabilities from the vote counts of all candidates of all texts; the classifier from ``sample`` different candidates of each kind at most, chosen by a hash and weighted by their number."""
    scratch = Scratch(docs.sparkSession, "personal")
    sealed = Sealed(docs)
    texts = sealed.rows.select(F.col(sealed[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                for span in [*base, *wide_spans(text, base)]:
                    made.append((span[0], list(votes(text, span)), features(text, span)))
            if made:
                kinds, cast, words = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(cast, pa.list_(pa.int32())), pa.array(words, pa.string())], names=["kind", "cast", "words"])

    told = texts.mapInArrow(run, "kind int, cast array<int>, words string").groupBy("kind", "cast", "words").count()
    told = scratch.keep(told)
    by_votes = told.groupBy("kind", "cast").agg(F.sum("count").alias("n")).collect()  # four kinds, three votes: 2,916 rows at most
    right = np.full((len(KINDS), len(LABELERS)), 0.8)
    weights = np.zeros((len(KINDS), 1 + len(LABELERS) + HASHED))
    for k in range(len(KINDS)):
        own = [r for r in by_votes if r.kind == k]
        if own:
            right[k] = reliabilities(np.array([r.cast for r in own]), np.array([float(r.n) for r in own]), prior)
        centre = np.zeros(weights.shape[1])
        centre[0], centre[1 : 1 + len(LABELERS)] = math.log(prior / (1 - prior)), np.log(right[k] / (1 - right[k]))
        rows = told.where(F.col("kind") == k).orderBy(F.xxhash64("words"), "words", "cast").limit(sample).collect() if own else []
        if rows:
            x = np.stack([vector(tuple(r.cast), r.words) for r in rows])
            y = posterior(np.array([r.cast for r in rows]), right[k], prior)
            weight = np.sqrt(np.array([float(r["count"]) for r in rows]))  # copies say little more than one
            weights[k] = logistic(x, y, weight, centre)
        else:
            weights[k] = centre
    scratch.drop(told)
    return Model(right, weights)


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean").add("probability", "double"))


def find(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """docs with spans (kind, start, end, base, probability, by kind and start) and, with keep_text, redacted.

    Offsets count code points, ends are exclusive. Base spans are there whatever
    the classifier says; other candidates from ``threshold`` on. In ``redacted``
    each span is its kind in brackets, of overlapping ones the first and longest.
    A null text has no spans and a null redacted text; empty ones and texts of
    any length are handled whole. Repeated rows are told alike. Other columns
    pass through; input columns named like the added ones are replaced. Without
    keep_text the text isn't returned.
    """
    sealed = Sealed(docs, "spans", "redacted")
    text = sealed[text_col]
    kept = [c for c in sealed.kept if keep_text or c != text]
    rows = sealed.rows.select(*kept, F.col(text).alias("text"))
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, redacted = [], []
            for value in batch.columns[-1]:
                text = value.as_py()
                base = base_spans(text or "")
                told = [(*s, model.probability(text, s)) for s in [*base, *wide_spans(text or "", base)]]
                told = sorted(s for s in told if s[3] or s[4] >= threshold)
                all_spans.append([{"kind": KINDS[k], "start": s, "end": e, "base": b, "probability": p} for k, s, e, b, p in told])
                if keep_text:
                    redacted.append(None if text is None else replaced(text, told))
            out = [*batch.columns[:-1], pa.array(all_spans, struct)]
            if keep_text:
                out.append(pa.array(redacted, pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = [*kept, "spans", *(["redacted"] if keep_text else [])]
    kind = T.StructType([*(rows.schema[c] for c in kept), T.StructField("spans", SPANS)])
    if keep_text:
        kind.add("redacted", "string")
    sealed.kept = kept
    return rows.mapInArrow(run, kind).select(*sealed.restored(), *names[len(kept) :])


def replaced(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for k, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
