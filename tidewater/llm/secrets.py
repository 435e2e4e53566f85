"""Secrets: base patterns, and formats learnt from labelled credentials by grammar inference.

Labelled credentials (kind, value) become one prefix tree per kind, over classes of
characters.  Statistically compatible states are merged (ALERGIA: Hoeffding bounds on the
frequencies of each state's ends and transitions, then of all that follow) into a
probabilistic automaton.  Every candidate token is scored: its log-likelihood per character
under the best automaton less that under a bigram model of ordinary tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

KINDS = ("assign", "access", "hex", "format")
BASE = KINDS[:3]
#: The most distinct labelled credentials that a model is fitted on, shared among the kinds; of each those with the lowest hashes are taken.
#: The bigrams of ordinary tokens are counted over all texts, and weigh like so many tokens at most.
FIT_ROWS = 600
#: Tokens whose verdict a task remembers.
CACHE = 200_000

_ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_WORDS = ("token", "password", "passwd", "secret", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: What may be a credential: all that is as long as an assigned value must be; marks at its ends that may belong to the sentence aren't scored.
SHORTEST = 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
_MARKS = ".-"
_CLASS = {c: k for k, chars in {"d": "0123456789", "a": "abcdef", "l": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "+": "+", "/": "/", "_": "_", ".": ".", "=": "=", "-": "-"}.items() for c in chars}
_SIZE = Counter(_CLASS.values())
_FLOOR = 1e-4
#: Classes by byte, as numbers: those of _SIZE, then any other character, then white space, which starts a token.
_NAMES = [*_SIZE, None, "^"]
_BYTE = np.full(256, len(_SIZE), np.uint8)
for _c, _k in _CLASS.items():
    _BYTE[ord(_c)] = _NAMES.index(_k)
_BYTE[[9, 10, 11, 12, 13, 32]] = len(_SIZE) + 1


def _mentions(low: str) -> bool:
    return any(w in low for w in _WORDS)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value)"""
    found = []
    if ("=" in text or ":" in text) and _mentions(text.lower()):
        found = [(*m.span(), "assign", m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access", m[0]) for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- grammar inference


class Automaton:
    """A deterministic probabilistic automaton over character classes."""

    def __init__(self, values: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.uses: list[Counter] = [Counter()]  # by class; "" ends
        for value in values:
            at = 0
            for c in (_CLASS[x] for x in value):
                self.uses[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.uses.append(Counter())
                at = self.next[at][c]
            self.uses[at][""] += 1
        self.scale = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._logs()

    def _close(self, p: int, q: int) -> bool:
        """Hoeffding's test on every frequency of two states and of all that follows both."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            a, b = self.uses[p], self.uses[q]
            n, m = a.total(), b.total()
            if not n or not m:
                continue
            bound = self.scale * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:  # no difference could be told, here or below
                continue
            if any(abs(a[c] / n - b[c] / m) > bound for c in a.keys() | b.keys()):
                return False
            todo += [(self.next[p][c], self.next[q][c]) for c in self.next[p].keys() & self.next[q].keys()]
        return True

    def _fold(self, p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.uses[p] += self.uses[q]
            for c, to in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], to))
                else:
                    self.next[p][c] = to

    def _merge_states(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            source, c = blue.pop(0)
            q = self.next[source][c]
            if q in red:
                continue
            for p in red:
                if self._close(p, q):
                    self.next[source][c] = p
                    self._fold(p, q)
                    break
            else:
                red.append(q)
            blue = [(p, c) for p in red for c in sorted(self.next[p]) if self.next[p][c] not in red]
        self.states = red

    def _logs(self) -> None:
        """Log-probability of each class and end at each state, per character of the class."""
        self.log = {}
        for p in self.states:
            n = self.uses[p].total()
            self.log[p] = {c: math.log((1 - _FLOOR) * self.uses[p][c] / n / (_SIZE[c] if c else 1) + _FLOOR / 80) for c in ["", *_SIZE]}

    def score(self, value: str) -> float:
        at, total = 0, 0.0
        for c in (_CLASS[x] for x in value):
            total += self.log[at][c]
            at = self.next[at].get(c, 0)
        return total + self.log[at][""]


def _histogram(text: str) -> np.ndarray:
    """How often each pair of _NAMES stands in text, as a table; characters are taken as bytes."""
    raw = np.frombuffer(f" {text}".encode(), np.uint8)
    total = np.zeros(len(_NAMES) ** 2, np.int64)
    for at in range(0, len(raw) - 1, 1 << 18):
        c = _BYTE[raw[at : at + (1 << 18) + 1]]
        total += np.bincount(c[:-1] * np.uint8(len(_NAMES)) + c[1:], minlength=len(total))
    return total.reshape(len(_NAMES), -1)


def _counter(table: np.ndarray, scale: float = 1.0) -> Counter:
    """Pairs of a class, or any start, and a class."""
    return Counter({(_NAMES[a], _NAMES[b]): table[a, b] * scale for a, b in zip(*np.nonzero(table), strict=True) if b < len(_SIZE)})


def _pairs(text: str) -> Counter:
    return _counter(_histogram(text))


class FormatModel:
    """Automata by kind, the bigram model of ordinary tokens, and the least score of a credential."""

    def __init__(self, labelled: list[tuple[str, str]], ordinary: list[str] | Counter, keep: float = 0.98):
        """ordinary: tokens, or the counts of their pairs of classes."""
        values = defaultdict(list)
        for kind, value in sorted(labelled):
            values[kind].append(value)
        self.automata = {k: Automaton(v) for k, v in values.items()}
        pairs = ordinary if isinstance(ordinary, Counter) else _pairs(" ".join(ordinary))
        singles = Counter()
        for (a, _), n in pairs.items():
            singles[a] += n
        self.plain = {(a, b): math.log((pairs[a, b] + 0.5) / (singles[a] + 0.5 * len(_SIZE)) / _SIZE[b]) for a in ["^", *_SIZE] for b in _SIZE}
        self.known: dict[str, bool] = {}
        scores = sorted(self.score(v) for _, v in labelled)
        self.least = max(0.0, scores[int((1 - keep) * len(scores))]) if scores else math.inf

    def score(self, value: str) -> float:
        if not self.automata:
            return -math.inf
        classes = [_CLASS[x] for x in value]
        plain = sum(self.plain[p] for p in zip(["^", *classes], classes, strict=False))
        return (max(a.score(value) for a in self.automata.values()) - plain) / len(value)

    def spans(self, text: str, base) -> list[tuple[int, int, str]]:
        """Tokens, or what base spans leave of them, that have the format of a credential.  base: by start."""
        out, k, end = [], 0, 0  # the next base span, and where those before it end
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            while k < len(base) and base[k][0] < b:
                out += self._piece(text, max(a, end), base[k][0])
                end = max(end, base[k][1])
                k += 1
            out += self._piece(text, max(a, end), b)
        return out

    def _piece(self, text: str, a: int, b: int) -> list[tuple[int, int, str]]:
        if b - a < SHORTEST:
            return []
        value = text[a:b].strip(_MARKS)
        if len(value) < SHORTEST or not self.fits(value):
            return []
        a = text.index(value, a)
        return [(a, a + len(value), "format")]

    def fits(self, value: str) -> bool:
        known = self.known.get(value)
        if known is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            known = self.known[value] = self.score(value) >= self.least
        return known


# ---------------------------------------------------------------- over tables


def _without(text: str, base) -> str:
    """text without its base spans."""
    out, end = [], 0
    for a, b, *_ in base:
        if a >= end:
            out.append(text[end:a])
        end = max(end, b)
    return " ".join([*out, text[end:]])


def _labelled(batches):
    """Distinct values of base spans with the hash that orders them, and counts of pairs of classes outside of base spans."""
    for batch in batches:
        values: set[tuple[str, str]] = set()
        pairs = np.zeros((len(_NAMES), len(_NAMES)), np.int64)
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            base = base_spans(text)
            values.update((kind, value) for _, _, kind, value in base)
            pairs += _histogram(_without(text, base) if base else text)
        rows = [(k, v, hashlib.blake2b(v.encode(), digest_size=8).hexdigest(), 1) for k, v in values]
        rows += [("", str(c), "", int(pairs.flat[c])) for c in np.flatnonzero(pairs)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.string()] * 3, pa.int64()], strict=True)], ["kind", "value", "place", "n"])


def _shares(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """How many of `rows` each kind gets: equal parts, and what smaller kinds leave goes to larger ones."""
    out, left = {}, rows
    for k, kind in enumerate(sorted(sizes, key=sizes.get)):
        out[kind] = min(sizes[kind], left // (len(sizes) - k))
        left -= out[kind]
    return out


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> FormatModel:
    """A model of the credentials that base patterns label in docs.

    All texts are searched; the automata are fitted on at most `rows` distinct credentials,
    in equal parts of the kinds, those whose hash is lowest.  The bigrams of ordinary tokens
    are those of all texts outside of base spans, scaled to the weight of `rows` tokens if
    there are more.
    """
    found = durable(docs.select("text").mapInArrow(_labelled, "kind string, value string, place string, n long"))
    values = {kind: [r.value for r in found.where(F.col("kind") == kind).select("place", "value").distinct().orderBy("place", "value").limit(rows).collect()] for kind in BASE}
    shares = _shares({k: len(v) for k, v in values.items()}, rows)
    table = np.zeros((len(_NAMES), len(_NAMES)), np.int64)
    for r in found.where("kind = ''").groupBy("value").agg(F.sum("n").alias("n")).collect():
        table.flat[int(r.value)] = r.n
    tokens = table[-1, :-1].sum()
    return FormatModel([(k, v) for k in BASE for v in values[k][: shares[k]]], _counter(table, min(1.0, rows / max(tokens, 1))))


def listed(spans) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of docs: counts of the base kinds, their digest, all spans.

    `format` spans are tokens of SHORTEST characters or more, or what base spans leave of
    them, that the inferred automata score as likely as the labelled credentials; every such
    token of every whole text is scored, in time linear in the text.  A null text is empty:
    counts 0, spans "" and the digest of the empty string.  Without any labelled credential
    there are no format spans.  Repeated rows give repeated rows; doc_id may be null.  An
    empty table gives no rows.  Only doc_id and text are read.
    """
    model = fit(docs, rows)

    def scan(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = model.spans(text or "", base)
                spans = sorted([s[:3] for s in base] + more, key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([*(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)])
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, _SCHEMA)
