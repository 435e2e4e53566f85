"""Toxicity by a chain of linear classifiers.

The categories are predicted in order.  The model of each sees the text and the
probabilities of all earlier categories; in training these are out-of-fold predictions, so a
later model learns from earlier ones as they are on texts they haven't seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import labelled_sample, linear, logistic, sigmoid

#: At most so many labelled documents are fitted on, and so many features kept by a model.
FIT_ROWS, FEATURES = 10_000, 768
FOLDS = 5
#: Rows of the sample that a feature must be in.
LEAST = 3
#: Categories in the order of the chain.  A labelled toxic document is severe if at least SEVERE of its distinct words, or of their beginnings of one length, are toxic terms.
CATEGORIES = ("toxic", "severe")
SEVERE = 3
CACHE = 200_000

#: Bits of a feature's number; the lowest two are its kind.
_SPACE = 31
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a raw word: the word in lower case without marks around it, and its first 4, 5 and 6 letters.

    The lowest two bits tell which of these a feature is.
    """
    w = _EDGES.sub("", word.decode().lower())
    if not w:
        return ()
    forms = [(0, w), *((k - 3, w[:k]) for k in (4, 5, 6) if len(w) > k)]
    return tuple(xxhash.xxh3_64_intdigest(f) >> (66 - _SPACE) << 2 | kind for kind, f in forms)


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _features(batches):
    cache = _Cache(word_features)
    for batch in batches:
        out = []
        for raw in batch.column("text").cast(pa.binary()):
            found: set[int] = set()
            for w in set((raw.as_py() or b"").split()):
                found.update(cache[w])
            out.append(np.fromiter(sorted(found), np.int32, len(found)))
        ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))], ["id", "label", "features"])


class Sample:
    """Rows as flat arrays: for each row the features that it has, numbered among those that at least LEAST rows have."""

    def __init__(self, lists):
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate(lists) if len(lists) else np.empty(0, np.int32)
        order = np.sort(flat)
        first = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(order)))
        #: The features by number.
        self.known = order[first[times >= LEAST]]
        del order
        at = np.minimum(np.searchsorted(self.known, flat), max(len(self.known) - 1, 0)).astype(np.int32)
        hit = self.known[at] == flat if len(self.known) else np.zeros(len(flat), bool)
        self.rows = len(lists)
        self.flat, self.row = at[hit], np.repeat(np.arange(self.rows, dtype=np.int32), size)[hit]

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        at = np.full(len(self.known) + 1, -1, np.int32)
        at[chosen] = np.arange(len(chosen))
        place = at[self.flat]
        hit = place >= 0
        x = np.zeros((self.rows, len(chosen)), np.float32)
        x[self.row[hit], place[hit]] = 1
        return x

    def most_of_a_kind(self, terms: np.ndarray) -> np.ndarray:
        """How many of the terms each row has, of the kind of which it has most."""
        is_term = np.zeros(len(self.known) + 1, bool)
        is_term[terms] = True
        hit = is_term[self.flat]
        return np.bincount(self.row[hit] * 4 + (self.known[self.flat[hit]] & 3), minlength=4 * self.rows).reshape(-1, 4).max(1, initial=0)


class Link:
    """One category's model: the features that tell it best, their weights, those of earlier categories."""

    def __init__(self, sample: Sample, y: np.ndarray, rows: np.ndarray, earlier: np.ndarray, most: int = FEATURES):
        use = np.zeros(len(y), bool)
        use[rows] = True
        on = use[sample.row]
        hits = np.bincount(sample.flat[on], y[sample.row[on]], len(sample.known))
        every = np.bincount(sample.flat[on], minlength=len(sample.known))
        n1, n = max(y[rows].sum(), 1), max(len(rows), 1)
        n0 = max(n - n1, 1)
        gap = hits / n1 - (every - hits) / n0
        z = np.abs(gap) / np.sqrt((hits + 1) / n1**2 + (every - hits + 1) / n0**2)
        z[every < LEAST] = 0
        best = np.argsort(-z, kind="stable")[:most]
        chosen = np.sort(best[z[best] > 2.5])
        self.terms = chosen[(gap[chosen] > 0) & ((every - hits)[chosen] <= 0.02 * hits[chosen])]
        self.chosen, self.features = chosen, sample.known[chosen]
        x = np.column_stack([sample.matrix(chosen)[rows], earlier[rows]])
        self.w = logistic(x, y[rows].astype(float), ridge=0.02)

    def logit(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return linear(self.w, np.column_stack([x, earlier]))

    def sparse(self, row: np.ndarray, feature: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """The same from pairs of a row and a feature that it has."""
        k = len(self.features)
        out = earlier @ self.w[k:-1] + self.w[-1]
        if k and len(row):
            at = np.minimum(np.searchsorted(self.features, feature), k - 1)
            hit = self.features[at] == feature
            out = out + np.bincount(row[hit], self.w[at[hit]], len(earlier))
        return out


class Chain:
    """Models by category and the limit of each, from hashed features and 0/1 labels by category.

    A label may be a function of the sample and of the first category's model: a derived
    category.  In each fold it is derived from that fold's model, which knows nothing of the
    rows held out.
    """

    def __init__(self, lists, labels: dict, order=CATEGORIES, folds: int = FOLDS):
        sample, n = Sample(lists), len(lists)
        fold = np.arange(n) % folds
        earlier = np.zeros((n, 0))
        self.links, self.limits = {}, {}
        first: list[Link] = []
        for name in order:
            label = labels[name]
            told = (lambda link, label=label: label(sample, link)) if callable(label) else (lambda link, label=label: label)
            out, truth, parts = np.zeros(n), np.zeros(n, np.int64), []
            for k in range(folds):
                held = np.flatnonzero(fold == k)
                y = told(first[k] if first else None)
                part = Link(sample, y, np.flatnonzero(fold != k), earlier)
                out[held] = sigmoid(part.logit(sample.matrix(part.chosen)[held], earlier[held]))
                truth[held] = y[held]
                parts.append(part)
            whole = Link(sample, told(first[-1] if first else None), np.arange(n), earlier)
            first = first or [*parts, whole]
            self.links[name] = whole
            self.limits[name] = _limit(out, truth)
            earlier = np.column_stack([earlier, out])

    def score(self, rows: list[set[int]]) -> dict[str, np.ndarray]:
        out = {}
        earlier = np.zeros((len(rows), 0))
        size = [len(x) for x in rows]
        row = np.repeat(np.arange(len(rows)), size)
        feature = np.fromiter((f for x in rows for f in x), np.int64, sum(size))
        for name, link in self.links.items():
            out[name] = sigmoid(link.sparse(row, feature, earlier))
            earlier = np.column_stack([earlier, out[name]])
        return out


def severe(toxic: np.ndarray):
    """The derived category: toxic documents with at least SEVERE of the first category's terms."""
    return lambda sample, link: toxic * (sample.most_of_a_kind(link.terms) >= SEVERE).astype(np.int64)


def _limit(p: np.ndarray, y: np.ndarray) -> float:
    """The limit on out-of-fold probabilities with the best F1, midway between neighbours."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + after) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Chain | None:
    """A chain fitted on at most `rows` labelled documents; None without any."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", rows).select("_id", "_label", "text")
    found = sample.mapInArrow(_features, "id long, label int, features array<int>").toArrow()
    if not found.num_rows:
        return None
    ids = np.asarray(found["id"].combine_chunks())
    order = np.argsort([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) for i in ids], kind="stable")
    column = found["features"].combine_chunks()
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    lists = [flat[ends[i] : ends[i + 1]] for i in order]
    toxic = (np.asarray(found["label"].combine_chunks())[order] > 0).astype(np.int64)
    return Chain(lists, {"toxic": toxic, "severe": severe(toxic)})


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, p_toxic, toxic, p_severe, severe.

    labels has one category, toxic; severe is derived from it: a toxic document with SEVERE or
    more distinct toxic terms, which each fold finds without the documents that it holds out.
    A null or wordless text is scored on no features at all.  Without labelled rows the
    probabilities are null and nothing is flagged.  Repeated rows are scored alike and count once in
    the fit; a null doc_id is carried.  Texts are read whole.  An empty table gives no rows.
    Only doc_id and text of docs, doc_id and toxic of labels are read.
    """
    schema = "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in CATEGORIES)
    chain = fit(docs, labels, rows)
    if chain is None:
        return docs.select("doc_id", *(x for c in CATEGORIES for x in (F.lit(None).cast("double").alias(f"p_{c}"), F.lit(False).alias(c))))
    wanted = {f for link in chain.links.values() for f in link.features.tolist()}

    def scan(batches):
        cache = _Cache(lambda w: tuple(f for f in word_features(w) if f in wanted))
        for batch in batches:
            p = {c: [] for c in CATEGORIES}
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, len(texts), 1000):
                found = [set().union(*map(cache.__getitem__, set((raw.as_py() or b"").split()))) for raw in texts[at : at + 1000]]
                for c, x in chain.score(found).items():
                    p[c].append(x)
            p = {c: np.concatenate(x) if x else np.empty(0) for c, x in p.items()}
            columns = [y for c in CATEGORIES for y in (pa.array(p[c]), pa.array(p[c] >= chain.limits[c]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(y for c in CATEGORIES for y in (f"p_{c}", c))])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
