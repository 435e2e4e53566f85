"""Quality by co-training of a text view and a metadata view.

One linear model sees the text's content (bytes and repetition), the other what is known of
the document without reading it (source, language, length).  Both start from labelled
documents; in each round either model labels the unlabelled documents that it is surest of
for the other.  All unlabelled documents take part: their views are stored, and each
round is a few distributed passes that count probabilities and add up gradients and Gram
matrices, which are all that the driver sees.  At the end both are calibrated on held-out labelled documents and combined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, small, tidy
from .linear import labelled_sample, linear, logistic, sigmoid

#: The most labelled documents that are fitted on.
FIT_ROWS = 10_000
#: Rounds of exchange, the part of the unlabelled documents that a view labels in each, how sure it must be, and the weight of such a label.
ROUNDS, GIVEN, SURE, WEIGHT = 3, 0.1, 0.95, 0.3
FOLDS = 5
#: A document is rejected when its calibrated probability of being good is lower.
LIMIT = 0.5

#: Log-odds are counted in bins of this width, an edge of which is SURE, up to END on either side; numbers of a partial sum that travel together.
WIDTH, END = np.log(SURE / (1 - SURE)) / 256, 3000
CHUNK = 4096
STEPS = 12

_SOURCES, _LANGS = 48, 12
TEXT_WIDTH = 256 + 8
META_WIDTH = _SOURCES + _LANGS + 4


def text_view(text: str | None) -> np.ndarray:
    """Square roots of the frequencies of bytes, and how much words, pairs of words and lines repeat."""
    x = np.zeros(TEXT_WIDTH, np.float32)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return x
    x[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    log = np.log1p(n)
    kinds, pairs = len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)
    x[256:] = kinds, pairs, kinds * log / 5, pairs * log / 5, len(set(lines)) / len(lines), log / 5, (len(raw) / n) / 10, np.log1p(len(raw) / len(lines)) / 5
    return x


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language, and the length; a null is a value of its own."""
    x = np.zeros(META_WIDTH, np.float32)
    x[xxhash.xxh3_64_intdigest(f"s{source}") % _SOURCES] = 1
    x[_SOURCES + xxhash.xxh3_64_intdigest(f"l{lang}") % _LANGS] = 1
    log = np.log1p(max(n_chars or 0, 0)) / 10
    x[_SOURCES + _LANGS :] = log, log * log, float(n_chars is None), float((n_chars or 0) < 300)
    return x


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    texts, sources, langs, sizes = (batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
    if not texts:
        return np.zeros((0, TEXT_WIDTH), np.float32), np.zeros((0, META_WIDTH), np.float32)
    return np.stack([text_view(t) for t in texts]), np.stack([meta_view(*m) for m in zip(sources, langs, sizes, strict=True)])


@dataclass
class CoTrained:
    """Weights of both views and of their combination."""

    text: np.ndarray
    meta: np.ndarray
    joint: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the probability of being good by text, by metadata, and by both, calibrated."""
        a, b = linear(self.text, text), linear(self.meta, meta)
        return sigmoid(a), sigmoid(b), sigmoid(linear(self.joint, np.column_stack([a, b])))


class Told:
    """What each view of each model labels: log-odds from the cuts on, and a part, by place, of the bins at the cuts."""

    def __init__(self, models, cuts):
        self.weights = [np.column_stack([m[k] for m in models]) for k in (0, 1)]
        self.cuts = cuts  # by model and view: bin and part for good, bin and part for bad

    def __call__(self, views, place):
        """By model and view: the rows that it labels, and their labels."""
        bins = _bins(self.weights, views)
        for t, cuts in enumerate(self.cuts):
            for k, (high, more, low, less) in enumerate(cuts):
                b = bins[k][:, t]
                good = (b > high) | ((b == high) & (place < more))
                rows = np.flatnonzero(good | (b < low) | ((b == low) & (place < less)))
                yield t, k, rows, good[rows].astype(float)

    def any(self, views, place) -> np.ndarray:
        """Whether any view of any model labels the row."""
        out = np.zeros(len(place), bool)
        for _, _, rows, _ in self(views, place):
            out[rows] = True
        return out


def _bins(weights, views) -> list[np.ndarray]:
    """Numbers of the bins of each row's log-odds, by view: a column for each model."""
    return [np.clip(np.floor((v @ w[:-1] + w[-1]) / WIDTH), -END, END - 1).astype(np.int64) + END for v, w in zip(views, weights, strict=True)]


def _counts(models):
    """Of a batch: how many rows are in each bin, by model and view, flat."""
    weights = [np.column_stack([m[k] for m in models]) for k in (0, 1)]

    def run(views, place):
        bins = _bins(weights, views)
        return np.concatenate([np.bincount(bins[k][:, t], minlength=2 * END) for t in range(len(models)) for k in (0, 1)]).astype(float)

    return run


def _newton(told: Told, now):
    """Of a batch: gradients and upper triangles of the curvature from the labels that each model's views are told by the other, flat."""

    def run(views, place):
        parts = {}
        for t, k, rows, y in told(views, place):
            parts[t, 1 - k] = _gradient(views[1 - k][rows], y, np.full(len(rows), WEIGHT), now[t][1 - k])
        return np.concatenate([np.concatenate([g, h[np.triu_indices(len(g))]]) for _, (g, h) in sorted(parts.items())])

    return run


def _gradient(x, y, weight, w):
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    p = sigmoid(x @ w)
    return x.T @ (weight * (y - p)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x


class Arrays:
    """Unlabelled rows in memory."""

    def __init__(self, text, meta, place=None):
        self.views, self.rows = (text, meta), len(text)
        self.place = np.arange(self.rows) * 0.6180339887498949 % 1 if place is None else place

    def add(self, function) -> np.ndarray:
        return function(self.views, self.place)

    def only(self, told: Told) -> Arrays:
        kept = told.any(self.views, self.place)
        return Arrays(*(v[kept] for v in self.views), self.place[kept])

    def forget(self) -> None:
        pass


def _stored_views(batch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(batch.num_rows, -1) for c in ("text_view", "meta_view")]


class Stored:
    """Unlabelled rows in a table of views; function's results are added up by chunks, so that no task and not the driver holds those of all tasks."""

    def __init__(self, table: DataFrame, rows: int | None = None):
        self.table, self.rows = table, table.count() if rows is None else rows

    def only(self, told: Told) -> Stored:
        """The rows that `told` labels for any model, in a table of their own: a round's steps read only these."""

        @tidy
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(told.any(_stored_views(batch), np.asarray(batch.column("place")))))

        return Stored(durable(self.table.mapInArrow(run, self.table.schema)), self.rows)

    def forget(self) -> None:
        forget(self.table)

    def add(self, function) -> np.ndarray:
        @tidy
        def run(batches):
            total = 0
            for batch in batches:
                if batch.num_rows:
                    total = total + function(_stored_views(batch), np.asarray(batch.column("place")))
            if isinstance(total, np.ndarray):
                parts = [total[at : at + CHUNK].tobytes() for at in range(0, len(total), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "part"])

        def merge(table):
            parts = [np.frombuffer(b) for b in table["part"].to_pylist()]
            return pa.table({"chunk": table["chunk"][:1], "part": pa.array([np.sum(parts, 0).tobytes()], pa.binary())})

        schema = "chunk int, part binary"
        found = self.table.mapInArrow(run, schema).groupBy("chunk").applyInArrow(merge, schema).collect()
        if not found:  # no rows
            return function([np.zeros((0, TEXT_WIDTH), np.float32), np.zeros((0, META_WIDTH), np.float32)], np.zeros(0))
        return np.concatenate([np.frombuffer(r.part) for r in sorted(found, key=lambda r: r.chunk)])


def _cut(counts: np.ndarray, most: int) -> tuple[int, float]:
    """The bin, from the surest on, at which `most` rows are reached, and the part of it that is taken."""
    before = np.cumsum(counts) - counts
    at = int(np.searchsorted(before + counts, most))
    return (at, (most - before[at]) / counts[at]) if at < len(counts) else (len(counts), 0.0)


def _exchanges(views, y, weights, pool, rounds=ROUNDS):
    """Both views' weights after the rounds, for each weighting of the labelled rows, from these and the pool's rows."""
    models = [[logistic(v, y, weight=w) for v in views] for w in weights]
    n = pool.rows
    sure = END - 256  # bins on either side that are sure
    for _ in range(rounds if n else 0):
        counts = pool.add(_counts(models)).reshape(len(models), 2, 2 * END)
        cuts = []
        for t, w in enumerate(weights):
            mean, most = np.average(y, weights=w), max(1, int(GIVEN * n))
            high, low = max(1, int(most * mean)), max(1, int(most * (1 - mean)))
            cuts.append([])
            for c in counts[t]:
                (a, more), (b, less) = _cut(c[::-1][:sure], high), _cut(c[:sure], low)
                cuts[t].append((2 * END - 1 - a, more, b, less))
        told = Told(models, cuts)
        models = [list(m) for m in models]
        chosen = pool.only(told)
        for _ in range(STEPS):
            flat, at, far = chosen.add(_newton(told, models)), 0, 0.0
            for t, w in enumerate(weights):
                for k, v in enumerate(views):
                    d = v.shape[1] + 1
                    gain, curve = _gradient(v, y, w, models[t][k])
                    upper = np.zeros((d, d))
                    upper[np.triu_indices(d)] = flat[at + d : at + d + d * (d + 1) // 2]
                    penalty = np.append(np.ones(d - 1), 1e-6)
                    gain = gain + flat[at : at + d] - penalty * models[t][k]
                    step = np.linalg.solve(curve + upper + np.triu(upper, 1).T + np.diag(penalty), gain)
                    models[t][k] = models[t][k] + step
                    far = max(far, np.abs(step).max())
                    at += d + d * (d + 1) // 2
            if far < 1e-6:
                break
        chosen.forget()
    return models


def _exchange(views, y, pool, rounds=ROUNDS):
    """Both views' weights after the rounds, from labelled rows and the pool's arrays."""
    return _exchanges(views, y, [np.ones(len(y))], Arrays(*pool), rounds)[0]


def co_train(text, meta, y, pool, rounds: int = ROUNDS, folds: int = FOLDS) -> CoTrained:
    """y: 1 for good, 0 for bad.  All folds share the passes over the pool."""
    views = (text, meta)
    fold = np.arange(len(y)) % folds
    *parts, final = _exchanges(views, y, [*((fold != f).astype(float) for f in range(folds)), np.ones(len(y))], pool, rounds)
    out = np.zeros((len(y), 2))
    for f, models in enumerate(parts):
        out[fold == f] = np.column_stack([linear(m, v[fold == f]) for m, v in zip(models, views, strict=True)])
    return CoTrained(final[0], final[1], logistic(out, y, ridge=1e-3))


_SCHEMA = "id long, label int, text_view array<float>, meta_view array<float>"


def _featurise(batches):
    for batch in batches:
        text, meta = _views(batch)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float32())) for v in (text, meta)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), *lists], ["id", "label", "text_view", "meta_view"])


def _collect(rows: DataFrame):
    table = rows.select("_id", "_label", "text", "source", "lang", "n_chars").mapInArrow(_featurise, _SCHEMA).toArrow()
    ids = np.asarray(table["id"].combine_chunks())
    order = np.argsort([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) for i in ids], kind="stable") if len(ids) else np.zeros(0, int)
    text, meta = (table[c].combine_chunks().values.to_numpy().reshape(len(ids), width)[order] for c, width in (("text_view", TEXT_WIDTH), ("meta_view", META_WIDTH)))
    return np.asarray(table["label"].combine_chunks())[order], text, meta


@tidy
def _store(batches):
    for batch in batches:
        text, meta = _views(batch)
        lists = [pa.array([row.tobytes() for row in v], pa.binary()) for v in (text, meta)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), *lists], ["doc_id", "place", "text_view", "meta_view"])


def _unlabelled(read: DataFrame, labels: DataFrame) -> DataFrame:
    """The views of all rows whose doc_id isn't in labels, with their place in [0, 1)."""
    known = durable(labels.select("doc_id").where("doc_id is not null").distinct())
    few = small(known)
    placed = read.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    store = lambda rows: rows.mapInArrow(_store, "doc_id long, place double, text_view binary, meta_view binary")
    # views are narrower than texts: if the join shuffles, it's these that it moves
    found = store(placed).join(known, "doc_id", "left_anti") if few is known else store(placed.join(few, "doc_id", "left_anti"))
    return durable(found.select("place", "text_view", "meta_view"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> CoTrained | None:
    """Fitted on at most `rows` labelled documents, those whose ids hash lowest, and all unlabelled ones; None without labels of both kinds."""
    read = docs.select("doc_id", "text", "source", "lang", "n_chars")
    label, text, meta = _collect(labelled_sample(read, labels, "quality", rows))
    if not len(label) or label.min() == label.max():
        return None
    return co_train(text, meta, (label > 0).astype(float), Stored(_unlabelled(read, labels)))


def _scorer(model: CoTrained, limit: float):
    def views(batch):
        for at in range(0, batch.num_rows, 1000):
            yield model.score(*_views(batch.slice(at, 1000)))

    return lambda batch: tuple(np.concatenate(x) for x in zip(*views(batch), strict=True)) if batch.num_rows else (np.zeros(0),) * 3


def quality_scores(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, text_score, meta_score, score, kept.

    Null or empty texts have the empty view; nulls in source, lang and n_chars are values of
    their own.  Without labels of both kinds scores are null and everything is kept.
    Repeated rows are scored alike; a null doc_id is carried.  Only the columns of
    documents, and doc_id and quality of labels, are read.
    """
    model = fit(docs, labels)
    if model is None:
        null = F.lit(None).cast("double")
        return docs.select("doc_id", null.alias("text_score"), null.alias("meta_score"), null.alias("score"), F.lit(True).alias("kept"))
    score = _scorer(model, limit)

    @tidy
    def run(batches):
        for batch in batches:
            a, b, both = score(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (a, b, both, both >= limit))], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all columns of docs."""
    model = fit(docs, labels)
    if model is None:
        return docs
    score = _scorer(model, limit)

    @tidy
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(batch)[2] >= limit))

    return docs.mapInArrow(run, docs.schema)
