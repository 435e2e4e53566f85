"""Held-out accuracy of the classifiers, their parts, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import linear, quality_classifier, toxicity

SYLLABLES = ["an", "er", "th", "ou", "st", "re", "in", "on", "ti", "ed"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def junk(rng, n):
    kind = rng.random()
    words = prose(rng, n).split()
    if kind < 0.4:
        return " ".join(w + rng.choice(["***", "%%%", "&&&"]) for w in words)
    if kind < 0.7:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w for w in words[: n // 8 + 1] for _ in range(8))


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < linear.sigmoid(2 * x[:, 0] - x[:, 1] + 0.5)).astype(float)
    assert linear.logistic(x, y, ridge=1e-3) == pytest.approx([2, -1, 0, 0.5], abs=0.25)


def test_quality(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for k in range(900):
        good = rng.random() < 0.75
        text = (prose if good else junk)(rng, rng.randint(40, 160))
        rows.append((k, text, f"s{rng.randint(0, 5)}", "en", len(text)))
        truth[k] = good
    rows += [(5000, None, None, None, None), (5001, "", "s1", "en", 0), (None, rows[0][1], "s1", "en", 5), rows[1]]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, score int")
    known = [(k, int(truth[k]), 0) for k in range(0, 900, 3)] + [(None, 1, 0), (1, None, 0), (4, 0, 0), (4, 1, 0)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3]
    assert sum(r.kept == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.kept for r in held if truth[r.doc_id]) / sum(truth[r.doc_id] for r in held) > 0.98
    kept = quality_classifier.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    again = quality_classifier.quality_scores(docs.repartition(5), labels).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in got} == {(r.doc_id, round(r.score, 9)) for r in again}
    none = labels.limit(0)
    assert all(r.kept and r.score is None for r in quality_classifier.quality_scores(docs, none).collect())
    assert quality_classifier.good_documents(docs, none).count() == len(rows)
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_views_help_each_other():
    """The text view has few labels and the metadata view tells all: exchange lifts the text view."""
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.5).astype(float)
    direction = rng.normal(size=60)
    text = y[:, None] * direction * 0.5 + rng.normal(size=(4000, 60))
    meta = y[:, None] * 6 + rng.normal(size=(4000, 1))
    fit, pool, test = slice(0, 60), slice(60, 2000), slice(2000, 4000)
    accuracy = lambda w: ((linear.linear(w, text[test]) > 0) == y[test]).mean()
    alone = quality_classifier._exchange([text[fit], meta[fit]], y[fit], (text[pool], meta[pool]), rounds=0)[0]
    together = quality_classifier._exchange([text[fit], meta[fit]], y[fit], (text[pool], meta[pool]), rounds=6)[0]
    assert accuracy(together) > accuracy(alone) + 0.005


BAD = ["nasty", "vile", "rotten", "horrid", "foul"]


def toxic_corpus(rng, n):
    rows, truth = [], {}
    for k in range(n):
        words = prose(rng, rng.randint(60, 150)).split()
        truth[k] = rng.random() < 0.2
        if truth[k]:
            for w in rng.sample(BAD, rng.randint(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice([w, w.upper() + "!!", w + "***"]))
        rows.append((k, " ".join(words)))
    return rows, truth


def test_toxicity(spark):
    rng = random.Random(4)
    rows, truth = toxic_corpus(rng, 1500)
    rows += [(9000, None), (9001, ""), (None, "so vile and foul"), rows[0]]
    docs = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, toxic boolean")
    labels = spark.createDataFrame([(k, int(truth[k]), 1) for k in range(0, 1500, 2)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 2]
    hits = sum(r.toxic and truth[r.doc_id] for r in held)
    assert hits / sum(truth[r.doc_id] for r in held) > 0.97 and hits / sum(r.toxic for r in held) > 0.97
    by = {r.doc_id: r for r in got}
    assert not by[9000].toxic and not by[9001].toxic and by[None].toxic
    severe = [r for r in held if r.severe]
    assert severe and sum(r.toxic for r in severe) / len(severe) > 0.95
    words = {r[0]: len({b for b in BAD if b in r[1].lower()}) for r in rows if r[1]}
    assert np.mean([words[r.doc_id] >= 3 for r in severe]) > 0.9
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.toxic for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_chain_feeds_out_of_fold_predictions():
    """The second category follows from the first alone, so its model leans on the first's probability."""
    rng = np.random.default_rng(5)
    y = (rng.random(600) < 0.4).astype(np.int64)
    lists = [np.sort(rng.choice(np.arange(10, 2000), 20, replace=False)).astype(np.int32) for _ in y]
    lists = [np.unique(np.append(x, 5)).astype(np.int32) if t else x for x, t in zip(lists, y, strict=True)]
    chain = toxicity.Chain(lists, {"toxic": y, "severe": y}, folds=4)
    first, second = chain.links["toxic"], chain.links["severe"]
    assert len(second.w) == len(second.chosen) + 2 and second.w[-2] > 1
    assert 5 in first.features
    p = chain.score([{5, 11}, {11}])
    assert p["severe"][0] > 0.8 and p["severe"][1] < 0.3


def test_chain_is_the_plain_chain():
    """Scores are those of a chain written out: out-of-fold probabilities of the first category are features of the second, whose labels each fold derives by itself."""
    rng = np.random.default_rng(8)
    n, folds = 400, 4
    y = (rng.random(n) < 0.3).astype(np.int64)
    bad = np.arange(4, 4 * 9, 4)
    lists = [np.unique(np.append(4 * rng.choice(np.arange(20, 200), 15), rng.choice(bad, rng.integers(1, 6)) if t else [])).astype(np.int32) for t in y]
    chain = toxicity.Chain(lists, {"toxic": y, "severe": toxicity.severe(y)}, folds=folds)
    every = np.unique(np.concatenate(lists))
    dense = np.array([np.isin(every, x) for x in lists], float)

    def fit(target, rows, earlier):
        a, b = dense[rows][target[rows] == 1], dense[rows][target[rows] == 0]
        n1, n0 = max(len(a), 1), max(len(b), 1)
        gap = a.sum(0) / n1 - b.sum(0) / n0
        z = np.abs(gap) / np.sqrt((a.sum(0) + 1) / n1**2 + (b.sum(0) + 1) / n0**2)
        z[(dense[rows].sum(0) < 3) | (dense.sum(0) < 3)] = 0
        chosen = np.flatnonzero(z > 2.5)
        terms = every[chosen[(gap[chosen] > 0) & (b.sum(0)[chosen] <= 0.02 * a.sum(0)[chosen])]]
        w = linear.logistic(np.column_stack([dense[rows][:, chosen], earlier[rows]]), target[rows].astype(float), ridge=0.02)
        return terms, lambda x, e: linear.sigmoid(linear.linear(w, np.column_stack([x[:, chosen], e])))

    parts, out, none = [], np.zeros(n), np.zeros((n, 0))
    for k in range(folds):
        held = np.arange(n) % folds == k
        parts.append(fit(y, np.flatnonzero(~held), none))
        out[held] = parts[k][1](dense[held], none[held])
    terms, first = fit(y, np.arange(n), none)
    second = fit(y * (np.array([np.isin(x, terms).sum() for x in lists]) >= 3), np.arange(n), out[:, None])[1]
    got = chain.score([set(x.tolist()) for x in lists])
    p = first(dense, none)
    assert got["toxic"] == pytest.approx(p, abs=1e-6)
    assert got["severe"] == pytest.approx(second(dense, p[:, None]), abs=1e-6)


def test_sample_is_bounded_by_rows(spark):
    """An id that is there very often doesn't fill the sample, and the sample has no more rows than asked for."""
    docs = spark.createDataFrame([(1, f"text {k % 700}") for k in range(5000)] + [(k, f"t {k}") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(1, 60)], "doc_id long, toxic int")
    assert linear.labelled_sample(docs, labels, "toxic", 10).count() == 10
    assert linear.labelled_sample(docs, labels, "toxic", 1000).count() == 758


def test_all_unlabelled_documents_take_part(spark):
    """Sums over the stored views are those over arrays of all rows, more than the 6000 of the former pool."""
    rng = np.random.default_rng(6)
    n = 9000
    docs = spark.createDataFrame([(k, f"{'ab cd' if k % 2 else 'XY! Z'} {k}", f"s{k % 5}", "en", 10) for k in range(n)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    pool = quality_classifier.Stored(quality_classifier._unlabelled(docs.repartition(3), labels))
    assert pool.rows == n - 100
    models = [[rng.normal(size=quality_classifier.TEXT_WIDTH + 1), rng.normal(size=quality_classifier.META_WIDTH + 1)] for _ in range(2)]
    texts, metas = zip(*((quality_classifier.text_view(r.text), quality_classifier.meta_view(r.source, r.lang, r.n_chars)) for r in docs.where("doc_id >= 100").collect()), strict=True)
    counts = quality_classifier._counts(models)
    assert pool.add(counts).tolist() == quality_classifier.Arrays(np.stack(texts), np.stack(metas)).add(counts).tolist()
    told = quality_classifier.Told(models, [[(0, 0.0, 0, 0.0)] * 2] * 2)
    newton = quality_classifier._newton(told, models)
    assert pool.add(newton) == pytest.approx(quality_classifier.Arrays(np.stack(texts), np.stack(metas)).add(newton))
    # a round's steps read only the rows that some model labels, with the same sums
    ends = [[int(np.searchsorted(np.cumsum(c), part * c.sum())) for part in (0.95, 0.05)] for c in pool.add(counts).reshape(4, -1)]
    some = quality_classifier.Told(models, [[(high, 0.1, low, 0.1) for high, low in ends[t : t + 2]] for t in (0, 2)])
    chosen = pool.only(some)
    assert 0 < chosen.table.count() < pool.rows
    newton = quality_classifier._newton(some, models)
    assert chosen.add(newton) == pytest.approx(pool.add(newton))
    # with nothing to label the sums are zero
    none = quality_classifier.Told(models, [[(2 * quality_classifier.END, 0.0, -1, 0.0)] * 2] * 2)
    nothing = pool.only(none)
    assert nothing.table.count() == 0 and not nothing.add(quality_classifier._newton(none, models)).any()
