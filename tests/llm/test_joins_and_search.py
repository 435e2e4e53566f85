"""The n-gram join and BM25 against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import bm25, common, jaccard_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)].append(d)
    return Counter((d, len(sets[i]), min(low[root(i)], default=None), links[i]) for i, (d, _) in enumerate(rows))


def corpus(rng, n):
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randint(0, 30))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                if w:
                    w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w[: rng.randint(max(1, len(w) * 3 // 4), len(w))] if w and rng.random() < 0.4 else w))
        elif kind < 0.6:
            texts.append(" ".join(word() for _ in range(rng.randint(0, 6))))
        else:
            body = [word() for _ in range(rng.randint(5, 120))]
            texts.append(" ".join(body) + (" " + passage if kind > 0.85 else ""))
    return texts


def test_shingles_are_whole_and_lower_cased():
    texts = ["a b c d e f", "A b  C\x0bd e f g", "", None, "x y", "X  y\n", "é ß w q r t", "É ß w q r t", "a b c d e f a b c d e f", " ", "a"]
    got = dict(common.shingle_sets(pa.array(texts)))
    for i, a in enumerate(texts):
        assert len(got[i]) == len(shingles(a))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(a) & shingles(b))
    sliced = dict(common.shingle_sets(pa.array(texts).slice(4, 3)))
    assert all((sliced[k] == got[4 + k]).all() for k in range(3))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_is_exact(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = list(enumerate(corpus(rng, 220)))
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, "  "), (None, rows[0][1]), (None, "only here and nowhere else"), rows[1], rows[1], (905, "Two words"), (904, "two WORDS")]
    if seed == 2:
        monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # groups beyond a block are joined block by block
        monkeypatch.setattr(common, "HOT", 3)  # and hot keys apart from others
        monkeypatch.setattr(common, "fits", lambda df, *_: False)
    if seed == 3:
        monkeypatch.setattr(jaccard_join, "WHOLE", 2)  # groups of a few classes are dealt into blocks too
        monkeypatch.setattr(jaccard_join, "SPREAD", 3)
    docs = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], "doc_id long, text string, key string, n long, id long, `row` int").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == brute_join(rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c, _ in brute_join(rows) if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want)


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert jaccard_join.one_of_each(docs).count() == 0
    empty = spark.createDataFrame([(2, None), (1, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(empty).collect())) == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5)]
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: label[n] for n in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_search(rows, queries, k):
    docs = [(d, Counter((t or "").encode().lower().split())) for d, t in rows]
    size, length = len(docs), {}
    average = max(sum(c.total() for _, c in docs) / size, 1.0)
    df = Counter(w for _, c in docs for w in c)
    out = set()
    for q, t in queries:
        found = []
        for d, c in docs:
            if d is None:
                continue
            score = sum(math.log(1 + (size - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / average)) for w in set((t or "").encode().lower().split()) & c.keys())
            if score > 0:
                found.append((-round(score, 9), d))
        out |= {(q, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k])}
    del length
    return out


@pytest.mark.parametrize(("docs", "block"), [(60, 4096), (700, 3)])
def test_search_is_exact(spark, docs, block, monkeypatch):
    rng = random.Random(docs)
    rows = list(enumerate(corpus(rng, docs)))
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), rows[3]]
    monkeypatch.setattr(bm25, "QUERY_BLOCK", block)
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, rank int").repartition(3, "text")
    asked = [r for r in rows[:-1] if r[0] is not None and (r[0] % 10 == 0)]
    queries = frame.where("doc_id % 10 = 0")
    got = {(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in bm25.bm25_top(frame, queries, 5).collect()}
    want = brute_search(rows, asked, 5)
    assert {(q, r, round(s, 6)) for q, r, _, s in got} == {(q, r, round(s, 6)) for q, r, _, s in want}
    ties = Counter((q, round(s, 6)) for q, _, _, s in want)
    clear = {(q, d) for q, _, d, s in want if ties[q, round(s, 6)] == 1}
    assert clear <= {(q, d) for q, _, d, _ in got}


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bm25.bm25_top(docs, docs).count() == 0
    one = spark.createDataFrame([(100, "a b")], "doc_id long, text string")
    assert bm25.bm25_top(one, docs).count() == 0
    assert bm25.bm25_top(docs, one).count() == 0
    assert [tuple(r)[:3] for r in bm25.bm25_top(one, one).collect()] == [(100, 1, 100)]


def shard_of(texts, ids=None, average=41.0):
    made = bm25.built(pa.array(ids or range(len(texts)), pa.int64()), pa.array(texts, pa.string()))
    return bm25.Shard({c: v.astype(bm25._KINDS[c]) if c in bm25._KINDS else v for c, v in made.items()}, average)


def test_pruning_skips_postings():
    rng = random.Random(1)
    tongues = [["the", "of", "and", "to", "in"], ["der", "die", "und", "zu", "im"], ["le", "la", "et", "de", "en"], ["el", "los", "y", "que", "un"]]
    texts = [" ".join(rng.choice(tongues[k % 4]) for _ in range(40)) + (f" rare{k % 400}" if k % 8 < 4 else "") for k in range(4000)]
    shard = shard_of(texts)
    asked = bm25._postings(pa.array(["the of and to in rare4"]))[1]
    terms = np.flatnonzero(np.isin(shard.terms, asked))
    idf = np.array([6.0 if d < 100 else 0.01 for d in shard.df[terms]])
    every = shard._add(terms, idf, np.ones(shard.blocks, bool))
    shard.read = 0
    found, score = shard.search(terms, idf, 5, 3.0)
    assert sorted(shard.ids[found]) == [k for k in range(4000) if k % 400 == 4 and k % 4 == 0 and k % 8 < 4]
    assert shard.read < shard.df[terms].sum() / 2
    assert score == pytest.approx(every[found])
    found, score = shard.search(terms, idf, 5)  # without a threshold: at least the best five
    assert sorted(score)[-5:] == pytest.approx(sorted(every)[-5:])


@pytest.mark.parametrize("least", [0.0, 0.3, 1.0])
def test_shard_finds_what_brute_force_finds(least):
    rng = random.Random(3)
    texts = [*corpus(rng, 300), None, "", "\u00e9 x" * 50_000]
    ids = [*range(300), 300, 301, 302]
    shard = shard_of(texts, ids, 60.0)
    for q in range(0, 300, 7):
        asked = bm25._postings(pa.array([texts[q]], pa.string()))[1]
        terms = np.flatnonzero(np.isin(shard.terms, asked))
        idf = np.log1p((shard.docs - shard.df[terms] + 0.5) / (shard.df[terms] + 0.5))
        every = shard._add(terms, idf, np.ones(shard.blocks, bool))
        limit = least * np.sort(every)[-4]
        found, score = shard.search(terms, idf, 4, limit)
        assert score == pytest.approx(every[found])
        want = np.sort(every[every > 0])[-4:]
        want = want[want >= limit * (1 + 1e-12)]
        assert np.sort(score)[-len(want) :] == pytest.approx(want) if len(want) else True


def test_ties_and_long_texts(spark, monkeypatch):
    """Equal texts in many shards: the smaller ids come first, however shards and waves are cut."""
    monkeypatch.setattr(bm25, "WAVE", 2)
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(k, "one text that all share, word for word") for k in range(40)] + [(k, f"other {k} words") for k in range(40, 160)] + [(200, long)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, score string").repartition(6)
    got = bm25.bm25_top(docs, docs.where("doc_id in (0, 31, 200)"), 10).collect()
    for q in (0, 31):
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == list(range(10))
    assert [(r.doc_id, r["rank"]) for r in got if r.query_id == 200][:1] == [(200, 1)]


def test_waves_bound_what_shards_emit(spark, monkeypatch):
    """Rows that shards emit don't grow with the number of shards."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(40))) for k in range(2000)]
    emitted, add = [], common.Scratch.add
    monkeypatch.setattr(common.Scratch, "add", lambda self, df, part: (add(self, df, part), emitted.append(self.read().count()))[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)
    got = bm25.bm25_top(docs, docs.where("doc_id % 200 = 0"), 3)
    assert got.count() == 30 and len(emitted) == 3
    assert emitted[-1] < 1000  # the best 3 of each of 64 shards would be 1920


def test_queries_of_a_block_only(spark):
    docs = spark.createDataFrame([(k, f"w{k} w{k + 1}") for k in range(30)], "doc_id long, text string")
    got = bm25.bm25_top(docs, docs.where(F.col("doc_id") == 3), 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [3, 2, 4]


def test_shards_lose_no_rows(monkeypatch):
    """combine_chunks leaves several batches of very long texts; all of them are kept, and shards close by bytes."""
    batches = [pa.record_batch({"doc_id": [k], "text": ["x" * 1000]}) for k in range(24)]
    monkeypatch.setattr(bm25, "SHARD_BYTES", 5000)
    parts = list(bm25._gathered(iter(batches), 8000))
    assert len(parts) > 1 and [i for b in parts for i in b.column("doc_id").to_pylist()] == list(range(24))
    monkeypatch.setattr(bm25, "SHARD_BYTES", 1 << 40)

    class Split:
        """A table whose pieces can't be joined, as one of over 2 GiB."""

        def __init__(self, held):
            self.held = held

        def combine_chunks(self):
            return self

        def to_batches(self):
            return self.held

        @staticmethod
        def from_batches(held):
            return Split(held)

    monkeypatch.setattr(bm25.pa, "Table", Split)
    for rows in (8, 9):  # with and without a rest
        assert [i for b in bm25._gathered(iter(batches), rows) for i in b.column("doc_id").to_pylist()] == list(range(24))


@pytest.mark.parametrize(("dense", "few"), [(3, 0), (24, 4), (1000, 4)])
def test_queries_are_searched_together(dense, few, monkeypatch):
    """One pass over a shard finds for many queries what brute force finds, with and without thresholds, whatever is in matrices."""
    monkeypatch.setattr(bm25, "DENSE", dense)
    monkeypatch.setattr(bm25, "FEW", few)
    monkeypatch.setattr(bm25, "TOGETHER", 50)
    monkeypatch.setattr(bm25, "THIN", 2000)
    rng = random.Random(8)
    texts = [*corpus(rng, 1100), None, ""]
    shard = shard_of(texts)
    every, limits, ends, terms, weights = [], [], [0], [], []
    for q in range(0, 1102, 9):
        own = np.flatnonzero(np.isin(shard.terms, bm25._postings(pa.array([texts[q]], pa.string()))[1]))
        idf = np.log1p((shard.docs - shard.df[own] + 0.5) / (shard.df[own] + 0.5))
        every.append(shard._add(own, idf, np.ones(shard.blocks, bool)))
        limits.append((0.0, 0.4, 1.0)[q % 3] * np.sort(every[-1])[-4])
        ends.append(ends[-1] + len(own))
        terms.append(own)
        weights.append(idf)
    found = {q: (docs, score) for q, docs, score in shard.search_all(np.array(ends), np.concatenate(terms), np.concatenate(weights), 4, np.array(limits))}
    for q, (scores, limit) in enumerate(zip(every, limits, strict=True)):
        docs, score = found.get(q, (np.empty(0, int), np.empty(0)))
        assert (score == scores[docs]).all()
        must = np.flatnonzero((scores >= max(limit, np.sort(scores)[-4])) & (scores > 0))  # those tied with the fourth too
        assert set(must) <= set(docs) and (score >= limit).all()


def test_index_is_narrow():
    """Numbers of the index take the bytes that the largest one needs, and come back as they were."""
    for values, size in (([], 1), ([0, 255], 1), ([3, 256], 2), ([1 << 20], 4), ([1 << 40], 8)):
        content = bm25._stored("rows", np.array(values, np.int64))
        assert len(content) == 1 + size * len(values)
        assert bm25._loaded("rows", pa.py_buffer(content)).tolist() == values


def test_counts_are_packed():
    """The counting step sends a row a batch and part, however many shingles there are, and counts as brute force does."""
    texts = corpus(random.Random(9), 300)
    batches = [pa.record_batch({"text": pa.array(texts[k : k + 40])}) for k in range(0, 300, 40)]
    rows = [b for task in (batches[:3], batches[3:]) for b in jaccard_join._entries(5)(iter(task))]
    assert sum(b.num_rows for b in rows) == 5 * len(batches)
    got = Counter()
    for part in range(5):
        for b in jaccard_join._shared(iter([b.filter(np.asarray(b.column("part")) == part) for b in rows])):
            got.update(dict(zip(*b.to_pydict().values(), strict=True)))
    sets = {jaccard_join._key(s): s[s < jaccard_join.SEEN] for _, s in common.shingle_sets(pa.array(texts)) if len(s)}
    df = Counter(x for s in sets.values() for x in s.tolist())
    want = {int(np.uint64(k).astype(np.int64)): n for k, s in sets.items() if (n := sum(df[x] > 1 for x in s.tolist()))}
    # a class that two tasks have may count twice: the filter needs no less than the true number
    twice = {jaccard_join._key(s) for _, s in common.shingle_sets(pa.array(texts[:120])) if len(s)} & {jaccard_join._key(s) for _, s in common.shingle_sets(pa.array(texts[120:])) if len(s)}
    twice = {int(np.uint64(k).astype(np.int64)) for k in twice}
    assert got.keys() == want.keys() and all(got[k] == n or (k in twice and got[k] > n) for k, n in want.items())
    assert list(jaccard_join._shared(iter([]))) == []


def test_only_wanted_sets_are_given_out():
    """Sets of classes that can't link don't leave the task that reads them."""
    texts = corpus(random.Random(10), 60)
    batch = pa.record_batch({"text": pa.array(texts)})
    every = [k for b in jaccard_join._sets(None)(iter([batch])) for k in b.column("key").to_pylist()]

    class Sent:
        value = np.sort(np.array(every[::7], np.int64).view(np.uint64))

    some = [k for b in jaccard_join._sets(Sent)(iter([batch])) for k in b.column("key").to_pylist()]
    assert some == every[::7] and len(every) == len(set(every)) > 7
