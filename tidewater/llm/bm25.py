"""Exact top-k BM25 search: block-max WAND over persisted shards, merged with global statistics.

Index.  One scan cuts the rows into shards and writes an inverted index of each to the
shared folder: sorted terms, their postings in document order, document lengths.  Documents
of a shard are renumbered, those with the same commonest term together and by length, so
that blocks of neighbours are alike.  Document frequencies and the average length come from
the index.

Search.  Queries of a block are searched in a shard together.  The documents are cut into
blocks of DOC_BLOCK neighbours and tiles of some blocks.  In a tile the commoner terms are
rows of a matrix, with their largest impact in each block; the rarer ones stay in lists.  The
rare lists are read first.  A query's pivots are the blocks in which its best sum so far and
the block maxima add up to the threshold.  Only in the tiles with pivots, and only for the
queries that have them there, the common terms follow, as one product of matrices; where a
few documents of a tile can reach the threshold, these alone are scored.  Products are in
single precision with a margin; what passes is scored exactly.

Waves.  The first wave searches a few shards; each further one eight times as many, with the
k-th best score so far as the starting threshold of each query.  So a wave's tasks emit about
8 k rows a query, however many shards it has, and the rows grow as the queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Scratch, durable, mix, signed, text_chunks, tidy, word_hashes

K1, B, TOP = 1.2, 0.75, 10
#: Queries, and distinct terms of all of them, about, that are searched in one pass.
QUERY_BLOCK, TERM_BLOCK = 8192, 3_000_000
#: Documents of a block of postings; words by which documents are grouped.
DOC_BLOCK, LEADS = 64, 64
#: Documents of a tile; postings of a term in one from which on they are a row of its matrix.
TILE, DENSE = 8 * DOC_BLOCK, 24
#: Queries that a shard searches together; postings of thin lists that are added at once, about; documents of a tile up to which each is scored by itself.
TOGETHER, THIN, FEW = 512, 1 << 16, 4
#: Documents of a shard, and bytes at which it is closed with fewer.
SHARD_ROWS, SHARD_BYTES = 8000, 48 << 20
#: Each wave has so many times the shards of all before it, about.
WAVE = 8


def _postings(column: pa.Array):
    """Rows, terms and counts of the distinct terms of each row, by row and term, and the rows' lengths."""
    rows, terms, counts, lengths = [np.empty(0, np.int32)], [np.empty(0, np.uint64)], [np.empty(0, np.int32)], np.zeros(len(column), np.int64)
    for first, offsets, data in text_chunks(column):
        h, ends = word_hashes(offsets, data)
        n = np.diff(ends)
        lengths[first : first + len(n)] = n
        if not len(h):
            continue
        own, at = np.unique(h, return_inverse=True)
        key = np.sort(np.repeat(np.arange(len(n)), n) * len(own) + at)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        row, at = np.divmod(key[start], len(own))
        rows.append((row + first).astype(np.int32))
        terms.append(own[at])
        counts.append(np.diff(np.append(start, len(key))).astype(np.int32))
    return np.concatenate(rows), np.concatenate(terms), np.concatenate(counts), lengths


def _query_terms(batches):
    for batch in batches:
        row, term, _, _ = _postings(batch.column("text"))
        ids = np.asarray(batch.column("doc_id"))
        yield from pa.table({"query_id": ids[row], "term": signed(term)}).to_batches(50_000)


def _slices(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    runs = ends - starts
    return np.repeat(starts - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())


# ---------------------------------------------------------------- the index

_INDEX = "place double, docs long, words long, known long, ids binary, lengths binary, terms binary, ends binary, rows binary, counts binary"
_KINDS = {"ids": np.int64, "lengths": np.int64, "terms": np.uint64, "ends": np.int64, "rows": np.uint32, "counts": np.uint32}
#: Columns that are stored in as few bytes a number as their largest needs, a last byte says how many.
_NARROW = ("lengths", "ends", "rows", "counts")


def built(ids: pa.Array, texts: pa.Array) -> dict:
    """A shard: `known` documents with an id come first; all of them count in the frequencies."""
    row, term, tf, lengths = _postings(texts)
    n = len(lengths)
    terms, at = np.unique(term, return_inverse=True)
    del term
    # documents are grouped by the commonest of their words that is among the LEADS commonest here
    rank = np.zeros(len(terms), np.uint8)
    common = np.argsort(np.bincount(at, minlength=len(terms)), kind="stable")[-LEADS:]
    rank[common] = np.arange(1, len(common) + 1)
    some = np.flatnonzero(rank[at])
    some = some[np.argsort(rank[at[some]], kind="stable")]
    lead = np.zeros(n, np.int64)
    lead[row[some]] = rank[at[some]]  # of equal places the last, which is the commonest, stays
    nameless = np.asarray(ids.is_null())
    order = np.lexsort((lengths, lead, nameless))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by = np.argsort(at * n + place[row])
    return {
        "docs": n,
        "words": int(lengths.sum()),
        "known": int(n - nameless.sum()),
        "ids": np.asarray(ids.fill_null(0))[order].astype(np.int64),
        "lengths": lengths[order],
        "terms": terms,
        "ends": np.append(0, np.cumsum(np.bincount(at, minlength=len(terms)))),
        "rows": place[row[by]],
        "counts": tf[by],
    }


def _stored(name: str, values: np.ndarray) -> bytes:
    if name not in _NARROW:
        return values.astype(_KINDS[name]).tobytes()
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return values.astype(kind).tobytes() + bytes([kind.itemsize])


def _loaded(name: str, content: pa.Buffer) -> np.ndarray:
    if name not in _NARROW:
        return np.frombuffer(content, _KINDS[name])
    size = memoryview(content)[-1]
    return np.frombuffer(content, f"u{size}", (len(content) - 1) // size)


@tidy
def _index(batches):
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(_gathered(batches, SHARD_ROWS)):
        shard = built(batch.column("doc_id"), batch.column("text"))
        at = int(mix(np.array([(part << 24) + k + 1], np.uint64))[0]) / 2.0**64
        row = {"place": at} | {c: _stored(c, v) if c in _KINDS else v for c, v in shard.items()}
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row.values()], list(row))


def _read(batch: pa.RecordBatch, columns):
    """The shards of a batch, one at a time."""
    for k in range(batch.num_rows):
        yield {c: _loaded(c, batch.column(c)[k].as_buffer()) if c in _KINDS else batch.column(c)[k].as_py() for c in columns}


@tidy
def _frequencies(batches):
    for batch in batches:
        for shard in _read(batch, ("terms", "ends")):
            yield from pa.table({"term": signed(shard["terms"]), "df": np.diff(shard["ends"].astype(np.int64))}).to_batches(50_000)


class Shard:
    """A shard's postings with their impacts.

    The documents are cut into tiles of TILE.  The postings that a term has in a tile are a
    row of the tile's matrix if they are DENSE or more; all others stay in the term's thin
    list.  Block maxima are those of the matrices' rows.
    """

    def __init__(self, shard: dict, average: float):
        self.ids, self.known, self.docs, self.terms = shard["ids"], shard["known"], shard["docs"], shard["terms"]
        self.row, self.ends = shard["rows"].astype(np.int32), shard["ends"].astype(np.int64)
        self.df = np.diff(self.ends)
        norm = K1 * (1 - B + B * shard["lengths"] / average)
        tf = shard["counts"].astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + norm[self.row])
        del tf
        self.of = np.arange(self.docs) // DOC_BLOCK
        self.blocks = -(-self.docs // DOC_BLOCK)
        self.tiles = max(-(-self.docs // TILE), 1)
        term_of = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        cell = term_of.astype(np.int64) * self.tiles + self.row // TILE
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(cell)))
        dense = count >= DENSE
        thin = np.repeat(~dense, count)
        self.thin_ends = np.append(0, np.cumsum(thin))[self.ends]
        self.thin_row, self.thin_impact = self.row[thin], self.impact[thin]
        first, count = first[dense], count[dense]
        term, tile = np.divmod(cell[first], self.tiles)
        del cell, new, thin
        #: Terms with a row in a matrix, and the number of each among them.
        common = np.unique(term)
        self.column = np.full(len(self.terms) + 1, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.block_max = np.zeros((len(common), self.tiles * TILE // DOC_BLOCK), np.float32)
        #: Of each tile: its terms (as columns), their impacts by document, and their numbers of postings.
        self.matrix = []
        for k in range(self.tiles):
            own = np.flatnonzero(tile == k)
            at = _slices(first[own], first[own] + count[own])
            held = np.zeros((len(own), TILE), np.float32)
            held[np.repeat(np.arange(len(own)), count[own]), self.row[at] - k * TILE] = self.impact[at]
            columns = self.column[term[own]]
            self.block_max[columns, k * TILE // DOC_BLOCK : (k + 1) * TILE // DOC_BLOCK] = held.reshape(len(own), TILE // DOC_BLOCK, DOC_BLOCK).max(2)
            self.matrix.append((columns, held, count[own]))
        # terms and impacts by document, and by term within one
        order = np.argsort(self.row.astype(np.uint16) if self.docs < 1 << 16 else self.row, kind="stable")
        self.by_row, self.by_row_impact = term_of[order], self.impact[order]
        self.row_ends = np.append(0, np.cumsum(np.bincount(self.row, minlength=self.docs)))
        self.weight = np.zeros(len(self.terms))  # of one query's terms, while it is scored
        self.read = 0  # postings that searches have read

    def _add(self, terms: np.ndarray, idf: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The sum by document over the terms' postings in live blocks.

        Terms are added in one order, so equal texts have equal sums.
        """
        a, b = self.ends[terms], self.ends[terms + 1]
        at, weight = _slices(a, b), np.repeat(idf, b - a)
        if not live.all():
            hit = live[self.of[self.row[at]]]
            at, weight = at[hit], weight[hit]
        self.read += len(at)
        return np.bincount(self.row[at], weight * self.impact[at], self.docs)

    def _exact(self, docs: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """The documents' scores: from their own postings, or from the terms' lists where that is less; the sums are the same."""
        if (self.row_ends[docs + 1] - self.row_ends[docs]).sum() > self.df[terms].sum():
            return self._add(terms, idf, np.ones(self.blocks, bool))[docs]
        a, b = self.row_ends[docs], self.row_ends[docs + 1]
        at = _slices(a, b)
        self.read += len(at)
        self.weight[terms] = idf
        out = np.bincount(np.repeat(np.arange(len(docs)), b - a), self.weight[self.by_row[at]] * self.by_row_impact[at], len(docs))
        self.weight[terms] = 0
        return out

    def _thin(self, ends: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """The sums over the thin lists, a row a query."""
        n, width = len(ends) - 1, self.tiles * TILE
        out = np.empty((n, width), np.float32)
        a, b = self.thin_ends[terms], self.thin_ends[terms + 1]
        query = np.repeat(np.arange(n), np.diff(ends))
        upto = np.append(0, np.cumsum(b - a))
        self.read += int(upto[-1])
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(upto[ends], upto[ends[lo]] + THIN, "right")) - 1)
            of = slice(ends[lo], ends[hi])
            runs = b[of] - a[of]
            at = _slices(a[of], b[of])
            place = np.repeat((query[of] - lo) * width, runs)
            place += self.thin_row[at]
            out[lo:hi] = np.bincount(place, np.repeat(idf[of], runs) * self.thin_impact[at], (hi - lo) * width).reshape(hi - lo, width)
            lo = hi
        return out

    def _candidates(self, ends: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int, least: np.ndarray):
        """(queries, documents) that may reach `least`, and the best k of queries without one."""
        n, per = len(ends) - 1, TILE // DOC_BLOCK
        query, column = np.repeat(np.arange(n), np.diff(ends)), self.column[terms]
        weight = np.zeros((n, len(self.block_max)), np.float32)
        weight[query[column >= 0], column[column >= 0]] = idf[column >= 0]
        # sums of so many numbers of 24 bits are off by less than this part
        slip = (np.diff(ends) + 16) * 2.0**-22
        reach = self._thin(ends, terms, idf)
        reach[:, self.known :] = -np.inf
        bound = (weight @ self.block_max) * (1 + slip)[:, None]
        floor = least * (1 - slip)
        # pivots: blocks in which the best thin sum and the block maxima add up to the threshold
        pivot = (reach.reshape(n, self.tiles * per, DOC_BLOCK).max(2) + bound >= np.maximum(floor, 1e-300)[:, None]).reshape(n, self.tiles, per).any(2)
        opened = least <= 0
        found = []
        for tile, (columns, held, count) in enumerate(self.matrix):
            rows = np.flatnonzero(pivot[:, tile])
            if not len(rows):
                continue
            at = slice(tile * TILE, (tile + 1) * TILE)
            may = reach[rows, at] + np.repeat(bound[rows, tile * per : (tile + 1) * per], DOC_BLOCK, axis=1) >= floor[rows, None]
            many = opened[rows] | (may.sum(1) > FEW)
            q, doc = np.nonzero(may & ~many[:, None])
            found.append((rows[q], doc + tile * TILE))
            rows = rows[many]
            if not len(rows):
                continue
            own = weight[rows][:, columns]
            self.read += int((own > 0).sum(0) @ count)
            total = reach[rows, at] + own @ held
            reach[rows, at] = total
            q, doc = np.nonzero((total >= np.maximum(floor[rows], 1e-300)[:, None]) & ~opened[rows, None])
            found.append((rows[q], doc + tile * TILE))
        for q in np.flatnonzero(opened):
            total = reach[q]
            limit = max(np.partition(total, -k)[-k] * (1 - 2 * slip[q]), 0.0) if len(total) > k else 0.0
            docs = np.flatnonzero((total > 0) & (total >= limit))
            found.append((np.full(len(docs), q), docs))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def search_all(self, ends: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int, least: np.ndarray):
        """Yields (query, documents, scores): those that may be among its best k; those tied with the k-th too.

        terms: numbers of the queries' terms here, ascending in each query, which `ends` cuts.
        Documents below a query's `least` are left out.
        """
        for lo in range(0, len(ends) - 1, TOGETHER):
            hi = min(lo + TOGETHER, len(ends) - 1)
            of = slice(ends[lo], ends[hi])
            queries, docs = self._candidates(ends[lo : hi + 1] - ends[lo], terms[of], idf[of], k, least[lo:hi])
            order = np.lexsort((docs, queries))
            queries, docs = queries[order], docs[order]
            asked, first = np.unique(queries, return_index=True)
            for q, a, b in zip(asked.tolist(), first.tolist(), np.append(first, len(docs))[1:].tolist(), strict=True):
                own = slice(ends[lo + q], ends[lo + q + 1])
                score = self._exact(docs[a:b], terms[own], idf[own])
                keep = (score >= least[lo + q]) & (score > 0)
                if keep.any():
                    yield lo + q, docs[a:b][keep], score[keep]

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The same for one query."""
        for _, docs, score in self.search_all(np.array([0, len(terms)]), terms, idf, k, np.array([least])):
            return docs, score
        return np.empty(0, np.int64), np.empty(0)


# ---------------------------------------------------------------- over tables

_HIT = "query_id long, doc_id long, score double"


def _gathered(batches, rows: int):
    """Batches joined to ones of about so many rows or SHARD_BYTES, whichever is first."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        size += batch.nbytes
        if n >= rows or size >= SHARD_BYTES:
            yield from _joined(held)
            held, n, size = [], 0, 0
    if n:
        yield from _joined(held)


def _joined(held):
    # a column of over 2 GiB stays in several pieces, each of which is a batch
    for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
        if batch.num_rows:
            yield batch


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k; of tied ones those with the smaller ids."""
    best = np.lexsort((ids, -score))[:k]
    return ids[best], score[best]


def _search(shared, average: float, k: int):
    @tidy
    def run(batches):
        queries, ends, term, idf, vocabulary, floors = shared.value
        held, floors = [(np.empty(0, np.int64), np.empty(0))] * len(queries), floors.copy()
        for batch in batches:
            for content in _read(batch, ("docs", "known", *_KINDS)):
                shard = Shard(content, average)
                if not len(shard.terms):
                    continue
                at = np.minimum(np.searchsorted(shard.terms, vocabulary), len(shard.terms) - 1)
                here = (shard.terms[at] == vocabulary)[term]
                own = term[here]
                for q, docs, score in shard.search_all(np.append(0, np.cumsum(here))[ends], at[own], idf[own], k, floors):
                    ids, before = held[q]
                    held[q] = ids, before = _best(np.append(ids, shard.ids[docs]), np.append(before, score), k)
                    if len(before) == k:
                        floors[q] = max(floors[q], before[-1])
        sizes = [len(ids) for ids, _ in held]
        if sum(sizes):
            ids, score = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            yield from pa.table({"query_id": np.repeat(queries, sizes), "doc_id": ids, "score": score}).to_batches(50_000)

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k rows of docs for each row of queries.

    queries: doc_id and text.  A query is the set of its words, lower-cased A to Z; idf =
    ln(1 + (N - df + 0.5) / (df + 0.5)).  Ties go to the smaller doc_id.  Rows of docs with
    a null doc_id count in the statistics but aren't found; null and wordless texts match
    nothing, and such a query, or one with a null id, has no result.  Rows of docs that
    repeat are found as often as they are there; repeated query rows count once, and those
    of one id with different texts are one query of all their words.  Empty tables give no
    rows.  Texts are read whole: a shard closes by bytes, so a very long one may be a shard
    of its own.  Only doc_id and text are read.  Queries are searched in blocks of about
    QUERY_BLOCK queries and TERM_BLOCK terms, each over all shards.
    """
    spark = docs.sparkSession
    index = durable(docs.select("doc_id", "text").mapInArrow(_index, _INDEX))
    whole = index.agg(F.count("*").alias("shards"), F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    n, average = whole.n or 0, max((whole.words or 0) / max(whole.n or 0, 1), 1.0)
    df = index.select("terms", "ends").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.where("doc_id is not null").select("doc_id", "text").mapInArrow(_query_terms, "query_id long, term long").distinct()
    weighted = asked.join(df, "term").select("query_id", "term", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = durable(weighted)
    size = weighted.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("terms")).first()
    blocks = max(1, -(-size.queries // QUERY_BLOCK), -(-size.terms // TERM_BLOCK))
    waves = int(math.log(max(whole.shards, 1), WAVE) + 1e-9)
    hits = Scratch(spark, _HIT)
    for block in range(blocks):
        table = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()  # bounded by TERM_BLOCK, about
        ids, term, idf = (np.asarray(table[c].combine_chunks()) for c in ("query_id", "term", "idf"))
        vocabulary, term = np.unique(term.view(np.uint64), return_inverse=True)
        weight = np.empty(len(vocabulary))
        weight[term] = idf  # a term's, whatever the query
        order = np.lexsort((term, ids))
        asked_ids, starts = np.unique(ids[order], return_index=True)
        ends, term = np.append(starts, len(ids)), term[order].astype(np.int32)
        del table, ids, idf, order
        floors = np.zeros(len(asked_ids))
        for wave in range(waves + 1):
            low, high = WAVE ** float(wave - 1 - waves) if wave else 0.0, WAVE ** float(wave - waves)
            shared = spark.sparkContext.broadcast((asked_ids, ends, term, weight, vocabulary, floors))
            part = index.where((F.col("place") >= low) & (F.col("place") < high)) if high < 1 else index.where(F.col("place") >= low)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a row is a shard
            hits.add(part.drop("place", "words").mapInArrow(_search(shared, average, k), _HIT), f"block={block}")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
            if wave < waves:
                known = _ranked(hits.read(f"block={block}"), k).where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query of the block
                floors[np.searchsorted(asked_ids, np.asarray(known["query_id"].combine_chunks()))] = np.asarray(known["score"].combine_chunks())
            shared.destroy()
    return _ranked(hits.read(), k)
