"""Exact n-gram Jaccard self-join with a prefix-tree join inside each candidate group.

Plan:

1. One scan gives each document its set size and a 64-bit hash of its set; documents with
   the same set are a class, and only classes are compared.
2. A class that links with another has at most `floor(n / 4)` (for 0.75) shingles that no
   other class has.  A second scan counts, over the shingles in a fixed part of the hash
   space, how many of each class's shingles another class also has.  Copies and local
   repeats are combined before the shuffle, to which each batch gives a row for each part of
   the hash space, not one for each shingle.  Classes below the bound can't link, and no task
   gives out their sets.
3. The sets of the remaining classes get one global order, rarest shingle first.  Two linked
   sets share a shingle of their prefixes in that order.  Star edges over those shingles
   give candidate groups.
4. In each group the sets are stored in a trie, which all members traverse together, sharing
   partial overlaps; subtrees that can't reach the needed overlap are pruned.  Groups beyond
   `WHOLE` classes are joined block by block, in a task for each pair of blocks; a block has
   at most about `BLOCK` classes, so a task holds two of them.
5. Links give components; each class's links are counted, copies included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, forget, join_hot, shingle_sets, signed, small, tidy

#: Classes of a candidate group that a task holds as one side of the join, at most.
BLOCK = 1024
#: Groups of up to so many classes are joined whole, and small ones together in units of about as many; larger ones are
#: dealt into blocks of about as many, up to SPREAD of them, and into more once these would pass BLOCK.
WHOLE, SPREAD = 256, 8
#: Shingles that one task of the counting step receives, about, and its least number of tasks.
#: With that many, a class has few shingles in a task at any size, so the counts sent on grow as the input.
PART_ROWS, LEAST_PARTS = 1_000_000, 64
#: The part of the hash space whose shingles the counting step looks at.
SEEN = np.uint64(3 << 61)
#: Rows, and about the bytes of packed ones, that a worker hands on at a time.
CHUNK_ROWS, CHUNK_BYTES = 20_000, 8 << 20
#: Keys of remaining classes that every task may get, 32 MB, to leave out the sets of all others at once.
#: Where there are more, a join leaves these out.
WANTED = 4_000_000


def _key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _slack(n, num: int, den: int):
    """Shingles of a set of n that a linked set may lack: n - ceil(n * num / den)."""
    return n - (n * num + den - 1) // den


@tidy
def _describe(batches):
    for batch in batches:
        n, m, keys = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for row, s in shingle_sets(batch.column("text")):
            n[row], m[row] = len(s), int(np.searchsorted(s, SEEN))
            keys[row] = np.uint64(_key(s)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(m), pa.array(keys, mask=n == 0)], ["doc_id", "n", "m", "key"])


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, m, key): set size, shingles in the counted part, hash of the set (null if empty)."""
    return docs.select("doc_id", "text").mapInArrow(_describe, "doc_id long, n long, m long, key long")


#: Of one part of the hash space: shingles and the classes that have them; shared shingles; classes and counts.  All are runs of 64-bit numbers.
_ENTRY = "part int, pairs binary, fresh binary, counts binary"


def _dealt(parts: int, deal: np.ndarray, *columns: np.ndarray) -> list[bytes]:
    """The rows of each part, all of a column after all of the one before."""
    part = (deal % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    return [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _entries(parts: int):
    """For each batch a row a part of the hash space, which holds what the batch has in it.

    pairs: one class of the batch has the shingle; fresh: several have it; counts: so many of
    the class's shingles are shared here.  A shingle that several classes of a batch have is
    counted for them on the spot, and for all later ones of the task; for others it is sent
    once a task.  So a shingle that every document has comes once from each task, not once
    from each document.
    """

    @tidy
    def run(batches):
        done: set[int] = set()
        known = np.empty(0, np.uint64)  # shingles that are shared in this task
        for batch in batches:
            tokens, keys = [], []
            for _, s in shingle_sets(batch.column("text")):
                if len(s) and (k := _key(s)) not in done:
                    done.add(k)
                    part = s[: np.searchsorted(s, SEEN)]
                    tokens.append(part)
                    keys.append(np.full(len(part), k, np.uint64))
            if not tokens:
                continue
            t, k = np.concatenate(tokens), np.concatenate(keys)
            if not len(t):
                continue
            order = np.argsort(t, kind="stable")
            t, k = t[order], k[order]
            same = t[1:] == t[:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            fresh = np.setdiff1d(t[shared], known)
            if len(known):
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                shared |= known[at] == t
            known = np.union1d(known, fresh)
            own, times = np.unique(k[shared], return_counts=True)
            pairs = _dealt(parts, t[~shared], t[~shared], k[~shared])
            rows = pa.table({"part": pa.array(range(parts), pa.int32()), "pairs": pairs, "fresh": _dealt(parts, fresh, fresh), "counts": _dealt(parts, own, own, times.astype(np.uint64))})
            yield from rows.to_batches(max(1, parts * CHUNK_BYTES // (rows.nbytes + 1)))

    return run


def _runs(rows: list, width: int) -> list[np.ndarray]:
    """The columns that _dealt has put into the rows."""
    parts = [np.frombuffer(x, np.uint64).reshape(width, -1) for x in rows]
    return list(np.concatenate(parts, axis=1)) if parts else [np.empty(0, np.uint64)] * width


@tidy
def _shared(batches):
    held: list[list] = [[], [], []]
    for batch in batches:
        for column, name in zip(held, ("pairs", "fresh", "counts"), strict=True):
            column.extend(x.as_buffer() for x in batch.column(name))
    (token, key), (fresh,), (own, times) = (_runs(x, n) for x, n in zip(held, (2, 1, 2), strict=True))
    held.clear()
    keys, counts = [own], [times.astype(np.int64)]
    if len(token):
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        new_token = np.concatenate(([True], token[1:] != token[:-1]))
        new_pair = new_token | np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(new_token)
        many = (np.add.reduceat(new_pair.astype(np.int64), at) > 1) | np.isin(token[at], fresh)
        chosen = key[new_pair & many[np.cumsum(new_token) - 1]]
        keys.append(chosen)
        counts.append(np.ones(len(chosen), np.int64))
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    if not len(keys):
        return
    total = np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.int64)
    yield from pa.table({"key": signed(keys), "cnt": total}).to_batches(CHUNK_ROWS)


def _sets(wanted):
    """The sets of the classes whose keys the broadcast array has, ascending; of all without one."""

    @tidy
    def run(batches):
        done: set[int] = set()
        asked = None if wanted is None else wanted.value
        for batch in batches:
            keys, sets = [], []
            for _, s in shingle_sets(batch.column("text")):
                if len(s) and (k := _key(s)) not in done and (asked is None or asked[min(np.searchsorted(asked, np.uint64(k)), len(asked) - 1)] == k):
                    done.add(k)
                    keys.append(k)
                    sets.append(s)
                if sets and len(sets) >= 512:
                    yield _set_batch(keys, sets)
                    keys, sets = [], []
            if sets:
                yield _set_batch(keys, sets)

    return run


def _wanted(alive: DataFrame):
    """The keys of alive as a broadcast array, if there are few enough of them (and any)."""
    if not 0 < alive.count() <= WANTED:
        return None
    keys = np.asarray(alive.select("key").toArrow()["key"].combine_chunks())
    return alive.sparkSession.sparkContext.broadcast(np.sort(keys.view(np.uint64)))


def _set_batch(keys, sets):
    ends = np.cumsum([0, *map(len, sets)])
    tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(sets))))
    return pa.RecordBatch.from_arrays([pa.array(signed(np.array(keys, np.uint64))), tokens], ["key", "tokens"])


# ---------------------------------------------------------------- the trie join of one unit


class _Unit:
    """Sets of one unit: the trie holds side a, side b asks.  For one block both are the same."""

    def __init__(self, keys, n, copies, lists, rarity):
        self.keys, self.n, self.copies = keys, n, copies
        ends = np.cumsum([0, *map(len, lists)])
        flat, freq = np.concatenate(lists), np.concatenate(rarity)
        _, first, local = np.unique(flat, return_index=True, return_inverse=True)
        # common shingles first, so that similar sets share long paths
        rank = np.empty(len(first), np.int64)
        rank[np.lexsort((flat[first], -freq[first]))] = np.arange(len(first))
        local = rank[local]
        self.seqs = [np.sort(local[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.width = len(first)

    def join(self, trie, ask, num, den):
        """Yields (i, js): set i of `trie` links with sets js of `ask`."""
        order = sorted(trie, key=lambda i: self.seqs[i].astype(">u4").tobytes())
        seqs = [self.seqs[i] for i in order]
        sizes = self.n[order]
        lcp = np.zeros(len(seqs) + 1, np.int64)
        for k in range(1, len(seqs)):
            a, b = seqs[k - 1], seqs[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            lcp[k] = differ[0] if len(differ) else m
        owner = np.repeat(np.arange(len(ask)), [len(self.seqs[q]) for q in ask])
        held = np.concatenate([self.seqs[q] for q in ask])
        by = np.argsort(held, kind="stable")
        post, ptr = owner[by], np.concatenate(([0], np.cumsum(np.bincount(held, minlength=self.width))))
        nq, kq = self.n[ask], np.array([len(self.seqs[q]) for q in ask])
        lengths = np.array([len(s) for s in seqs])
        stack = [(0, len(seqs), 0, np.zeros(len(ask), np.int64))]
        while stack:
            lo, hi, depth, acc = stack.pop()
            common = int(lcp[lo + 1 : hi].min()) if hi - lo > 1 else len(seqs[lo])
            chain = seqs[lo][depth:common]
            if len(chain):
                starts, runs = ptr[chain], ptr[chain + 1] - ptr[chain]
                at = np.repeat(starts - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
                acc = acc + np.bincount(post[at], minlength=len(ask))
            # bound: what is left of the asking set and of the longest set below
            reach = acc + np.minimum(kq - acc, lengths[lo:hi].max() - common)
            least = sizes[lo:hi].min()
            alive = (acc >= 0) & (den * reach >= num * (nq + least - reach))
            if not alive.any():
                continue
            acc = np.where(alive, acc, -(1 << 40))
            end = lo
            while end < hi and lengths[end] == common:  # sets that end here; they sort first
                hit = np.flatnonzero((acc >= 0) & (den * acc >= num * (nq + sizes[end] - acc)))
                if len(hit):
                    yield order[end], ask[hit]
                end += 1
            cut = [end, *(k for k in np.flatnonzero(lcp[end + 1 : hi] == common) + end + 1), hi] if end < hi else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                stack.append((a, b, common, acc))


def _join_unit(num, den):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        keys = np.asarray(rows["key"])
        order = np.argsort(keys, kind="stable")
        rows = rows.take(pa.array(order))
        keys, n, copies, block = (np.asarray(rows[c]) for c in ("key", "n", "copies", "block"))
        lists, rarity = ([x.values.to_numpy() for x in rows[c]] for c in ("tokens", "dfs"))
        unit = _Unit(keys, n, copies, lists, rarity)
        sides = np.unique(block)
        label, links = np.arange(len(keys)), np.zeros(len(keys), np.int64)
        a = np.flatnonzero(block == sides[0])
        # a unit of two blocks joins one with the other; both that a unit of two has meet themselves in their own units
        b = np.flatnonzero(block == sides[1]) if len(sides) > 1 else a
        for i, js in unit.join(a, b, num, den):
            js = js[js != i]
            if not len(js):
                continue
            links[i] += copies[js].sum()
            if len(sides) > 1:
                links[js] += copies[i]
            met = np.unique(np.append(label[js], label[i]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        # within one block the smallest class of a component is its root, and the component is whole
        return pa.table({"key": keys, "root": keys[label], "links": links, "whole": (rows["blocks"].to_numpy() == 1)})

    return run


def link_classes(docs: DataFrame, described: DataFrame, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame]:
    """(key, root, links) of classes with a link to another class, and the classes."""
    classes = durable(described.where("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("copies"), F.min("doc_id").alias("lowest")))
    total = classes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-total // PART_ROWS))
    texts = docs.select("text")
    dealt = texts.mapInArrow(_entries(parts), _ENTRY).repartitionById(parts, "part")
    counts = dealt.mapInArrow(_shared, "key long, cnt long").groupBy("key").agg(F.sum("cnt").alias("cnt"))
    slack = f"n - (n * {num} + {den - 1}) div {den}"
    alive = durable(classes.join(counts, "key", "left").where(f"coalesce(cnt, 0) >= m - ({slack})").select("key", "n", "copies"))
    wanted = _wanted(alive)
    sets = texts.mapInArrow(_sets(wanted), "key long, tokens array<long>").join(small(alive), "key").groupBy("key").agg(F.first("tokens").alias("tokens"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    sets = durable(sets)
    if wanted is not None:
        wanted.destroy()
    entries = sets.select("key", F.explode("tokens").alias("token"))
    common = durable(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumn("n", F.col("df")))
    held = join_hot(entries, common, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    held = durable(held.join(sets.select("key", "n", "copies"), "key").where(f"n - size(shared) <= {slack}").select("key", "n", "copies", F.col("shared.token").alias("tokens"), F.col("shared.df").alias("dfs")))
    prefix = held.select("key", F.explode(F.slice("tokens", F.lit(1), F.expr(f"cast({slack} + 1 - (n - size(tokens)) as int)"))).alias("token"))
    forget(common, sets, alive)
    stars = durable(prefix.groupBy("token").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1"))
    groups = components(join_hot(prefix, stars, "token").select(F.col("key").alias("a"), F.col("low").alias("b")))
    groups = durable(groups)
    sizes = durable(groups.groupBy("component").agg(F.count("*").alias("size")).withColumn("n", F.col("size")))
    bins = max(1, -(-groups.count() // WHOLE))
    blocks = f"greatest(least({SPREAD}, ceil(size / {WHOLE})), ceil(size / {BLOCK}))"
    member = join_hot(groups, sizes, "component").join(held.withColumnRenamed("key", "node"), "node").withColumn("blocks", F.expr(f"cast({blocks} as int)"))
    member = member.withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    one = member.where("blocks = 1").select(F.expr(f"pmod(xxhash64(component), {bins})").alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), F.col("node").alias("key"), "n", "copies", "tokens", "dfs", "blocks")
    more = member.where("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(F.col("component").alias("unit"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("block"), F.col("node").alias("key"), "n", "copies", "tokens", "dfs", "blocks")
    found = one.unionByName(more).groupBy("unit", "i", "j").applyInArrow(_join_unit(num, den), "key long, root long, links long, whole boolean")
    found = durable(found)
    forget(held, stars, groups, sizes)
    return found, classes


def jaccard_components(docs: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of docs.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles is
    at least num / den (at least one half).  component_id is the smallest doc_id reachable
    over links; n_links the number of other rows linked directly.

    A null or wordless text has the empty set, is linked with nothing and is its own
    component.  Rows that repeat are copies of each other.  A null doc_id takes part and
    gets the smallest known id of its component, or null.  Only doc_id and text are read.
    Texts are read whole, however long.  An empty table gives no rows.  Sets are compared by
    64-bit hashes of shingles and classes by 64-bit hashes of sets.
    """
    described = durable(describe(docs))
    found, classes = link_classes(docs, described, num, den)
    near = found.where("whole and links > 0").select("key", F.col("root").alias("component"))
    split = found.where("not whole and key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    near = near.unionByName(components(split).select(F.col("node").alias("key"), "component"))
    # one row a class: a single aggregation, which combines before its shuffle, in place of joins
    facts = classes.select("key", "lowest", "copies", F.lit(None).cast("long").alias("component"), F.lit(0).alias("links"))
    for more in (near, found.select("key", "links")):
        facts = facts.unionByName(more, allowMissingColumns=True)
    whole = facts.groupBy("key").agg(F.min("lowest").alias("lowest"), F.max("copies").alias("copies"), F.min("component").alias("component"), F.sum("links").alias("links"))
    whole = whole.where("copies > 1 or component is not null")
    whole = durable(whole.select("key", "lowest", F.coalesce("component", "key").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"))
    ids = durable(whole.groupBy("component").agg(F.min("lowest").alias("component_id"), F.count("*").alias("n")))
    known = join_hot(whole.select("component", "key", "n_links", "copies"), ids, "component").select("key", "component_id", "n_links", F.col("copies").alias("n"))
    known = durable(known)
    forget(whole, ids, found, classes)
    return join_hot(described.select("doc_id", "key", F.col("n").alias("n_shingles")), known, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """The rows of docs without those linked, directly or not, to one with a smaller doc_id.

    Rows that repeat a doc_id and its text count once.  Rows with a null doc_id stay, as
    nothing tells them apart; so do wordless texts.  All columns of docs are returned,
    whatever their names.
    """
    parts = durable(jaccard_components(docs, num, den).where("doc_id is not null"))
    gone = parts.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    again = durable(parts.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    nameless = rows.where("id is null").select("row.*")
    left = rows.where("id is not null").join(small(durable(gone)), "id", "left_anti")
    if not again.head(1):
        return left.select("row.*").unionByName(nameless)
    again = small(again)
    once = left.join(again, "id", "left_anti").select("row.*")
    some = left.join(again, "id", "left_semi").dropDuplicates(["id", "content"]).select("row.*")
    return once.unionByName(some).unionByName(nameless)
