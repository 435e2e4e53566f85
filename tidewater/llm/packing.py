"""Packing documents into fixed-length sequences by patterns.

The lengths of all pieces make a histogram.  Patterns are multisets of a few length bins that
fill a sequence; non-negative least squares fits how often each pattern is used, so that no
bin is overdrawn.  The repeats are rounded down and realised with exact lengths, the last
place of a pattern by the longest piece that fits; what is left goes, longest first, into the fullest sequence
with room.  All of that works on counts, so its cost doesn't depend on the number of
documents; every piece then finds its place from its length and its rank among pieces of
that length.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small, tidy

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Width of the length bins that patterns are made of, how many equal bins a pattern may have, and how many bins it may leave empty.
BIN, MOST, SLACK = 32, 6, 2
#: Fits, and how much more the squares of overdrawn bins weigh in each.
FITS, OVER = 4, 10.0
#: Pieces below SHORT are short; this part of them isn't placed by patterns.
SHORT, KEPT = 256, 0.5
#: Entries of a worker's caches of words.
CACHE = 200_000

# ---------------------------------------------------------------- tokens


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabets write a byte as its Latin-1 character if that is visible, else as the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 0x100 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class _Words(dict):
    """Ids of white-space separated words, as little-endian 32-bit integers.

    The tokenizer splits at all white space and then into runs of letters, single digits and
    runs of other characters, each on its own; so a text's ids are those of its words.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.stems = tokenizer, tokenizer.model, {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stem(self, text: str) -> bytes:
        known = self.stems.get(text)
        if known is None:
            if len(self.stems) >= CACHE:
                self.stems.clear()
            # one run of letters in lower case: past the normalizer and the splits, straight to the merges
            found = self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(_LETTERS))
            known = self.stems[text] = np.array([t.id for t in found], "<u4").tobytes()
        return known

    def marks(self, text: str) -> bytes:
        known = self.stems.get(text)
        if known is None:
            known = self.stems[text] = self.encode(text)
        return known

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode()
        body = text.rstrip(".,!*#$%&;:?")
        # letters below U+0100 have lower forms of one letter; marks after them are a run of their own
        if body.isalpha() and max(body) < "Ā":
            ids = self.stem(body.lower())
            if len(body) < len(text):
                ids += self.marks(text[len(body) :])
        else:
            ids = self.encode(text)
        self[word] = ids
        return ids


_words: dict[str, _Words] = {}


def encoder(path: str) -> _Words:
    if path not in _words:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _words[path] = _Words(Tokenizer.from_file(path))
    return _words[path]


def token_bytes(words: _Words, raw: bytes) -> bytes:
    """The ids of a whole text and the end id."""
    return b"".join(map(words.__getitem__, raw.split())) + END.to_bytes(4, "little")


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])


def _pieces(path: str, length: int):
    @tidy
    def run(batches):
        words, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for doc, raw in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
                data = token_bytes(words, raw.as_py() or b"")
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    cut = data[at : at + 4 * length]
                    n = len(cut) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(cut), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return run


# ---------------------------------------------------------------- the plan


def patterns(bins: int, most: int = MOST, slack: int = SLACK) -> np.ndarray:
    """Multisets of bins that sum to `bins`, or to `slack` less at most: rows of places, 0 where there is none.

    One to three bins of any size; and one of any size with up to `most` equal ones and what
    fills the rest, which is where short pieces go.
    """
    a = np.arange(1, bins + 1)
    out = [np.stack([a, *[np.zeros_like(a)] * (most + 1)], 1)]
    for total in range(max(bins - slack, 1), bins + 1):
        x, y = (v.ravel() for v in np.meshgrid(a, np.append(0, a), indexing="ij"))
        z = total - x - y
        ok = (x >= y) & (y >= z) & (z >= 0) & ((y > 0) | (z == 0))
        out.append(np.stack([x[ok], y[ok], z[ok], *[np.zeros_like(x[ok])] * (most - 1)], 1))
    x, v = (v.ravel() for v in np.meshgrid(np.append(0, a), a, indexing="ij"))
    for m in range(2, most + 1):
        rest = bins - x - m * v
        ok = (rest >= 0) & (rest < np.maximum(v, slack + 1))
        out.append(np.stack([x[ok], *[v[ok]] * m, *[np.zeros_like(x[ok])] * (most - m), rest[ok]], 1))
    kinds = -np.sort(-np.concatenate(out), axis=1)
    kinds = kinds[kinds.sum(1) >= bins - slack]
    return np.unique(kinds, axis=0)


def nnls(columns: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, bool]:
    """Non-negative least squares by active sets, and whether it has converged.

    Column k of the matrix counts the entries of columns[k] (0 counts nothing); `weight` is
    that of the squares of each row.
    """
    x = np.zeros(len(columns))
    root = np.ones(len(b)) if weight is None else np.sqrt(weight)
    root = np.where(np.arange(len(b)) == 0, 0, root)
    goal = b * root
    active: list[int] = []
    dense = np.zeros((len(b), 0))
    tol = 1e-6 * (1 + b.max(initial=0))
    for _ in range(most or 10 * len(b)):
        rest = (goal - dense @ x[active]) * root if active else goal * root
        gain = rest[columns].sum(1)
        gain[active] = 0
        j = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[j] <= tol:
            return x, True
        active.append(j)
        dense = np.column_stack([dense, np.bincount(columns[j], minlength=len(b)) * root])
        while True:
            z = np.linalg.solve(dense.T @ dense + 1e-9 * np.eye(len(active)), dense.T @ goal)
            if z.min() > 1e-9:
                x[active] = z
                break
            now = x[active]
            low = z <= 1e-9
            step = (now[low] / np.maximum(now[low] - z[low], 1e-30)).min()
            now = now + step * (z - now)
            x[active] = 0
            stay = now > 1e-9
            if stay.all():
                stay[np.argmin(z)] = False
            active = [k for k, s in zip(active, stay, strict=True) if s]
            dense = dense[:, stay]
            x[active] = now[stay]
            if not active:
                break
    return x, False


def _used(kinds: np.ndarray, repeats: np.ndarray, bins: int) -> np.ndarray:
    out = np.zeros(bins + 1)
    np.add.at(out, kinds, np.repeat(repeats[:, None], kinds.shape[1], 1))
    out[0] = 0
    return out


def fitted(by_bin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole repeats that together use no more of a bin than there is.

    Least squares alone uses too much of some bins and too little of others; so the squares
    of bins that are overdrawn weigh OVER times more in each further fit.  What rounding and
    the last overdrafts leave too many is taken back from the patterns that overdraw most.
    """
    bins = len(by_bin) - 1
    kinds = patterns(bins)
    kinds = kinds[(by_bin[kinds] > 0).sum(1) == (kinds > 0).sum(1)]
    weight = 1 / np.maximum(by_bin, 1)
    repeats = np.zeros(len(kinds))
    for _ in range(FITS):
        repeats, _ = nnls(kinds, by_bin, weight)
        over = _used(kinds, repeats, bins) > by_bin * (1 + 1e-3)
        if not over.any():
            break
        weight = np.where(over, OVER * weight, weight)
    repeats = np.floor(repeats + 1e-6)
    while (over := np.maximum(_used(kinds, repeats, bins) - by_bin, 0)).any():
        cost = np.where(repeats > 0, over[kinds].sum(1), 0)
        k = int(cost.argmax())
        worst = over[kinds[k]].max()
        repeats[k] = max(0, repeats[k] - np.ceil(worst / max(1, np.bincount(kinds[k])[1:].max(initial=1))))
    some = repeats > 0
    return kinds[some], repeats[some].astype(np.int64)


def _largest(count: np.ndarray, low: int, high: int) -> int:
    """The longest length in low..high of which any is left, or 0."""
    at = np.flatnonzero(count[max(low, 1) : high + 1])
    return int(at[-1]) + max(low, 1) if len(at) else 0


def by_patterns(count: np.ndarray, length: int = LENGTH, width: int = BIN) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), sequences)] that the fitted patterns make; what they use is taken out of count."""
    bins = length // width
    of = (np.arange(length + 1) + width - 1) // width
    by_bin = np.bincount(of, count, bins + 1)
    by_bin[0] = 0
    made: list[tuple[tuple[tuple[int, int], ...], int]] = []
    kinds, repeats = fitted(by_bin)
    for k in np.argsort(-kinds.max(1), kind="stable"):
        left = int(repeats[k])
        places = [int(v) for v in kinds[k] if v]
        while left and count.any():
            # a place takes the longest piece of its bin, or a shorter one if others have used it up;
            # the last place the longest that fits into what rounding to bins has left
            chosen: list[int] = []
            for at, v in enumerate(places):
                most = width * v if at < len(places) - 1 else length - sum(chosen)
                if got := _largest(count, 1, most):
                    count[got] -= 1
                    chosen.append(got)
            times = {v: chosen.count(v) for v in chosen}
            for v in chosen:
                count[v] += 1
            n = min(left, *(int(count[v]) // t for v, t in times.items()))
            for v, t in times.items():
                count[v] -= n * t
            made.append((tuple(times.items()), n))
            left -= n
    return made


def pack_counts(histogram: np.ndarray, length: int = LENGTH, width: int = BIN) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), sequences)] that hold as many pieces of each length as histogram counts."""
    count = histogram.astype(np.int64).copy()
    count[0] = 0
    # a part of the short pieces is kept to fill what exact lengths leave of the patterns' bins
    kept = np.where(np.arange(length + 1) < SHORT, (count * KEPT).astype(np.int64), 0)
    count -= kept
    made = by_patterns(count, length, width)
    count += kept
    # best fit for the rest: by room, the sequences that have it
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    some = np.zeros(length + 1, bool)

    def put(items, n, room):
        if n:
            open_.setdefault(room, []).append((items, n))
            some[room] = True

    for items, n in made:
        put(items, n, length - sum(v * t for v, t in items))
    for v in range(length, 0, -1):
        left = int(count[v])
        while left:
            at = np.flatnonzero(some[v:])
            if not len(at):
                k = length // v
                put(((v, k),), left // k, length - k * v)
                if left % k:
                    put(((v, left % k),), 1, length - left % k * v)
                break
            room = int(at[0]) + v
            items, n = open_[room].pop()
            some[room] = bool(open_[room])
            k = room // v
            full = min(n, left // k)
            put((*items, (v, k)), full, room - k * v)
            left, n = left - full * k, n - full
            if n and left < k and left:
                put((*items, (v, left)), 1, room - left * v)
                left, n = 0, n - 1
            put(items, n, room)
    return [x for rows in open_.values() for x in rows]


def plan_table(plan, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """key (length << 44 | first rank), first sequence and offset, by key."""
    used = np.zeros(length + 1, np.int64)
    keys, sequences, offsets = [], [], []
    base = 0
    for items, n in plan:
        at = 0
        for v, times in items:
            for _ in range(times):
                keys.append((v << 44) | int(used[v]))
                sequences.append(base - int(used[v]))
                offsets.append(at)
                used[v] += n
                at += v
        base += n
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def _place(table):
    keys, sequences, offsets = table

    @tidy
    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[at] + rank), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; a null or empty text is the end id alone.  Only
    documents longer than a sequence are cut.  Repeated rows are packed again; a null doc_id
    is carried.  An empty table gives no rows.  Only doc_id and text are read.
    `tokenizer`: the file's path on every machine.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = durable(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, length), f"{fields}, part int, rank long"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = durable(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = np.zeros(length + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length: `length` at most
        histogram[row.length] = row.n
    table = plan_table(pack_counts(histogram, length), length)
    ranked = pieces.join(small(counts.select("length", "part", "first")), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(_place(table), f"{fields}, sequence_id long, offset long")
