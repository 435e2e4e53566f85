"""Shared pieces: table access, durable intermediates, checked broadcasts, word and shingle hashing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes that it may have; its rows are counted and measured first.
BROADCAST_BYTES = 64 << 20
#: Rows of one key that a task of a shuffle join may get.
HOT = 100_000


#: Rows that Spark hands to a Python worker at a time; with long texts they are megabytes.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- durable intermediates

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    Where it is unset: a temporary folder if driver and executors are one process (tests),
    else the warehouse, which a cluster shares.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        known = "file://" + tempfile.mkdtemp(prefix="tidewater-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


class Scratch:
    """A folder in the shared folder that tables of one schema are added to."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/tidewater/{uuid.uuid4().hex}"
        if not _written:
            atexit.register(_clean, spark)
        _written.append(self.path)

    def add(self, df: DataFrame, part: str = "part") -> None:
        df.write.mode("append").parquet(f"{self.path}/{part}")

    def read(self, part: str = "*") -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{part}")


def durable(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    store = Scratch(spark, "")
    df.write.parquet(store.path)
    out = spark.read.schema(df.schema).parquet(store.path)
    out._stored = store.path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove durable tables that no plan reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._stored)
        _written.remove(df._stored)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean(spark: SparkSession) -> None:
    """Remove what this process wrote, as far as the session is still there."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    for path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session ended first; the folder is the cluster's to clear
            return


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes.  df should be cheap to read (a durable table)."""
    wide = sum((F.coalesce(F.octet_length(c) if t == "string" else F.length(c) if t == "binary" else 16 * F.size(c) if t.startswith("array") else F.lit(0), F.lit(0)) for c, t in df.dtypes), F.lit(16 * len(df.columns)))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(wide).alias("bytes")).first()
    return found.n <= rows and (found.bytes or 0) <= size


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it `fits`, else df as it is.

    A join with the unmarked df is a shuffle join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if fits(df, limit) else df


# ---------------------------------------------------------------- memory of Python workers


def tidy(function):
    """function(batches) whose worker gives free memory back to the system when the task ends.

    Workers outlive tasks; without it each keeps the most that any of its tasks has used.
    """

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


# ---------------------------------------------------------------- connected components


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with a durable table of one row a key: `n` is how many of rows have that key.

    A small table is broadcast.  Otherwise only the hot keys are, of which there can't be
    more than len(rows) / HOT; no other key brings a task more than HOT rows, and rows with a
    null key aren't moved.
    """
    if fits(table):
        return rows.join(F.broadcast(table.drop("n")), key, how)
    hot = F.broadcast(table.where(F.col("n") > HOT).drop("n"))
    cold = table.where(F.col("n") <= HOT).drop("n")
    known = rows.where(F.col(key).isNotNull())
    out = known.join(hot, key).unionByName(known.join(hot.select(key), key, "left_anti").join(cold, key, how))
    return out if how == "inner" else out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) with m, the least b of each a; combined before the shuffle.  Also the table of m."""
    least = durable(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    return join_hot(pairs, least, "a"), least


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), both long.

    Alternating large-star and small-star steps, each written to the shared folder.  Minima
    are combined before they are shuffled, and a hub's edges stay where they are.  Every step
    emits at most as many edges as it reads.  Nodes without an edge don't appear.  Repeated
    edges count once; an edge with a null is none.  Empty in, empty out.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        # large star: every larger neighbour is linked to the smallest of the closed neighbourhood
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near, least = _with_least(both)
        big = durable(near.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        forget(now, least)
        # small star: the smaller neighbours and the node itself are linked to the smallest
        low, least = _with_least(big)
        rest = low.select(F.explode(F.when(F.col("b") == F.col("m"), F.array("a")).otherwise(F.array("a", "b"))).alias("a"), F.col("m").alias("b"))
        now = durable(rest.where("a <> b").distinct())
        forget(big, least)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ---------------------------------------------------------------- words and hashes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: The same for upper and lower A-Z, so that hashes are those of lower-cased words.
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Words are `[^\x20\x09-\x0D]+`; no byte of a longer UTF-8 sequence is one of these.
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)
_PLACE = [np.uint64(x) for x in _RNG.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_R, _RINV)):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]).cumprod(dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_chunks(column: pa.Array, most: int = 1 << 20):
    """(first row, offsets, bytes) of runs of rows with about `most` bytes; a null is an empty text.

    A row longer than that is a run by itself.
    """
    if pa.types.is_dictionary(column.type) or not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the first word of each row (one more entry than rows)."""
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word and the first word of each row."""
    starts, ends, rows = word_bounds(offsets, data)
    if not len(starts):
        return np.empty(0, np.uint64), rows
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _PLACE[7]), rows


def shingle_sets(column: pa.Array, size: int = 5):
    """(row, sorted distinct 64-bit shingle hashes) for every row, whole texts.

    A text with fewer words than `size` has its whole word sequence as its one shingle;
    without words the set is empty.
    """
    for first, offsets, data in text_chunks(column):
        h, rows = word_hashes(offsets, data)
        n = len(h)
        if n >= size:
            x = h[: n - size + 1] * _PLACE[0]
            for k in range(1, size):
                x = x + h[k : n - size + 1 + k] * _PLACE[k]
            x = mix(x)
        for r in range(len(rows) - 1):
            a, b = rows[r], rows[r + 1]
            if b - a >= size:
                s = np.sort(x[a : b - size + 1])
                yield first + r, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                y = np.uint64(b - a) * _PLACE[6]
                with np.errstate(over="ignore"):
                    for k in range(a, b):
                        y = y + h[k] * _PLACE[k - a]
                yield first + r, mix(np.array([y]))
            else:
                yield first + r, np.empty(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
