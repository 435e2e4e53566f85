"""Quality rules judged with their hosts.

Every document is measured and held against rules.  Failures are summed by host (source);
each rule's rate at a host is shrunk towards the rate of all hosts by a beta prior that is
fitted to the hosts' rates; a host whose shrunk rate is high for that prior is not trusted
for the rule, and the rule's stricter limit holds for its documents.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small

#: rule: (per document numerator, denominator, limit, limit at hosts that aren't trusted); a document fails above the limit.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.5, 0.25),
    "dup_lines": ("n_dup_lines", "n_lines", 0.5, 0.3),
    "repeats": ("n_repeat_words", "n_words", 0.3, 0.2),
}
#: A host isn't trusted for a rule when its shrunk failure rate is so many standard deviations of the prior above the prior's mean.
DEVIATIONS = 0.5

_SYMBOLS = b"#*$%&|<>"


def _measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines"""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, b"\t\n\x0b\x0c\r "))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            covered = 0  # words before this position have been counted
            for k, w in enumerate(windows):
                if times[w] > 1:
                    repeated += k + 3 - max(k, covered)
                    covered = k + 3
    return n, len(text) - spaces, symbols, dup, repeated, len(lines)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _scan(batches):
    for batch in batches:
        rows = [_measure(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 6)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *columns], ["doc_id", "source", *_COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "text").mapInArrow(_scan, "doc_id long, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def host_rates(measured: DataFrame, rules=RULES, deviations: float = DEVIATIONS) -> DataFrame:
    """(source, n, and by rule fails_<rule>, rate_<rule> and limit_<rule>): one row per host; a null host is one of its own.

    Prior of a rule: the beta distribution with the mean m (all failures / all documents) and
    the variance v of the hosts' rates, both weighed by documents; its strength is
    s = m (1 - m) / v - 1, at least 1 and at most 10 000.  Shrunk rate: (fails + s m) / (n + s).
    Limit: m and `deviations` times the prior's standard deviation, sqrt(m (1 - m) / (s + 1)).
    It follows the rates themselves, so verdicts don't depend on how common failures are.
    """
    fails = {r: (F.col(a) > F.lit(lim) * F.col(b)).cast("long") for r, (a, b, lim, _) in rules.items()}
    hosts = durable(measured.groupBy("source").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"fails_{r}") for r, x in fails.items())))
    every = hosts.agg(F.sum("n").alias("docs"), *(F.sum(f"fails_{r}").alias(f"all_{r}") for r in rules))
    mean = lambda r: F.col(f"all_{r}") / F.col("docs")
    with_means = hosts.join(F.broadcast(every), F.lit(True))
    spread = with_means.agg(*(F.sum(F.col("n") * (F.col(f"fails_{r}") / F.col("n") - mean(r)) * (F.col(f"fails_{r}") / F.col("n") - mean(r))).alias(f"spread_{r}") for r in rules))
    full = with_means.join(F.broadcast(spread), F.lit(True))
    out = []
    for r in rules:
        m = mean(r)
        v = F.col(f"spread_{r}") / F.col("docs")
        s = F.when(v <= 0, F.lit(10000.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.try_divide(m * (1 - m), v) - 1)))
        out += [((F.col(f"fails_{r}") + s * m) / (F.col("n") + s)).alias(f"rate_{r}"), (m + F.lit(float(deviations)) * F.sqrt(m * (1 - m) / (s + 1))).alias(f"limit_{r}")]
    return full.select("source", "n", *(f"fails_{r}" for r in rules), *out)


def quality_verdicts(docs: DataFrame, rules=RULES, deviations: float = DEVIATIONS) -> DataFrame:
    """One row per row of docs: counts, base_failed, kept and the names of the failed rules.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows.
    kept: not base_failed, and no rule above its limit; at a host that isn't trusted for a
    rule, the rule's stricter limit holds.  A null or wordless text has counts 0 and fails.
    Repeated rows are measured alike and count as often as they are there; a null source is a
    host of its own.  Texts are measured whole, however long.  An empty table gives no rows.
    Only doc_id, text and source are read.
    """
    measured = durable(measure(docs))
    hosts = small(durable(host_rates(measured, rules, deviations).select(F.col("source").alias("host"), *((F.col(f"rate_{r}") > F.col(f"limit_{r}")).alias(f"strict_{r}") for r in rules))))
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = {r: F.col(a) > F.when(F.col(f"strict_{r}"), F.lit(strict)).otherwise(F.lit(lim)) * F.col(b) for r, (a, b, lim, strict) in rules.items()}
    failed = F.concat_ws(",", *(F.when(x, F.lit(r)) for r, x in broken.items()))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
