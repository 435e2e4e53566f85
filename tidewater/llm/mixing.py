"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small

#: Weights that sources get in turn, in order of their names' code points, null last.
WEIGHTS = (3, 1, 2)
#: Size of the mix against all sizes, and the most a source may be repeated.
SHARE, EPOCHS = 1.5, 2
#: Documents of a source are dealt to so many places by their hash; the fractional repetition takes the first places.
PLACES = 16**3
SEED = "mix-2"

_WORD = r"[^\x20\x09-\x0D]+"


def key():
    """A document's key in hexadecimal digits: it follows from the seed, doc_id and text alone.  Its first digits are the place."""
    text = F.coalesce(F.md5("text"), F.lit("null"))
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))


def _place(c: str):
    return F.conv(F.substring(c, 1, 3), 16, 10).cast("int")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, place)"""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key().alias("key")).withColumn("place", _place("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Water-filling in closed form: sources in order of the water level at which they are full
    (epochs * size / weight).  At the first source where the level that the rest shares is
    not above its own, the level is final: targets are min(cap, level * weight).
    The windows are over the table of sources, not of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    table = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    whole = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.lit(share) * F.sum("source_size").over(whole)).withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    s = s.withColumn("final", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(whole))
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def plan(measured: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: name, source_size, target, whole repetitions, and how far the fractional one goes.

    A source that is to be repeated e times gives every document floor(e) times; the rest of
    its target is met by the documents in order of their keys: all places before `last`, of
    that place all keys before `cut`, and of the rows with the key `cut` (copies of one
    another) `some` of `copies`.  So the words taken differ from the target by half of one
    document at most, even if all rows of a source are alike.
    """
    dealt = durable(measured.groupBy("source", "place").agg(F.sum("size").alias("words")))
    goal = targets(dealt.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    goal = goal.withColumn("whole", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = small(durable(goal.withColumnRenamed("source", "name")))
    # the place in which the rest ends: PLACES rows a source at most
    at = Window.partitionBy("source").orderBy("place")
    last = dealt.join(goal.select("name", "rest"), F.col("source").eqNullSafe(F.col("name"))).withColumn("upto", F.sum("words").over(at))
    last = last.where("upto - words <= rest and rest < upto").select(F.col("name").alias("owner"), F.col("place").alias("last"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    last = small(durable(last))
    # the keys of that place, copies combined: one in PLACES of a source's documents
    keys = measured.join(last, F.col("source").eqNullSafe(F.col("owner")) & (F.col("place") == F.col("last")))
    keys = keys.groupBy("owner", "last", "left", "key").agg(F.first("size").alias("size"), F.count("*").alias("copies"))
    keys = keys.withColumn("left", F.col("left") - F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("owner").orderBy("key")) + F.col("size") * F.col("copies"))
    some = F.when(F.col("size") == 0, F.when(F.col("left") >= 0, F.col("copies")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least("copies", F.floor(F.try_divide("left", "size") + 0.5))))
    cuts = keys.withColumn("some", some.cast("long")).where("some > 0").groupBy("owner").agg(F.max_by(F.struct(F.col("key").alias("cut"), "some", "copies"), "key").alias("end"))
    known = goal.join(last.select(F.col("owner").alias("in"), "last"), F.col("name").eqNullSafe(F.col("in")), "left").join(cuts, F.col("name").eqNullSafe(F.col("owner")), "left")
    return durable(known.select("name", "source_size", "target", "whole", F.coalesce("last", F.lit(PLACES)).alias("last"), F.coalesce("end.cut", F.lit("")).alias("cut"), F.coalesce("end.some", F.lit(0)).alias("some"), F.coalesce("end.copies", F.lit(0)).alias("copies")))


def _taken(rows: DataFrame, plans: DataFrame, epochs: int) -> DataFrame:
    """rows (source, key, place, and others) with their source's plan and `times`.

    Of copies that are only partly taken, those that come first in a stored table are; which
    ones is of no account, as they are alike.  They are numbered by file and then together, so
    that no task sees more of them than a file holds.
    """
    joined = rows.join(small(plans), F.col("source").eqNullSafe(F.col("name")), "left")
    joined = joined.withColumn("torn", (F.col("place") == F.col("last")) & (F.col("key") == F.col("cut")) & (F.col("some") < F.col("copies")))
    full = (F.col("place") < F.col("last")) | ((F.col("place") == F.col("last")) & (F.col("key") <= F.col("cut")))
    times = lambda more: F.least(F.lit(epochs), F.col("whole") + more.cast("int"))
    out = joined.where("not torn").withColumn("times", times(full))
    if not plans.where("some < copies").head(1):
        return out
    torn = durable(joined.where("torn").withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", 33)
    sizes = torn.groupBy("name", part.alias("part")).agg(F.count("*").alias("n"), F.min("number").alias("start"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("name").orderBy("part")) - F.col("n"))
    before = small(durable(before.select(F.col("name").alias("whose"), F.col("part"), "before")))
    ranked = torn.withColumn("at", part).join(before, F.col("name").eqNullSafe(F.col("whose")) & (F.col("at") == F.col("part")))
    own = Window.partitionBy("name", "at").orderBy("number")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(own))
    return out.unionByName(ranked.withColumn("times", times(F.col("rank") <= F.col("some"))).select(out.columns))


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per row of docs.

    A null text has size 0; a null source is a source of its own, last in order.  Rows that
    repeat a doc_id, or have none, are dealt by their texts too; of rows alike in both as many
    are taken as the target needs.  Texts are measured whole.  An empty table gives no rows.
    Only doc_id, source and text are read.  The table of sources is sorted in one task.
    """
    measured = durable(measure(docs))
    joined = _taken(measured, plan(measured, weights, share, epochs), epochs)
    return joined.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Nulls and repeated rows as in `mix_report`; other columns are carried whatever their names.
    """
    plans = plan(durable(measure(docs)), weights, share, epochs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source"), key().alias("key")).withColumn("place", _place("key"))
    joined = _taken(rows, plans, epochs).where("times > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
