"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh by a repeated list of weights and share all words; a target stops
at three times its source's words, and what is above goes to the others by weight. That is the level L at which the sum
of min(3 x words, L x weight) is the sum of all words; it comes from running sums over one row a source.

Copies: a document is taken floor(target / words) whole times for certain. What is left of the target is filled by a
sample without replacement: inclusion probabilities grow with ``EMPHASIS``, a power of the length, up to one, so that the
expected words are what is left; a document's rank is u / (1 - u) over p / (1 - p), u a hash of the document, and
documents are taken in the order of ranks until the words are used up (fixed size, in words). A document that doesn't
fit any more is passed over for later ones that do, so a source ends less than one short document below its target.

Scale: texts are read once, for their length and hash; the rest works on one narrow row a document. No source is sorted:
ranks fall into about sqrt(N) ranges, whose words are summed per source, and only the ranges around the end of a
sample are ordered, by one task a source with some sqrt(N) rows.

Defined cases. A null text has no words; documents without words are taken zero times. Rows that repeat id and text are
documents of their own, told apart by a number (of equal rows any may have any number: the results are the same). Rows
without an id, source or text are mixed like the others. An empty table gives no rows. Other columns are left out by
``mix`` and kept by ``mixed_rows``. The same rows give the same mix, however they are partitioned.
"""

from __future__ import annotations

import math
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and target over words of a source
EMPHASIS = 0.25  # twice as likely at 16 times the length
SEED = 20_240_817
NUMBERED = 4096  # equal rows numbered by one task


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest, place), one narrow row a document, written to the shared folder."""
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size")
    return materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), size, F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("place")), "mix-sizes")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target), one row a source; only these rows are ordered."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    level = (F.sum("source_size").over(whole) - full) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    levels = total.withColumn("weight", weight).withColumn("level", level)
    # sources without room for their share come first; the level is that of the first source that has room
    fits = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))
    share = F.first(fits, ignorenulls=True).over(whole) * F.col("weight")
    return levels.select("source", "source_size", F.least(share, (most * F.col("source_size")).cast("double")).alias("target"))


def sampling_plan(sized: DataFrame, wanted: DataFrame, emphasis: float) -> DataFrame:
    """(source, source_size, target, whole, rest, scale): certain copies, words left for the sample, and the factor with
    which min(1, scale x size^emphasis) times size sums up to them. Sums run over the distinct sizes of a source."""
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = wanted.withColumn("whole", ratio.cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(plan, "mix-targets")
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).withColumnRenamed("source", "of")
    sizes = sizes.join(plan.where("rest > 0").select("source", "rest"), F.col("of").eqNullSafe(F.col("source")))
    power, descending = F.pow("size", F.lit(emphasis)), Window.partitionBy("of").orderBy(F.col("size").desc())
    larger = F.coalesce(F.sum(F.col("n") * F.col("size")).over(descending.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scale = (F.col("rest") - larger) / F.sum(F.col("n") * F.col("size") * power).over(descending.rowsBetween(0, Window.unboundedFollowing))
    scales = sizes.withColumn("scale", scale).where(F.col("scale") * power <= 1).groupBy("of").agg(F.max_by("scale", "size").alias("scale"))
    joined = plan.join(scales, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return materialise(joined.withColumn("scale", F.coalesce("scale", F.lit(0.0))), "mix-plan")


def numbered(sized: DataFrame) -> DataFrame:
    """Adds number, which tells rows apart that are equal in all but their place."""
    key = F.struct("source", "doc_id", "digest", "size")
    repeated = materialise(sized.groupBy(key.alias("key")).count().where("count > 1").select("key"), "mix-repeats")
    if repeated.isEmpty():
        return sized.withColumn("number", F.lit(0).cast("bigint"))
    rows = sized.withColumn("key", key).withColumn("slot", F.floor(F.col("place") / NUMBERED))
    single = rows.join(repeated, "key", "left_anti").withColumn("number", F.lit(0).cast("bigint"))
    rows = rows.join(repeated, "key", "left_semi")
    slots = rows.groupBy("key", "slot").count()
    before = F.sum("count").over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slots.select("key", "slot", F.coalesce(before, F.lit(0)).alias("start"))
    several = rows.withColumn("own", F.row_number().over(Window.partitionBy("key", "slot").orderBy("place"))).join(starts, ["key", "slot"])
    several = several.withColumn("number", (F.col("start") + F.col("own")).cast("bigint"))
    return materialise(single.drop("key", "slot").unionByName(several.drop("key", "slot", "start", "own")), "mix-numbered")


def ranked_documents(rows: DataFrame, plan: DataFrame, emphasis: float, ranges: int) -> DataFrame:
    """Adds v = r / (1 + r) of the rank r, and the range of v."""
    mixed = F.xxhash64(F.lit(SEED), "doc_id", "digest", "number")
    out = rows.withColumnRenamed("source", "of").join(plan, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    out = out.withColumn("u", (F.shiftrightunsigned(mixed, 12) + 0.5) / float(1 << 52)).withColumn("p", F.least(F.lit(1.0), F.col("scale") * F.pow("size", F.lit(emphasis))))
    v = F.when(F.col("p") >= 1, 0.0).when((F.col("p") > 0) & (F.col("size") > 0), F.expr("u * (1 - p) / (u * (1 - p) + (1 - u) * p)"))
    return out.withColumn("v", v).withColumn("at", F.least(F.floor(F.col("v") * ranges), F.lit(ranges - 1)))


def sample_ends(ranked: DataFrame, spare: int) -> DataFrame:
    """(of, cut, last, room): ranges below cut are taken whole; those from cut to last, with ``spare`` rows at least
    beyond cut if there are so many, share what room is left in words."""
    sums = ranked.where("v IS NOT NULL").groupBy("source", "rest", "at").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    up_to = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = materialise(sums.withColumn("upto", F.sum("words").over(up_to)).withColumn("seen", F.sum("n").over(up_to)).withColumnRenamed("source", "of"), "mix-ranges")
    first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("at", (F.col("rest") - F.col("upto") + F.col("words")).alias("room"), "seen")))
    cuts = sums.groupBy("of").agg(first.alias("end"), F.max("at").alias("final")).select(F.col("of").alias("name"), F.coalesce("end.at", F.col("final") + 1).alias("cut"), F.coalesce("end.room", F.lit(0.0)).alias("room"), "final", F.col("end.seen").alias("enough"))
    beyond = sums.join(cuts, F.col("of").eqNullSafe(F.col("name")))
    last = F.coalesce(F.min(F.when(F.col("seen") >= F.col("enough") + spare, F.col("at"))), F.max("final"))
    return materialise(beyond.groupBy("of", "cut", "room").agg(last.alias("last")), "mix-ends")


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Takes, in the order of ranks, each document that fits into what room is left."""
    group = group.sort_values(["v", "digest", "number"], kind="stable")
    room, extra = float(group["room"].iloc[0]), []
    for size in group["size"]:
        extra.append(int(size <= room))
        room -= size if extra[-1] else 0
    return group.assign(extra=extra)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, emphasis: float = EMPHASIS) -> DataFrame:
    """(doc_id, source, digest, size, source_size, target, copies, taken), one row a row of docs (doc_id, text, source)."""
    sized = sized_documents(docs)
    plan = sampling_plan(sized, targets(sized, weights, most), emphasis)
    ranges = max(64, math.isqrt(sized.count()))
    ranked = ranked_documents(numbered(sized), plan, emphasis, ranges)
    ends = sample_ends(ranked, ranges)
    rows = ranked.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rows = rows.select("doc_id", "source", "digest", "size", "source_size", "target", "whole", "v", "number", "room", F.coalesce(F.col("at") < F.col("cut"), F.lit(False)).alias("sure"), F.coalesce(F.col("at").between(F.col("cut"), F.col("last")), F.lit(False)).alias("open"))
    settled = rows.where("NOT open").withColumn("extra", F.col("sure").cast("int"))
    filled = rows.where("open").groupBy("source").applyInPandas(_fill, settled.schema)
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return settled.unionByName(filled).select("doc_id", "source", "digest", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as ``mix`` takes it."""
    copies = plan.groupBy(F.struct("doc_id", "source", "digest").alias("__key")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    key = F.struct("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    packed = docs.select(key.alias("__key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")).join(copies, "__key")
    once = packed.where("__rows = 1").unionByName(packed.where("__rows > 1").dropDuplicates(["__key"]))
    return once.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")
