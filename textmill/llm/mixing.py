"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash of its id and text.  A source that is to
give ``target`` words out of ``source_size`` takes all of its documents
``floor(target / source_size)`` times and, for what is left of the budget,
those whose hash lies under a threshold.  The threshold comes from sums of
words by source and hash bucket: buckets are added up in hash order until one
would exceed the budget, and only that boundary bucket is split into finer
buckets in the next pass, until it holds a single hash.  No document is sorted
and a rerun takes the same documents.  Thresholds of one source are nested: a
larger budget takes every document that a smaller one takes.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows equal in ``doc_id`` and ``text`` share a hash and are taken
together; an empty table gives an empty result; columns other than ``doc_id``,
``text`` and ``source`` are ignored by :func:`mix` and kept by
:func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import HASH_BITS, digest60, fresh, stage, word_count
from textmill.operators.ordering import BK, dense_index, range_buckets

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
LEVEL_BITS = 12


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """``(source, source_size)`` with the column ``target``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and
    share ``share`` times all words.  No target exceeds ``most`` times its
    source's words; the excess is shared again by weight until none does.  Per
    round the driver only learns one number, the words for a weight of 1.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = dense_index(range_buckets(sizes, order), [], order, BK, out="rank").drop(BK)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = stage(ranked.select("source", "source_size", weight.alias("weight"),
                              (F.col("source_size") * float(most)).alias("cap")), "mix-sources")
    total, all_weights = src.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    each = budget / all_weights if all_weights else 0.0
    while True:
        full = F.col("cap") <= F.lit(each) * F.col("weight")
        capped, open_weight = src.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        again = (budget - (capped or 0.0)) / open_weight if open_weight else each
        if again <= each:
            break
        each = again
    return src.select("source", "source_size", F.least(F.col("cap"), F.lit(each) * F.col("weight")).alias("target"))


def source_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS,
                level_bits: int = LEVEL_BITS) -> DataFrame:
    """``(source, source_size, target, whole, threshold)`` from staged
    ``(source, size, h)`` rows: each document of a source is taken ``whole``
    times, and once more if ``h < threshold``."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = source_targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    src = stage(src.withColumn("whole", F.least(whole, F.lit(most)).cast("long"))
                .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-budgets")

    open_ = src.where(F.col("whole") < most).select(F.col("source").alias("s0"), "rest", F.lit(0).cast("long").alias("prefix"))
    found, shift = None, HASH_BITS
    while shift > 0:
        step = min(level_bits, shift)
        rows = (sized.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("s0")))
                .where(F.shiftright("h", shift) == F.col("prefix")))
        shift -= step
        hist = (rows.groupBy("s0", "rest", F.shiftright("h", shift).alias("bucket"))
                .agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        # at most 2^level_bits buckets of a source meet here
        ahead = Window.partitionBy("s0").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("s").over(ahead), F.lit(0)))
        edge = stage(hist.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("s") > F.col("rest"))),
                     "mix-edge")
        near = F.col("lo") + (2 * (F.col("rest") - F.col("before")) >= F.col("s")).cast("long")
        done = edge.where("lo = hi").select("s0", near.alias("threshold"))
        found = done if found is None else found.unionByName(done)
        open_ = edge.where("lo < hi").select("s0", (F.col("rest") - F.col("before")).alias("rest"),
                                             F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    # a source without a boundary bucket has no more words than its budget
    nothing = F.when((F.col("whole") >= most) | (F.col("rest") <= 0), F.lit(0)).otherwise(F.lit(1 << HASH_BITS))
    return (src.join(found, F.col("source").eqNullSafe(F.col("s0")), "left")
            .select("source", "source_size", "target", "whole", F.coalesce("threshold", nothing.cast("long")).alias("threshold")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target,
    copies, taken``; ``taken`` is ``copies * size`` words."""
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                              word_count(F.col("text")).alias("size"), digest60("doc_id", "text").alias("h")), "mix-docs")
    plan = stage(source_plan(sized, weights, share, most), "mix-plan").withColumnRenamed("source", "s1")
    copies = F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("s1")))
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Only the plan, one row per source, is joined to the texts."""
    src = F.col("source").cast("string")
    sized = stage(docs.select(src.alias("source"), word_count(F.col("text")).alias("size"),
                              digest60("doc_id", "text").alias("h")), "mix-docs")
    s1, whole, threshold, copy = fresh(["mix_source", "whole", "threshold", "copy"], docs.columns)
    plan = stage(source_plan(sized, weights, share, most), "mix-plan") \
        .select(F.col("source").alias(s1), F.col("whole").alias(whole), F.col("threshold").alias(threshold))
    copies = F.col(whole) + (digest60("doc_id", "text") < F.col(threshold)).cast("long")
    return (docs.join(plan, src.eqNullSafe(F.col(s1)))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns))
