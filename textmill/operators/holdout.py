"""Held-out evaluation splits that exclude what training consumed
(T1-T3, T6, J4, U4, P2, A3, K3).

Sampling is seeded by hashing: a row's rank is ``md5(seed:key)``, so the
sample is uniform without replacement, reproducible, and the same in every
engine.  (The reference's reservoir sample draws from a serial Mersenne
stream; only its distribution is reproduced.)  Per-source top-n uses a
``row_number`` window; Spark inserts a partial per-partition limit before the
shuffle (WindowGroupLimit), so no source is gathered whole into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.ordering import dense_index, id_bucket, running_total

SEED = 42
MIN_TEXT_CHARS = 50
MIN_CODE_CHARS = 30


def seeded_key(key, seed: int = SEED, *extra) -> Column:
    """``md5('<seed>:<extra...>:<key>')``: the sampling / shuffling order."""
    parts = [F.lit(str(seed))] + [F.lit(str(e)) for e in extra]
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", *parts, k.cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = SEED, part=()) -> DataFrame:
    """``n`` rows per ``part`` group (all rows when ``part`` is empty)
    ranked by the seeded hash, plus ``eligible`` = rows available."""
    part = list(part)
    d = df.withColumn("_h", seeded_key(key, seed))
    if part:
        w = Window.partitionBy(*part).orderBy("_h")  # partial top-n per partition (WindowGroupLimit)
        picked = d.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")
        counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("eligible"))
        return picked.join(counts, part).drop("_h")
    picked = d.orderBy("_h").limit(int(n))  # TakeOrderedAndProject: per-partition top-n
    eligible = df.count()  # one scalar
    return picked.withColumn("eligible", F.lit(eligible).cast("long")).drop("_h")


def seeded_shuffle(df: DataFrame, key: str, seed: int = SEED, epoch: int = 0) -> DataFrame:
    """A reproducible permutation per epoch: ``shuffle_pos`` is the rank of
    ``md5(seed:epoch:key)``.  The rank is a two-level dense index over range
    buckets of the hash, so the permutation needs no single-task sort."""
    from textmill.operators.ordering import BK, range_buckets

    d = df.withColumn("_h", seeded_key(key, seed, epoch))
    d = range_buckets(d, ["_h"])
    return dense_index(d, [], ["_h"], BK, out="shuffle_pos").drop(BK, "_h")


def in_source_index(docs: DataFrame, group: str = "group", file: str = "file", line: str = "line",
                    bucket_width: int = 10_000) -> DataFrame:
    """0-based position of each document inside its source (``src_doc``)."""
    return dense_index(docs, [group, file], [line], id_bucket(line, bucket_width), out="src_doc")


def holdout_text(docs: DataFrame, usage: DataFrame, n: int, min_chars: int = MIN_TEXT_CHARS,
                 seed: int = SEED, group: str = "group", file: str = "file", line: str = "line",
                 text: str = "text", per_source_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per source, skip the first ``consumed_docs`` documents the
    training replay consumed (``usage``: group, file, consumed_docs), keep
    texts of at least ``min_chars`` code points, sample ``n``.

    ``per_source_hash`` samples by a hash of group, file and line, for lines
    that are numbered anew in every file; otherwise ``line`` is unique by itself.

    Returns ``(sample, stats)``; stats has ``eligible_unused_docs`` and
    ``sampled_docs`` per source.  Sort the sample by ``line`` when writing."""
    from textmill.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    # the length is taken at the scan; index, join and sampling see keys only
    keys = docs.select(group, file, line, (F.char_length(text) >= min_chars).alias("_long"))
    d = in_source_index(keys, group, file, line)
    u = usage.select(group, file, "consumed_docs")
    d = d.join(u, [group, file], "left").fillna(0, ["consumed_docs"])
    elig = d.where((F.col("src_doc") >= F.col("consumed_docs")) & F.col("_long")).select(group, file, line)
    elig = elig.checkpoint(eager=True)
    if per_source_hash:
        elig = elig.withColumn("_key", F.concat_ws(":", group, file, F.col(line).cast("string")))
    sample = seeded_sample(elig, "_key" if per_source_hash else line, n, seed, part=[group, file]).select(group, file, line, "eligible")
    sample = docs.join(sample, [group, file, line])
    stats = (elig.groupBy(group, file).agg(F.count(F.lit(1)).alias("eligible_unused_docs"))
             .withColumn("sampled_docs", F.least(F.col("eligible_unused_docs"), F.lit(int(n)))))
    return sample, stats


def code_blocks_after_budget(blocks: DataFrame, consumed_bytes, order: str = "block_index",
                             size: str = "block_bytes", bucket_width: int = 10_000) -> DataFrame:
    """T3 (skip part): blocks are skipped while the bytes skipped so far are
    below ``consumed_bytes``; the straddling block is skipped whole.  A block
    is unused when the exclusive running sum of sizes has reached the
    consumed bytes."""
    c = consumed_bytes if isinstance(consumed_bytes, Column) else F.lit(int(consumed_bytes))
    r = running_total(blocks, [], [order], size, id_bucket(order, bucket_width), out="skipped_before",
                      exclusive=True)
    return r.where(F.col("skipped_before") >= c).drop("skipped_before")


def holdout_code(blocks: DataFrame, consumed_bytes, n: int, min_chars: int = MIN_CODE_CHARS,
                 seed: int = SEED, order: str = "block_index", text: str = "block_text") -> DataFrame:
    """Unused blocks of at least ``min_chars`` code points, ``n`` sampled."""
    unused = code_blocks_after_budget(blocks, consumed_bytes, order)
    elig = unused.where(F.char_length(text) >= min_chars)
    return seeded_sample(elig, order, n, seed)
