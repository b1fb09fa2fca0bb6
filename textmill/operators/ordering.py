"""Order-dependent building blocks: running totals and dense indexes.

A window such as ``sum(x) over (order by k)`` without ``partitionBy`` plans an
``Exchange SinglePartition``: one task for the whole corpus.  Everything here
is two-level instead:

1. every row gets a *bucket* that is non-decreasing along the order key and
   holds a bounded number of rows (a data column, never a physical id, so
   retries and AQE cannot change results);
2. per-bucket totals are aggregated (map-side partial aggregation) and a small
   window over the *bucket rows* gives each bucket its starting offset;
3. offsets are joined back and a window partitioned by ``(part, bucket)``
   finishes the job.  The join and that window share one hash partitioning,
   so the data side is shuffled once.

When the caller cannot name a bounded bucket (e.g. ordering by timestamp,
where one instant may hold a third of the rows) :func:`range_buckets` derives
one from a range repartition on the full order key and materialises it with a
reliable ``checkpoint()`` so the bucket ids are stable.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.session import checkpoint_dir

BK = "_tm_bucket"
_V = "_tm_val"
_BS = "_tm_bsum"
_BO = "_tm_boff"

# ~1M narrow rows (tens of MB) per bucket: one task's worth of a window
DEFAULT_BUCKET_ROWS = 1_000_000


def _cols(xs) -> list[Column]:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _names(xs) -> list[str]:
    if xs is None:
        return []
    if isinstance(xs, str):
        return [xs]
    return list(xs)


def id_bucket(id_col, width: int = 10_000) -> Column:
    """Bucket for a *unique* integer order key: at most ``width`` rows each."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.floor(c / F.lit(width)).cast("long")


def range_buckets(df: DataFrame, order: Sequence, part: Sequence[str] = (),
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Adds ``BK``: the id of a range partition over ``(part, order)``.

    Range partitioning samples the full composite key, so ties on a leading
    column are split by the following ones and buckets stay balanced even when
    one value holds a large share of the rows.  Partition ids after a range
    exchange are non-decreasing along the key (AQE only merges neighbours).
    The number of ranges is the session's shuffle width, coalesced by AQE to
    its advisory partition size -- no extra pass over the data; pass
    ``rows_per_bucket`` to size it from a row count instead.  The result is
    checkpointed to the shared checkpoint folder so that the bucket column is
    data from then on (bucket sizes never change results, only balance).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if rows_per_bucket is None:
        keyed = df.repartitionByRange(*_cols(part), *_cols(order))
    else:
        n = max(1, math.ceil(df.count() / rows_per_bucket))
        keyed = df.repartitionByRange(n, *_cols(part), *_cols(order))
    return keyed.withColumn(BK, F.spark_partition_id().cast("long")).checkpoint(eager=True)


def running_totals(df: DataFrame, part: Sequence[str], order: Sequence, values: dict, bucket,
                   exclusive: bool = False, max_start=None) -> DataFrame:
    """Several running sums along the same order in one pass: ``values`` maps
    an output column to the expression summed.  ``bucket``: a Column
    non-decreasing along ``order`` within ``part`` and of bounded size, or the
    name of an existing bucket column (see :func:`range_buckets`).
    ``max_start``: optional Column/number compared with the *first* value's
    bucket offset; buckets starting past it are pruned before the data is
    shuffled (the early stop of a budget or first-n prefix), so use it only
    for prefix queries."""
    part = _names(part)
    outs = list(values)
    keep = isinstance(bucket, str) and bucket == BK  # caller-owned bucket column
    if isinstance(bucket, str):
        b = df.withColumn(BK, F.col(bucket)) if bucket != BK else df
    else:
        b = df.withColumn(BK, bucket)
    vals = {f"{_V}{i}": (F.col(v) if isinstance(v, str) else v) for i, v in enumerate(values.values())}
    b = b.withColumns(vals)
    sums = b.groupBy(*part, BK).agg(*[F.sum(v).alias(f"{_BS}{i}") for i, v in enumerate(vals)])
    w = Window.partitionBy(*part).orderBy(BK).rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(*part, BK, *[F.coalesce(F.sum(f"{_BS}{i}").over(w), F.lit(0)).alias(f"{_BO}{i}")
                                   for i in range(len(vals))])
    if max_start is not None:
        lim = max_start if isinstance(max_start, Column) else F.lit(max_start)
        offs = offs.where(F.col(f"{_BO}0") <= lim)
    j = b.join(offs, [*part, BK])
    w2 = (Window.partitionBy(*part, BK).orderBy(*_cols(order))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cums = {}
    for i, (out, v) in enumerate(zip(outs, vals)):
        c = F.col(f"{_BO}{i}") + F.sum(v).over(w2)
        cums[out] = c - F.col(v) if exclusive else c
    r = j.withColumns(cums).drop(*vals, *[f"{_BO}{i}" for i in range(len(vals))])
    return r if keep else r.drop(BK)


def running_total(df: DataFrame, part: Sequence[str], order: Sequence, value,
                  bucket, out: str = "cum", exclusive: bool = False,
                  max_start=None) -> DataFrame:
    """Running ``sum(value)`` along ``order`` inside each ``part`` group
    (:func:`running_totals` with one value)."""
    return running_totals(df, part, order, {out: value}, bucket, exclusive, max_start)


def dense_index(df: DataFrame, part: Sequence[str], order: Sequence, bucket,
                out: str = "idx", base: int = 0, max_index=None) -> DataFrame:
    """Dense position of each row along ``order`` inside ``part``, starting at
    ``base``.  Order keys must be total (unique) for a deterministic result."""
    lim = None
    if max_index is not None:
        lim = (max_index if isinstance(max_index, Column) else F.lit(max_index)) - F.lit(base)
    r = running_total(df, part, order, F.lit(1).cast("long"), bucket, out=out,
                      exclusive=True, max_start=lim)
    if base:
        r = r.withColumn(out, F.col(out) + F.lit(base))
    return r


def spread_small(df: DataFrame) -> DataFrame:
    """A rebalance of the rows before CPU-heavy per-row work, for inputs too
    small to give every core a scan split (one small file is one task).

    The size is what the optimizer knows of the plan's inputs, so nothing runs
    here and a large input keeps its scan partitions without a shuffle; AQE
    sizes the rest.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    estimate = 0
    while leaves.hasNext():
        estimate += int(str(leaves.next().stats().sizeInBytes()))
    split = 128 << 20
    return df.hint("rebalance") if estimate < split * spark.sparkContext.defaultParallelism else df
