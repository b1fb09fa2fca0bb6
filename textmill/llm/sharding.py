"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash of id and text.
All documents start in one bucket; only a bucket with more bytes than the limit
splits, on one more bit, until every bucket fits.  A pass sums bytes by a
prefix a few bits longer than the last directory, sums those up to every
shorter prefix, and keeps the shortest prefix that fits; the next pass looks
only at prefixes that are still too large.

Defined results: a null text has 0 bytes; a document larger than the limit by
itself can't share a shard and gets its own (``oversized``), named after its
hash and, where rows have equal hashes, after a number given to each row; rows
equal in id and text have equal hashes, so when all 60 bits are used up and
they still exceed the limit, they split on the bits of such a number; an empty
table has no shards; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import HASH_BITS, digest60, fresh, stage

#: Bytes a shard may hold.
LIMIT_BYTES = 1 << 20
#: Bits that a pass looks ahead, after a first one of as many as equal shards need and two more.
STEP_BITS = 3


def directories(rows: DataFrame, limit: int, step_bits: int = STEP_BITS):
    """Directory tables for ``(h, bytes)`` rows that each fit the limit.

    Returns ``([(bits, table)], rest)``: in a table, ``slot`` is a hash prefix
    of ``bits`` bits, ``depth`` the bits its shard uses and ``shard_bytes`` its
    size.  ``rest`` are whole hashes (``h``) that exceed the limit, or None.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    tables, depth, open_ = [], 0, None
    while depth < HASH_BITS:
        bits = min(HASH_BITS, depth + step_bits if depth else max(1, (total // limit).bit_length() + 2))
        left = rows if open_ is None else rows.join(open_, F.shiftright("h", HASH_BITS - depth) == F.col("over"), "left_semi")
        fine = stage(left.groupBy(F.shiftright("h", HASH_BITS - bits).alias("slot"))
                     .agg(F.sum("bytes").alias("b")), "shard-slots")
        at = fine.select("slot", "b", F.explode(F.sequence(F.lit(depth), F.lit(bits))).alias("d"))
        up = F.expr(f"shiftright(slot, {bits} - d)")
        sums = at.groupBy("d", up.alias("p")).agg(F.sum("b").alias("s"))
        # the shortest prefix of a slot that fits
        fits = sums.where(F.col("s") <= limit).select("d", "p", "s")
        paths = fine.select("slot", F.explode(F.sequence(F.lit(depth), F.lit(bits))).alias("d")) \
            .withColumn("p", F.expr(f"shiftright(slot, {bits} - d)"))
        table = stage(paths.join(fits, ["d", "p"]).groupBy("slot")
                      .agg(F.min("d").alias("depth"), F.min_by("s", "d").alias("shard_bytes")), "shard-directory")
        tables.append((bits, table))
        open_ = fine.where(F.col("b") > limit).select(F.col("slot").alias("over"))
        depth = bits
        if open_.isEmpty():
            return tables, None
    return tables, open_.select(F.col("over").alias("h"))


def _name(bits_used: Column, h: Column) -> Column:
    """The shard's hash prefix as a string of bits; the only shard of all is ``*``."""
    whole = F.lpad(F.bin(h), HASH_BITS, "0")
    return F.when(bits_used == 0, F.lit("*")).otherwise(F.substr(whole, F.lit(1), bits_used.cast("int")))


def _assign(df: DataFrame, tables, key: str, depth: str, size: str) -> DataFrame:
    """Adds ``depth`` and ``size`` (bytes of the shard) by looking each hash up in the directories."""
    found_depth, found_size, used = F.lit(None).cast("int"), F.lit(None).cast("long"), []
    for bits, table in tables:
        slot, d, b = fresh(["slot", "slot_depth", "slot_bytes"], [*df.columns, depth, size])
        t = table.select(F.col("slot").alias(slot), F.col("depth").alias(d), F.col("shard_bytes").alias(b))
        df = df.join(t, F.shiftright(key, HASH_BITS - bits) == F.col(slot), "left")
        found_depth, found_size = F.coalesce(found_depth, F.col(d)), F.coalesce(found_size, F.col(b))
        used += [slot, d, b]
    return df.withColumn(depth, found_depth).withColumn(size, found_size).drop(*used)


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, step_bits: int = STEP_BITS) -> DataFrame:
    """The rows of ``docs`` with ``bytes, shard, depth, shard_bytes, oversized``
    (in place of columns of those names)."""
    docs = docs.drop("bytes", "shard", "depth", "shard_bytes", "oversized")
    out = docs.columns
    key, over, used, row, first = fresh(["hash", "over", "bits", "row", "first_hash"],
                                        [*out, "bytes", "shard", "depth", "shard_bytes", "oversized"])
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keyed = docs.withColumns({"bytes": size, key: digest60("doc_id", "text")})
    rows = stage(docs.select(digest60("doc_id", "text").alias("h"), size.alias("bytes")), "shard-rows")
    tables, rest = directories(rows.where(F.col("bytes") <= limit), limit, step_bits)
    again = rows.where(F.col("bytes") > limit).groupBy(F.col("h").alias(over)).count().where("count > 1").select(over)
    small, alone = keyed.where(F.col("bytes") <= limit), keyed.where(F.col("bytes") > limit)
    full = None if rest is None else rest.select(F.col("h").alias(over))
    placed = small if full is None else small.join(full, F.col(key) == F.col(over), "left_anti")
    placed = _assign(placed, tables, key, used, "shard_bytes").select(
        *out, "bytes", _name(F.col(used), F.col(key)).alias("shard"), F.col(used).alias("depth"), "shard_bytes", F.lit(False).alias("oversized"))
    name = [F.lit("alone"), F.lpad(F.lower(F.hex(key)), 15, "0")]
    own = lambda rows, *name: rows.select(
        *out, "bytes", F.concat_ws("-", *name).alias("shard"), F.lit(HASH_BITS).alias("depth"), F.col("bytes").alias("shard_bytes"),
        F.lit(True).alias("oversized"))
    if again.isEmpty():
        placed = placed.unionByName(own(alone, *name))
    else:
        again = stage(again, "shard-again")
        once = alone.join(again, F.col(key) == F.col(over), "left_anti")
        more = stage(alone.join(again, F.col(key) == F.col(over), "left_semi").withColumn(row, F.monotonically_increasing_id()), "shard-alone")
        placed = placed.unionByName(own(once, *name)).unionByName(own(more, *name, F.col(row).cast("string")))
    if full is not None:
        # equal hashes: number the rows once, then split on the bits of a hash of that number
        twins = stage(small.join(full, F.col(key) == F.col(over), "left_semi").withColumn(row, F.monotonically_increasing_id()), "shard-twins")
        twins = twins.withColumnRenamed(key, first)
        twins = twins.withColumn(key, digest60(first, row))
        more, _ = directories(stage(twins.select(F.col(key).alias("h"), "bytes"), "shard-rows"), limit, step_bits)
        split = _assign(twins, more, key, used, "shard_bytes").select(
            *out, "bytes", F.concat(F.lit("twins-"), _name(F.col(used), F.col(key))).alias("shard"),
            (F.col(used) + HASH_BITS).alias("depth"), "shard_bytes", F.lit(False).alias("oversized"))
        placed = placed.unionByName(split)
    return placed


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard below ``path``."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
