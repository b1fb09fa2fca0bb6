"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.session import scratch_path

#: The six separators of ``[^\x20\x09-\x0D]+`` words; Java's ``\s`` is the same set.
SPACES = " \t\n\x0b\f\r"

#: Bits of :func:`digest60`.
HASH_BITS = 60


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage so that a costly pass runs once, and fixes values such as
    row numbers; the files outlive the executors that wrote them.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Native array of the text's words; empty for null or blank texts."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.octet_length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, r"\s+"))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.octet_length(trimmed), F.lit(0)) == 0, F.lit(0)) \
        .otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def digest60(*cols) -> Column:
    """First 60 bits of the MD5 of the columns joined by ``:`` (nulls left
    out), as a non-negative long: a hash that SQL engines agree on."""
    joined = F.concat_ws(":", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def fresh(names, taken) -> list:
    """``names``, each with underscores added until it clashes with none in ``taken``."""
    out, used = [], {c.lower() for c in taken}
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def utf8_words(raw: bytes) -> list:
    """Words between ASCII white space; the six bytes that ``bytes.split``
    knows are exactly the separators of :data:`SPACES`."""
    return raw.split()


def text_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes (null: empty)."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def text_slices(batches, column: str = "text", most: int = 1 << 20):
    """The batches cut into slices of at most ``most`` bytes of text, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def trimmed(run):
    """``run``, an Arrow function of a partition, that hands the memory it has
    freed back to the system when it ends: Python workers idle on for a while,
    beside tasks that need it."""
    def run_and_trim(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run_and_trim


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)``: the smallest node reachable over ``edges``.

    Alternating large-star and small-star steps: each keeps the components and
    lets every node point at a smaller one until only stars are left, which
    takes about log(longest chain) rounds.  A node's neighbours are only
    reduced to their minimum and joined back, never gathered.
    """
    mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    e, last = stage(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v"), "edges"), None
    while True:
        # large star: of all neighbours, the greater ones point at the least
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v")
        # small star: of the lesser neighbours and itself, all point at the least
        large = large.where("u < v")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
                 .unionByName(low.select(F.col("m").alias("u"), "v"))
                 .where("u < v").distinct())
        e = stage(small, "edges")
        now = tuple(e.agg(*mark).first())
        if now == last:
            break
        last = now
    return (e.select(F.col("v").alias("node"), F.col("u").alias("component"))
            .unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct())


def empty_like(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def left_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_bytes: int) -> list:
    """``[(text bytes, 0 or 1)]`` on the driver, at most ``per_class`` of either
    label and ``max_bytes`` bytes each: of the ids with ``usable`` labels those
    with the least hashes, whose texts are then fetched by a broadcast join of
    that bounded set."""
    spark = docs.sparkSession
    ids = labels.where(F.col("doc_id").isNotNull() & usable).select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    picked = [r for y in (0, 1) for r in ids.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class).collect()]
    if not picked:
        return []
    small = spark.createDataFrame([(r[0], r[1]) for r in picked], ids.schema)
    d = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    rows = d.join(F.broadcast(small), "doc_id").dropDuplicates(["doc_id"]).orderBy(order, "doc_id").select("text", "y").collect()
    return [(r[0].encode(), r[1]) for r in rows]
