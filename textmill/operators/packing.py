"""Packing token streams into fixed-length blocks.

The stream is the concatenation, in mix order, of each document's ids plus
EOS.  Instead of a buffer, every document gets its global token offset (a
two-level running sum) and is exploded into one row per block it touches;
a block then gathers at most ``block_size`` ids from its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import tokens as TK
from textmill.operators.ordering import id_bucket, running_total

# Fixed values of the reference run (defaults of the API).
BLOCK_SIZE = 4096
BLOCKS_PER_FILE = 2048
EVAL_BLOCKS = 2000


def token_offsets(mixed: DataFrame, order: str = "mix_pos", text: str = "text",
                  count: Column | None = None, bucket_width: int = 50_000) -> DataFrame:
    """``n_tokens`` (ids + EOS) and ``tok_start`` (global offset) per document.

    ``count`` is the token count before EOS; by default the byte tokenizer's
    (UTF-8 length of ``text``), which needs no encoding -- pass a narrow
    column (e.g. a byte count taken at the scan) to keep text out of the
    shuffles.  Documents without tokens are dropped (P5) before offsets are
    assigned.
    """
    cnt = count if count is not None else TK.byte_token_count(text)
    d = mixed.withColumn("n_tokens", (cnt + F.lit(1)).cast("long")).where(F.col("n_tokens") > 1)
    return running_total(d, [], [order], "n_tokens", id_bucket(order, bucket_width),
                         out="tok_start", exclusive=True)


def pack_blocks(offsets: DataFrame, ids, block_size: int = BLOCK_SIZE,
                eval_blocks: int = EVAL_BLOCKS, blocks_per_file: int = BLOCKS_PER_FILE,
                texts: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``(block_idx, split, shard, local_idx, input_ids)``.

    ``offsets``: rows with ``tok_start`` and ``n_tokens``.  ``ids``: a Column
    (or a function of a column name) giving the document's id list *without*
    EOS (appended here, D1).  With ``texts`` (``key``, text) the offsets are
    narrow: they are checkpointed (the total-token count and the packing
    both read them) and the text is joined once, just before encoding.
    The incomplete tail block is dropped.  Every block gathers at most
    ``block_size`` ids, so no group grows with the data.
    """
    B = int(block_size)
    if texts is not None:
        offsets = offsets.select(key, "tok_start", "n_tokens").checkpoint(eager=True)
    total = offsets.agg(F.sum("n_tokens")).first()[0] or 0  # one scalar
    n_blocks = total // B
    start, n = F.col("tok_start"), F.col("n_tokens")
    d = offsets.where(start < F.lit(n_blocks * B))
    if texts is not None:
        d = d.join(texts, key)
    ids_col = ids("text") if callable(ids) else ids
    d = (d.withColumn("_ids", TK.append_eos(ids_col))
         .withColumn("_blk", F.explode(F.sequence(F.floor(start / B), F.floor((start + n - 1) / B))))
         .where(F.col("_blk") < F.lit(n_blocks)))
    seg_lo = F.greatest(start, F.col("_blk") * B)
    seg_hi = F.least(start + n, (F.col("_blk") + 1) * B)
    d = d.select(F.col("_blk").cast("long").alias("block_idx"),
                 seg_lo.alias("_lo"),
                 F.slice("_ids", (seg_lo - start + 1).cast("int"), (seg_hi - seg_lo).cast("int")).alias("_seg"))
    g = d.groupBy("block_idx").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_lo"), F.col("_seg")))).alias("_parts"))
    blocks = g.select("block_idx", F.flatten(F.transform("_parts", lambda p: p["_seg"])).alias("input_ids"))
    return with_split(blocks, eval_blocks, blocks_per_file)


def with_split(blocks: DataFrame, eval_blocks: int = EVAL_BLOCKS,
               blocks_per_file: int = BLOCKS_PER_FILE) -> DataFrame:
    """The first ``eval_blocks`` blocks form ``eval``; the rest are
    ``train`` shards of ``blocks_per_file`` blocks."""
    b = F.col("block_idx")
    is_eval = b < F.lit(eval_blocks)
    return blocks.select(
        "block_idx",
        F.when(is_eval, F.lit("eval")).otherwise(F.lit("train")).alias("split"),
        F.when(is_eval, F.lit(None).cast("long"))
         .otherwise(F.floor((b - eval_blocks) / blocks_per_file)).cast("long").alias("shard"),
        F.when(is_eval, b).otherwise((b - eval_blocks) % blocks_per_file).cast("long").alias("local_idx"),
        "input_ids")


def pack_metadata(offsets: DataFrame, block_size: int = BLOCK_SIZE,
                  eval_blocks: int = EVAL_BLOCKS, blocks_per_file: int = BLOCKS_PER_FILE,
                  role: str = "role", roles=("main", "repeat", "capped")) -> DataFrame:
    """D5 (A4 + A11): one row.  Documents in the dropped tail still count."""
    B = int(block_size)
    total_blocks = F.floor(F.sum("n_tokens") / B).cast("long")
    aggs = [F.count(F.lit(1)).alias("total_docs"),
            F.sum("n_tokens").cast("long").alias("total_tokens"),
            total_blocks.alias("total_blocks")]
    aggs += [F.count_if(F.col(role) == F.lit(r)).alias(f"docs_{r}") for r in roles]
    m = offsets.agg(*aggs)
    return m.select(
        F.lit(B).alias("block_size"), F.lit(int(blocks_per_file)).alias("blocks_per_file"),
        "total_docs", *[f"docs_{r}" for r in roles], "total_tokens", "total_blocks",
        F.least(F.col("total_blocks"), F.lit(int(eval_blocks)).cast("long")).alias("eval_blocks"),
        F.greatest(F.col("total_blocks") - F.lit(int(eval_blocks)), F.lit(0)).cast("long").alias("train_blocks"))


def split_overlap(offsets: DataFrame, block_size: int = BLOCK_SIZE, eval_blocks: int = EVAL_BLOCKS,
                  key: str = "doc_id") -> DataFrame:
    """Optional report: documents with tokens in both the eval head and the
    train blocks -- one emission straddling the boundary, or a repeated
    document emitted in both.  Works on the narrow offsets only."""
    B, E = int(block_size), int(eval_blocks)
    total = offsets.agg(F.sum("n_tokens")).first()[0] or 0
    n_blocks = total // B
    first = F.floor(F.col("tok_start") / B)
    last = F.least(F.floor((F.col("tok_start") + F.col("n_tokens") - 1) / B), F.lit(n_blocks - 1))
    d = offsets.where(F.col("tok_start") < F.lit(n_blocks * B))
    g = d.groupBy(key).agg(F.max((first < E).cast("int")).alias("in_eval"),
                           F.max((last >= E).cast("int")).alias("in_train"),
                           F.count(F.lit(1)).alias("emissions"))
    return g.where((F.col("in_eval") == 1) & (F.col("in_train") == 1)).select(key, "emissions")


def with_lm_labels(blocks: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Causal-LM labels are a copy of the inputs."""
    return blocks.withColumn("labels", F.col(ids))


def shard_index(blocks: DataFrame) -> DataFrame:
    """Per train shard: block count and the first global train index (the
    cumulative counts a random-access reader bisects)."""
    t = blocks.where(F.col("split") == "train")
    s = t.groupBy("shard").agg(F.count(F.lit(1)).alias("n_blocks"),
                               (F.min("block_idx")).alias("first_block"))
    return s


def block_lookup(indexes: DataFrame, shards: DataFrame, idx: str = "train_idx",
                 bucket_width: int = 1024) -> DataFrame:
    """Global train index -> (shard, local index) given per-shard block
    counts, as a reader bisecting cumulative counts would do.

    ``shards``: ``(shard, n_blocks)``.  Shard starts are a running sum over the
    shard rows.  The range predicate ``start <= i < start + n`` is answered
    with a bucketed equi-join: each shard is listed under every bucket of
    ``bucket_width`` indexes it overlaps, each index looks up its own bucket.
    """
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sh = shards.select("shard", "n_blocks",
                       F.coalesce(F.sum("n_blocks").over(w), F.lit(0)).cast("long").alias("start"))
    W_ = int(bucket_width)
    sh = sh.where(F.col("n_blocks") > 0).withColumn(
        "_bk", F.explode(F.sequence(F.floor(F.col("start") / W_),
                                    F.floor((F.col("start") + F.col("n_blocks") - 1) / W_))))
    i = indexes.withColumn("_bk", F.floor(F.col(idx) / W_))
    j = i.join(sh, "_bk")
    return (j.where((F.col(idx) >= F.col("start")) & (F.col(idx) < F.col("start") + F.col("n_blocks")))
             .select(idx, "shard", (F.col(idx) - F.col("start")).alias("local_idx")))


def resume_skip(blocks: DataFrame, optimizer_step: int, grad_accum: int = 8,
                eval_blocks: int = EVAL_BLOCKS) -> DataFrame:
    """A resumed run skips the first ``step * grad_accum`` train blocks."""
    first = int(optimizer_step) * int(grad_accum)
    t = blocks.where(F.col("split") == "train")
    return (t.withColumn("train_idx", F.col("block_idx") - F.lit(int(eval_blocks)))
             .where(F.col("train_idx") >= F.lit(first)))


def read_block_files(spark, path: str, block_size: int = BLOCK_SIZE, ids: str = "input_ids") -> DataFrame:
    """S11 on files: the blocks below ``path`` with ``file_idx``, the place of
    their file among all in name order, and ``row``, their place in it.

    A folder without a block file is an error at once; a block of another width
    than ``block_size``, or none, is one when its rows are read."""
    from textmill.session import path_exists
    from textmill.sources.jsonl import metadata_path

    files = sorted(metadata_path(u) for u in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
                   .load(path).inputFiles()) if path_exists(spark, path) else []
    if not files:
        raise FileNotFoundError(f"no block files below {path}")
    blocks = spark.read.parquet(path)
    if ids not in blocks.columns or not blocks.schema[ids].dataType.typeName() == "array":
        raise ValueError(f"{path}: {ids} is no column of id lists")
    listed = spark.createDataFrame(list(enumerate(files)), "file_idx long, _path string")
    place = F.col("_metadata.row_index")
    width = F.coalesce(F.size(ids), F.lit(-1))
    wrong = F.concat(F.lit(f"block is not {block_size} ids wide but "), width.cast("string"), F.lit(" in "), F.col("_metadata.file_path"))
    d = blocks.select("*", F.col("_metadata.file_path").alias("_file"), place.alias("row"),
                      F.when(width == int(block_size), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean")).alias("_fits"))
    # the check is a filter, so no projection prunes it
    return d.where("_fits").join(F.broadcast(listed), F.col("_file") == F.col("_path")).drop("_file", "_path", "_fits")


def validate_blocks(blocks: DataFrame, block_size: int = BLOCK_SIZE, ids: str = "input_ids") -> DataFrame:
    """Blocks whose width differs from the block size (empty when valid)."""
    return (blocks.withColumn("width", F.size(ids))
            .where(F.col("width") != F.lit(int(block_size)))
            .select("block_idx", "split", "shard", "width"))
