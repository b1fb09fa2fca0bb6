"""Sinks (K1-K8).  Ordered outputs are range-partitioned and sorted inside
partitions, so the part files, read in name order, are the ordered file the
reference writes -- without funnelling the data through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.sinks.verbatim import joined, write_verbatim


def _ordered(df: DataFrame, order, parts: int | None = None) -> DataFrame:
    # without a width it is the session's shuffle width, and AQE merges small neighbours
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def write_corpus(docs: DataFrame, path: str, group_order: list[str], group: str = "group",
                 file: str = "file", line: str = "line", text: str = "text", parts: int | None = None) -> None:
    """K1: every document followed by ``"\\n\\n"``, groups in ``group_order``,
    then file and line order."""
    rank = F.array_position(F.array(*[F.lit(g) for g in group_order]), F.col(group))
    d = docs.withColumn("_g", F.when(rank > 0, rank).otherwise(
        F.raise_error(F.concat(F.lit("group without a place in the order: "), F.coalesce(group, F.lit("null"))))))
    _ordered(d, ["_g", file, line], parts).select(text).write.mode("overwrite") \
        .option("lineSep", "\n\n").text(path)


def write_corpus_groups(docs: DataFrame, path: str, group: str = "group", file: str = "file",
                        line: str = "line", text: str = "text") -> None:
    """K1 for all groups that the data holds in one job: a ``<group>=...``
    folder each, part files in file and line order, sized by AQE."""
    ordered = docs.repartitionByRange(group, file, line).sortWithinPartitions(group, file, line)
    ordered.select(group, text).write.mode("overwrite").partitionBy(group).option("lineSep", "\n\n").text(path)


def write_blocks(blocks: DataFrame, path: str, max_records_per_file: int = 2048) -> None:
    """K2: packed blocks as Parquet, partitioned by split and shard (shard
    pruning is free on read)."""
    (blocks.withColumn("shard", F.coalesce(F.col("shard"), F.lit(-1)))
     .repartition("split", "shard").sortWithinPartitions("block_idx")
     .write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("split", "shard").parquet(path))


def write_json_row(one_row: DataFrame, path: str) -> None:
    """K3/K8: a one-row summary (manifest, metadata, report) as JSON text."""
    one_row.select(F.to_json(F.struct(*one_row.columns)).alias("json")).coalesce(1) \
        .write.mode("overwrite").text(path)


def write_holdout_lines(sample: DataFrame, path: str, order: str = "line_number", raw: str = "raw_line") -> None:
    """K4 (text): raw JSONL lines verbatim, sorted by line number."""
    _ordered(sample, [order]).select(raw).write.mode("overwrite").text(path)


def write_holdout_blocks(sample: DataFrame, path: str, order: str = "block_index", text: str = "block_text",
                         parts: int | None = None) -> None:
    """K4 (code): blocks with a blank line between them and nothing behind the
    last one: part files and a manifest of their offsets (see
    :mod:`textmill.sinks.verbatim`)."""
    blocks = joined(sample.select(order, text), [order], text, "\n\n", out="_joined")
    write_verbatim(blocks, path, [order], "_joined", parts)


def write_predictions(scored: DataFrame, path: str) -> None:
    """K5: ``{id, prediction, reference, rouge{rouge1,rouge2,rougeL}{p,r,f1}}``
    per line."""
    scored.select("id", "prediction", "reference", "rouge").write.mode("overwrite").json(path)


def write_points_csv(points: DataFrame, path: str, bom: bool = False) -> None:
    """K6: the plot points as CSV with a header, original row order kept;
    ``bom`` prefixes the header with a UTF-8 byte-order mark."""
    d = points
    if bom:
        first = d.columns[0]
        d = d.withColumnRenamed(first, "﻿" + first)
    d.write.mode("overwrite").option("header", True).csv(path)


def append_log_csv(rows: DataFrame, path: str, resume: bool = True) -> None:
    """K7: append to a CSV log; a fresh log (or ``resume=False``, the base
    run without a resume checkpoint) starts over.  Every part file carries
    its own header, which is how a multi-file CSV stays readable with
    ``header=True`` (the single-file log writes it once)."""
    from textmill.session import path_exists

    fresh = not resume or not path_exists(rows.sparkSession, path)
    rows.write.mode("overwrite" if fresh else "append").option("header", True).csv(path)


def tokenizer_report(quality: DataFrame, top: DataFrame, failures: DataFrame, group: str = "group") -> DataFrame:
    """K8: one row per group with its top tokens and failure examples nested
    (both bounded: 20 and 3 rows per group)."""
    t = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "token_id", "token", "count")))
                               .alias("top_used_tokens"))
    f = failures.groupBy(group).agg(F.collect_list(F.struct("input_preview", "decoded_preview"))
                                    .alias("roundtrip_fail_examples"))
    return quality.join(t, group, "left").join(f, group, "left")
