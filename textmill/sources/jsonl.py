"""Tolerant line and block scans.

Parsing works on a DataFrame of raw lines ``(file, line_no, raw)``, so the
same code serves files read with :func:`read_lines` and lines derived from
tables.  JSON is parsed once with ``try_parse_json`` into a VARIANT; malformed
lines give NULL instead of failing the task.

Documented deviations from Python's ``json`` + ``str``: trailing text after a
complete JSON value is accepted; ``NaN`` is rejected; numbers are rendered by
Spark (``1.0E20``) and nested values as JSON text; non-object lines are skipped
by every scan (the strict packing scan of the reference would crash on them).
Undecodable bytes are dropped by the coercing, lineage and block scans; the
strict scan reads them as U+FFFD.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.text import drop_undecodable, is_falsy_json, strip_u
from textmill.operators.ordering import id_bucket, running_total


# --- reading files ---------------------------------------------------------
def _existing(paths, on_missing: str, spark: SparkSession | None = None) -> list[str]:
    """``'skip'`` drops missing paths (warn-and-continue scans),
    ``'error'`` raises (SFT and evaluation scans)."""
    if isinstance(paths, str):
        paths = [paths]
    keep = []
    for p in paths:
        if spark is not None:
            from textmill.session import path_exists
            ok = path_exists(spark, p)
        else:
            ok = os.path.exists(p)
        if ok:
            keep.append(p)
        elif on_missing == "error":
            raise FileNotFoundError(p)
    return keep


def file_uris(spark: SparkSession, path: str) -> list[str]:
    """The files of a path (a file, folder or pattern) as ``_metadata.file_path``
    names them; none if it is missing."""
    if not _existing([path], "skip", spark):
        return []
    return sorted(metadata_path(u) for u in spark.read.text(path).inputFiles())


def metadata_path(uri: str) -> str:
    # inputFiles() writes an empty authority, the metadata column leaves it out
    return re.sub(r"^([\w+.-]+):///", r"\1:/", uri)


def read_lines(spark: SparkSession, paths, on_missing: str = "skip",
               line_sep: str | None = None, errors: str = "replace") -> DataFrame:
    """Raw lines ``(file, line_no, raw)`` with 1-based physical line numbers
    (blank and malformed lines are counted).

    The order inside a file comes from the scan itself: the split's start
    offset and ``monotonically_increasing_id()`` taken directly above the
    scan, which counts on within a split.  A first pass counts the lines of
    every split; its result, one row per split, is joined back to the scan,
    so the lines themselves are not shuffled.
    ``on_missing``: ``'skip'`` (warn-and-continue scans) or ``'error'``;
    ``errors``: ``'ignore'`` drops undecodable bytes.
    """
    keep = _existing(paths, on_missing, spark)
    if not keep:
        return spark.createDataFrame([], "file string, line_no long, raw string")
    r = spark.read
    if line_sep is not None:
        r = r.option("lineSep", line_sep)
    df = (r.text(keep)
          .select(F.col("_metadata.file_path").alias("file"),
                  F.col("_metadata.file_block_start").alias("_split"),
                  F.monotonically_increasing_id().alias("_mono"),
                  F.col("value").alias("raw")))
    splits = df.groupBy("file", "_split").agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    line_no = F.col("_before") + F.col("_mono") - F.col("_first") + 1
    raw = drop_undecodable("raw") if errors == "ignore" else F.col("raw")
    return df.join(splits, ["file", "_split"]).select("file", line_no.alias("line_no"), raw.alias("raw"))


# --- JSONL text scans --------------------------------------------------------
def _parse(lines: DataFrame, raw: str) -> DataFrame:
    return lines.withColumn("_v", F.try_parse_json(strip_u(raw)))


def _text_value(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _py_str(val: Column) -> Column:
    """Python ``str()`` of a JSON value (see module deviations)."""
    t = F.schema_of_variant(val)
    return (F.when(val.isNull(), F.lit(None))
            .when(t == "VOID", F.lit("None"))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(val, "$", "boolean"), "True").otherwise("False"))
            .when(t == "STRING", F.try_variant_get(val, "$", "string"))
            .otherwise(F.to_json(val)))


def parse_jsonl_text(lines: DataFrame, mode: str = "strict", key: str = "text",
                     raw: str = "raw") -> DataFrame:
    """S1 (``strict``) / S2-S3 (``coerce``): documents from JSON lines.

    strict: keep the value only when it is a JSON string.  coerce: ``str()``
    of any value (``null`` -> ``"None"``), objects only.  Both strip Unicode
    whitespace and drop empty results; a missing key gives nothing.
    Keeps the input columns and adds ``text``.
    """
    d = _parse(lines, raw)
    val = _text_value(F.col("_v"), key)
    is_obj = F.schema_of_variant(F.col("_v")).startswith("OBJECT")
    if mode == "strict":
        txt = F.when(is_obj & (F.schema_of_variant(val) == "STRING"), F.try_variant_get(val, "$", "string"))
    elif mode == "coerce":
        txt = F.when(is_obj, _py_str(val))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = d.withColumn("_t", strip_u(txt)).where(F.length("_t") > 0).drop("_v")
    if "text" in out.columns and "text" != raw:
        out = out.drop("text")
    return out.withColumnRenamed("_t", "text")


def jsonl_with_lineage(lines: DataFrame, key: str = "text", raw: str = "raw") -> DataFrame:
    """S3: coerced documents with ``line_number``, ``raw_line`` (line without
    its newline) and ``train_block_bytes`` (text + separator, UTF-8)."""
    d = parse_jsonl_text(lines, "coerce", key, raw)
    return d.select("file", F.col("line_no").alias("line_number"), F.col(raw).alias("raw_line"), "text",
                    (F.octet_length("text") + 2).cast("long").alias("train_block_bytes"))


# --- blank-line blocks -------------------------------------------------------
def blocks_from_text(df: DataFrame, text: str = "text", sep: str = "\n\n",
                     keys=()) -> DataFrame:
    """S4 on a text column: split on ``sep`` (CRLF normalised first), strip,
    drop empty blocks; ``block_index`` is 1-based and counts dropped blocks.
    Adds ``block_bytes`` = bytes of the block plus a ``"\\n\\n"`` separator."""
    norm = F.regexp_replace(F.col(text), "\r\n", "\n")
    parts = F.split(norm, _regex_quote(sep), -1)
    d = df.select(*keys, F.posexplode(parts).alias("_pos", "_blk"))
    d = d.withColumn("block_text", strip_u("_blk")).where(F.length("block_text") > 0)
    return d.select(*keys, (F.col("_pos") + 1).cast("long").alias("block_index"), "block_text",
                    (F.octet_length("block_text") + 2).cast("long").alias("block_bytes"))


def _regex_quote(s: str) -> str:
    return re.escape(s).replace("\\\n", "\n")


def read_blocks(spark: SparkSession, paths, on_missing: str = "skip", bucket_width: int = 50_000) -> DataFrame:
    """S4 on files with either line ending: blocks are the runs of lines
    between empty ones.

    Splitting the text at every ``"\\n\\n"`` counts one block more for each two
    line breaks, so ``e`` empty lines before a line raise the block number by
    ``(e + 1) div 2`` (``e div 2`` at the top of a file).  The numbers come
    from a two-level running total over the lines that aren't empty; each
    block gathers its own lines only."""
    lines = read_lines(spark, paths, on_missing, errors="ignore")
    full = lines.where(F.length("raw") > 0)
    keys = full.select("file", "line_no", id_bucket("line_no", bucket_width).alias("_b"))
    own = Window.partitionBy("file", "_b").orderBy("line_no")
    ends = keys.groupBy("file", "_b").agg(F.max("line_no").alias("_end"))
    earlier = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "_b", F.max("_end").over(earlier).alias("_end"))
    keys = keys.withColumn("_prev", F.lag("line_no").over(own)).join(ends, ["file", "_b"])
    prev = F.coalesce("_prev", "_end")
    step = F.when(prev.isNull(), F.floor((F.col("line_no") - 1) / 2)).otherwise(F.floor((F.col("line_no") - prev) / 2))
    numbered = running_total(keys.select("file", "line_no", step.alias("_step")), ["file"], ["line_no"], "_step",
                             id_bucket("line_no", bucket_width), out="_blk")
    rows = full.join(numbered.select("file", "line_no", "_blk"), ["file", "line_no"])
    g = rows.groupBy("file", "_blk").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("_l"))
    d = g.withColumn("block_text", strip_u(F.array_join(F.col("_l.raw"), "\n"))).where(F.length("block_text") > 0)
    return d.select("file", (F.col("_blk") + 1).cast("long").alias("block_index"), "block_text",
                    (F.octet_length("block_text") + 2).cast("long").alias("block_bytes"))


# --- prompt/response scans ---------------------------------------------------
def sft_rows(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Classify each line as blank, bad or valid.

    bad = not JSON, or ``prompt``/``response`` Python-falsy (missing, null,
    "", 0, false, [], {}).  Adds ``status``, ``prompt``, ``response`` and
    ``id_value`` (the ``id`` key as text, NULL when absent).
    """
    d = lines.withColumn("_s", strip_u(raw))
    d = d.withColumn("_v", F.try_parse_json("_s"))
    p = F.try_variant_get("_v", "$.prompt", "variant")
    r = F.try_variant_get("_v", "$.response", "variant")
    is_obj = F.schema_of_variant("_v").startswith("OBJECT")
    blank = F.length("_s") == 0
    bad = (~blank) & (F.col("_v").isNull() | ~is_obj | is_falsy_json(p) | is_falsy_json(r))
    idv = F.try_variant_get("_v", "$.id", "variant")
    return d.select(
        *lines.columns,
        F.when(blank, "blank").when(bad, "bad").otherwise("valid").alias("status"),
        _py_str(p).alias("prompt"), _py_str(r).alias("response"),
        F.when(idv.isNotNull() & (F.schema_of_variant(idv) != "VOID"), _py_str(idv)).alias("id_value"),
        idv.isNotNull().alias("has_id"))


def sft_scan_quality(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """A10: one row of line counts; blank lines are not counted as bad."""
    s = sft_rows(lines, raw)
    return s.agg(F.count_if(F.col("status") == "blank").alias("blank_lines"),
                 F.count_if(F.col("status") == "bad").alias("bad_lines"),
                 F.count_if(F.col("status") == "valid").alias("valid_samples"))


def observed_samples(lines: DataFrame, raw: str = "raw") -> tuple[DataFrame, Observation]:
    """S6/A10 in one pass: the valid rows of :func:`sft_rows`, and an
    observation with ``blank_lines``, ``bad_lines`` and ``valid_samples``, which
    the first job that scans these rows fills."""
    seen = Observation()
    count = lambda status, name: F.count_if(F.col("status") == status).alias(name)
    rows = sft_rows(lines, raw).observe(seen, count("blank", "blank_lines"), count("bad", "bad_lines"), count("valid", "valid_samples"))
    return rows.where(F.col("status") == "valid"), seen


def raw_text(spark: SparkSession, paths, on_missing: str = "skip") -> DataFrame:
    """The text of files as pieces ``(file, line, text)`` whose
    concatenation in line order is the file, read as Python reads text: any
    line ending becomes ``"\\n"``, undecodable bytes go.

    The last line only ends with a line break if the file does: the lines'
    bytes and breaks add up to the file's size, or to one more."""
    lines = read_lines(spark, paths, on_missing, line_sep="\n")
    if not lines.columns or lines.isEmpty():
        return spark.createDataFrame([], "file string, line long, text string")
    sizes = (spark.read.format("binaryFile").load(_existing(paths, on_missing, spark))
             .select(F.col("_metadata.file_path").alias("file"), F.col("length")))
    held = lines.groupBy("file").agg(F.max("line_no").alias("_last"), F.sum(F.octet_length("raw") + 1).alias("_bytes"))
    open_end = held.join(sizes, "file").select("file", "_last", (F.col("_bytes") > F.col("length")).alias("_open"))
    body = F.regexp_replace(F.regexp_replace(drop_undecodable("raw"), r"\r\z", ""), r"\r", "\n")
    last = (F.col("line_no") == F.col("_last")) & F.col("_open")
    # a carriage return at an open end is a line break of its own
    end = F.when(last, F.when(F.col("raw").endswith("\r"), F.lit("\n")).otherwise(F.lit(""))).otherwise(F.lit("\n"))
    return lines.join(open_end, "file").select("file", F.col("line_no").alias("line"), F.concat(body, end).alias("text"))


def generation_samples(lines: DataFrame, raw: str = "raw", max_samples: int | None = None) -> DataFrame:
    """Valid samples with ``id`` = the ``id`` key, else the line number;
    ``max_samples`` keeps the first N valid lines (None = all)."""
    s = sft_rows(lines, raw).where(F.col("status") == "valid")
    # ``ex.get('id', line_no)``: a present key wins even when it is null
    ident = F.when(F.col("has_id"), F.col("id_value")).otherwise(F.col("line_no").cast("string"))
    s = s.select("line_no", ident.alias("id"), "prompt", F.col("response").alias("reference"))
    if max_samples is not None:
        s = s.orderBy("line_no").limit(int(max_samples))
    return s


# --- format dispatch, source fallback, log columns -----------------------------
def read_texts(spark: SparkSession, paths, on_missing: str = "skip") -> DataFrame:
    """Documents ``(file, line_no, text)`` from a mix of files: JSONL for a
    ``.jsonl`` suffix or ``wiki`` in the name (coercing scan), blank-line
    blocks otherwise."""
    keep = _existing(paths, on_missing, spark)
    name = [p.rsplit("/", 1)[-1] for p in keep]
    js = [p for p, n in zip(keep, name) if n.endswith(".jsonl") or "wiki" in n]
    tx = [p for p in keep if p not in js]
    out = spark.createDataFrame([], "file string, line_no long, text string")
    if js:
        out = out.unionByName(parse_jsonl_text(read_lines(spark, js, errors="ignore"), "coerce").select("file", "line_no", "text"))
    if tx:
        b = read_blocks(spark, tx)
        out = out.unionByName(b.select("file", F.col("block_index").alias("line_no"), F.col("block_text").alias("text")))
    return out


def resolve_group_files(files: DataFrame, group: str = "group", file: str = "file", kind: str = "kind",
                        exists: str = "exists", priority=("holdout", "train")) -> DataFrame:
    """Per group, the existing files of the best available kind (holdout
    first, then the training files as ``train_fallback``); a group with none
    gets one row with ``source = 'missing'``."""
    rank = F.array_position(F.array(*[F.lit(k) for k in priority]), F.col(kind))
    f = files.where(F.col(exists) & (rank > 0)).withColumn("_p", rank)
    best = f.groupBy(group).agg(F.min("_p").alias("_p"))
    chosen = f.join(best, [group, "_p"]).select(
        group, file, F.when(F.col("_p") == 1, F.lit(priority[0])).otherwise(F.lit(f"{priority[1]}_fallback"))
        .alias("source"))
    groups = files.select(group).distinct()
    missing = groups.join(best, group, "left_anti").select(group, F.lit(None).cast("string").alias(file),
                                                           F.lit("missing").alias("source"))
    return chosen.unionByName(missing)


# The names a run log may use for its columns, by preference.
LOG_COLUMNS = {
    "step": ["optimizer_step", "global_step", "step"],
    "train_loss": ["train_loss", "loss"],
    "eval_loss": ["eval_loss", "validation_loss", "val_loss"],
}


def log_column(log: DataFrame, role: str, path: str = "") -> str:
    """The column of ``log`` that plays ``role``, by the preferred names."""
    known = [name for name in LOG_COLUMNS[role] if name in set(log.columns)]
    if not known:
        raise ValueError(f"run log {path or '(frame)'} has no {role} column; its columns are {log.columns}")
    return known[0]


def read_log_csv(spark: SparkSession, path: str, on_missing: str = "error") -> DataFrame:
    """S12 + P6: a training-log CSV with its step / train / eval columns
    resolved by candidate names and coerced to numbers."""
    from textmill.operators.runlog import coerce_numeric

    if on_missing == "error":
        _existing([path], "error", spark)
    df = spark.read.option("header", True).csv(path)
    return df.select(*[coerce_numeric(log_column(df, role, path)).alias(role) for role in LOG_COLUMNS])
