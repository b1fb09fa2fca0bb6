"""End-to-end jobs over files, composed from the operators: what a user of
the reference runs as whole scripts (tokenizer corpus, holdout split, packed
dataset, tokenizer evaluation, supervised batches, summary evaluation, log
points), as Spark jobs over JSONL / text / CSV files.  All files of a job are
one scan, told apart by their path.

Corpus groups are ``{label: [paths]}``; file order inside a group is the
order given (the file's position becomes its sort key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import tokens as TK
from textmill.operators import budget as B
from textmill.operators import mixing as MX
from textmill.operators import packing as PK
from textmill.operators import quality as QU
from textmill.operators import runlog as RL
from textmill.operators import sft as SF
from textmill.operators.ordering import BK, dense_index, id_bucket, range_buckets
from textmill.session import checkpoint_dir, scratch_path
from textmill.sinks import writers as W
from textmill.sinks.verbatim import write_verbatim
from textmill.sources import jsonl as J


LINE_BITS = 40  # doc_id = file index * 2^40 + line number: exact, no hashing


def _listed(spark: SparkSession, groups: dict) -> DataFrame:
    """``(label, position, number, path)`` of the groups' existing files, a
    table as small as the call's lists; ``path`` as scans report it."""
    rows = []
    for label, paths in groups.items():
        for pos, path in enumerate(paths):
            for uri in J.file_uris(spark, path):
                rows.append((label, pos, len(rows), uri))
    return spark.createDataFrame(rows, "label string, position int, number long, path string")


def _in_groups(scan: DataFrame, listed: DataFrame, line: str) -> DataFrame:
    """A scan of all groups' files with ``group``, ``file`` (``<position>:<path>``,
    so the given order is the sort order), ``line`` and the unique ``doc_id``."""
    d = scan.join(F.broadcast(listed), F.col("file") == F.col("path"))
    return d.select(F.col("label").alias("group"), F.concat(F.lpad(F.col("position").cast("string"), 6, "0"), F.lit(":"), F.col("file")).alias("file"),
                    F.col(line).alias("line"), (F.col("number") * F.lit(1 << LINE_BITS) + F.col(line)).alias("doc_id"),
                    *[c for c in scan.columns if c not in ("file", line)])


def _docs(spark: SparkSession, groups: dict, mode: str) -> DataFrame:
    """``(group, file, line, doc_id, text)`` of every group's JSONL files, from
    one scan of all of them.  ``mode`` coerce also takes text files, as blocks
    between blank lines, told apart by name."""
    paths = [p for ps in groups.values() for p in ps]
    d = J.read_texts(spark, paths) if mode == "coerce" else J.parse_jsonl_text(J.read_lines(spark, paths), mode)
    return _in_groups(d.select("file", "line_no", "text"), _listed(spark, groups), "line_no")


def tokenizer_corpus(spark: SparkSession, groups: dict, budgets: dict, out_dir: str, code: dict | None = None) -> DataFrame:
    """K1 + W1 + W2 + A1: the tokenizer training text -- each group's documents
    (coercing scan) up to its byte budget, groups in the given order, every
    document followed by a blank line.  The groups of ``code`` are raw text,
    copied file by file with a blank line behind each and cut at the last
    character that fits.  Returns docs/bytes per group (no docs for ``code``)."""
    out_dir = out_dir.rstrip("/")
    docs = _docs(spark, groups, "coerce")
    kept = B.byte_budget_prefix(docs, budgets, keys=["doc_id"])
    usage = B.budget_usage(kept)
    texts = kept.join(docs.select("doc_id", "text"), "doc_id").checkpoint(eager=True)
    for label in groups:  # one ordered folder per group of the call
        W.write_corpus(texts.where(F.col("group") == label), f"{out_dir}/{label}", [label])
    if not code:
        return usage
    pieces = J.raw_text(spark, [p for ps in code.values() for p in ps])
    pieces = _in_groups(pieces.select("file", "line", "text"), _listed(spark, code), "line")
    written = B.byte_budget_truncate(pieces, budgets).checkpoint(eager=True)
    ends = written.groupBy("group", "file").agg(F.max("line").alias("line"), F.lit(True).alias("_last"))
    sep = F.when(F.col("_last") & F.col("file_done"), F.lit("\n\n")).otherwise(F.lit(""))
    written = written.join(ends, ["group", "file", "line"], "left").withColumn("written", F.concat("kept_text", sep)).checkpoint(eager=True)
    for label in code:
        write_verbatim(written.where(F.col("group") == label), f"{out_dir}/{label}", ["file", "line"], "written")
    sizes = written.groupBy("group").agg(F.lit(None).cast("long").alias("consumed_docs"), F.sum(F.octet_length("written")).cast("long").alias("consumed_bytes"))
    return usage.unionByName(sizes)


def sft_dataset(spark: SparkSession, paths, out_dir: str, max_length: int, batch_size: int, tokenizer: TK.Tokenizer | None = None) -> DataFrame:
    """prompt/response files to padded batches.

    One pass scans, counts and encodes; a missing file and files without a
    valid sample are errors, the latter with nothing written.  Batches are in
    file and line order.  Writes ``batches`` as Parquet and the counts as JSON,
    and returns the counts."""
    tok = tokenizer or TK.get_tokenizer("byte")
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows, seen = J.observed_samples(J.read_lines(spark, paths, on_missing="error"))
    rows = _in_groups(rows.select("file", "line_no", "prompt", "response"), _listed(spark, {"sft": paths}), "line_no")
    examples = SF.encode_pairs(rows, max_length, encode=tok.encode, eos_id=tok.eos_id)
    staged = scratch_path(spark, "sft")
    examples.select("file", "line", "doc_id", "input_ids", "labels").write.parquet(staged)
    counts = seen.get
    if not counts["valid_samples"]:
        raise ValueError(f"no valid samples in {', '.join(paths)}: {counts['bad_lines']} bad lines, {counts['blank_lines']} blank")
    examples = spark.read.parquet(staged)
    # doc_id grows along file and line; the ids are numbered alone and the payload joined to them
    keys = SF.batch_numbers(examples.select("doc_id"), batch_size, ["doc_id"], id_bucket("doc_id"))
    pad_id = SF.resolve_pad_id(tok.pad_id, tok.eos_id)
    batches = SF.pad(examples.join(keys, "doc_id"), pad_id)
    batches.repartitionByRange("batch_id").sortWithinPartitions("sample_idx").write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batches")
    row = spark.createDataFrame([(counts["valid_samples"], counts["bad_lines"], counts["blank_lines"])],
                                "valid_samples long, bad_lines long, blank_lines long")
    W.write_json_row(row, f"{out_dir.rstrip('/')}/counts")
    return row


def log_points(spark: SparkSession, csv_path: str, out_dir: str, train_window: int = 200, eval_window: int = 3) -> DataFrame:
    """A training log's points.  Writes ``points`` (the rows
    as they come, CSV with a byte-order mark) and ``curves``: per series
    ``train`` and ``eval`` the rows that have a step and a value, by step, with
    the rolling mean.  Returns the curves."""
    log = J.read_log_csv(spark, csv_path)
    out_dir = out_dir.rstrip("/")
    W.write_points_csv(log.withColumn("_row", F.monotonically_increasing_id()).orderBy("_row").drop("_row"), f"{out_dir}/points", bom=True)
    curves = None
    for series, value, window in (("train", "train_loss", train_window), ("eval", "eval_loss", eval_window)):
        # equal steps keep their order in the file
        d = log.select("step", F.col(value).alias("value"), F.monotonically_increasing_id().alias("row")).where("step is not null and value is not null")
        d = dense_index(range_buckets(d, ["step", "row"]), [], ["step", "row"], BK, out="idx").drop(BK)
        d = RL.rolling_mean(d, "idx", "value", window).select(F.lit(series).alias("series"), "idx", "step", "value", "smooth")
        curves = d if curves is None else curves.unionByName(d)
    curves.repartitionByRange("series", "idx").sortWithinPartitions("series", "idx").write.mode("overwrite").parquet(f"{out_dir}/curves")
    return spark.read.parquet(f"{out_dir}/curves")


def packed_dataset(spark: SparkSession, main: dict, repeat: dict, capped: dict, out_dir: str,
                   tokenizer: TK.Tokenizer | None = None, block_size: int = PK.BLOCK_SIZE,
                   eval_blocks: int = PK.EVAL_BLOCKS, blocks_per_file: int = PK.BLOCKS_PER_FILE) -> DataFrame:
    """The strict-scan corpora mixed 6:3:1 then 7:3,
    encoded, packed into blocks and written as ``split/shard`` Parquet; the
    metadata row is written as JSON and returned.  Each argument is a
    one-entry ``{label: [paths]}``."""
    tok = tokenizer or TK.get_tokenizer("byte")
    (ml, mp), (rl, rp), (cl, cp) = (next(iter(x.items())) for x in (main, repeat, capped))
    docs = _docs(spark, {ml: mp, rl: rp, cl: cp}, "strict")
    if tok.count is None:  # ids are made once; their number and the blocks come from the same column
        docs = docs.withColumn("ids", tok.encode("text")).drop("text")
    docs = docs.checkpoint(eager=True)
    keys = docs.select("doc_id", "group", "file", "line")
    mix = MX.ratio_mix(*(keys.where(F.col("group") == g) for g in (ml, rl, cl)),
                       labels=(ml, rl, cl), key="doc_id")
    count, payload, ids = (F.size("ids"), "ids", F.col("ids")) if tok.count is None else (tok.count("text"), "text", tok.encode)
    # a narrow table of counts, so that a document emitted many times is not counted for each emission
    counted = mix.join(docs.select("doc_id", count.alias("_n")), "doc_id")
    offsets = PK.token_offsets(counted, count=F.col("_n"))
    blocks = PK.pack_blocks(offsets, ids, block_size, eval_blocks, blocks_per_file, texts=docs.select("doc_id", payload))
    W.write_blocks(blocks, f"{out_dir.rstrip('/')}/blocks", blocks_per_file)
    meta = PK.pack_metadata(offsets, block_size, eval_blocks, blocks_per_file, roles=(ml, rl, cl))
    W.write_json_row(meta, f"{out_dir.rstrip('/')}/metadata")
    return meta


def evaluation_files(spark: SparkSession, holdout: dict, training: dict) -> tuple[dict, dict]:
    """Per group of either argument the existing files of ``holdout``, else
    those of ``training``; and the group's source, ``holdout``,
    ``train_fallback`` or ``missing``."""
    labels = list(dict.fromkeys([*holdout, *training]))
    rows = [(g, p, kind, bool(J.file_uris(spark, p))) for kind, files in (("holdout", holdout), ("train", training)) for g in labels for p in files.get(g, [])]
    rows += [(g, None, None, False) for g in labels]
    found = J.resolve_group_files(spark.createDataFrame(rows, "group string, file string, kind string, exists boolean")).collect()
    files, source = {g: [] for g in labels}, {}
    given = {g: [*holdout.get(g, []), *training.get(g, [])] for g in labels}
    for r in sorted(found, key=lambda r: (labels.index(r.group), given[r.group].index(r.file) if r.file else 0)):
        source[r.group] = r.source
        files[r.group] += [r.file] if r.file else []
    return files, source


def tokenizer_report(spark: SparkSession, groups: dict, out_path: str, tokenizer: TK.Tokenizer | None = None,
                     first_docs: int | None = None, training: dict | None = None) -> DataFrame:
    """Per-group tokenizer statistics with top tokens
    and round-trip failure examples, written as JSON lines and returned.  All
    documents count; ``first_docs`` keeps the first so many of each group.
    With ``training`` a group without an existing file is evaluated on its
    training files instead, which the column ``source`` says.  Documents are
    encoded once."""
    tok = tokenizer or TK.get_tokenizer("byte")
    checkpoint_dir(spark)
    source = None
    if training is not None:
        groups, source = evaluation_files(spark, groups, training)
    docs = _docs(spark, groups, "coerce")
    most = None if first_docs is None else first_docs - 1
    docs = dense_index(docs, ["group"], ["file", "line"], F.struct("file", id_bucket("line")), out="doc_idx", max_index=most)
    if first_docs is not None:
        docs = docs.where(F.col("doc_idx") < first_docs)
    enc = QU.encode_docs(docs, encode=tok.encode, decode=tok.decode).checkpoint(eager=True)
    vocab = QU.vocab_frame(spark, tok.vocab_rows())
    report = W.tokenizer_report(QU.tokenizer_quality(enc, tok.vocab_size, unk_id=tok.unk_id),
                                QU.top_tokens(enc, vocab, doc_rank="doc_idx"), QU.roundtrip_failures(enc))
    if source is not None:
        named = spark.createDataFrame(list(source.items()), "group string, source string")
        report = F.broadcast(named).join(report, "group", "left")
    report.write.mode("overwrite").json(out_path)
    return report


def _file_size(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getFileStatus(p).getLen()) if fs.exists(p) else 0


def holdout_split(spark: SparkSession, sources: dict, budgets: dict, code_path: str | None, code_budget: int,
                  out_dir: str, n_text: int = 5000, n_code: int = 5000, seed: int = 42) -> DataFrame:
    """Replay what the tokenizer corpus consumed, then
    sample held-out documents per source (and code blocks) from the unused
    suffix.  ``sources``: ``{group: [path, ...]}`` in consumption order.
    Writes the sampled raw lines / blocks and a manifest; returns the
    manifest rows ``(group, file, consumed_docs, consumed_bytes,
    eligible_unused, sampled)``."""
    from textmill.operators import holdout as HO

    lines = J.read_lines(spark, [p for ps in sources.values() for p in ps], errors="ignore")
    rows = J.jsonl_with_lineage(lines).select("file", "line_number", "raw_line", "text")
    rows = _in_groups(rows, _listed(spark, sources), "line_number").drop("doc_id")
    usage = B.budget_replay(rows, budgets)
    sample, stats = HO.holdout_text(rows, usage, n_text, seed=seed, per_source_hash=True)
    W.write_holdout_lines(sample.withColumnRenamed("line", "line_number"),
                          f"{out_dir.rstrip('/')}/text", "line_number", "raw_line")
    manifest = (usage.join(stats, ["group", "file"], "left").fillna(0, ["eligible_unused_docs", "sampled_docs"])
                .select("group", "file", "consumed_docs", "consumed_bytes",
                        F.col("eligible_unused_docs").alias("eligible_unused"), F.col("sampled_docs").alias("sampled")))
    if code_path:
        size = _file_size(spark, code_path)
        consumed = min(size + B.SEP_BYTES, int(code_budget))
        blocks = J.read_blocks(spark, [code_path])
        code = HO.holdout_code(blocks, consumed, n_code, seed=seed)
        W.write_holdout_blocks(code, f"{out_dir.rstrip('/')}/code")
        crow = code.agg(F.count(F.lit(1)).alias("sampled"), F.max("eligible").alias("eligible_unused")).select(
            F.lit("code").alias("group"), F.lit(code_path).alias("file"), F.lit(None).cast("long").alias("consumed_docs"),
            F.lit(consumed).cast("long").alias("consumed_bytes"),
            F.coalesce("eligible_unused", F.lit(0)).cast("long").alias("eligible_unused"),
            F.col("sampled").cast("long").alias("sampled"))
        manifest = manifest.unionByName(crow)
    manifest.coalesce(1).write.mode("overwrite").json(f"{out_dir.rstrip('/')}/manifest")
    return manifest


def summary_eval(spark: SparkSession, test_jsonl: str, predictions: DataFrame, out_dir: str,
                 mode: str = "char") -> DataFrame:
    """Test samples (``id`` or line number) joined to a
    predictions table ``(id, prediction)``; per-sample ROUGE written as
    predictions JSONL; returns the macro averages (zeros when empty)."""
    from textmill.operators import rouge as RG

    samples = J.generation_samples(J.read_lines(spark, [test_jsonl], on_missing="error"))
    pairs = samples.select("id", "reference").join(predictions.select(F.col("id").cast("string"), "prediction"), "id")
    scored = RG.compute_rouge(pairs, mode).join(pairs, "id")
    W.write_predictions(scored, f"{out_dir.rstrip('/')}/predictions")
    return RG.average_metrics(scored)
