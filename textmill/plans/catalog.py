"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Queries read whole driver tables (or data Spark derives from them).  Column
names match the DuckDB oracles in :mod:`textmill.plans.oracle`.

Parameters.  The library defaults are the reference's values (block 4 096,
2 048 blocks per shard, 2 000 eval blocks, 10 000 documents per evaluated
group, 5 000 holdout samples, 4 096-token SFT examples, 64 000-id vocabulary).
A registered query uses a smaller value only where the reference's would leave
the feature idle at the test scales (a few thousand documents): 100 eval
blocks and 128 blocks per shard so that both splits and several shards
exist; 10 holdout samples per source and 50 code blocks so that sampling
actually selects; 100 documents for the first-n query so that the cap binds
(the tokenizer evaluation keeps 10 000); 1 024-token SFT examples so that
response and prompt truncation both occur; 256 merges for BPE.  None of them
limits the data a query reads: every query runs over whole tables and texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import tokens as TK
from textmill.operators import budget as B
from textmill.operators import bpe as BP
from textmill.operators import holdout as HO
from textmill.operators import mixing as MX
from textmill.operators import ordering as OR
from textmill.operators import packing as PK
from textmill.operators import quality as QU
from textmill.operators import rouge as RG
from textmill.operators import runlog as RL
from textmill.operators import sft as SF
from textmill.plans.fixtures import RETENTION_EDGE_NAMES, SFT_EDGE_LINES, TEXT_EDGE_LINES
from textmill.session import scratch_path
from textmill.sinks import verbatim as VB
from textmill.sinks import writers as WR
from textmill.sources import jsonl as J
from textmill.sources.tables import conversation_pairs, corpus_docs, table, training_log
from textmill.streaming import logs as STR

# Fixed parameters of the registered queries (chosen for the test scales).
BUDGET_FRACTION = 0.6          # text budget: share of each group's bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("corpus_composition")
def q_corpus_composition(spark, sf):
    return B.corpus_composition(corpus_docs(spark, sf))


@register("byte_budget_prefix")
def q_byte_budget_prefix(spark, sf):
    docs = corpus_docs(spark, sf)
    budgets = B.group_fraction_budgets(docs, BUDGET_FRACTION)
    kept = B.byte_budget_prefix(docs, budgets, keys=["doc_id"])
    return kept.select("group", "file", "doc_id", "block_bytes", "cum_bytes")


@register("budget_usage")
def q_budget_usage(spark, sf):
    docs = corpus_docs(spark, sf)
    budgets = B.group_fraction_budgets(docs, BUDGET_FRACTION)
    return B.budget_usage(B.byte_budget_prefix(docs, budgets, keys=["doc_id"]))


# --- mixing and packing ------------------------------------------------------

PACK_BLOCK, PACK_EVAL, PACK_SHARD = 4096, 100, 128
RESUME_STEP = 3


def mix_inputs(spark, sf):
    """Repeated = de, capped = es, main = every other language (files
    ``lang/source``).  Narrow rows: the key, file, line and the byte count taken
    at the scan."""
    d = (corpus_docs(spark, sf).withColumn("file", F.concat_ws("/", "group", "file"))
         .withColumn("n_bytes", F.octet_length("text")).drop("text"))
    main = d.where(~F.coalesce(F.col("group").isin("de", "es"), F.lit(False)))
    rep = d.where(F.col("group") == "de")
    cap = d.where(F.col("group") == "es")
    return main, rep, cap


def mix_keys(spark, sf):
    return MX.ratio_mix(*mix_inputs(spark, sf), key="doc_id", keep=["n_bytes"])


def doc_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def packed(spark, sf):
    offs = PK.token_offsets(mix_keys(spark, sf), count=F.col("n_bytes"))
    return PK.pack_blocks(offs, TK.byte_encode, PACK_BLOCK, PACK_EVAL, PACK_SHARD, texts=doc_texts(spark, sf))


@register("round_robin")
def q_round_robin(spark, sf):
    d = MX.round_robin(corpus_docs(spark, sf).drop("text"))
    return d.select("group", "doc_id", "in_file", "rr_pos")


@register("ratio_mix")
def q_ratio_mix(spark, sf):
    return mix_keys(spark, sf).select("mix_pos", "role", "doc_id", "src_idx")


@register("token_offsets")
def q_token_offsets(spark, sf):
    return PK.token_offsets(mix_keys(spark, sf), count=F.col("n_bytes")).select("mix_pos", "n_tokens", "tok_start")


@register("pack_blocks")
def q_pack_blocks(spark, sf):
    b = packed(spark, sf)
    return b.select("block_idx", "split", "shard", "local_idx",
                    F.size("input_ids").alias("n_ids"), TK.ids_md5("input_ids").alias("ids_md5"))


@register("pack_metadata")
def q_pack_metadata(spark, sf):
    offs = PK.token_offsets(mix_keys(spark, sf), count=F.col("n_bytes"))
    return PK.pack_metadata(offs, PACK_BLOCK, PACK_EVAL, PACK_SHARD)


@register("block_lookup")
def q_block_lookup(spark, sf):
    b = packed(spark, sf).select("block_idx", "split", "shard").checkpoint(eager=True)
    shards = PK.shard_index(b).select("shard", "n_blocks")
    idx = b.where(F.col("split") == "train").select((F.col("block_idx") - PACK_EVAL).alias("train_idx"))
    return PK.block_lookup(idx, shards)


@register("resume_skip")
def q_resume_skip(spark, sf):
    b = packed(spark, sf).select("block_idx", "split")
    return PK.resume_skip(b, RESUME_STEP, 8, PACK_EVAL).select("block_idx", "train_idx")


@register("packed_validate")
def q_packed_validate(spark, sf):
    """Every 50th block has lost its end: validation lists exactly those."""
    cut = F.when(F.col("block_idx") % 50 == 0, F.slice("input_ids", 1, 100)).otherwise(F.col("input_ids"))
    return PK.validate_blocks(packed(spark, sf).withColumn("input_ids", cut), PACK_BLOCK)


# --- scans over JSON lines derived from the tables ----------------------------

def json_escape(c):
    """JSON string body of a text: escapes backslash, quote, CR, LF and tab."""
    e = F.col(c) if isinstance(c, str) else c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def _edge_lines(spark, lines, file):
    rows = [(file, i + 1, s) for i, s in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, line_no long, raw string")


def doc_jsonl_lines(spark, sf):
    """Four lines per document (object, numeric text, truncated object, blank)
    in file ``source``, line ``4 * doc_id + k``, plus the fixed edge lines."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text", "n_chars")
    esc = json_escape("text")
    variants = F.array(
        F.concat(F.lit('{"text": "'), esc, F.lit('", "doc_id": '), F.col("doc_id").cast("string"), F.lit("}")),
        F.concat(F.lit('{"text": '), F.col("n_chars").cast("string"), F.lit("}")),
        F.concat(F.lit('{"text": "'), esc),
        F.lit(""))
    lines = d.select(F.col("source").alias("file"), "doc_id", F.posexplode(variants).alias("k", "raw"))
    lines = lines.select("file", (F.col("doc_id") * 4 + F.col("k") + 1).alias("line_no"), "raw")
    return lines.unionByName(_edge_lines(spark, TEXT_EDGE_LINES, "inline"))


def sft_jsonl_lines(spark, sf):
    """Five lines per conversation pair (valid, empty response, falsy prompt,
    valid with id, blank) at line ``8 * pair_id + k``, plus edge lines."""
    p = conversation_pairs(spark, sf)
    pe, re_ = json_escape("prompt"), json_escape("response")
    idl = F.concat(F.lit('"c'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('"'))
    variants = F.array(
        F.concat(F.lit('{"prompt": "'), pe, F.lit('", "response": "'), re_, F.lit('"}')),
        F.concat(F.lit('{"prompt": "'), pe, F.lit('", "response": ""}')),
        F.concat(F.lit('{"id": '), idl, F.lit(', "prompt": 0, "response": "'), re_, F.lit('"}')),
        F.concat(F.lit('{"id": '), idl, F.lit(', "prompt": "'), pe, F.lit('", "response": "'), re_, F.lit('"}')),
        F.lit(""))
    lines = p.select(F.lit("sft").alias("file"), "pair_id", F.posexplode(variants).alias("k", "raw"))
    lines = lines.select("file", (F.col("pair_id") * 8 + F.col("k") + 1).alias("line_no"), "raw")
    return lines.unionByName(_edge_lines(spark, SFT_EDGE_LINES, "sft_inline"))


@register("jsonl_scan_strict")
def q_jsonl_scan_strict(spark, sf):
    return J.parse_jsonl_text(doc_jsonl_lines(spark, sf), "strict").select("file", "line_no", "text")


@register("jsonl_scan_coerce")
def q_jsonl_scan_coerce(spark, sf):
    return J.parse_jsonl_text(doc_jsonl_lines(spark, sf), "coerce").select("file", "line_no", "text")


@register("jsonl_scan_lineage")
def q_jsonl_scan_lineage(spark, sf):
    d = J.jsonl_with_lineage(doc_jsonl_lines(spark, sf))
    return d.select("file", "line_number", F.md5("raw_line").alias("raw_md5"), "text", "train_block_bytes")


@register("block_scan")
def q_block_scan(spark, sf):
    """Lines of a document as blocks: blank lines between them, with either line ending."""
    gap = F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n")).otherwise(F.lit("\r\n\r\n"))
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), gap).alias("text"))
    b = J.blocks_from_text(d, "text", "\n\n", keys=["doc_id"])
    return b.select("doc_id", "block_index", F.md5("block_text").alias("block_md5"), "block_bytes")


@register("strip_nonempty")
def q_strip_nonempty(spark, sf):
    lines = doc_jsonl_lines(spark, sf)
    s = lines.withColumn("stripped", J.strip_u("raw")).where(F.length("stripped") > 0)
    return s.select("file", "line_no", F.char_length("stripped").alias("n_chars"))


@register("sft_scan_quality")
def q_sft_scan_quality(spark, sf):
    return J.sft_scan_quality(sft_jsonl_lines(spark, sf))


@register("generation_samples")
def q_generation_samples(spark, sf):
    return J.generation_samples(sft_jsonl_lines(spark, sf))


# --- supervised examples -------------------------------------------------------

SFT_MAX_LEN, SFT_MAX_NEW, SFT_BATCH, PROMPT_ROOM = 1024, 128, 8, 64
RUN_EPOCHS, RUN_MAX_STEPS = 3, 100


def sft_examples(spark, sf):
    return SF.encode_pairs(conversation_pairs(spark, sf), SFT_MAX_LEN)


@register("sft_encode")
def q_sft_encode(spark, sf):
    e = sft_examples(spark, sf)
    return e.select("pair_id", F.size("input_ids").alias("n_input"), "n_prompt",
                    TK.ids_md5("input_ids").alias("input_md5"), TK.ids_md5("labels").alias("labels_md5"))


@register("truncate_prompt")
def q_truncate_prompt(spark, sf):
    p = conversation_pairs(spark, sf).withColumn("ids", SF.truncate_keep_suffix(TK.byte_encode("prompt"),
                                                                                 F.lit(PROMPT_ROOM)))
    return p.select("pair_id", F.size("ids").alias("n_ids"), TK.ids_md5("ids").alias("ids_md5"))


@register("generation_prompts")
def q_generation_prompts(spark, sf):
    p = conversation_pairs(spark, sf).withColumn(
        "ids", SF.generation_prompt(TK.byte_encode("prompt"), SFT_MAX_LEN, SFT_MAX_NEW))
    return p.select("pair_id", F.size("ids").alias("n_ids"), TK.ids_md5("ids").alias("ids_md5"))


@register("sft_valid_labels")
def q_sft_valid_labels(spark, sf):
    return SF.with_valid_labels(sft_examples(spark, sf)).select("pair_id", "n_supervised")


@register("pad_batches")
def q_pad_batches(spark, sf):
    p = conversation_pairs(spark, sf)
    n = SF.batch_numbers(OR.range_buckets(p.select("pair_id"), ["pair_id"]), SFT_BATCH, ["pair_id"], OR.BK)
    e = SF.encode_pairs(p, SFT_MAX_LEN).select("pair_id", "input_ids", "labels")
    b = SF.pad(e.join(n.select("pair_id", "batch_id"), "pair_id"))
    return b.select("pair_id", "batch_id", "padded_len", TK.ids_md5("input_ids").alias("input_md5"),
                    TK.ids_md5("labels").alias("labels_md5"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@register("run_plan")
def q_run_plan(spark, sf):
    n = conversation_pairs(spark, sf).agg(F.count(F.lit(1)).alias("n_samples"))
    upd, warm = SF.run_plan(F.col("n_samples"), RUN_EPOCHS)
    upd_min, _ = SF.run_plan(F.col("n_samples"), RUN_EPOCHS, max_steps=RUN_MAX_STEPS, cap_mode="min")
    upd_rep, warm_rep = SF.run_plan(F.col("n_samples"), RUN_EPOCHS, max_steps=RUN_MAX_STEPS, cap_mode="replace")
    return n.select("n_samples", upd.alias("total_updates"), warm.alias("warmup_steps"),
                    upd_min.alias("updates_capped_min"), upd_rep.alias("updates_capped_replace"),
                    warm_rep.alias("warmup_capped_replace"))


# --- ROUGE ---------------------------------------------------------------------


def prediction_pairs(spark, sf):
    """Predictions (user turns) joined to references (the next assistant
    turn) on their id."""
    p = conversation_pairs(spark, sf)
    return p.select(F.col("pair_id").alias("id"), F.col("prompt").alias("prediction"),
                    F.col("response").alias("reference"))


def _flat(c):
    return [F.col(f"{c}.{s}").alias(f"{c.replace('rouge', 'r').replace('rL', 'rl')}_{s}") for s in ("p", "r", "f1")]


@register("rouge_tokens")
def q_rouge_tokens(spark, sf):
    p = prediction_pairs(spark, sf)
    return p.select("id",
                    F.size(RG.rouge_tokens("prediction", "char")).alias("pred_chars"),
                    F.size(RG.rouge_tokens("reference", "char")).alias("ref_chars"),
                    F.size(RG.rouge_tokens("prediction", "whitespace")).alias("pred_words"),
                    F.size(RG.rouge_tokens("reference", "whitespace")).alias("ref_words"))


@register("ngram_counts")
def q_ngram_counts(spark, sf):
    c = RG.ngram_counts(prediction_pairs(spark, sf), (1, 2), "char").where("distinct > 0")
    return c.select("id", "n", F.col("distinct").alias("distinct_ngrams"), F.col("pred").alias("pred_total"),
                    F.col("ref").alias("ref_total"), "overlap")


@register("rouge_scores")
def q_rouge_scores(spark, sf):
    r = RG.rouge_n(prediction_pairs(spark, sf), (1, 2), "char")
    return r.select("id", *_flat("rouge1"), *_flat("rouge2"))


@register("rouge_l")
def q_rouge_l(spark, sf):
    r = RG.rouge_l(prediction_pairs(spark, sf), "char")
    return r.select("id", "lcs", *_flat("rougeL"))


@register("rouge_summary")
def q_rouge_summary(spark, sf):
    return RG.average_metrics(RG.compute_rouge(prediction_pairs(spark, sf), "char"))


@register("rouge_summary_n")
def q_rouge_summary_n(spark, sf):
    r = RG.rouge_n(prediction_pairs(spark, sf), (1, 2), "char")
    s = RG.average_metrics(r.withColumn("rouge", F.struct("rouge1", "rouge2", F.col("rouge1").alias("rougeL"))))
    return s.select("samples", *[c for c in s.columns if c.startswith("rouge1") or c.startswith("rouge2")])


@register("rouge_running_avg")
def q_rouge_running_avg(spark, sf):
    r = RG.rouge_n(prediction_pairs(spark, sf), (1,), "char")
    r = OR.range_buckets(r, ["id"])
    return RG.running_average(r, ["id"], OR.BK, F.col("rouge1.f1"), 10)


# --- run logs ------------------------------------------------------------------

KEEP_CHECKPOINTS = 3


def log_text_columns(log):
    """The log as CSV text: train loss blank on signups and ``nan`` on errors;
    eval loss only on purchases."""
    tl = (F.when(F.col("event_type") == "error", F.lit("nan"))
           .when(F.col("event_type") == "signup", F.lit(""))
           .otherwise(F.col("loss").cast("string")))
    el = F.when(F.col("event_type") == "purchase", F.col("loss").cast("string")).otherwise(F.lit(""))
    return log.select(F.col("global_step").cast("string").alias("step_txt"), tl.alias("train_txt"),
                      el.alias("eval_txt"))


def log_points(spark, sf):
    t = log_text_columns(training_log(spark, sf))
    return t.select(RL.coerce_numeric("step_txt").cast("long").alias("step"),
                    RL.coerce_numeric("train_txt").alias("train_loss"),
                    RL.coerce_numeric("eval_txt").alias("eval_loss"))


@register("eval_loss_ppl")
def q_eval_loss_ppl(spark, sf):
    log = training_log(spark, sf)
    b = log.select("user_id", F.when(F.col("valid"), F.col("loss")).otherwise(F.lit(float("nan"))).alias("loss"))
    return RL.eval_loss_ppl(b, ["user_id"])


@register("masked_nll")
def q_masked_nll(spark, sf):
    log = training_log(spark, sf)
    t = log.select(F.col("user_id").alias("seq"), F.col("global_step").alias("pos"),
                   F.when(F.col("valid"), F.lit(0)).otherwise(F.lit(-100)).alias("label"),
                   F.col("loss").alias("nll"))
    return RL.masked_nll(t)


@register("optimizer_steps")
def q_optimizer_steps(spark, sf):
    return RL.optimizer_steps_both(training_log(spark, sf)).select(
        "global_step", "update_base", "opt_step_base", "update_summary", "opt_step_summary")


@register("train_log_windows")
def q_train_log_windows(spark, sf):
    log = training_log(spark, sf).select("global_step", "loss", "valid").checkpoint(eager=True)  # both rules read the steps
    return RL.train_log_windows(log, "base").unionByName(RL.train_log_windows(log, "summary"))


@register("log_points")
def q_log_points(spark, sf):
    return log_points(spark, sf)


@register("loss_smoothing")
def q_loss_smoothing(spark, sf):
    pts = log_points(spark, sf).checkpoint(eager=True)  # both series read the points
    out = None
    for series, col, window in (("train", "train_loss", 200), ("eval", "eval_loss", 3)):
        s = pts.select("step", F.col(col).alias("loss")).where(F.col("loss").isNotNull())
        s = OR.dense_index(s, [], ["step"], OR.id_bucket("step", 50_000), out="idx")
        r = RL.rolling_mean(s, "idx", "loss", window).select(F.lit(series).alias("series"), "step", "smooth")
        out = r if out is None else out.unionByName(r)
    return out


@register("retention_list")
def q_retention_list(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("run"),
                                        F.concat(F.lit("step_"), F.col("p_partkey").cast("string")).alias("name"))
    edge = spark.createDataFrame([("inline", n) for n in RETENTION_EDGE_NAMES], "run string, name string")
    return RL.checkpoint_retention(p.unionByName(edge), KEEP_CHECKPOINTS).select("run", "name", "step")


# --- holdout splits --------------------------------------------------------------

HOLDOUT_TEXT_N, HOLDOUT_CODE_N, SAMPLE_N, FIRST_N = 10, 50, 100, 100
CODE_BUDGET_FRACTION = 0.5


def code_blocks(spark, sf):
    """The code file stand-in: every document's text in ``doc_id`` order with
    ``\\n`` as the block separator; ``block_index`` counts empty blocks too."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    d = d.withColumn("n_pieces", F.size(F.split("text", "\n", -1)).cast("long"))
    d = OR.running_total(d, [], ["doc_id"], "n_pieces", OR.id_bucket("doc_id"), out="piece_start", exclusive=True)
    b = J.blocks_from_text(d, "text", "\n", keys=["doc_id", "piece_start"])
    return b.select((F.col("piece_start") + F.col("block_index")).alias("block_index"), "block_text", "block_bytes")


def code_source_bytes(spark, sf) -> int:
    """Bytes of the code file: texts plus one ``\\n`` between documents."""
    r = table(spark, sf, "documents").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int((r["b"] or 0) + max(0, (r["n"] or 0) - 1))


def replay_usage(spark, sf):
    docs = corpus_docs(spark, sf)
    return docs, B.budget_replay(docs, B.group_fraction_budgets(docs, BUDGET_FRACTION))


@register("budget_replay")
def q_budget_replay(spark, sf):
    return replay_usage(spark, sf)[1]


@register("code_budget")
def q_code_budget(spark, sf):
    d = table(spark, sf, "documents")
    src = d.agg((F.sum(F.octet_length("text")) + F.greatest(F.count(F.lit(1)) - 1, F.lit(0)))
                .cast("long").alias("source_bytes"))
    budget = F.floor(F.col("source_bytes") * CODE_BUDGET_FRACTION).cast("long")
    consumed, full = B.code_budget(F.col("source_bytes"), budget)
    return src.select("source_bytes", consumed.alias("consumed_bytes"), full.alias("fully_consumed"))


@register("holdout_text")
def q_holdout_text(spark, sf):
    docs, usage = replay_usage(spark, sf)
    sample, _ = HO.holdout_text(docs, usage, HOLDOUT_TEXT_N)
    return sample.select("group", "file", "doc_id", "eligible")


@register("holdout_code")
def q_holdout_code(spark, sf):
    size = code_source_bytes(spark, sf)
    consumed = min(size + 2, int(size * CODE_BUDGET_FRACTION))
    s = HO.holdout_code(code_blocks(spark, sf), consumed, HOLDOUT_CODE_N)
    return s.select("block_index", F.md5("block_text").alias("block_md5"), "eligible")


@register("split_manifest")
def q_split_manifest(spark, sf):
    docs, usage = replay_usage(spark, sf)
    _, stats = HO.holdout_text(docs, usage, HOLDOUT_TEXT_N)
    m = usage.join(stats, ["group", "file"], "left").fillna(0, ["eligible_unused_docs", "sampled_docs"])
    return m.select("group", "file", "consumed_docs", "consumed_bytes", "eligible_unused_docs", "sampled_docs")


@register("seeded_sample")
def q_seeded_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return HO.seeded_sample(d, "doc_id", SAMPLE_N).select("doc_id", "eligible")


@register("seeded_shuffle")
def q_seeded_shuffle(spark, sf):
    p = conversation_pairs(spark, sf).select("pair_id")
    out = None
    for epoch in (0, 1):
        s = HO.seeded_shuffle(p, "pair_id", HO.SEED, epoch).select(F.lit(epoch).alias("epoch"), "pair_id", "shuffle_pos")
        out = s if out is None else out.unionByName(s)
    return out


@register("first_n_per_group")
def q_first_n_per_group(spark, sf):
    d = corpus_docs(spark, sf)
    r = OR.dense_index(d, ["group"], ["file", "line"], F.struct("file", OR.id_bucket("line")), out="idx",
                       max_index=FIRST_N - 1)
    return r.where(F.col("idx") < FIRST_N).select("group", "doc_id", "idx")


@register("ordered_union")
def q_ordered_union(spark, sf):
    d = corpus_docs(spark, sf)
    r = OR.dense_index(d, ["group"], ["file", "line"], F.struct("file", OR.id_bucket("line")), out="pos")
    return r.select("group", "doc_id", "pos")


@register("byte_budget_truncate")
def q_byte_budget_truncate(spark, sf):
    d = corpus_docs(spark, sf).withColumn("text", F.concat("text", F.lit("\n")))
    budgets = B.group_fraction_budgets(d, CODE_BUDGET_FRACTION)
    w = B.byte_budget_truncate(d, budgets)
    return w.select("group", "file", "doc_id", "start", "kept_bytes", F.md5("kept_text").alias("kept_md5"))


# --- tokenizer evaluation ---------------------------------------------------------

BYTE_VOCAB_SIZE = TK.N_SPECIAL + 256


def eval_docs(spark, sf):
    """Every document with its position in file order."""
    return OR.dense_index(corpus_docs(spark, sf), ["group"], ["file", "line"], F.struct("file", OR.id_bucket("line")),
                          out="doc_idx")


def masked_docs(spark, sf):
    """Documents of which every fifth has masked a name, and every tenth an address, at its ends."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<NAME>"), "text")).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(text, F.lit("x<URL><URL>"))).otherwise(text)
    return corpus_docs(spark, sf).withColumn("text", text)


@register("encode_docs")
def q_encode_docs(spark, sf):
    e = QU.encode_docs(masked_docs(spark, sf), roundtrip=False)
    return e.select("doc_id", F.size("ids").alias("n_tokens"), TK.ids_md5("ids").alias("ids_md5"))


@register("roundtrip_check")
def q_roundtrip_check(spark, sf):
    return QU.encode_docs(corpus_docs(spark, sf)).select("doc_id", "roundtrip_ok")


@register("tokenizer_quality")
def q_tokenizer_quality(spark, sf):
    return QU.tokenizer_quality(QU.encode_docs(eval_docs(spark, sf)), BYTE_VOCAB_SIZE)


@register("top_tokens")
def q_top_tokens(spark, sf):
    return QU.top_tokens(QU.encode_docs(eval_docs(spark, sf), roundtrip=False), QU.vocab_frame(spark),
                         doc_rank="doc_idx")


@register("roundtrip_failures")
def q_roundtrip_failures(spark, sf):
    """A codec that stops at 2 000 tokens loses the end of longer documents."""
    enc = QU.encode_docs(eval_docs(spark, sf), encode=lambda c: F.slice(TK.byte_encode(c), 1, 2000))
    return QU.roundtrip_failures(enc).select("group", "line", "input_preview", "decoded_preview")


@register("special_token_counts")
def q_special_token_counts(spark, sf):
    return QU.special_token_counts(masked_docs(spark, sf))


# --- byte-level BPE ---------------------------------------------------------------

BPE_VOCAB = TK.N_SPECIAL + 256 + 256   # 256 merges
BPE_SMALL_MERGES = 128
_BPE_MODELS: dict = {}


def bpe_model(spark, sf, vocab_size: int = BPE_VOCAB, fresh: bool = False) -> dict:
    """Trained once per process and scale factor for the queries that only
    use the model (training is deterministic); ``fresh`` retrains."""
    key = (sf, vocab_size)
    if fresh or key not in _BPE_MODELS:
        _BPE_MODELS[key] = BP.train_bpe(table(spark, sf, "documents").select("text"), vocab_size)
    return _BPE_MODELS[key]


@register("pretoken_counts")
def q_pretoken_counts(spark, sf):
    return BP.pretoken_counts(table(spark, sf, "documents"))


@register("bpe_pair_counts")
def q_bpe_pair_counts(spark, sf):
    w = BP.word_symbols(BP.pretoken_counts(table(spark, sf, "documents")))
    return BP.pair_counts(w)


@register("bpe_merges")
def q_bpe_merges(spark, sf):
    return BP.merges_frame(spark, bpe_model(spark, sf, fresh=True))


@register("bpe_encode")
def q_bpe_encode(spark, sf):
    m = bpe_model(spark, sf)
    enc, dec = BP.make_bpe_encoder(m["merges"]), BP.make_bpe_decoder(m["vocab"])
    d = table(spark, sf, "documents").select("doc_id", "text").withColumn("ids", enc("text"))
    return d.select("doc_id", F.size("ids").alias("n_tokens"), TK.ids_md5("ids").alias("ids_md5"),
                    (dec("ids") == F.col("text")).alias("roundtrip_ok"))


@register("tokenizer_compare")
def q_tokenizer_compare(spark, sf):
    """The same documents under three vocabularies (bytes only, the first
    128 merges, all 256 merges): tokens and round-trip per vocabulary."""
    m = bpe_model(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    variants = [("byte", TK.N_SPECIAL + 256, TK.byte_encode, TK.byte_decode)]
    for k in (BPE_SMALL_MERGES, len(m["merges"])):
        merges = m["merges"][:k]
        size = TK.N_SPECIAL + 256 + len({n for _, _, n in merges})
        variants.append((f"bpe{size}", size, BP.make_bpe_encoder(merges), BP.make_bpe_decoder(m["vocab"])))
    out = None
    for name, size, enc, dec in variants:
        e = docs.withColumn("ids", enc("text"))
        r = e.agg(F.lit(name).alias("tokenizer"), F.lit(size).alias("vocab_size"),
                  F.sum(F.size("ids")).cast("long").alias("tokens"),
                  F.sum(F.char_length("text")).cast("long").alias("chars"),
                  F.count_if(dec("ids") == F.col("text")).alias("roundtrip_ok"))
        out = r if out is None else out.unionByName(r)
    return out


# --- streaming ------------------------------------------------------------------

STREAM_FILES = 4


def run_logs(spark, sf):
    """The events as the logs of many runs: one per user, steps numbered
    within it."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "event_type",
                                          F.col("value").alias("loss"))
    e = OR.range_buckets(e, ["ts", "event_id"], ["run"])
    e = OR.dense_index(e, ["run"], ["ts", "event_id"], OR.BK, out="global_step", base=1)
    return e.select(F.col("run").cast("string").alias("run"), "global_step", "loss", (F.col("event_type") != "error").alias("valid"))


def stream_windows(spark, sf, rule):
    """The run logs written as files and consumed as a file stream."""
    base = scratch_path(spark, f"stream-{rule}")
    run_logs(spark, sf).repartitionByRange(STREAM_FILES, "global_step").write.parquet(f"{base}/src")
    r = STR.stream_run_windows(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt", rule)
    return r.select("run", F.lit(rule).alias("rule"), "global_step", "optimizer_step", "train_loss", "n_losses")


@register("stream_log_windows")
def q_stream_log_windows(spark, sf):
    """ST1, base rule: every run's windows as they close."""
    return stream_windows(spark, sf, "base")


@register("stream_ingest_counts")
def q_stream_ingest_counts(spark, sf):
    """ST2: documents written as JSONL files per language, ingested as a file
    stream with running documents and bytes per language."""
    base = scratch_path(spark, "stream-ingest")
    d = table(spark, sf, "documents").select(F.col("lang").alias("group"),
                                             F.to_json(F.struct("text")).alias("line"))
    # a file of a language for every split of the scan; as many batches as with the least number of files
    n = max(STREAM_FILES, d.rdd.getNumPartitions())
    d.repartition(n).write.partitionBy("group").text(f"{base}/src")
    return STR.stream_ingest_counts(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt", n // STREAM_FILES)


@register("source_fallback")
def q_source_fallback(spark, sf):
    """Every source of a group has a training file; a holdout file exists
    when the holdout sample of that source is not empty."""
    docs, usage = replay_usage(spark, sf)
    _, stats = HO.holdout_text(docs, usage, HOLDOUT_TEXT_N)
    srcs = docs.select("group", "file").distinct()
    hold = (srcs.join(stats, ["group", "file"], "left")
            .select("group", "file", F.lit("holdout").alias("kind"),
                    F.coalesce(F.col("sampled_docs") > 0, F.lit(False)).alias("exists")))
    train = srcs.select("group", "file", F.lit("train").alias("kind"), F.lit(True).alias("exists"))
    return J.resolve_group_files(hold.unionByName(train))


# --- previews and sink round trips ------------------------------------------------------

PREVIEW_TOKENS = 50


@register("token_preview")
def q_token_preview(spark, sf):
    """Escaped previews of the first 50 tokens of every document."""
    esc = TK.escaped_vocab(TK.byte_vocab_tokens())
    d = doc_texts(spark, sf).withColumn("ids", TK.byte_encode("text"))
    p = d.select("doc_id", TK.token_preview("ids", esc, PREVIEW_TOKENS).alias("preview"))
    return p.select("doc_id", F.size("preview").alias("n_tokens"), F.md5(F.array_join("preview", " ")).alias("preview_md5"))


@register("corpus_sink_stats")
def q_corpus_sink_stats(spark, sf):
    """K1: the budgeted tokenizer-training corpus written as text (documents
    separated by a blank line, groups in order), read back and counted."""
    docs = corpus_docs(spark, sf)
    kept = B.byte_budget_prefix(docs, B.group_fraction_budgets(docs, BUDGET_FRACTION), keys=["doc_id"])
    kept = kept.join(doc_texts(spark, sf), "doc_id")  # the text joins the (smaller) kept prefix once
    path = scratch_path(spark, "corpus")
    WR.write_corpus_groups(kept, path)
    back = (spark.read.option("lineSep", "\n\n").text(path + "/*")
            .select(F.regexp_extract(F.col("_metadata.file_path"), r"/group=([^/]+)/part-", 1).alias("group"), "value"))
    return back.groupBy("group").agg(F.count(F.lit(1)).alias("docs"),
                                     F.sum(F.octet_length("value") + 2).cast("long").alias("bytes"))


@register("pack_shards")
def q_pack_shards(spark, sf):
    """K2: blocks written as Parquet partitioned by split and shard, read back
    per shard (partition pruning gives each shard's files directly)."""
    path = scratch_path(spark, "blocks")
    WR.write_blocks(packed(spark, sf), path, PACK_SHARD)
    back = spark.read.parquet(path)
    return back.groupBy("split", "shard").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("block_idx").alias("first_block"),
        F.sum(F.size("input_ids")).cast("long").alias("n_tokens"))


@register("pack_overlap")
def q_pack_overlap(spark, sf):
    """Documents whose tokens land in both eval and train blocks."""
    offs = PK.token_offsets(mix_keys(spark, sf), count=F.col("n_bytes"))
    return PK.split_overlap(offs, PACK_BLOCK, PACK_EVAL)


@register("pack_split")
def q_pack_split(spark, sf):
    """D3: the eval head and the train remainder."""
    b = packed(spark, sf)
    return b.groupBy("split").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("block_idx").alias("first_block"),
                                  F.max("block_idx").alias("last_block"))


@register("lcs_length")
def q_lcs_length(spark, sf):
    """LCS length of every prediction/reference pair (char tokens, whole
    texts; checked against a loop DP in pytest, no SQL form)."""
    p = OR.spread_small(prediction_pairs(spark, sf))
    t = p.select("id", RG.rouge_tokens("prediction").alias("a"), RG.rouge_tokens("reference").alias("b"))
    return t.select("id", F.size("a").alias("pred_len"), F.size("b").alias("ref_len"),
                    RG.lcs_length("a", "b").alias("lcs"))


@register("stream_summary_windows")
def q_stream_summary_windows(spark, sf):
    """ST1, summary rule: every run's windows as they close."""
    return stream_windows(spark, sf, "summary")


@register("tokenizer_quality_bpe")
def q_tokenizer_quality_bpe(spark, sf):
    """A5 with the trained byte-level BPE vocabulary (through the pluggable
    tokenizer): the report the reference produces for its own vocabulary."""
    tok = TK.get_tokenizer("bpe", bpe_model(spark, sf))
    enc = QU.encode_docs(eval_docs(spark, sf), encode=tok.encode, decode=tok.decode)
    return QU.tokenizer_quality(enc, tok.vocab_size, unk_id=tok.unk_id)


# --- files written from the tables and read back ---------------------------------------


@register("raw_text_scan")
def q_raw_text_scan(spark, sf):
    """The documents of a language as text files, read as Python reads text."""
    path = scratch_path(spark, "raw")
    table(spark, sf, "documents").select(F.col("lang").alias("group"), "text").write.partitionBy("group").text(path)
    t = J.raw_text(spark, path).select(F.regexp_extract("file", "group=([^/]+)/", 1).alias("group"), "text")
    return t.groupBy("group").agg(F.sum(F.char_length("text")).cast("long").alias("chars"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


DISPATCH = {0: "some.jsonl", 1: "wiki_dump", 2: "plain.txt"}


@register("format_dispatch")
def q_format_dispatch(spark, sf):
    """JSON lines by suffix or a wiki name, blocks otherwise; S10: a missing file yields nothing."""
    base, d = scratch_path(spark, "dispatch"), table(spark, sf, "documents")
    for k, name in DISPATCH.items():
        part = d.where(F.col("doc_id") % 3 == k)
        if k < 2:
            part.select(F.to_json(F.struct("text"))).write.text(f"{base}/{name}")
        else:
            part.select("text").write.option("lineSep", "\n\n").text(f"{base}/{name}")
    t = J.read_texts(spark, [f"{base}/{name}" for name in [*DISPATCH.values(), "missing.jsonl", "missing.txt"]])
    t = t.withColumn("name", F.regexp_extract("file", "/([^/]+)/part-", 1))
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@register("log_columns")
def q_log_columns(spark, sf):
    """A log whose columns have their less preferred names, as CSV."""
    path, log = scratch_path(spark, "log"), training_log(spark, sf)
    val = F.when(F.col("global_step") % 7 == 0, F.col("loss").cast("string")).when(F.col("global_step") % 7 == 1, F.lit("n/a"))
    log.select("event_type", "global_step", F.col("loss"), val.alias("val_loss")).write.option("header", True).csv(path)
    r = J.read_log_csv(spark, path)
    return r.agg(F.count("step").alias("steps"), F.sum("step").cast("long").alias("step_sum"), F.round(F.sum("train_loss"), 6).alias("train_sum"),
                 F.count("eval_loss").alias("evals"), F.round(F.sum("eval_loss"), 6).alias("eval_sum"))


@register("predictions_sink")
def q_predictions_sink(spark, sf):
    """K5: predictions with their scores as JSON lines."""
    path, pairs = scratch_path(spark, "predictions"), prediction_pairs(spark, sf)
    WR.write_predictions(RG.compute_rouge(pairs).join(pairs, "id"), path)
    leaf = "struct<p: double, r: double, f1: double>"
    back = spark.read.schema(f"id long, prediction string, reference string, rouge struct<rouge1: {leaf}, rouge2: {leaf}, rougeL: {leaf}>").json(path)
    return back.select("id", F.md5("prediction").alias("prediction_md5"), F.md5("reference").alias("reference_md5"),
                       *[F.col(f"rouge.{m}.f1").alias(f"{m.lower()}_f1") for m in ("rouge1", "rouge2", "rougeL")])


@register("points_sink")
def q_points_sink(spark, sf):
    """K6: the points of the log as CSV with a byte-order mark."""
    path = scratch_path(spark, "points")
    WR.write_points_csv(training_log(spark, sf).select(F.col("global_step").alias("step"), F.col("loss").alias("train_loss")), path, bom=True)
    # readers take the mark off: look at the files
    head = spark.read.format("binaryFile").load(f"{path}/part-*").agg(F.min(F.hex(F.substring("content", 1, 7))).alias("head"))
    back = spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("step").cast("long")).alias("step_sum"),
                                                           F.round(F.sum(F.col("train_loss").cast("double")), 6).alias("loss_sum"))
    return back.join(F.broadcast(head))  # a row each


@register("log_append_sink")
def q_log_append_sink(spark, sf):
    """K7: a log started anew, then appended to by a resumed run."""
    path, log = scratch_path(spark, "train-log"), training_log(spark, sf)
    w = RL.train_log_windows(log).select("global_step", "optimizer_step", "train_loss").checkpoint(eager=True)
    for rows, resume in ((w, True), (w, False), (w.where(F.col("optimizer_step") % 20 == 0), True)):
        WR.append_log_csv(rows, path, resume)
    back = spark.read.option("header", True).schema("global_step long, optimizer_step long, train_loss double").csv(path)
    return back.groupBy("optimizer_step").agg(F.count(F.lit(1)).alias("rows"), F.sum("global_step").alias("step_sum"))


@register("report_sink")
def q_report_sink(spark, sf):
    """K8: the tokenizer report with its nested top tokens as JSON."""
    path, e = scratch_path(spark, "report"), QU.encode_docs(eval_docs(spark, sf)).checkpoint(eager=True)
    WR.tokenizer_report(QU.tokenizer_quality(e, BYTE_VOCAB_SIZE), QU.top_tokens(e, QU.vocab_frame(spark), doc_rank="doc_idx"),
                        QU.roundtrip_failures(e)).write.json(path)
    top = "array<struct<rank: int, token_id: int, token: string, count: long>>"
    back = spark.read.schema(f"group string, docs long, tokens long, used_vocab long, top_used_tokens {top}").json(path)
    return back.select("group", "docs", "tokens", "used_vocab", F.size("top_used_tokens").alias("n_top"),
                       F.col("top_used_tokens")[0]["token_id"].alias("top_id"), F.col("top_used_tokens")[0]["count"].alias("top_count"))


@register("pad_eos_batches")
def q_pad_eos_batches(spark, sf):
    """Batches of a tokenizer without a pad token, padded with its EOS."""
    p = conversation_pairs(spark, sf)
    n = SF.batch_numbers(OR.range_buckets(p.select("pair_id"), ["pair_id"]), SFT_BATCH, ["pair_id"], OR.BK)
    e = SF.encode_pairs(p, SFT_MAX_LEN).select("pair_id", "input_ids", "labels")
    b = SF.pad(e.join(n.select("pair_id", "batch_id"), "pair_id"), SF.resolve_pad_id(None, TK.EOS_ID))
    return b.select("pair_id", TK.ids_md5("input_ids").alias("input_md5"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@register("lm_labels")
def q_lm_labels(spark, sf):
    """Packed blocks with their labels."""
    return PK.with_lm_labels(packed(spark, sf)).select("block_idx", TK.ids_md5("labels").alias("labels_md5"))


@register("holdout_sink")
def q_holdout_sink(spark, sf):
    """K4: the held-out code blocks with a blank line between them, read back;
    ``bytes`` of all parts, by the manifest."""
    size, path = code_source_bytes(spark, sf), scratch_path(spark, "holdout-code")
    s = HO.holdout_code(code_blocks(spark, sf), min(size + 2, int(size * CODE_BUDGET_FRACTION)), HOLDOUT_CODE_N)
    WR.write_holdout_blocks(s, path)
    back = spark.read.option("lineSep", "\n\n").text(f"{path}/part-*").where("value <> ''")
    return back.select(F.md5("value").alias("block_md5"), F.lit(VB.read_manifest(path)["bytes"]).cast("long").alias("bytes"))
