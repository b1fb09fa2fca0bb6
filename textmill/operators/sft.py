"""Supervised prompt/response examples.

All steps are array expressions on each row; batching uses a dense index
and a window over batch ids, whose partitions hold ``batch_size`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import tokens as TK
from textmill.operators.ordering import dense_index

IGNORE = -100
SUFFIX_KEEP = 32


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _empty_ints() -> Column:
    return F.array().cast("array<int>")


def truncate_keep_suffix(ids, room, suffix: int = SUFFIX_KEEP) -> Column:
    """Keep ids when they fit; else the head plus the last ``suffix`` ids;
    when ``room <= suffix`` only the last ``room`` ids.  ``room <= 0`` gives an
    empty list (documented deviation from Python's ``ids[-0:]``)."""
    a, r = _c(ids), _c(room) if not isinstance(room, int) else F.lit(room)
    n = F.size(a)
    tail = F.slice(a, -r, r)
    head = F.concat(F.slice(a, F.lit(1), r - F.lit(suffix)), F.slice(a, F.lit(-suffix), F.lit(suffix)))
    return (F.when(n <= r, a)
            .when(r <= 0, _empty_ints())
            .when(r <= F.lit(suffix), tail)
            .otherwise(head))


def encode_pairs(pairs: DataFrame, max_length: int, prompt: str = "prompt", response: str = "response",
                 encode=TK.byte_encode, eos_id: int = TK.EOS_ID) -> DataFrame:
    """``input_ids`` = truncated prompt + response + EOS and
    ``labels`` with the prompt masked by -100.  A response of ``max_length``
    ids or more keeps its first ``max_length - 1`` ids plus EOS and drops the
    prompt."""
    L = int(max_length)
    d = pairs.withColumn("_p", encode(prompt)).withColumn("_r", TK.append_eos(encode(response)))
    too_long = F.size("_r") >= L
    d = (d.withColumn("_r", F.when(too_long, F.concat(F.slice("_r", 1, L - 1), F.array(F.lit(eos_id))))
                      .otherwise(F.col("_r")))
          .withColumn("_p", F.when(too_long, _empty_ints()).otherwise(F.col("_p"))))
    d = d.withColumn("_p", truncate_keep_suffix("_p", F.lit(L) - F.size("_r")))
    return (d.withColumn("input_ids", F.concat("_p", "_r"))
             .withColumn("labels", F.concat(F.array_repeat(F.lit(IGNORE), F.size("_p")), F.col("_r")))
             .withColumn("n_prompt", F.size("_p"))
             .drop("_p", "_r"))


def generation_prompt(ids, max_length: int, max_new_tokens: int) -> Column:
    """The prompt a generator sees: room ``max_length - max_new_tokens``."""
    room = int(max_length) - int(max_new_tokens)
    if room < 1:
        raise ValueError(f"no room for a prompt: {max_new_tokens} new tokens of {max_length}")
    return truncate_keep_suffix(ids, F.lit(room))


def supervised_count(labels) -> Column:
    """Labels that remain supervised after the one-position shift."""
    a = _c(labels)
    shifted = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.size(F.filter(shifted, lambda x: x != F.lit(IGNORE)))


def with_valid_labels(examples: DataFrame, labels: str = "labels") -> DataFrame:
    """Drop examples with nothing to learn after the shift."""
    return (examples.withColumn("n_supervised", supervised_count(labels))
            .where(F.col("n_supervised") > 0))


def resolve_pad_id(pad_id: int | None, eos_id: int | None) -> int:
    """Pad falls back to EOS; a tokenizer without EOS is an error."""
    if eos_id is None:
        raise ValueError("tokenizer must define an EOS token")
    return eos_id if pad_id is None else pad_id


def pad_batches(examples: DataFrame, batch_size: int, order, bucket, pad_id: int = TK.PAD_ID,
                ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Consecutive batches of ``batch_size`` examples (in ``order``),
    each padded to its longest member; labels padded with -100; attention
    mask = ``input_ids != pad_id`` (so genuine pad ids are masked too)."""
    return pad(batch_numbers(examples, batch_size, order, bucket), pad_id, ids, labels)


def batch_numbers(keys: DataFrame, batch_size: int, order, bucket) -> DataFrame:
    """E5: ``sample_idx`` and ``batch_id`` along ``order``.  Number the keys
    and join or encode the payload afterwards: it then moves once."""
    d = dense_index(keys, [], order, bucket, out="sample_idx")
    return d.withColumn("batch_id", F.floor(F.col("sample_idx") / int(batch_size)).cast("long"))


def pad(d: DataFrame, pad_id: int = TK.PAD_ID, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Examples with a ``batch_id`` padded to their batch's longest."""
    w = Window.partitionBy("batch_id")
    d = d.withColumn("padded_len", F.max(F.size(ids)).over(w))
    fill = F.col("padded_len") - F.size(ids)
    d = d.withColumns({ids: F.concat(F.col(ids), F.array_repeat(F.lit(int(pad_id)), fill)),
                       labels: F.concat(F.col(labels), F.array_repeat(F.lit(IGNORE), fill))})
    return d.withColumn("attention_mask",
                        F.transform(ids, lambda x: F.when(x != F.lit(int(pad_id)), 1).otherwise(0)))


def run_plan(n_samples: Column, epochs: int = 1, grad_accum: int = 8, warmup_ratio: float = 0.03,
             max_steps: int | None = None, cap_mode: str = "min") -> tuple[Column, Column]:
    """Optimizer updates ``max(1, n*epochs div grad_accum)`` and warm-up
    ``int(updates * ratio)``.  ``cap_mode='replace'`` (base run) uses the cap
    as is; ``'min'`` (summary run) takes the smaller."""
    upd = F.greatest(F.lit(1), F.floor(n_samples * int(epochs) / int(grad_accum))).cast("long")
    if max_steps is not None:
        upd = F.lit(int(max_steps)).cast("long") if cap_mode == "replace" else F.least(upd, F.lit(int(max_steps)))
    # int(x * 0.03) in double precision, as Python computes it
    warm = F.floor(upd.cast("double") * F.lit(float(warmup_ratio))).cast("long")
    return upd, warm
