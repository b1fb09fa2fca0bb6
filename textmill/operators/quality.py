"""Tokenizer evaluation per group.

Documents are encoded once (Arrow UDF); everything else is aggregation.
Token frequencies come from ``posexplode`` + ``groupBy(group, token_id)``:
partial aggregation keeps at most one row per token per partition before the
shuffle, so the shuffle is bounded by the vocabulary, not by the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import tokens as TK
from textmill.operators.ordering import spread_small

MAX_EXAMPLES = 3
TOP_K = 20
PREVIEW_CHARS = 200


def encode_docs(docs: DataFrame, text: str = "text", encode=TK.byte_encode, decode=TK.byte_decode,
                roundtrip: bool = True) -> DataFrame:
    """``ids`` (no special tokens added) and, optionally, ``decoded``
    and the exact round-trip flag ``roundtrip_ok``."""
    d = spread_small(docs).withColumn("ids", encode(text))
    if roundtrip:
        d = d.withColumn("decoded", decode("ids")).withColumn("roundtrip_ok", F.col("decoded") == F.col(text))
    return d


def token_counts(encoded: DataFrame, group: str = "group", order=("file", "line"), ids: str = "ids",
                 doc_rank: str | None = None) -> DataFrame:
    """``(group, token_id, count, first)``; ``first`` = earliest occurrence, the
    tie-break of ``Counter.most_common``.  With ``doc_rank`` (a dense document
    position in ``order``) ``first`` is the long ``doc_rank * 2^32 + pos``, a
    cheap codegen-friendly minimum; otherwise the struct ``(order..., pos)``."""
    if doc_rank is not None:
        e = encoded.select(group, F.posexplode(ids).alias("pos", "token_id"),
                           (F.col(doc_rank).cast("long") * F.lit(1 << 32)).alias("_d"))
        first = F.min(F.col("_d") + F.col("pos"))
    else:
        e = encoded.select(group, *order, F.posexplode(ids).alias("pos", "token_id"))
        first = F.min(F.struct(*order, "pos"))
    return e.groupBy(group, "token_id").agg(F.count(F.lit(1)).alias("count"), first.alias("first"))


def tokenizer_quality(encoded: DataFrame, vocab_size: int, group: str = "group", text: str = "text",
                      ids: str = "ids", order=("file", "line"), unk_id: int | None = TK.UNK_ID,
                      digits: int = 9) -> DataFrame:
    """One row of tokenizer statistics per group, in one pass.

    Only the distinct ids of a document are exploded; its own statistics ride
    on its first row (``posexplode_outer`` keeps token-less documents).  A
    first aggregation by ``(group, token_id)`` is bounded by the vocabulary;
    the second sums documents' statistics and counts distinct ids per group."""
    unk = (F.size(F.filter(ids, lambda x: x == F.lit(unk_id))) if unk_id is not None else F.lit(0))
    # per-document values first (one evaluation per document), then explode
    per_doc = encoded.select(group, ids, F.char_length(text).cast("long").alias("_c"),
                             F.size(ids).cast("long").alias("_t"), unk.cast("long").alias("_u"),
                             F.col("roundtrip_ok").cast("long").alias("_ok"))
    d = per_doc.select(group, "_c", "_t", "_u", "_ok", F.posexplode_outer(F.array_distinct(ids)).alias("pos", "token_id"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)

    def on_first(c):
        return F.sum(F.when(first, F.col(c)).otherwise(F.lit(0)))
    per_tok = d.groupBy(group, "token_id").agg(
        F.count_if(first).alias("_docs"), on_first("_c").alias("_c"), on_first("_t").alias("_t"),
        on_first("_u").alias("_u"), on_first("_ok").alias("_ok"))
    g = per_tok.groupBy(group).agg(
        F.sum("_docs").alias("docs"), F.sum("_c").alias("chars"), F.sum("_t").alias("tokens"),
        F.sum("_u").alias("unk_count"), F.sum("_ok").alias("roundtrip_success"),
        F.count("token_id").alias("used_vocab"))
    g = g.withColumn("roundtrip_fail", F.col("docs") - F.col("roundtrip_success"))

    def ratio(a, b):
        return F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)), digits)
    return g.select(
        group, "docs", "chars", "tokens",
        F.round(F.col("chars") / F.col("docs"), digits).alias("avg_chars_per_doc"),
        F.round(F.col("tokens") / F.col("docs"), digits).alias("avg_tokens_per_doc"),
        ratio("chars", "tokens").alias("avg_token_length_in_chars"),
        ratio("chars", "tokens").alias("chars_per_token"),
        ratio("tokens", "chars").alias("tokens_per_char"),
        "unk_count", ratio("unk_count", "tokens").alias("unk_ratio"),
        "roundtrip_success", F.round(F.col("roundtrip_success") / F.col("docs"), digits).alias("roundtrip_success_ratio"),
        "roundtrip_fail", F.round(F.col("roundtrip_fail") / F.col("docs"), digits).alias("roundtrip_fail_ratio"),
        "used_vocab", F.round(F.col("used_vocab") / F.lit(float(vocab_size)), digits).alias("used_vocab_ratio"))


def top_tokens(encoded: DataFrame, vocab: DataFrame, k: int = TOP_K, group: str = "group",
               order=("file", "line"), ids: str = "ids", doc_rank: str | None = None) -> DataFrame:
    """T4 + J2: the ``k`` most frequent ids per group, ties by first
    occurrence, with their token strings (vocabulary joined by broadcast: its
    size is the vocabulary size, a fixed bound)."""
    c = token_counts(encoded, group, order, ids, doc_rank)
    w = Window.partitionBy(group).orderBy(F.col("count").desc(), F.col("first"))
    top = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(F.broadcast(vocab), "token_id", "left").select(group, "rank", "token_id", "token", "count")


def roundtrip_failures(encoded: DataFrame, k: int = MAX_EXAMPLES, group: str = "group",
                       order=("file", "line"), text: str = "text") -> DataFrame:
    """W10 + P7: the first ``k`` failing documents per group with 200-character
    previews of input and decoded text."""
    f = encoded.where(~F.col("roundtrip_ok"))
    w = Window.partitionBy(group).orderBy(*order)
    f = f.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return f.select(group, *order, F.substring(text, 1, PREVIEW_CHARS).alias("input_preview"),
                    F.substring("decoded", 1, PREVIEW_CHARS).alias("decoded_preview"))


def special_token_counts(docs: DataFrame, group: str = "group", text: str = "text") -> DataFrame:
    """Occurrences of each reserved atom per group (long format).  One
    regex pass finds all atoms; ``explode_outer`` keeps documents without any
    so every group reports every atom (zeros included)."""
    alt = "|".join(_re_quote(t) for t in TK.SPECIAL_TOKENS)
    m = docs.select(group, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(alt), 0)).alias("_m"))
    aggs = [F.count_if(F.col("_m") == F.lit(t)).cast("long").alias(f"c{i}") for i, t in enumerate(TK.SPECIAL_TOKENS)]
    g = m.groupBy(group).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("token_id"), F.lit(t).alias("token"), F.col(f"c{i}").alias("count"))
                     for i, t in enumerate(TK.SPECIAL_TOKENS)])
    return g.select(group, F.inline(rows))


def _re_quote(s: str) -> str:
    import re
    return re.escape(s)


def vocab_frame(spark, rows=None) -> DataFrame:
    """The vocabulary as a small dimension table ``(token_id, token)``."""
    rows = rows if rows is not None else TK.byte_vocab()
    return spark.createDataFrame(rows, "token_id int, token string")
