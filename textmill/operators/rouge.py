"""ROUGE-1/2/L between predictions and references.

Both texts of a pair are in one row, so every score is a narrow computation:
tokens come from a built-in pattern match, one Arrow call per batch counts the
clipped n-gram overlaps (tokens as numbers, sorted runs of n-grams intersected
for all pairs at once) and the longest common subsequence (bit-parallel: one
big-integer step per token), and the averages are plain aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.text import WS_CLASS, strip_u
from textmill.operators.ordering import running_totals, spread_small

MODES = ("char", "whitespace")


def rouge_tokens(text, mode: str = "char") -> Column:
    """``char`` = every non-space code point; ``whitespace`` = split on
    Unicode whitespace.  NULL text gives no tokens."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    t = F.coalesce(strip_u(F.col(text) if isinstance(text, str) else text), F.lit(""))
    pat = rf"(?U)[^{WS_CLASS}]" + ("+" if mode == "whitespace" else "")
    return F.regexp_extract_all(t, F.lit(pat), 0)


def precision_recall(overlap: Column, pred_n: Column, ref_n: Column, digits: int = 9) -> Column:
    """Precision, recall, F1; all zero when any count or the overlap is 0."""
    zero = (pred_n == 0) | (ref_n == 0) | (overlap == 0)
    p = overlap / pred_n
    r = overlap / ref_n
    f1 = 2 * p * r / (p + r)

    def z(x):
        return F.round(F.when(zero, F.lit(0.0)).otherwise(x), digits)
    return F.struct(z(p).alias("p"), z(r).alias("r"), z(f1).alias("f1"))


def _numbered(p: pa.Array, r: pa.Array):
    """The tokens of all predictions, then of all references, as numbers, and the row of each."""
    flat = pa.concat_arrays([p.flatten(), r.flatten()]).dictionary_encode()
    lengths = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (p, r)])
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)


def _grams(ids, row, n: int):
    """``(row, number)`` of every n-gram; equal n-grams share a number."""
    at, gram, size = np.arange(len(ids)), ids, len(ids) + 1
    for k in range(1, n):
        inside = at + k < len(ids)
        at, gram = at[inside], gram[inside]
        inside = row[at + k] == row[at]
        at, gram = at[inside], gram[inside]
        _, gram = np.unique(gram * size + ids[at + k], return_inverse=True)
    return row[at], gram


def _overlap_counts(ids, row, n: int, pairs: int):
    """Per pair: distinct n-grams of both sides, n-grams of each, clipped overlap."""
    row, gram = _grams(ids, row, n)
    size = int(gram.max()) + 1 if len(gram) else 1
    keys, count = np.unique(row * size + gram, return_counts=True)
    cut = np.searchsorted(keys, pairs * size)
    (a, na), (b, nb) = (keys[:cut], count[:cut]), (keys[cut:] - pairs * size, count[cut:])
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    per = lambda k, w=None: np.bincount(k // size, w, pairs).astype(np.int64)
    return {"distinct": per(a) + per(b) - per(both), "pred": per(a, na), "ref": per(b, nb), "overlap": per(both, np.minimum(na[i], nb[j]))}


_COUNT = T.StructType([T.StructField(c, T.LongType()) for c in ("distinct", "pred", "ref", "overlap")])


def _numbers_udf(ns: tuple, lcs: bool):
    """One Arrow call per batch for everything: a struct per n, and the LCS."""
    fields = [T.StructField(f"n{n}", _COUNT) for n in ns] + [T.StructField("lcs", T.IntegerType())] * lcs

    def run(p: pa.Array, r: pa.Array) -> pa.Array:
        ids, row = _numbered(p, r)
        out = []
        for n in ns:
            c = _overlap_counts(ids, row, n, len(p))
            out.append(pa.StructArray.from_arrays([pa.array(c[x]) for x in _COUNT.names], _COUNT.names))
        if lcs:
            end = np.r_[0, np.cumsum(np.bincount(row, minlength=2 * len(p)))]
            side = lambda i: ids[end[i]:end[i + 1]].tolist()
            out.append(pa.array([lcs_length_py(side(i), side(len(p) + i)) for i in range(len(p))], pa.int32()))
        return pa.StructArray.from_arrays(out, [f.name for f in fields])

    return F.arrow_udf(run, T.StructType(fields))


def _tokenized(pairs: DataFrame, mode: str, id_col: str, pred: str, ref: str) -> DataFrame:
    return spread_small(pairs.select(id_col, pred, ref)).select(
        id_col, rouge_tokens(pred, mode).alias("_p"), rouge_tokens(ref, mode).alias("_r"))


def ngram_counts(pairs: DataFrame, ns=(1, 2), mode: str = "char", id_col: str = "id",
                 pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Per ``(id, n)``: ``distinct`` n-grams of both sides, n-grams of each
    side (``pred``, ``ref``) and their clipped ``overlap``."""
    d = _tokenized(pairs, mode, id_col, pred, ref).select(id_col, _numbers_udf(tuple(ns), False)("_p", "_r").alias("_c"))
    rows = F.array(*[F.struct(F.lit(n).alias("n"), *[F.col(f"_c.n{n}.{c}").alias(c) for c in _COUNT.names]) for n in ns])
    return d.select(id_col, F.inline(rows))


def _scored(tokens: DataFrame, ns, id_col: str, lcs: bool = False) -> DataFrame:
    """``rouge<n>`` and, with ``lcs``, ``lcs`` and ``rougeL`` from one Arrow call."""
    d = tokens.select(id_col, F.size("_p").alias("_pn"), F.size("_r").alias("_rn"), _numbers_udf(tuple(ns), lcs)("_p", "_r").alias("_c"))
    out = [precision_recall(F.col(f"_c.n{n}.overlap"), F.col(f"_c.n{n}.pred"), F.col(f"_c.n{n}.ref")).alias(f"rouge{n}") for n in ns]
    if lcs:
        out += [F.col("_c.lcs").alias("lcs"), precision_recall(F.col("_c.lcs"), F.col("_pn"), F.col("_rn")).alias("rougeL")]
    return d.select(id_col, *out)


def rouge_n(pairs: DataFrame, ns=(1, 2), mode: str = "char", id_col: str = "id",
            pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """R4 for every pair and n: ``(id, rouge1, rouge2, ...)`` structs of p/r/f1.
    Pairs with no n-grams on a side score zero (they still appear)."""
    return _scored(_tokenized(pairs, mode, id_col, pred, ref), ns, id_col)


# --- LCS --------------------------------------------------------------------
def lcs_length_py(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel: bit j of ``v``
    is 0 once ``b[:j+1]`` gained a match; the answer counts the zero bits)."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if m == 0:
        return 0
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << m) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _lcs_arrow(a: pa.Array, b: pa.Array) -> pa.Array:
    la, lb = a.to_pylist(), b.to_pylist()
    return pa.array([lcs_length_py(x or [], y or []) for x, y in zip(la, lb)], pa.int32())


_lcs_udf = F.arrow_udf(_lcs_arrow, T.IntegerType())


def lcs_length(a, b) -> Column:
    """R5 as a column: LCS length of two token arrays (Arrow-batched UDF)."""
    return _lcs_udf(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def rouge_l(pairs: DataFrame, mode: str = "char", id_col: str = "id",
            pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """``(id, lcs, rougeL)`` from the LCS of the two token lists."""
    return _scored(_tokenized(pairs, mode, id_col, pred, ref), (), id_col, lcs=True)


def compute_rouge(pairs: DataFrame, mode: str = "char", id_col: str = "id",
                  pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """R7 per pair: ``(id, rouge struct<rouge1, rouge2, rougeL>)``, from one read of the pairs."""
    d = _scored(_tokenized(pairs, mode, id_col, pred, ref), (1, 2), id_col, lcs=True)
    return d.select(id_col, F.struct("rouge1", "rouge2", "rougeL").alias("rouge"))


def average_metrics(scored: DataFrame, rouge: str = "rouge", digits: int = 9) -> DataFrame:
    """Macro average of every leaf; zeros when there are no rows."""
    leaves = [(m, s) for m in ("rouge1", "rouge2", "rougeL") for s in ("p", "r", "f1")]
    aggs = [F.round(F.coalesce(F.avg(F.col(f"{rouge}.{m}.{s}")), F.lit(0.0)), digits).alias(f"{m}_{s}")
            for m, s in leaves]
    return scored.agg(F.count(F.lit(1)).alias("samples"), *aggs)


def running_average(scored: DataFrame, order, bucket, metric: Column, every: int = 10,
                    digits: int = 9) -> DataFrame:
    """The running mean of ``metric`` after every ``every``-th sample."""
    d = running_totals(scored, [], order, {"idx": F.lit(1).cast("long"), "_msum": metric}, bucket)
    return (d.where(F.col("idx") % every == 0)
             .select("idx", F.round(F.col("_msum") / F.col("idx"), digits).alias("running_mean")))
