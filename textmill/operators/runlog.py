"""Training and evaluation logs as tables.

A log is a table of micro-steps ``(global_step, loss, valid)``.  Running
counts use the two-level running total; rolling means use a *halo*: each
bucket of consecutive rows also receives the last ``window - 1`` rows of the
previous bucket, so a window partitioned by bucket sees every row it needs
and no task holds more than one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.ordering import id_bucket, running_total, running_totals

GRAD_ACCUM = 8
LOG_STEPS = 10
PPL_CAP = 20.0


def is_finite(c: Column) -> Column:
    """Not null, not NaN, not +-inf."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def coerce_numeric(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: unparsable -> NULL; NaN also
    becomes NULL (pandas drops it with the missing values); inf is kept."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def eval_loss_ppl(batches: DataFrame, group=(), loss: str = "loss", has_labels: str | None = None,
                  digits: int = 9) -> DataFrame:
    """Unweighted mean over evaluation batches with a finite loss and
    ``exp(mean)`` perplexity (inf from mean >= 20); NaN / inf when no batch
    is valid.  Batches without supervised labels or with a bad loss count as
    skipped; ``nan_steps`` counts the bad losses alone."""
    ok = is_finite(F.col(loss))
    if has_labels is not None:
        lab = F.col(has_labels)
        valid = lab & ok
        skipped = ~lab | ~ok
        nan_steps = lab & ~ok
    else:
        valid, skipped, nan_steps = ok, ~ok, ~ok
    g = batches.groupBy(*group).agg(
        F.avg(F.when(valid, F.col(loss))).alias("_m"),
        F.count_if(valid).alias("valid_steps"),
        F.count_if(skipped).alias("skipped_steps"),
        F.count_if(nan_steps).alias("nan_steps"))
    m = F.col("_m")
    return g.select(*group, F.coalesce(F.round(m, digits), F.lit(float("nan"))).alias("eval_loss"),
                    F.when(m.isNull(), F.lit(float("inf")))
                     .when(m < PPL_CAP, F.round(F.exp(m), digits))
                     .otherwise(F.lit(float("inf"))).alias("perplexity"),
                    "valid_steps", "skipped_steps", "nan_steps")


def masked_nll(tokens: DataFrame, seq: str = "seq", pos: str = "pos", label: str = "label",
               nll: str = "nll", ignore: int = -100, digits: int = 9) -> DataFrame:
    """A8 re-aimed: per sequence, the mean negative log-likelihood over
    positions after the first (the shift) whose label is not ``ignore``.

    The first position of each sequence comes from a grouped ``min`` joined
    back, not from a window, so a very long sequence is not one task."""
    first = tokens.groupBy(seq).agg(F.min(pos).alias("_first"))
    t = tokens.join(first, seq).where((F.col(pos) > F.col("_first")) & (F.col(label) != F.lit(ignore)))
    return t.groupBy(seq).agg(F.round(F.avg(nll), digits).alias("mean_nll"),
                              F.count(F.lit(1)).alias("n_tokens"))


def _update_flag(rule: str, step: str, valid: str, grad_accum: int) -> Column:
    upd = (F.col(step) % grad_accum) == 0
    if rule == "summary":
        return upd & F.col(valid)
    if rule != "base":
        raise ValueError(rule)
    return upd


def optimizer_steps(log: DataFrame, rule: str = "base", step: str = "global_step",
                    valid: str = "valid", grad_accum: int = GRAD_ACCUM, bucket_width: int = 50_000,
                    run: str | None = None) -> DataFrame:
    """``is_update`` per micro-step and ``optimizer_step`` = updates so
    far.  base: every ``grad_accum``-th micro-step updates.  summary: an
    invalid loss on such a step cancels that update.  ``run``: a column
    separating several runs in one log (counts restart per run)."""
    d = log.withColumn("is_update", _update_flag(rule, step, valid, grad_accum).cast("long"))
    part = [run] if run else []
    return running_total(d, part, [step], "is_update", id_bucket(step, bucket_width), out="optimizer_step")


def optimizer_steps_both(log: DataFrame, step: str = "global_step", valid: str = "valid",
                         grad_accum: int = GRAD_ACCUM, bucket_width: int = 50_000) -> DataFrame:
    """W7 for both rules in one pass (two running counts share the shuffle):
    adds ``update_base``, ``opt_step_base``, ``update_summary``,
    ``opt_step_summary``."""
    d = log.withColumns({f"update_{r}": _update_flag(r, step, valid, grad_accum).cast("long")
                         for r in ("base", "summary")})
    return running_totals(d, [], [step], {"opt_step_base": F.col("update_base"),
                                          "opt_step_summary": F.col("update_summary")},
                          id_bucket(step, bucket_width))


def train_log_windows(log: DataFrame, rule: str = "base", step: str = "global_step", loss: str = "loss",
                      valid: str = "valid", grad_accum: int = GRAD_ACCUM, log_steps: int = LOG_STEPS,
                      digits: int = 9, run: str | None = None) -> DataFrame:
    """The mean training loss logged every ``log_steps`` optimizer steps.

    A micro-step belongs to window ``(updates strictly before it) div
    log_steps``; a window is logged when its ``log_steps``-th update happens
    (incomplete tail dropped).  base averages every micro-step, summary only
    the valid ones (``running_count`` floor of 1)."""
    d = optimizer_steps(log, rule, step, valid, grad_accum, run=run)
    d = d.withColumn("_win", F.floor((F.col("optimizer_step") - F.col("is_update")) / log_steps))
    contributes = F.lit(True) if rule == "base" else F.col(valid)
    keys = ([run] if run else []) + ["_win"]
    g = d.groupBy(*keys).agg(
        F.sum(F.when(contributes, F.col(loss)).otherwise(0.0)).alias("_s"),
        F.count_if(contributes).alias("n_losses"),
        F.max(F.when(F.col("is_update") == 1, F.col("optimizer_step"))).alias("_last_upd"),
        F.max(F.when((F.col("is_update") == 1) & (F.col("optimizer_step") % log_steps == 0),
                     F.col(step))).alias("global_step"))
    g = g.where(F.col("global_step").isNotNull())
    return g.select(*([run] if run else []), F.lit(rule).alias("rule"), "global_step",
                    ((F.col("_win") + 1) * log_steps).cast("long").alias("optimizer_step"),
                    F.round(F.col("_s") / F.greatest(F.col("n_losses"), F.lit(1)), digits).alias("train_loss"),
                    "n_losses")


def rolling_mean(series: DataFrame, idx: str, value: str, window: int, out: str = "smooth",
                 bucket_width: int = 50_000, digits: int = 9, run: str | None = None) -> DataFrame:
    """``rolling(window, min_periods=1).mean()`` along a dense 0-based
    index ``idx`` (per ``run`` when given), computed per bucket of
    ``bucket_width`` rows with a halo of the previous ``window - 1`` rows."""
    H = int(window) - 1
    W_ = max(int(bucket_width), 4 * int(window))  # the halo stays a small part of a bucket
    b = F.floor(F.col(idx) / W_)
    home = series.withColumn("_bk", b).withColumn("_own", F.lit(True))
    halo = (series.where((F.col(idx) % W_) >= W_ - H)
            .withColumn("_bk", b + 1).withColumn("_own", F.lit(False)))
    both = home.unionByName(halo)
    w = Window.partitionBy(*([run] if run else []), "_bk").orderBy(idx).rowsBetween(-H, Window.currentRow)
    return (both.withColumn(out, F.round(F.avg(value).over(w), digits))
                .where(F.col("_own")).drop("_bk", "_own"))


def checkpoint_retention(names: DataFrame, keep_last: int, run: str = "run", name: str = "name") -> DataFrame:
    """T5: checkpoints a cleanup would delete: the step is the integer after
    the last ``_`` (unparsable names ignored); all but the ``keep_last``
    newest per run.  ``keep_last <= 0`` keeps everything (deviation).
    Lists only; nothing is deleted."""
    step = F.substring_index(F.col(name), "_", -1).try_cast("bigint")
    d = names.withColumn("step", step).where(F.col("step").isNotNull())
    if keep_last <= 0:
        return d.limit(0)
    # the newest few of each run come from a partial top-n; what is older than the last of them goes
    w = Window.partitionBy(run).orderBy(F.col("step").desc(), F.col(name).desc())
    newest = d.select(run, "step", name).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= int(keep_last))
    last = (newest.groupBy(F.col(run).alias("_run")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("step", name)).alias("_last"))
            .where(F.col("_n") == int(keep_last)))
    return (d.join(last, F.col(run).eqNullSafe(F.col("_run"))).where(F.struct("step", name) < F.col("_last"))
            .drop("_run", "_n", "_last"))
