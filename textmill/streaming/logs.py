"""Structured Streaming forms of the log and ingest operators (ST1, ST2).

Log windows keep typed state for buckets of runs and emit a window once, when it
closes (append mode): a value with the open window of every run of the bucket,
and a map with the stretches of micro-steps that arrived ahead of a gap, each
of which is written once and removed once.
Ingest counts run in update mode into a table keyed by group, of which a batch
rewrites only the groups it changed.  There is no event time in these streams,
hence no watermark; the checkpoint location makes the file source exactly-once
across restarts.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textmill.sources.jsonl import parse_jsonl_text

RUN_SCHEMA = "run string, global_step long, loss double, valid boolean"
GRAD_ACCUM, LOG_STEPS = 8, 10


def keyed_sink(path: str, key: str):
    """A ``foreachBatch`` sink for update mode: a table with one row per
    ``key``, of which a batch replaces the rows it brings.

    Every key is a partition of its own, overwritten dynamically, so a batch
    touches no other key, and running one again leaves the same table."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("key", F.md5(F.col(key).cast("binary")))
         .repartition("key").write.partitionBy("key").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))
    return sink


def stream_ingest_counts(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str,
                         max_files_per_trigger: int = 1) -> DataFrame:
    """ST2: new JSONL files are scanned with the strict text scan (S1) and the
    running documents / text bytes per group (the ``group=<name>`` folder of
    each file) are kept up to date in ``out_dir`` (see :func:`keyed_sink`)."""
    lines = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
             .option("recursiveFileLookup", "true").text(src_dir)
             .select(F.col("_metadata.file_path").alias("fpath"), F.lit(0).cast("long").alias("line_no"),
                     F.col("value").alias("raw")))
    docs = parse_jsonl_text(lines, "strict")
    g = docs.groupBy(F.regexp_extract("fpath", "group=([^/]+)", 1).alias("group")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    q = (g.writeStream.outputMode("update").foreachBatch(keyed_sink(out_dir, "group"))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("group string, docs long, bytes long").parquet(out_dir).select("group", "docs", "bytes")


# --- ordered state per run
WINDOW_OUT = "run string, global_step long, optimizer_step long, train_loss double, n_losses long"
#: Runs share a state by the hash of their name, so that a batch calls the state once a bucket, not once a run.
BUCKETS = 512
#: Micro-steps in one stretch that waits.
STRETCH = 1 << 12
_OPEN = ("runs array<string>, updates array<long>, win_sum array<double>, win_cnt array<long>, next_step array<long>, "
         "wait_run array<long>, wait_first array<long>, wait_last array<long>, wait_key array<long>, stretches long")


def close_runs(rule, run, step, loss, valid, updates, win_sum, win_cnt):
    """The windows that close within the contiguous micro-steps of many runs.

    ``run`` numbers the run of every micro-step; rows are in order of run and
    step.  ``updates``, ``win_sum`` and ``win_cnt`` have the open window of
    every run and are brought up to date.  Returns ``(run, global_step,
    optimizer_step, train_loss, n_losses)`` arrays of the closed windows."""
    if rule == "summary":
        run, step, loss = run[valid], step[valid], loss[valid]
    if not len(run):
        return run, step, step, loss, step
    u = (step % GRAD_ACCUM == 0).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lasts, own, sizes = np.r_[starts[1:], len(run)] - 1, run[starts], np.diff(np.r_[starts, len(run)])
    total = np.cumsum(u)
    cum = total + np.repeat(updates[own] - total[starts] + u[starts], sizes)
    win = (cum - u) // LOG_STEPS - np.repeat(updates[own] // LOG_STEPS, sizes)
    windows = win[lasts] + 1
    first = np.cumsum(windows) - windows
    win += np.repeat(first, sizes)
    sums, counts = np.bincount(win, loss), np.bincount(win)
    sums[first] += win_sum[own]
    counts[first] += win_cnt[own]
    closing = (u == 1) & (cum % LOG_STEPS == 0)
    shut, at = closing[lasts], win[lasts]
    updates[own] = cum[lasts]
    win_sum[own], win_cnt[own] = np.where(shut, 0.0, sums[at]), np.where(shut, 0, counts[at])
    w = win[closing]
    return run[closing], step[closing], cum[closing], (sums[w] / np.maximum(counts[w], 1)).round(9), counts[w].astype(np.int64)


def close_windows(run, rule, cur, updates, win_sum, win_cnt):
    """The windows that close within the contiguous micro-steps ``cur``
    (``global_step, loss, valid``) of a run, and the open window after them.

    An update comes at every 8th global step (summary: whose loss is valid, and
    only valid micro-steps count); a window closes at every 10th update."""
    valid = cur["valid"].astype(bool).to_numpy()
    if not (valid.any() if rule == "summary" else len(cur)):
        return None, (updates, win_sum, win_cnt)
    state = np.array([updates], np.int64), np.array([win_sum], float), np.array([win_cnt], np.int64)
    _, *columns = close_runs(rule, np.zeros(len(cur), np.int64), cur["global_step"].to_numpy(dtype=np.int64),
                             cur["loss"].to_numpy(dtype=float), valid, *state)
    out = pd.DataFrame({"run": run, **dict(zip(("global_step", "optimizer_step", "train_loss", "n_losses"), columns))})
    return out, tuple(x[0].item() for x in state)


class WindowProcessor(StatefulProcessor):
    """Micro-steps carry dense global steps (invalid ones included), so the
    state knows the next expected one of every run.  Stretches ahead of it wait
    in a map by number (files may be picked up in any order), with their bounds
    beside the open windows, and leave it once the steps before them are there."""

    def __init__(self, rule: str):
        self.rule = rule

    def init(self, handle):
        self.open = handle.getValueState("open", _OPEN)
        self.ahead = handle.getMapState("ahead", "key long", "loss array<double>, valid array<boolean>")

    def handleInputRows(self, key, rows, timerValues):
        names, updates, win_sum, win_cnt, step, *waiting, number = self.open.get() if self.open.exists() else ([],) * 9 + (0,)
        new = pd.concat([p[["run", "global_step", "loss", "valid"]] for p in rows], ignore_index=True)
        new = new[new["global_step"].notna()]
        code, names = pd.factorize(pd.concat([pd.Series(names, dtype=object), new["run"].astype(object)]), use_na_sentinel=False)
        names = np.array([*(None if pd.isna(x) else x for x in names), None], object)[:-1]
        run, fresh = code[len(step):], len(names) - len(step)
        updates, win_cnt = (np.r_[np.array(x, np.int64), np.zeros(fresh, np.int64)] for x in (updates, win_cnt))
        win_sum, step = np.r_[np.array(win_sum, float), np.zeros(fresh)], np.r_[np.array(step, np.int64), np.ones(fresh, np.int64)]
        at, loss = new["global_step"].to_numpy(dtype=np.int64), new["loss"].to_numpy(dtype=float)
        valid = new["valid"].astype(bool).to_numpy()
        # in order of run and step; of repeats the first
        order = np.lexsort((at, run))
        order = order[at[order] >= step[run[order]]]
        order = order[np.r_[True, (np.diff(run[order]) != 0) | (np.diff(at[order]) != 0)][:len(order)]]
        run, at, loss, valid = run[order], at[order], loss[order], valid[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(run) != 0) | (np.diff(at) != 1)][:len(run)])
        ends = np.r_[starts[1:], len(run)][:len(starts)]
        # most runs have one stretch that goes on from their last step; the others are looked at one by one
        wait: dict = {}
        for r, *stretch in zip(*waiting):
            wait.setdefault(r, []).append(stretch)
        plain = (at[starts] == step[run[starts]]) & ~np.isin(run[starts], list(wait)) if len(starts) else np.zeros(0, bool)
        stays = np.repeat(plain, ends - starts)
        step[run[starts[plain]]] += (ends - starts)[plain]
        ready = [(run[stays], at[stays], loss[stays], valid[stays])]
        for i in np.flatnonzero(~plain):
            r, k = int(run[starts[i]]), int(starts[i])
            wait.setdefault(r, []).append([int(at[k]), int(at[ends[i] - 1]), -1 - k])
        for r in {int(run[starts[i]]) for i in np.flatnonzero(~plain)}:
            left = []
            # a stretch of this batch goes before one that waited
            for first, last, k in sorted(wait.pop(r), key=lambda x: (x[0], x[2] >= 0)):
                if first > step[r]:
                    if k >= 0:
                        left.append([first, last, k])
                    for a in range(-1 - k, last - first - k, STRETCH) if k < 0 else ():
                        b = min(a + STRETCH, last - first - k)
                        self.ahead.updateValue((number,), (loss[a:b].tolist(), valid[a:b].tolist()))
                        left.append([int(at[a]), int(at[b - 1]), number])
                        number += 1
                    continue
                if last >= step[r]:
                    skip, n = int(step[r]) - first, last + 1 - int(step[r])
                    held = (loss[-1 - k:][:last + 1 - first], valid[-1 - k:][:last + 1 - first]) if k < 0 else self.ahead.getValue((k,))
                    ready.append((np.full(n, r), np.arange(step[r], last + 1), np.array(held[0], float)[skip:], np.array(held[1], bool)[skip:]))
                    step[r] = last + 1
                if k >= 0:
                    self.ahead.removeKey((k,))
            if left:
                wait[r] = left
        run, at, loss, valid = (np.concatenate(x) for x in zip(*ready))
        if len(ready) > 1:
            order = np.lexsort((at, run))
            run, at, loss, valid = run[order], at[order], loss[order], valid[order]
        run, *columns = close_runs(self.rule, run, at, loss, valid, updates, win_sum, win_cnt)
        if len(run):
            yield pd.DataFrame({"run": names[run], **dict(zip(("global_step", "optimizer_step", "train_loss", "n_losses"), columns))})
        waiting = [list(x) for x in zip(*((r, *stretch) for r, found in wait.items() for stretch in found))] or [[]] * 4
        self.open.update((names.tolist(), updates.tolist(), win_sum.tolist(), win_cnt.tolist(), step.tolist(), *waiting, number))

    def close(self):
        pass


@contextmanager
def _typed_state(spark: SparkSession):
    """Typed state needs the RocksDB state store while a query starts."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)


def stream_run_windows(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str, rule: str = "base",
                       max_files_per_trigger: int = 1) -> DataFrame:
    """ST1: logged windows of every run, by the base or the summary rule of
    :func:`textmill.operators.runlog.train_log_windows`, from a stream of log
    files.  State is kept by buckets of runs (see :class:`WindowProcessor`)."""
    s = spark.readStream.schema(RUN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(src_dir)
    s = s.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(BUCKETS)))
    w = s.groupBy("bucket").transformWithStateInPandas(WindowProcessor(rule), WINDOW_OUT, "Append", "None")
    with _typed_state(spark):
        q = (w.writeStream.outputMode("append").format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(WINDOW_OUT).parquet(out_dir)
