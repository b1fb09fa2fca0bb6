"""Postings: which references share a key, for very many short-lived keys.

Keys and references are packed into byte strings by bucket of the key, so that
Spark shuffles a few rows per task and bucket instead of one per posting, and
numpy sorts each bucket.  Within a task, references that share a key are paired
off before the shuffle and only one of them goes on; a key that a third of all
rows hold sends one posting per task to its bucket, and its other members
are spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from textmill.llm.common import stage, trimmed

#: Postings that a task sorts at once, before the shuffle and about as many after it.
POSTINGS = 1_000_000


def _runs(keys, refs):
    """Sorted ``keys`` and ``refs`` without repeats, with each row's run number and the runs' starts."""
    import numpy as np

    order = np.lexsort((refs, keys))
    k, r = keys[order], refs[order]
    if not len(k):
        return k, r, np.empty(0, np.intp), np.empty(0, np.intp)
    new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
    k, r = k[new], r[new]
    first = np.r_[True, k[1:] != k[:-1]]
    return k, r, np.cumsum(first) - 1, np.flatnonzero(first)


def width_for(spark, postings: int) -> int:
    """Buckets for so many postings."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // POSTINGS))


def shared(df: DataFrame, emit, width: int, name: str) -> DataFrame:
    """Staged ``(key, leader, ref)``: the members of every key that several
    references post.  ``emit`` turns an iterator of Arrow batches of ``df`` into
    ``(uint64 keys, ref)`` pairs; ``leader`` is the member that the row's task
    compared with, and a member of the key itself."""

    def post(batches):
        import numpy as np
        import pyarrow as pa

        names = ["bucket", "keys", "refs", "run_keys", "run_leaders", "run_refs"]

        def flush(keys, refs, turn):
            keys, refs = np.concatenate(keys), np.concatenate(refs)
            k, r, run, starts = _runs(keys, refs)
            size = np.bincount(run, minlength=len(starts))
            lead = r[starts]
            several = size[run] > 1
            rk, rl, rr = k[several], lead[run][several], r[several]
            # postings in order of the reference, which compresses well
            k, r = k[starts], r[starts]
            order = np.argsort(r, kind="stable")
            k, r = k[order], r[order]
            to, run_to = (k % np.uint64(width)).astype(np.int64), ((rk + np.uint64(turn)) % np.uint64(width)).astype(np.int64)
            by, run_by = np.argsort(to, kind="stable"), np.argsort(run_to, kind="stable")
            cut, run_cut = np.searchsorted(to[by], range(width + 1)), np.searchsorted(run_to[run_by], range(width + 1))
            rows = []
            for b in range(width):
                p, q = by[cut[b]:cut[b + 1]], run_by[run_cut[b]:run_cut[b + 1]]
                if len(p) or len(q):
                    rows.append((b, k[p].tobytes(), r[p].tobytes(), rk[q].tobytes(), rl[q].tobytes(), rr[q].tobytes()))
            kinds = [pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        keys, refs, held, turn = [], [], 0, 0
        for got, ref in emit(batches):
            if len(got):
                keys.append(got)
                refs.append(np.full(len(got), ref, np.int64))
                held += len(got)
                if held >= POSTINGS:
                    yield flush(keys, refs, turn)
                    keys, refs, held, turn = [], [], 0, turn + 1
        if held:
            yield flush(keys, refs, turn)

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        keys, refs = [], []
        names = ["key", "leader", "ref"]
        as_long = lambda k: pa.array(k.view(np.int64))
        for batch in batches:
            for _, k, r, rk, rl, rr in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(np.frombuffer(k, np.uint64))
                refs.append(np.frombuffer(r, np.int64))
                if rk:
                    yield pa.RecordBatch.from_arrays([as_long(np.frombuffer(rk, np.uint64)), pa.array(np.frombuffer(rl, np.int64)),
                                                      pa.array(np.frombuffer(rr, np.int64))], names=names)
        if keys:
            k, r, run, starts = _runs(np.concatenate(keys), np.concatenate(refs))
            several = np.bincount(run, minlength=len(starts))[run] > 1
            yield pa.RecordBatch.from_arrays([as_long(k[several]), pa.array(r[starts][run][several]), pa.array(r[several])], names=names)

    posted = df.mapInArrow(trimmed(post), "bucket int, keys binary, refs binary, run_keys binary, run_leaders binary, run_refs binary")
    return stage(posted.repartition(width, "bucket").mapInArrow(trimmed(meet), "key long, leader long, ref long"), name)
