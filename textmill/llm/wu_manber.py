"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 words of the benchmark items (the whole item if
it is shorter).  Texts and patterns become numbers of the benchmark's words, by
the words' 64-bit hashes, 0 for any other word.  Patterns of one length share a
table: the shift table says for a hashed block of up to three words how far the
search may jump, the patterns are sorted by the block they end with, then by
their leading block, and a match is confirmed by comparing all words.  Blocks
that no pattern holds skip almost a whole window, so most positions of a clean
text are never looked at.

The benchmark reaches the executors in parts of at most ``part_bytes`` bytes of
text.  A part's tables are flat arrays that are built once, on the driver, and
broadcast: what a task holds doesn't grow with the benchmark.

Defined results: a null text or item has no words; an item without words has no
window; an item with a null id counts under the id ``null``; rows repeating an
item id count as one item; repeated documents are judged alike; with an empty
benchmark nothing is hit; other columns are kept.
"""

from __future__ import annotations

import itertools

import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import fresh, stage, text_slices, trimmed
from textmill.llm.hashed_words import hashed_words

WINDOW = 13
BLOCK = 3
#: Bytes of benchmark text in one broadcast part.
PART_BYTES = 4 << 20

#: Lower-cases A-Z and turns every byte that is no word character into a space;
#: bytes from 0x80 up only occur in characters that are.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def fold_words(raw: bytes) -> list:
    return raw.translate(_FOLD).split()


#: Multiplies block keys for the shift table.
_SPREAD, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Table:
    """Shift table and sorted patterns of one length: ``windows`` (a row of word
    numbers each), ``owner`` the items of window i at ``owner_at[i]:owner_at[i + 1]``."""

    def __init__(self, windows, owner, base: int, block: int):
        import numpy as np

        self.m, self.b, self.base = windows.shape[1], min(block, windows.shape[1]), base
        lead, suffix = self._keys(windows, self.b), self._keys(windows, self.m)
        order = np.lexsort((owner, *windows.T, lead, suffix))
        windows, owner, lead, suffix = windows[order], owner[order], lead[order], suffix[order]
        new = np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)]
        both = new | np.r_[True, owner[1:] != owner[:-1]]
        self.owner, self.owner_at = owner[both], np.r_[np.flatnonzero(new[both]), both.sum()]
        self.windows, self.lead, self.suffix = windows[new], lead[new], suffix[new]
        self.far = min(255, self.m - self.b + 1)
        self.bits = max(10, int(8 * len(self.windows)).bit_length())
        shift = np.full(1 << self.bits, self.far, np.uint8)
        for end in range(self.b, self.m + 1):
            slot = (self._keys(self.windows, end).astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)
            np.minimum.at(shift, slot.astype(np.int64), min(255, self.m - end))
        self.shift = shift.tobytes()

    def _keys(self, windows, end: int):
        """The numbers of the blocks that end before column ``end``, as one number each."""
        key = 0
        for k in range(end - self.b, end):
            key = key * self.base + windows[:, k].astype("int64")
        return key

    def occurrences(self, ids: list):
        """``(start, number of the window)`` of every occurrence in a text's word numbers."""
        from bisect import bisect_left, bisect_right

        m, b, base, shift, down, suffix, lead = self.m, self.b, self.base, self.shift, 64 - self.bits, self.suffix, self.lead
        end, n = m, len(ids)
        while end <= n:
            k = 0
            for x in ids[end - b:end]:
                k = k * base + x
            jump = shift[(k * _SPREAD & _WORD) >> down]
            if jump:
                end += jump
                continue
            lo = bisect_left(suffix, k)
            if lo < len(suffix) and suffix[lo] == k:
                start, first = end - m, 0
                for x in ids[start:start + b]:
                    first = first * base + x
                hi = bisect_right(suffix, k, lo)
                for i in range(bisect_left(lead, first, lo, hi), bisect_right(lead, first, lo, hi)):
                    if self.windows[i].tolist() == ids[start:end]:
                        yield start, i
            end += 1


class Patterns:
    """The tables of ``[(item, text)]``, one per pattern length."""

    def __init__(self, items, window: int = WINDOW, block: int = BLOCK):
        import numpy as np
        import pyarrow as pa

        items = list(items)
        self.names = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.names)}
        found, ends = hashed_words(pa.array([t for _, t in items], pa.large_string()), terms=True)
        self.words, ids = np.unique(found, return_inverse=True)
        ids = (ids + 1).astype(np.int32)
        by_length: dict = {}
        for (item, _), a, e in zip(items, ends, ends[1:]):
            if e > a:
                w = np.lib.stride_tricks.sliding_window_view(ids[a:e], min(window, e - a))
                by_length.setdefault(w.shape[1], []).append((w, np.full(len(w), place[item], np.int32)))
        self.tables = [Table(*(np.concatenate(x) for x in zip(*v)), len(self.words) + 1, block) for _, v in sorted(by_length.items())]

    def numbers(self, hashes):
        import numpy as np

        if not len(self.words):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0).astype(np.int32)

    def search(self, ids: list):
        """``(spans, items)``: merged ``[start, end)`` word spans that windows cover, and the items they belong to."""
        spans, own = [], set()
        for t in self.tables:
            for start, i in t.occurrences(ids):
                spans.append((start, start + t.m))
                own.update(t.owner[t.owner_at[i]:t.owner_at[i + 1]].tolist())
        return merged(spans), sorted(self.names[k] for k in own)


def merged(spans: list) -> list:
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _parts(benchmark: DataFrame, part_bytes: int):
    """The benchmark's items, streamed in lists of at most ``part_bytes`` (one item at least)."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        n = len(r[1].encode())
        if part and size + n > part_bytes:
            yield part
            part, size = [], 0
        part.append((r[0] if r[0] is not None else "null", r[1]))
        size += n
    yield part


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _search(docs: DataFrame, part, window: int, names: list) -> DataFrame:
    """One pass: ``docs`` with the word count, spans and items of one part of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(Patterns(part, window))
    words, spans, items = names
    schema = T.StructType([*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(spans, T.ArrayType(SPAN)),
                           T.StructField(items, T.ArrayType(T.StringType()))])
    at, columns = docs.columns.index("text"), schema.names

    def run(batches):
        import pyarrow as pa

        import numpy as np

        table = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in text_slices(batches):
            hashes, ends = hashed_words(batch.column(at), terms=True)
            ids = table.numbers(hashes)
            # a text without any word of the benchmark holds no pattern
            some = np.add.reduceat(np.r_[ids > 0, False], ends[:-1]) * (np.diff(ends) > 0) if len(ids) else np.zeros(batch.num_rows)
            found = [table.search(ids[a:e].tolist()) if x else ([], []) for x, a, e in zip(some, ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(np.diff(ends), pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in x] for x, _ in found], span),
                pa.array([own for _, own in found], pa.list_(pa.string()))], names=columns)

    return docs.mapInArrow(trimmed(run), schema)


@F.udf(T.ArrayType(SPAN))
def _merged(spans):
    return [tuple(x) for x in merged([(s["start"], s["end"]) for s in spans])]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_hit``, ``spans`` (word spans
    that benchmark windows cover) and ``items`` (ids, sorted as strings).

    A benchmark of one part takes one pass and no shuffle.  A larger one is
    searched part by part over a staged copy of the texts; of each pass only
    the rows with hits are kept, and these meet again by row number."""
    words, hit, spans, items = fresh(["n_words", "n_hit", "spans", "items"], docs.columns)
    parts = _parts(benchmark, part_bytes)
    first, second = next(parts), next(parts, None)
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = [*docs.columns, words, covered.alias(hit), spans, items]
    if second is None:
        return _search(docs, first, window, [words, spans, items]).select(*out)
    row, row1 = fresh(["row", "row1"], [*docs.columns, words, spans, items])
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "bench-docs")
    all_ = _search(numbered, [], window, [words, spans, items]).drop(spans, items)
    narrow, hits = numbered.select(F.col(row).alias(row1), "text"), None
    for part in itertools.chain([first, second], parts):
        one = stage(_search(narrow, part, window, [words, spans, items]).where(F.size(items) > 0).select(row1, spans, items), "bench-hits")
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.groupBy(row1).agg(_merged(F.flatten(F.collect_list(spans))).alias(spans),
                                  F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    none_ = [F.coalesce(spans, F.array().cast(T.ArrayType(SPAN))).alias(spans), F.coalesce(items, F.array().cast("array<string>")).alias(items)]
    return all_.join(hits, F.col(row) == F.col(row1), "left").select(*docs.columns, words, *none_).select(*out)


def contaminated(n_words, n_hit):
    """Hit at all, and in at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, spans, items, contaminated``."""
    r = find(docs.select("doc_id", "text"), benchmark, window)
    return r.withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit"))).drop("text")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    n_words, n_hit = fresh(["n_words", "n_hit"], docs.columns)
    r = find(docs, benchmark, window)
    return r.where(~contaminated(F.col(n_words), F.col(n_hit))).select(*docs.columns)
