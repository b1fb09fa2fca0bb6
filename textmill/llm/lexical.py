"""Ranked lexical search over a length-stratified index.

A document's normaliser ``m`` only depends on its length, so documents of equal
``m`` form a stratum.  The index holds each stratum in blocks: the block's terms
in hash order, each term's postings by falling term frequency, in runs of equal
frequency.  In a block the impact of a posting is a function of its frequency
alone and is worked out once per run.  A term's first run has its greatest
impact, so the weighted sum of first impacts bounds every score in the block.

Search takes the items in parts.  One pass over the terms alone gives document
frequencies, one gives the stratum bounds.  Each item first visits the strata
with the greatest bounds, until they hold ``first`` documents; its k-th score
there is the least that any other document must reach, so the second visit only
opens blocks with at least this bound.  Nothing else is left out: the result is
that of scoring every document.

Terms are compared by 64-bit hashes.  The block sizes, the items of a part and
the documents of the first visit are parameters and never change results.

Defined results: a null text has no terms; a document or an item without terms
matches nothing; rows that repeat a ``doc_id`` or an ``item_id`` are documents
or items of their own; null ids come last among equal scores; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import stage, text_slices, trimmed
from textmill.llm.hashed_words import hashed_words

TOP = 20
#: Terms, with repeats, of the documents of a block.
BLOCK_TERMS = 2_000_000
#: Documents of a block; their numbers have two bytes.
BLOCK_DOCS = 1 << 15
#: Strata with more blocks than one that the driver knows of; any further one has one hash bucket.
SPLIT_STRATA = 10_000
#: Items searched together, and bytes of their texts (one item at least).
PART_ITEMS, PART_BYTES = 512, 1 << 20

BLOCK = "m long, docs array<long>, terms binary, run_at binary, run_tf binary, run_to binary, members binary"


class Index:
    """``blocks``: the written index; ``n_docs`` and ``n_terms``: the documents with terms, and their terms with repeats."""

    def __init__(self, blocks, n_docs, n_terms):
        self.blocks, self.n_docs, self.n_terms = blocks, n_docs, n_terms


def lengths(docs: DataFrame) -> DataFrame:
    """``(n, docs)``: documents by their number of terms, those without terms left out."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in text_slices(batches):
            _, ends = hashed_words(batch.column(0), terms=True)
            n, docs = np.unique(np.diff(ends), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs)], names=["n", "docs"])

    return docs.select("text").mapInArrow(count, "n long, docs long").where("n > 0").groupBy("n").agg(F.sum("docs").alias("docs"))


def normaliser(n, n_docs: int, n_terms: int):
    return 100 - 25 + (25 * n * n_docs) // n_terms


def _pack(docs, terms, tfs, m):
    """The index row of documents of the stratum ``m``: their ids, and per document sorted terms and their frequencies."""
    import numpy as np

    member = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(t) for t in terms])
    term, tf = np.concatenate(terms), np.concatenate(tfs)
    order = np.lexsort((-tf.astype(np.int64), term))
    term, tf, member = term[order], tf[order], member[order]
    new_term = np.r_[True, term[1:] != term[:-1]]
    new_run = new_term | np.r_[True, tf[1:] != tf[:-1]]
    runs = np.flatnonzero(new_run)
    run_at = np.r_[np.flatnonzero(new_term[runs]), len(runs)].astype(np.uint32)
    return (m, docs, term[new_term].tobytes(), run_at.tobytes(), tf[runs].astype(np.uint32).tobytes(),
            np.r_[runs, len(term)].astype(np.uint32).tobytes(), member.tobytes())


def build(docs: DataFrame, block_terms: int = BLOCK_TERMS, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of all documents.

    The texts are read twice: for the lengths, which fix the strata, and for
    the postings, which are shuffled once, packed by document.  A stratum with
    more than a block is dealt over as many hash buckets as it needs blocks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_length = stage(lengths(docs), "lexical-lengths")
    n_docs, n_terms = by_length.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0))).first()
    if not n_docs:
        return Index(spark.createDataFrame([], BLOCK), 0, 0)
    m = F.expr(f"75 + cast(n as decimal(38, 0)) * {25 * n_docs} div {n_terms}")
    blocks = F.ceil(F.greatest(F.sum(F.col("n") * F.col("docs")) / block_terms, F.sum("docs") / block_docs)).cast("int")
    split = dict(by_length.groupBy(m.alias("m")).agg(blocks.alias("b")).where("b > 1").orderBy(F.desc("b"), "m").limit(SPLIT_STRATA).collect())

    def post(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in text_slices(batches):
            term, ends = hashed_words(batch.column(1), terms=True)
            n = np.diff(ends)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((term, row))
            term, row = term[order], row[order]
            new = np.flatnonzero(np.r_[len(term) > 0, (term[1:] != term[:-1]) | (row[1:] != row[:-1])][:len(term)])
            tf = np.diff(np.r_[new, len(term)]).astype(np.uint32)
            term, at = term[new], np.searchsorted(row[new], np.arange(len(n) + 1))
            strata = [normaliser(x, n_docs, n_terms) for x in n.tolist()]
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([strata[i] for i in held], pa.int64()),
                pa.array([(turn + 7919 * int(i)) % split.get(strata[i], 1) for i in held], pa.int32()),
                batch.column(0).take(pa.array(held)),
                pa.array([term[at[i]:at[i + 1]].tobytes() for i in held], pa.binary()),
                pa.array([tf[at[i]:at[i + 1]].tobytes() for i in held], pa.binary())], names=["m", "part", "doc_id", "terms", "tfs"])
            turn += len(n)

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 5
        names = ["m", "docs", "terms", "run_at", "run_tf", "run_to", "members"]
        row = lambda held, m: pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(_pack(*zip(*held), m), kinds)], names=names)
        held, size, now = [], 0, None
        for batch in batches:
            for m, part, doc, terms, tfs in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((m, part) != now or size >= 2 * block_terms or len(held) >= 2 * block_docs):
                    yield row(held, now[0])
                    held, size = [], 0
                now = m, part
                held.append((doc, np.frombuffer(terms, np.uint64), np.frombuffer(tfs, np.uint32)))
                size += len(held[-1][1])
        if held:
            yield row(held, now[0])

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_terms // (4 * block_terms)))
    posted = docs.select("doc_id", "text").mapInArrow(trimmed(post), "m long, part int, doc_id long, terms binary, tfs binary")
    packed = posted.repartition(width, "m", "part").sortWithinPartitions("m", "part").mapInArrow(trimmed(pack), BLOCK)
    return Index(stage(packed, "lexical-index"), n_docs, n_terms)


class Part:
    """Some items as flat arrays: the sorted terms, and each item's terms by number, with their repeats."""

    def __init__(self, ids, texts):
        import numpy as np
        import pyarrow as pa

        self.ids = ids
        found, ends = hashed_words(pa.array(texts, pa.large_string()), terms=True)
        self.terms, number = np.unique(found, return_inverse=True)
        self.items = [np.unique(number[a:b], return_counts=True) for a, b in zip(ends, ends[1:])]


def _parts(items: DataFrame, most_items: int, most_bytes: int):
    ids, texts, size = [], [], 0
    for i, text in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        n = len(text.encode())
        if ids and (len(ids) >= most_items or size + n > most_bytes):
            yield Part(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += n
    if ids:
        yield Part(ids, texts)


def _held(wanted, terms):
    """Which of the sorted ``wanted`` terms a block holds, and where in ``terms``."""
    import numpy as np

    at = np.searchsorted(terms, wanted)
    mine = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == wanted)
    return mine, at[mine]


def _impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _rows(batches, *kinds):
    """The rows of index batches, their binary columns as arrays."""
    import numpy as np

    for batch in batches:
        yield from zip(*(c.to_pylist() if k is None else [np.frombuffer(v.as_py(), k) for v in c] for c, k in zip(batch.columns, kinds)))


def _document_frequencies(index: Index, part) -> list:
    """The number of documents with each of the part's terms."""
    from pyspark.sql.types import LongType, StructField, StructType

    terms = part.value.terms

    def count(batches):
        import numpy as np
        import pyarrow as pa

        wanted, n = part.value.terms, np.zeros(len(part.value.terms), np.int64)
        for own, run_at, run_to in _rows(batches, np.uint64, np.uint32, np.uint32):
            mine, at = _held(wanted, own)
            n[mine] += run_to[run_at[at + 1]].astype(np.int64) - run_to[run_at[at]]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    schema = StructType([StructField("term", LongType()), StructField("n", LongType())])
    got = index.blocks.select("terms", "run_at", "run_to").mapInArrow(count, schema).groupBy("term").agg(F.sum("n")).collect()
    out = [0] * len(terms)
    for t, n in got:
        out[t] = n
    return out


def _bounds(part, weights, m, terms, run_at, run_tf):
    """The items' bounds in a block, and the numbers of its terms in the part and in the block."""
    import numpy as np

    mine, at = _held(part.terms, terms)
    best = np.zeros(len(part.terms), np.int64)
    best[mine] = weights[mine] * _impact(run_tf[run_at[at]].astype(np.int64), m)
    return np.array([int((best[t] * q).sum()) for t, q in part.items], np.int64), mine, at


def _first_visits(index: Index, part, weights, first: int):
    """Per item the least stratum bound of its first visit: the strata with the
    greatest bounds, as far as those before hold fewer than ``first`` documents."""
    import numpy as np

    def bound(batches):
        import pyarrow as pa

        p, w, strata = part.value, weights.value, {}
        for m, docs, terms, run_at, run_tf in _rows(batches, None, None, np.uint64, np.uint32, np.uint32):
            b, _, _ = _bounds(p, w, m, terms, run_at, run_tf)
            most, n = strata.get(m, (np.zeros_like(b), 0))
            strata[m] = np.maximum(most, b), n + docs
            if len(strata) >= 256:
                yield from rows(strata)
                strata = {}
        yield from rows(strata)

    def rows(strata):
        import pyarrow as pa

        for m, (b, n) in strata.items():
            some = np.flatnonzero(b)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), m)), pa.array(b[some]),
                                              pa.array(np.full(len(some), n))], names=["item", "m", "bound", "docs"])

    b = index.blocks.select("m", F.size("docs").cast("long").alias("docs"), "terms", "run_at", "run_tf") \
        .mapInArrow(bound, "item long, m long, bound long, docs long")
    b = b.groupBy("item", "m").agg(F.max("bound").alias("bound"), F.sum("docs").alias("docs"))
    # strata are as few as there are lengths
    before = F.coalesce(F.sum("docs").over(Window.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = np.full(len(part.value.ids), np.iinfo(np.int64).max)
    for i, least in b.withColumn("before", before).where(F.col("before") < first).groupBy("item").agg(F.min("bound")).collect():
        out[i] = least
    return out


def _visit(index: Index, part, weights, least, below, k: int, reach) -> DataFrame:
    """``(item, doc_id, score)``, from each task an item's ``k`` best scores in
    blocks with a bound from ``least`` up, under ``below``; scores under ``reach`` are left out."""
    spark = index.blocks.sparkSession
    limits = spark.sparkContext.broadcast((least, below, reach))

    def score(batches):
        import numpy as np
        import pyarrow as pa

        p, w = part.value, weights.value
        least, below, reach = limits.value
        reach, best = np.maximum(reach, 1), {}
        kinds = None, None, np.uint64, np.uint32, np.uint32, np.uint32, np.uint16
        for m, docs, terms, run_at, run_tf, run_to, members in _rows(batches, *kinds):
            bounds, mine, at = _bounds(p, w, m, terms, run_at, run_tf)
            opened = np.flatnonzero((bounds >= least) & (bounds < below) & (bounds >= reach))
            if not len(opened):
                continue
            where = np.full(len(p.terms), -1)
            where[mine] = at
            impact = np.repeat(_impact(run_tf.astype(np.int64), m), np.diff(run_to.astype(np.int64)))
            start = run_to[run_at]
            no_id = np.array([d is None for d in docs])
            ids = np.array([0 if d is None else d for d in docs], np.int64)
            for i in opened:
                scores = np.zeros(len(docs), np.int64)
                for t, q in zip(*p.items[i]):
                    if (x := where[t]) >= 0:
                        a, b = start[x], start[x + 1]
                        scores[members[a:b]] += w[t] * q * impact[a:b]
                good = np.flatnonzero(scores >= reach[i])
                if not len(good):
                    continue
                if len(good) > k:
                    good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]
                s, d, o = scores[good], ids[good], no_id[good]
                if i in best:
                    s, d, o = (np.concatenate(x) for x in zip(best[i], (s, d, o)))
                order = np.lexsort((d, o, -s))[:k]
                best[i] = s[order], d[order], o[order]
                if len(order) == k:
                    reach[i] = max(reach[i], best[i][0][-1])
        for i, (s, d, o) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(d, mask=o), pa.array(s)], names=["item", "doc_id", "score"])

    return index.blocks.mapInArrow(trimmed(score), "item long, doc_id long, score long")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = TOP, first: int | None = None, part_items: int = PART_ITEMS,
           part_bytes: int = PART_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each row of ``items``."""
    import numpy as np

    spark = index.blocks.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    if not index.n_docs:
        return out
    first = max(50 * k, index.n_docs // 50) if first is None else first
    for p in _parts(items, part_items, part_bytes):
        part = spark.sparkContext.broadcast(p)
        df = _document_frequencies(index, part)
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in df], np.int64))
        opened = _first_visits(index, part, weights, first)
        none, top = np.zeros(len(p.ids), np.int64), np.full(len(p.ids), np.iinfo(np.int64).max)
        near = stage(_ranked(_visit(index, part, weights, opened, top, k, none), k), "lexical-first")
        reach = none.copy()
        for i, s in near.where(F.col("rank") == k).select("item", "score").collect():
            reach[i] = s
        far = _visit(index, part, weights, none, opened, k, reach)
        best = _ranked(near.drop("rank").unionByName(far), k)
        names = spark.createDataFrame(list(enumerate(p.ids)), f"item long, item_id {id_type}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
