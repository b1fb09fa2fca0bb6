"""Subword lattice likelihood of texts under a unigram model.

The pieces are those of an existing public vocabulary, which is never trained.
A word is its bytes behind a space mark; its lattice has an edge for every
piece that spells some of these bytes, single bytes included, so each word has a
path.  A text's probability is the sum over all segmentations of the products of
the pieces' probabilities.  No piece reaches over a space, so the sum is the
product of the words' sums, and the forward recursion in log space runs once for
every distinct word, words of one length side by side.

The pieces' scores start from the vocabulary's own (its ranks, as a Zipf law)
and are fitted to the training texts by expectation maximisation: the
forward-backward posteriors of all pieces, weighted by how often each distinct
word occurs, are summed over all executors; the driver only holds one number
per piece.  The vocabulary's scores stay in as prior counts.

Word counts cover all documents: tasks count their own words, the counts meet by
word.  The most frequent words, at most ``HOT_WORDS``, are broadcast; the
documents' other words are joined to the table of words by their hash.

Words are compared by 64-bit hashes.  Defined results: a null text is empty and
consists of the end alone; a null ``doc_id`` is never held out; repeated rows
are documents of their own; with an empty table there is no row and without
training text the vocabulary's own scores hold; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import stage, text_slices, trimmed
from textmill.llm.hashed_words import _powers, _tables, buffers, hashed_words

#: Where the public vocabulary lies on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Prior observations of a piece, on average.
PRIOR = 1.0
#: Words that are broadcast with their counts and scores, at most.
HOT_WORDS = 1 << 18
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 1 << 20
#: Words of one length side by side; longer ones than LONG bytes one at a time.
SIDE_BY_SIDE, LONG = 1 << 14, 64


class Pieces:
    """Log probabilities of pieces, found by the hashes of their bytes."""

    def __init__(self, spelled: list, weights):
        import numpy as np

        self.spelled = spelled
        self.prior = np.asarray(weights) / np.sum(weights)
        by_length: dict = {}
        for i, h in enumerate(_hashes(spelled)):
            by_length.setdefault(len(spelled[i]), []).append((h, i))
        self.by_length = {n: tuple(np.array(x, t) for x, t in zip(zip(*sorted(v)), (np.uint64, np.int64))) for n, v in sorted(by_length.items())}
        self.fit(np.zeros(len(spelled)), 0, 0.0)

    def fit(self, counts, ends: int, prior: float) -> None:
        """Scores from the expected ``counts`` of the pieces, ``ends`` of texts and ``prior`` observations of the prior."""
        import numpy as np

        held = counts + max(prior, 1.0) * self.prior
        total = held.sum() + ends + 1
        self.end = math.log((ends + 1) / total)
        # the last score is that of no piece
        self.scores = np.r_[np.log(held / total), -np.inf]


def _hashes(spelled: list):
    import numpy as np

    values, power = _tables()[0], _powers(1 << 10)[0]
    return [int((values[np.frombuffer(p, np.uint8)] * power[:len(p)]).sum()) for p in spelled]


def vocabulary(path: str = VOCABULARY) -> Pieces:
    """The pieces that can occur in lower-cased words, weighted by the vocabulary's order.

    Pieces with A-Z or white space can't occur.  A byte that no piece spells is
    a piece of its own, behind all others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        p = model.id_to_piece(i)
        raw = (" " + p[1:] if p.startswith("▁") else p).encode()
        if "▁" in p[1:] or any(0x41 <= c <= 0x5A for c in raw) or raw[1:].split() != [raw[1:]] * (len(raw) > 1) or raw[:1] in b"\t\n\x0b\f\r":
            continue
        found.setdefault(raw, -model.get_score(i))
    last = max(found.values(), default=0.0) + 1
    for c in range(256):
        found.setdefault(bytes([c]), last + c)
    spelled = sorted(found, key=lambda p: (found[p], p))
    return Pieces(spelled, [1 / (2.7 + k) for k in range(len(spelled))])


def _logsum(x, axis=0):
    import numpy as np

    top = x.max(axis)
    top = np.where(np.isneginf(top), 0.0, top)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _edges(pieces: Pieces, m):
    """Per length and start the pieces that spell this stretch of each row of the byte matrix ``m`` (-1: none)."""
    import numpy as np

    values = _tables()[0]
    rows, n = m.shape
    power, inverse = _powers(max(64, 1 << (n - 1).bit_length()))
    sums = np.zeros((n + 1, rows), np.uint64)
    np.cumsum((values[m] * power[:n]).T, axis=0, out=sums[1:])
    for size, (hashes, ids) in pieces.by_length.items():
        if size > n:
            return
        h = (sums[size:] - sums[:n + 1 - size]) * inverse[:n + 1 - size, None]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        yield size, np.where(hashes[at] == h, ids[at], -1)


def _forward(pieces: Pieces, edges: dict, n: int, rows: int):
    """``alpha[j]``: the log of the summed probabilities of all ways to spell the first ``j`` bytes."""
    import numpy as np

    alpha = np.full((n + 1, rows), -np.inf)
    alpha[0] = 0.0
    for j in range(1, n + 1):
        alpha[j] = _logsum(np.stack([alpha[j - size] + pieces.scores[e[j - size]] for size, e in edges.items() if size <= j]))
    return alpha


def _expected(pieces: Pieces, edges: dict, alpha, weights, into) -> None:
    """Adds the posterior counts of all pieces, times ``weights``."""
    import numpy as np

    n = len(alpha) - 1
    beta = np.full(alpha.shape, -np.inf)
    beta[n] = 0.0
    for i in range(n - 1, -1, -1):
        beta[i] = _logsum(np.stack([beta[i + size] + pieces.scores[e[i]] for size, e in edges.items() if i + size <= n]))
    for size, e in edges.items():
        i, row = np.nonzero(e >= 0)
        ids = e[i, row]
        share = np.exp(alpha[i, row] + pieces.scores[ids] + beta[i + size, row] - alpha[n, row])
        into += np.bincount(ids, share * weights[row], len(into))


def _long_score(pieces: Pieces, word, weight=None, into=None) -> float:
    """The same for one long word, whose stretches of a length are side by side."""
    import numpy as np

    n = len(word)
    edges = {size: e[:, 0] for size, e in _edges(pieces, word[None, :])}
    sizes = np.array(list(edges))
    most = int(sizes.max())
    ids = np.full((len(sizes), n + 1), -1)  # by the place where the piece ends
    for k, (size, e) in enumerate(edges.items()):
        ids[k, size:] = e
    s = pieces.scores[ids]
    alpha = np.full(most + n + 1, -np.inf)
    alpha[most] = 0.0
    for j in range(1, n + 1):
        alpha[most + j] = _logsum(alpha[most + j - sizes] + s[:, j])
    if into is not None:
        beta = np.full(n + 1 + most, -np.inf)
        beta[n] = 0.0
        first = np.full((len(sizes), n + 1 + most), -np.inf)  # by the place where it begins
        for k, size in enumerate(sizes):
            first[k, :n + 1 - size] = s[k, size:]
        for i in range(n - 1, -1, -1):
            beta[i] = _logsum(beta[i + sizes] + first[:, i])
        k, j = np.nonzero(ids >= 0)
        share = np.exp(alpha[most + j - sizes[k]] + s[k, j] + beta[j] - alpha[most + n])
        into += np.bincount(ids[k, j], share * weight, len(into))
    return float(alpha[most + n])


def word_scores(pieces: Pieces, words, weights=None, into=None):
    """Log probabilities of an Arrow column of words; with ``weights`` the
    expected piece counts are added to ``into``."""
    import numpy as np

    bounds, data = buffers(words)
    length = np.diff(bounds)
    out = np.zeros(len(length))
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        n = int(length[order[at]])
        if n >= LONG:
            i = order[at]
            word = np.r_[np.uint8(0x20), data[bounds[i]:bounds[i + 1]]]
            out[i] = _long_score(pieces, word, None if weights is None else weights[i], into)
            at += 1
            continue
        to = min(at + SIDE_BY_SIDE, int(np.searchsorted(length[order], n, "right")))
        rows = order[at:to]
        m = np.full((len(rows), n + 1), 0x20, np.uint8)
        m[:, 1:] = data[bounds[rows][:, None] + np.arange(n)]
        edges = dict(_edges(pieces, m))
        alpha = _forward(pieces, edges, n + 1, len(rows))
        out[rows] = alpha[-1]
        if into is not None:
            _expected(pieces, edges, alpha, weights[rows], into)
        at = to
    return out


def word_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Staged ``(hash, word, c, n)``: how often each word occurs in the training texts and in all."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        lower = np.arange(256, dtype=np.uint8)
        lower[0x41:0x5B] += 32
        names = ["hash", "word", "c", "n"]

        def merged(held):
            h, c, n = (np.concatenate(x) for x in list(zip(*held))[:3])
            words = pa.concat_arrays([x[3] for x in held])
            some, first, at = np.unique(h, return_index=True, return_inverse=True)
            c, n = (np.bincount(at, x, len(some)).astype(np.int64) for x in (c, n))
            return some, c, n, words.take(pa.array(first))

        held, size = [], 0
        for batch in text_slices(batches):
            h, ends, first, last = hashed_words(batch.column(0), spans=True)
            if not len(h):
                continue
            data = buffers(batch.column(0))[1]
            train = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(ends))
            some, place, at, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            length = last[place] - first[place] + 1
            offsets = np.r_[0, np.cumsum(length)]
            taken = lower[data[np.repeat(first[place] - offsets[:-1], length) + np.arange(offsets[-1])]]
            words = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(taken.tobytes())])
            held.append((some, np.bincount(at, train, len(some)).astype(np.int64), n.astype(np.int64), words))
            size += len(some)
            if size >= HELD_WORDS:
                held, size = [merged(held)], 0
                size = len(held[0][0])
                if size >= HELD_WORDS // 2:
                    yield rows(held[0], names)
                    held, size = [], 0
        if held:
            yield rows(merged(held), names)

    def rows(x, names):
        import numpy as np
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), x[3].cast(pa.binary()), pa.array(x[1]), pa.array(x[2])], names=names)

    t = docs.select("text", (~held_out).alias("train")).mapInArrow(trimmed(count), "hash long, word binary, c long, n long")
    return stage(t.groupBy("hash", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lattice-words")


def train(words: DataFrame, ends: int, pieces: Pieces, rounds: int = ROUNDS, prior: float = PRIOR) -> Pieces:
    """``pieces`` fitted to the training counts ``c`` of ``words`` and to ``ends`` training texts."""
    import numpy as np

    spark = words.sparkSession
    known = words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)

        def expect(batches, shared=shared):
            import pyarrow as pa

            p = shared.value
            into = np.zeros(len(p.spelled))
            for b in batches:
                word_scores(p, b.column(0), b.column(1).to_numpy(zero_copy_only=False), into)
            some = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(into[some])], names=["piece", "n"])

        got = known.mapInArrow(trimmed(expect), "piece long, n double").groupBy("piece").agg(F.sum("n")).collect()
        counts = np.zeros(len(pieces.spelled))
        for i, n in got:
            counts[i] = n
        pieces.fit(counts, ends, prior * len(pieces.spelled))
    return pieces


def _scored(words: DataFrame, pieces: Pieces) -> DataFrame:
    """Staged ``(hash, c, n, p)``: the words with their log probabilities."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(word_scores(shared.value, b.column(1)))],
                                             names=["hash", "c", "n", "p"])

    return stage(words.mapInArrow(trimmed(run), "hash long, c long, n long, p double"), "lattice-scores")


def _frequent(scored: DataFrame, most: int) -> tuple:
    """The least count that at most ``most`` words reach, in powers of two, and those words as sorted arrays."""
    import numpy as np

    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    by, held, least = dict(scored.groupBy(power.alias("k")).agg(F.count(F.lit(1))).collect()), 0, 63
    for k in sorted(by, reverse=True):
        if held + by[k] > most:
            break
        held, least = held + by[k], k
    t = scored.where(power >= least).select("hash", "c", "p").toArrow()
    h = t.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return 1 << least, (h[order], t.column("c").to_numpy()[order], t.column("p").to_numpy()[order])


def score(docs: DataFrame, held_out: Column, path: str = VOCABULARY, rounds: int = ROUNDS, prior: float = PRIOR,
          hot_words: int = HOT_WORDS) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score`` (log10 under add-one word counts) and ``score`` (log10 under the lattice)."""
    spark = docs.sparkSession
    words = word_counts(docs, held_out)
    ends = docs.where(~held_out).count()
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    pieces = train(words, ends, vocabulary(path), rounds, prior)
    scored = _scored(words, pieces)
    _, frequent = _frequent(scored, hot_words)
    hot = spark.sparkContext.broadcast(frequent)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["row", "doc_id", "held_out", "words", "known", "base", "p", "rest"]
        at, (hashes, c, p) = TaskContext.get().partitionId() << 33, hot.value
        log_c = np.log10(c + 1.0)
        for batch in text_slices(batches):
            h, ends = hashed_words(batch.column(2))
            n = np.diff(ends)
            row = np.repeat(np.arange(len(n)), n)
            i = np.searchsorted(hashes, h)
            mine = np.zeros(len(h), bool) if not len(hashes) else hashes[np.minimum(i, len(hashes) - 1)] == h
            i, by = i[mine], row[mine]
            rest = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[~mine], minlength=len(n)))].astype(np.int32)),
                                            pa.array(h[~mine].view(np.int64)))
            sums = lambda x: np.bincount(by, x, len(n)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(at, at + len(n))), batch.column(0), batch.column(1), pa.array(n), pa.array(sums(c[i] > 0).astype(np.int64)),
                pa.array(sums(log_c[i])), pa.array(sums(p[i])), rest], names=names)
            at += len(n)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", held_out.alias("held_out"), "text")
    d = stage(d.mapInArrow(trimmed(run), f"row long, doc_id {id_type}, held_out boolean, words long, known long, base double, p double, rest array<long>"),
              "lattice-docs")
    rest = d.select("row", F.explode("rest").alias("hash")).join(scored.select("hash", "c", F.col("p").alias("p1")), "hash")
    rest = rest.groupBy("row").agg(F.count(F.when(F.col("c") > 0, 1)).alias("known1"), F.sum(F.log10(F.col("c") + 1.0)).alias("base1"), F.sum("p1").alias("p1"))
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    base = add("base", "base1") + math.log10(ends + 1) - (F.col("words") + 1) * math.log10(tokens + distinct + 1)
    return d.drop("rest").join(rest, "row", "left").select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (add("known", "known1") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), ((add("p", "p1") + pieces.end) / math.log(10)).alias("score"))
