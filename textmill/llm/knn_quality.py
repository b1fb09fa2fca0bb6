"""Quality by votes of the nearest labelled texts in a latent-semantic space.

Texts become hashed term vectors: words, and marks of how they are written
(capitals, symbols at the end, only symbols, length, equal to the word before).
A term weighs the root of its share of the text times its inverse document
frequency over all documents; words and marks are scaled to one length each.  A truncated singular value decomposition of a
bounded sample of labelled texts, on the driver, gives the latent space; the
projection and the unit vectors of the labelled texts, both of fixed size, are
broadcast.  Every document is projected and compared with all labelled vectors
in blocks; the ``NEIGHBOURS`` greatest cosines vote with their similarity.

Defined results: a null or empty text, or one that no labelled text resembles,
gets the labels' mean; without labels every score is 0; repeated rows score
alike; an empty table gives an empty result; only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import labelled_sample, left_out, text_bytes, text_slices, trimmed

#: Labelled texts of either label, and their largest size in bytes.
PER_CLASS = 2048
MAX_BYTES = 20_000
TERMS = 1 << 13
LATENT = 48
NEIGHBOURS = 25
#: Labelled vectors compared at once.
BLOCK = 1024
#: Documents turned into dense rows at once.
ROWS = 256
#: The last terms are marks, not hashed words.
MARKS = 16
REPEATED = TERMS - 1


def _mark(word: str) -> int:
    """0 to 14: how the word is written."""
    body = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = len(word) - len(body)
    if not body:
        return 0
    if tail > 1:
        return 1 + min(tail, 4) - 2
    if len(body) > 1 and body.isupper():
        return 4
    if any(c.isdigit() for c in body):
        return 5
    return 6 + min(len(body) // 3, 6) + (2 if body[:1].isupper() and len(body) < 3 else 0)


class _Terms(dict):
    """Word term and mark of a word, kept for up to half a million words."""

    def __missing__(self, raw):
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        word = raw.decode("utf-8", "replace")
        key = "".join(c for c in word.lower() if c.isalnum())
        t = self[raw] = ((xxhash.xxh32_intdigest(key) % (TERMS - MARKS)) << 4) | _mark(word)
        return t


def term_counts(raw: bytes, terms):
    """Counts of a text's terms, and its number of words."""
    import numpy as np

    ws = raw.split()
    t = np.fromiter(map(terms.__getitem__, ws), np.int64, len(ws))
    counts = np.bincount(t >> 4, minlength=TERMS).astype(np.float32)
    counts[TERMS - MARKS:REPEATED] = np.bincount(t & 15, minlength=MARKS)[:MARKS - 1]
    counts[REPEATED] = np.count_nonzero(t[1:] == t[:-1])
    return counts, len(ws)


def weighted(raws: list, idf, terms):
    """Rows of term weights."""
    import numpy as np

    out = np.zeros((len(raws), TERMS), np.float32)
    for k, raw in enumerate(raws):
        counts, n = term_counts(raw, terms)
        if n:
            out[k] = np.sqrt(counts / n) * idf
    words, marks = slice(0, TERMS - MARKS), slice(TERMS - MARKS, TERMS)
    out[:, words], out[:, marks] = unit(out[:, words]), unit(out[:, marks])
    return out


def unit(x):
    import numpy as np

    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-6)


@dataclass
class Model:
    idf: object
    axes: object  # terms x latent
    vectors: object  # labelled unit vectors
    labels: object
    prior: float

    def scores(self, raws: list, terms):
        import numpy as np

        if not len(self.labels):
            return np.full(len(raws), self.prior)
        out = np.empty(len(raws))
        for at in range(0, len(raws), ROWS):
            q = unit(weighted(raws[at:at + ROWS], self.idf, terms) @ self.axes)
            best = near = None
            for b in range(0, len(self.labels), BLOCK):
                sims = q @ self.vectors[b:b + BLOCK].T
                ys = np.broadcast_to(self.labels[b:b + BLOCK], sims.shape)
                if best is not None:
                    sims, ys = np.hstack([best, sims]), np.hstack([near, ys])
                if sims.shape[1] > NEIGHBOURS:
                    top = np.argpartition(-sims, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
                    sims, ys = np.take_along_axis(sims, top, 1), np.take_along_axis(ys, top, 1)
                best, near = sims, ys
            vote = np.maximum(best, 0.0).astype(float)
            total = vote.sum(axis=1)
            out[at:at + ROWS] = np.where(total > 1e-9, (vote * near).sum(axis=1) / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0.0, 1.0)


def document_frequencies(docs: DataFrame):
    """Number of texts and, by term, the texts that hold it, over all documents."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        terms, held, n = _Terms(), np.zeros(TERMS, np.int64), 0
        for batch in text_slices(batches):
            for raw in text_bytes(batch.column("text")):
                held += term_counts(raw, terms)[0] > 0
                n += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1], pa.int32()), pa.array(np.r_[held[at], n], pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(trimmed(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(TERMS), 0
    for term, n in rows:
        if term < 0:
            total = n
        else:
            out[term] = n
    return total, out


def latent_axes(x, k: int = LATENT, turns: int = 4, seed: int = 0):
    """Leading right singular vectors of ``x`` by subspace iteration."""
    import numpy as np

    k = min(k, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(k + 10, *x.shape))).astype(np.float32)
    for _ in range(turns):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray(q @ v[:k].T)


def fit(sample: list, total: int, held) -> Model:
    """The model for ``[(text bytes, 0 or 1)]`` and the document frequencies of the corpus."""
    import numpy as np

    labels = np.array([y for _, y in sample], float)
    prior = float(labels.mean()) if len(labels) else 0.0
    idf = np.log((1 + total) / (1 + held)).astype(np.float32) + np.float32(0.1)
    if not len(labels):
        return Model(idf, None, None, labels, prior)
    x = weighted([t for t, _ in sample], idf, _Terms())
    axes = latent_axes(x)
    return Model(idf, axes, unit(x @ axes), labels, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m, terms = shared.value, _Terms()
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.scores(text_bytes(batch.column("text")), terms), pa.float64())],
                                             names=["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {id_type}, score double")


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model:
    """The model from the labels whose ids don't leave ``remainder``."""
    total, held = document_frequencies(docs)
    return fit(labelled_sample(docs, labels, "quality", ~left_out(modulus, remainder), PER_CLASS, MAX_BYTES), total, held)
