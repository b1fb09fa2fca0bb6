"""Toxic spans by a linear-chain conditional random field.

There are labelled documents but no labelled tokens: a word of a toxic text is
labelled toxic when it is much more frequent in toxic texts than in clean ones.
So the chain learns a derived list of words, their parts and their neighbours.

Tokens are words with two states, clean and toxic.  A token's score for the
toxic state adds weights of hashed features of the word (the word, its first
three to five letters, its last three), and transition weights link
neighbours, so that a mild word next to toxic ones gains.  Maximum likelihood
fits the weights on the driver to a bounded sample of labelled documents.

A text is one chain.  Its stretches of ``CHUNK`` tokens run side by side: each
one's product of transfer matrices carries the messages over it, so forward and
backward messages enter every stretch as if the chain had been walked from its
ends.  The marginals of the toxic state give the offending spans (runs with a marginal of one half or more)
and the document's score, by a logistic function of the expected number of
toxic tokens, their share and the greatest marginal.

Defined results: null and empty texts have no tokens and get the score of a
text without any toxic token; without labels of both kinds every score is the
labels' mean, 0 without labels; repeated rows score alike; an empty table gives
an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import labelled_sample, left_out, text_bytes, text_slices, trimmed
from textmill.llm.wu_manber import fold_words

#: Training texts of either label, and their largest size in bytes.
PER_CLASS = 2000
MAX_BYTES = 20_000
#: Tokens of a stretch.
CHUNK = 64
BITS = 18
STEPS = 60
#: A training token is labelled toxic from this log-odds and share of the toxic
#: texts (and number of texts) on; of rarer words with such odds, which may
#: just come from copies of one text, the label is left open.
LOG_ODDS = 2.5
MIN_SHARE = 0.01
MIN_TEXTS = 4
#: A token of an offending span has at least this marginal.
SPAN_MARGINAL = 0.5
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def word_features(word: bytes) -> list:
    """Indexes of a word's features among 2^BITS hashed ones."""
    import xxhash

    w = word.decode("utf-8", "replace")
    names = [f"w{w}", f"s{w[-3:]}", *(f"p{n}{w[:n]}" for n in (3, 4, 5) if len(w) > n)]
    return [xxhash.xxh32_intdigest(n) & ((1 << BITS) - 1) for n in names]


class Scores(dict):
    """Word scores for the toxic state, kept for up to half a million words."""

    def __init__(self, weights):
        self.weights = weights

    def __missing__(self, word):
        if len(self) >= 500_000:
            self.clear()
        s = self[word] = float(self.weights[word_features(word)].sum())
        return s


def _transfer(emit, there, trans, starts_text):
    """Per stretch the log of the matrix that carries a message over its
    tokens, transition into the first one included unless the text starts there."""
    import numpy as np

    t = np.exp(np.array(trans) - np.max(trans))
    toxic = np.exp(np.clip(emit, -300, 300))
    m = np.broadcast_to(np.eye(2), (len(emit), 2, 2)).copy()
    for k in range(emit.shape[1]):
        step = m @ t
        if k == 0:
            step[starts_text] = m[starts_text]
        step[:, :, 1] *= toxic[:, k, None]
        step /= step.max(axis=(1, 2), keepdims=True)
        m = np.where(there[:, k, None, None], step, m)
    with np.errstate(divide="ignore"):
        return np.log(m)


def _carried(number, log_m, out, back: bool):
    """Log odds of the message that enters each stretch; ``number`` counts the
    stretches of a text in the direction of the message, whose first gets 0."""
    import numpy as np

    step = -1 if back else 1
    order = np.argsort(number, kind="stable")
    ends = np.searchsorted(number[order], np.arange(number.max() + 2))
    for j in range(1, number.max() + 1):
        row = order[ends[j]:ends[j + 1]]
        before = row - step
        p, m = out[before], log_m[before]
        m = m.transpose(0, 2, 1) if back else m
        out[row] = np.logaddexp(m[:, 0, 1], p + m[:, 1, 1]) - np.logaddexp(m[:, 0, 0], p + m[:, 1, 0])
    return out


def marginals(scores, starts, trans, bias: float):
    """Marginals of the toxic state for tokens with the given scores.

    ``starts`` are the offsets of the texts in ``scores``, with the end last;
    every text is one chain.
    """
    import numpy as np

    n = len(scores)
    if not n:
        return np.zeros(0)
    sizes = np.diff(starts)
    own = np.arange(n) - np.repeat(starts[:-1], sizes)  # place in the text
    first = own % CHUNK == 0
    row = np.cumsum(first) - 1
    col = own % CHUNK
    number = own[first] // CHUNK  # of the stretch in its text
    behind = (np.repeat(sizes, sizes)[first] - 1) // CHUNK - number  # stretches behind it
    # ratios of the two states' messages are enough: forward f, backward b, in log odds
    emit = np.full((row[-1] + 1, CHUNK), np.nan)
    emit[row, col] = scores + bias
    there = ~np.isnan(emit)
    emit = np.nan_to_num(emit)
    (t00, t01), (t10, t11) = trans
    log_m = _transfer(emit, there, trans, number == 0)
    enter, leave = (_carried(x, log_m, np.zeros(len(emit)), back) for x, back in ((number, False), (behind, True)))
    onward = lambda p: np.logaddexp(t01, t11 + p) - np.logaddexp(t00, t10 + p)
    f, b = np.zeros_like(emit), np.zeros_like(emit)
    f[:, 0] = emit[:, 0] + np.where(number == 0, 0.0, onward(enter))
    for k in range(1, CHUNK):
        f[:, k] = emit[:, k] + onward(f[:, k - 1])
    # what comes from the next stretch stands behind the last token, which is then at the end of the row
    b[:, -1] = leave
    for k in range(CHUNK - 2, -1, -1):
        q = np.where(there[:, k + 1], emit[:, k + 1] + b[:, k + 1], 0.0)
        step = np.logaddexp(t10, t11 + q) - np.logaddexp(t00, t01 + q)
        b[:, k] = np.where(there[:, k + 1], step, 0.0)
    odds = (f + b)[row, col]
    return 0.5 * (1 + np.tanh(odds / 2))


@dataclass
class Model:
    weights: object
    trans: tuple
    bias: float
    calibration: tuple | None
    prior: float

    def document_scores(self, p, starts):
        import numpy as np

        if self.calibration is None:
            return np.full(len(starts) - 1, self.prior)
        z = document_features(p, starts) @ np.array(self.calibration)
        return 0.5 * (1 + np.tanh(z / 2))


def document_features(p, starts):
    """Per text: 1, log of 1 + expected toxic tokens, root of their share, greatest marginal."""
    import numpy as np

    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(text, p, len(sizes))
    most = np.zeros(len(sizes))
    np.maximum.at(most, text, p)
    return np.stack([np.ones(len(sizes)), np.log1p(total), np.sqrt(total / np.maximum(sizes, 1)), most], axis=1)


def _logistic(x, y, steps: int = 30, ridge: float = 0.05):
    """Newton's method for a ridge logistic fit."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(x @ w / 2))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + ridge * w), -3, 3)
    return tuple(w)


def fit(sample: list) -> Model:
    """The model for ``[(text bytes, 0 or 1)]``."""
    import numpy as np

    labels = np.array([y for _, y in sample], float)
    prior = float(labels.mean()) if len(labels) else 0.0
    if not 0 < prior < 1:
        return Model(np.zeros(1 << BITS), ((0.0, 0.0), (0.0, 0.0)), 0.0, None, prior)
    texts = [fold_words(t) for t, _ in sample]
    toxic, clean = Counter(), Counter()
    for ws, (_, y) in zip(texts, sample):
        (toxic if y else clean).update(set(ws))
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = lambda w: np.log((toxic[w] + 0.1) / (n1 + 0.2)) - np.log((clean[w] + 0.1) / (n0 + 0.2))
    likely = {w: n >= max(MIN_TEXTS, MIN_SHARE * n1) for w, n in toxic.items() if odds(w) >= LOG_ODDS}

    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*texts)))}
    ids = np.array([vocabulary[w] for ws in texts for w in ws])
    y = np.array([bool(label) and likely.get(w, False) for ws, (_, label) in zip(texts, sample) for w in ws], float)
    told = np.array([w not in likely or likely[w] for ws in texts for w in ws], float)
    starts = np.r_[0, np.cumsum([len(ws) for ws in texts])]
    features = [word_features(w) for w in vocabulary]
    of_word = np.repeat(np.arange(len(features)), [len(f) for f in features])
    feature = np.concatenate([np.array(f) for f in features])

    # transitions from counts of labelled neighbours; weights by Adagrad on the likelihood of the tokens' labels
    own = np.arange(len(y)) - np.repeat(starts[:-1], np.diff(starts))
    inner = np.flatnonzero(own != 0)
    count = np.array([[np.sum((y[inner - 1] == a) & (y[inner] == b)) for b in (0, 1)] for a in (0, 1)], float) + 1
    joint = count / count.sum()
    trans = np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    bias, bias_seen = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 1e-6
    for _ in range(STEPS):
        score = np.bincount(of_word, weights[feature], len(features))
        p = marginals(score[ids], starts, trans, bias)
        missed = (y - p) * told
        by_word = np.bincount(ids, missed, len(features))
        grad = np.bincount(feature, by_word[of_word], 1 << BITS) - 0.02 * weights
        seen += grad * grad
        weights += 0.5 * grad / np.sqrt(seen)
        g = float(np.sum(missed))
        bias_seen += g * g
        bias += 0.1 * g / np.sqrt(bias_seen)
    score = np.bincount(of_word, weights[feature], len(features))
    p = marginals(score[ids], starts, trans, bias)
    calibration = _logistic(document_features(p, starts), labels)
    return Model(weights.astype("float32"), tuple(map(tuple, trans.tolist())), bias, calibration, prior)


def _spans(raw: bytes, p) -> list:
    """Code-point spans of runs of tokens with a high marginal."""
    out, at, chars, last = [], 0, 0, -2
    for k, m in enumerate(_WORD.finditer(raw)):
        if p[k] >= SPAN_MARGINAL:
            start = chars + len(raw[at:m.start()].decode())
            end = start + len(m.group().decode())
            at, chars = m.end(), end
            if last == k - 1:
                out[-1]["end"] = end
            else:
                out.append({"start": start, "end": end})
            last = k
    return out


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """Per document ``doc_id``, ``score`` and ``spans`` (offending offsets in code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        scores = Scores(m.weights)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in text_slices(batches):
            raws = text_bytes(batch.column("text"))
            texts = [fold_words(r) for r in raws]
            starts = np.r_[0, np.cumsum([len(ws) for ws in texts])].astype(np.int64)
            s = np.fromiter((scores[w] for ws in texts for w in ws), float, int(starts[-1]))
            p = marginals(s, starts, m.trans, m.bias)
            hit = np.flatnonzero(np.maximum.reduceat(np.r_[p, 0.0], np.minimum(starts[:-1], len(p))) >= SPAN_MARGINAL) if len(texts) else []
            spans: list = [[] for _ in texts]
            for k in hit:
                if len(texts[k]):
                    spans[k] = _spans(raws[k], p[starts[k]:starts[k + 1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.document_scores(p, starts), pa.float64()),
                                              pa.array(spans, span)], names=["doc_id", "score", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {id_type}, score double, spans array<struct<start: bigint, end: bigint>>")


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> Model:
    """The model from the labels whose ids don't leave ``remainder``."""
    return fit(labelled_sample(docs, labels, "toxic", ~left_out(modulus, remainder), PER_CLASS, MAX_BYTES))
