import math
import zlib
from collections import Counter

import brute
import edge
import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import lattice
from textmill.llm.common import left_out

SF = "/root/testdata/sf0.01"


def small(rounds=None):
    p = lattice.Pieces([b" ", b"a", b"b", b"c", b" a", b"ab", b"bc", b"abc", b"ca", b"\xc3", b"\xbc", b"\xc3\xbc"], [1, 2, 3, 1, 2, 4, 1, 2, 1, 1, 1, 3])
    p.scores[:-1] = np.log(p.prior)
    return p


def ways(p, word):
    """All segmentations with their probabilities."""
    if not word:
        return [((), 1.0)]
    return [((i, *rest), math.exp(p.scores[i]) * x) for i, s in enumerate(p.spelled) if word.startswith(s) for rest, x in ways(p, word[len(s):])]


WORDS = ["a", "abc", "abcabcab", "cab", "ü", "aübc", "abcabc" * 2, "cabcab"]


@pytest.mark.parametrize("long", [64, 3])
def test_forward_and_posteriors_match_enumeration(monkeypatch, long):
    monkeypatch.setattr(lattice, "LONG", long)
    p, counts = small(), np.array([1.0, 2, 3, 1, 5, 1, 1, 2])
    into = np.zeros(len(p.spelled))
    got = lattice.word_scores(p, pa.array([w.encode() for w in WORDS]), counts, into)
    want = np.zeros(len(p.spelled))
    for w, c, g in zip(WORDS, counts, got):
        every = ways(p, b" " + w.encode())
        total = sum(x for _, x in every)
        assert g == pytest.approx(math.log(total))
        for ids, x in every:
            for i in ids:
                want[i] += c * x / total
    assert into == pytest.approx(want)


def test_long_word_is_scored_whole():
    p = lattice.vocabulary()
    a, b = lattice.word_scores(p, pa.array([b"thetion" * 5, b"thetion" * 3000]))
    assert b < 500 * a < 0


def test_vocabulary_spells_every_byte():
    p = lattice.vocabulary()
    assert {bytes([c]) for c in range(256)} <= set(p.spelled)
    assert len(set(p.spelled)) == len(p.spelled) > 10_000
    assert np.exp(p.scores[:-1]).sum() + math.exp(p.end) == pytest.approx(1)


def base(docs, held):
    tokens = [brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or "")) + [None] for d in docs]
    c = Counter(t for d, ts in zip(docs, tokens) if not held(d) for t in ts)
    n, v = sum(c.values()), len(c)
    return [{"doc_id": d["doc_id"], "held_out": held(d), "n_tokens": len(ts), "n_known": sum(c[t] > 0 for t in ts), "train_tokens": n,
             "base_score": sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)} for d, ts in zip(docs, tokens)]


def held(d):
    return d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2


def compared(got, want):
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["base_score"], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert {k: g[k] for k in w if k != "base_score"} == {k: w[k] for k in w if k != "base_score"}
        assert g["base_score"] == pytest.approx(w["base_score"])


@pytest.mark.parametrize("hot", [1 << 18, 100, 0])
def test_whole_table(spark, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = brute.rows(lattice.score(docs, left_out(7, 2), hot_words=hot, rounds=2))
    compared(got, base(brute.read(spark, SF, "documents"), held))
    assert all(r["score"] < 0 for r in got)
    # held-out texts are far likelier under the lattice than byte by byte
    docs = brute.read(spark, SF, "documents")
    spelled = lambda d: "".join(f" {w}" for w in brute.words((d["text"] or "").lower())).encode()
    c = Counter(b for d in docs if not held(d) for b in spelled(d))
    total = sum(c.values()) + 256
    by_byte = sum(math.log10((c[b] + 1) / total) for d in docs if held(d) for b in spelled(d))
    assert 0.85 * by_byte < sum(r["score"] for r in got if r["held_out"])


def test_fit_raises_the_likelihood_and_ignores_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = [brute.rows(lattice.score(docs, left_out(7, 2), rounds=r)) for r in (0, 1, 2)]
    sums = [sum(r["score"] for r in x if not r["held_out"]) for x in scores]
    assert sums[0] < sums[1] < sums[2]
    from pyspark.sql import functions as F

    other = docs.withColumn("text", F.when(left_out(7, 2), F.lit("zz qq")).otherwise(F.col("text")))
    same = {r["doc_id"]: r["score"] for r in brute.rows(lattice.score(other, left_out(7, 2), rounds=2)) if not r["held_out"]}
    assert all(same[r["doc_id"]] == pytest.approx(r["score"]) for r in scores[2] if not r["held_out"])


def test_edges(spark):
    docs = edge.edge_docs(spark)
    extra = spark.createDataFrame([(20, "Ab aB AB ▁ x▁y " + "word" * 4000, "en", "a", 1)], edge.empty_docs(spark).schema)
    docs = docs.unionByName(extra, allowMissingColumns=True)
    rows = brute.rows(docs)
    for hot in (1 << 18, 3):
        got = brute.rows(lattice.score(docs, left_out(7, 2), rounds=1, hot_words=hot))
        compared(got, base(rows, held))
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert brute.rows(lattice.score(edge.empty_docs(spark), left_out(7, 2))) == []
