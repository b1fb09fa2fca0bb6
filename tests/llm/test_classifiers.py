import itertools
import zlib

import brute
import edge
import numpy as np
import pytest

from textmill.llm import crf, knn_quality, queries

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("chunk", [64, 1, 2, 3, 4])
def test_marginals_by_enumeration(monkeypatch, chunk):
    monkeypatch.setattr(crf, "CHUNK", chunk)
    g = np.random.default_rng(3)
    trans = ((0.3, -0.4), (-0.2, 0.9))
    sizes = [0, 1, 5, 0, 9, 3, 12]
    scores, bias = g.normal(0, 1.5, sum(sizes)), -0.3
    starts = np.r_[0, np.cumsum(sizes)]
    got = crf.marginals(scores, starts, trans, bias)
    for s, e in zip(starts[:-1], starts[1:]):
        total, toxic = 0.0, np.zeros(e - s)
        for states in itertools.product((0, 1), repeat=int(e - s)):
            w = np.exp(sum((scores[s + k] + bias) * y for k, y in enumerate(states)) + sum(trans[a][b] for a, b in zip(states, states[1:])))
            total += w
            toxic += w * np.array(states)
        assert np.allclose(got[s:e], toxic / total)


def test_a_long_text_is_one_chain(monkeypatch):
    g = np.random.default_rng(5)
    starts = np.array([0, 3, 3, 3 * 64 + 7, 40_000])
    scores, trans = g.normal(0, 6, 40_000), ((1.1, -2.1), (-1.3, 1.5))
    cut = crf.marginals(scores, starts, trans, 0.2)
    monkeypatch.setattr(crf, "CHUNK", 40_000)
    assert np.allclose(cut, crf.marginals(scores, starts, trans, 0.2), atol=1e-9)


def held_out(rows, labels, label, modulus, remainder):
    y = {r["doc_id"]: r[label] for r in labels if r[label] is not None}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in rows)
    return [(r, y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]


def test_toxicity_on_held_out_labels(spark):
    rows = brute.rows(queries.op9_crf_toxicity(spark, SF))
    docs = {d["doc_id"]: d["text"] for d in brute.read(spark, SF, "documents")}
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    test = held_out(rows, brute.read(spark, SF, "labels"), "toxic", 3, 1)
    toxic, clean = [r for r, y in test if y], [r for r, y in test if not y]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    for r in rows:
        for s in r["spans"]:
            word = docs[r["doc_id"]][s["start"]:s["end"]]
            assert word and word == word.strip()


def test_quality_on_held_out_labels(spark):
    rows = brute.rows(queries.op10_knn_quality(spark, SF))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = held_out(rows, brute.read(spark, SF, "labels"), "quality", 5, 0)
    good, bad = [r for r, y in test if y], [r for r, y in test if not y]
    assert sum(r["predicted"] for r in good) >= 0.99 * len(good) and sum(r["predicted"] for r in bad) <= 0.1 * len(bad)


def test_votes_by_brute_force(monkeypatch):
    monkeypatch.setattr(knn_quality, "BLOCK", 7)
    monkeypatch.setattr(knn_quality, "ROWS", 5)
    sample = [((edge.prose(30, i, 40) + (" ###" * 9 if i % 3 == 0 else "")).encode(), int(i % 3 > 0)) for i in range(60)]
    held = np.full(knn_quality.TERMS, 5.0)
    m = knn_quality.fit(sample, 60, held)
    raws = [edge.prose(25, 100 + i, 40).encode() for i in range(12)] + [b"", b"### ### ###"]
    got = m.scores(raws, knn_quality._Terms())
    q = knn_quality.unit(knn_quality.weighted(raws, m.idf, knn_quality._Terms()) @ m.axes)
    for k in range(len(raws)):
        sims = sorted(((float(q[k] @ v), y) for v, y in zip(m.vectors, m.labels)), reverse=True)[:knn_quality.NEIGHBOURS]
        votes = [(max(0.0, s), y) for s, y in sims]
        total = sum(s for s, _ in votes)
        assert got[k] == pytest.approx(sum(s * y for s, y in votes) / total if total > 1e-9 else m.prior, abs=1e-4)


def test_document_frequencies_cover_all_documents(spark):
    docs = edge.edge_docs(spark).repartition(4)
    total, held = knn_quality.document_frequencies(docs)
    terms = knn_quality._Terms()
    want = sum((knn_quality.term_counts((d["text"] or "").encode(), terms)[0] > 0).astype(int) for d in brute.rows(docs))
    assert total == docs.count() and (held == want).all()


@pytest.mark.parametrize("labels", ["none", "one", "both", "odd"])
def test_edges(spark, labels):
    docs = edge.edge_docs(spark)
    rows = {"none": [], "one": [(1, 1, 0), (4, 1, 0)], "both": [(i, i % 2, (i + 1) % 2) for i in range(1, 14)],
            "odd": [(5, None, None), (6, 1, 0), (6, 1, 0), (None, 0, 1), (7, 0, 1), (99, 1, 1), (10, 7, 7)]}[labels]
    lab = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for r in (crf.tag(docs, crf.train(docs, lab)), knn_quality.score(docs, knn_quality.train(docs, lab))):
        got = brute.rows(r)
        assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got)
        assert r.limit(0).count() == 0
    assert crf.tag(edge.empty_docs(spark), crf.train(docs, lab)).count() == 0
    empty = edge.empty_docs(spark)
    assert knn_quality.score(empty, knn_quality.train(empty, lab)).count() == 0
