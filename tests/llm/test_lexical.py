import math
import re
from collections import Counter

import brute
import edge
import pytest

from textmill.llm import lexical

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=20):
    held = [(d["doc_id"], Counter(t), len(t)) for d in docs if (t := terms(d["text"]))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for i in items:
        q, scores = Counter(terms(i["text"])), []
        for doc, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, x in q.items() if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [{"item_id": i["item_id"], "rank": r, "doc_id": None if none else doc, "score": -s}
                for r, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


COLS = ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 3000, "block_docs": 7}])
def test_whole_table_matches_brute_force(spark, sizes):
    index = lexical.build(spark.read.parquet(f"{SF}/documents.parquet"), **sizes)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.key_counts(ranked(brute.read(spark, SF, "documents"), brute.read(spark, SF, "benchmark")), COLS)
    assert brute.key_counts(brute.rows(lexical.search(index, items)), COLS) == want
    # parts of the items and the reach of the first visit change nothing
    assert brute.key_counts(brute.rows(lexical.search(index, items, first=1, part_items=17)), COLS) == want
    assert brute.key_counts(brute.rows(lexical.search(index, items, first=10**9, part_bytes=3000)), COLS) == want


def test_strata_hold_documents_of_equal_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = lexical.build(docs)
    n = Counter()
    for d in brute.read(spark, SF, "documents"):
        if t := terms(d["text"]):
            n[75 + (25 * len(t) * index.n_docs) // index.n_terms] += 1
    got = Counter()
    for m, docs in index.blocks.select("m", "docs").collect():
        got[m] += len(docs)
    assert got == n


def test_second_visit_skips_strata(spark):
    index = lexical.build(spark.read.parquet(f"{SF}/documents.parquet"))
    p = next(lexical._parts(spark.read.parquet(f"{SF}/benchmark.parquet"), 40, 1 << 20))
    part = spark.sparkContext.broadcast(p)
    import numpy as np

    df = lexical._document_frequencies(index, part)
    w = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in df], np.int64))
    opened = lexical._first_visits(index, part, w, 100)
    top = np.full(len(p.ids), np.iinfo(np.int64).max)
    none = np.zeros(len(p.ids), np.int64)
    some = lexical._visit(index, part, w, opened, top, 20, none).count()
    assert 0 < some < lexical._visit(index, part, w, none, top, 20, none).count()


def test_edges(spark):
    docs = edge.edge_docs(spark)
    text = "w1 " * 7
    more = spark.createDataFrame([(i, text, "en", "z", 1) for i in (30, 20, None, 20, None)], edge.empty_docs(spark).schema)
    docs = docs.unionByName(more, allowMissingColumns=True)
    items = [(1, "one"), (2, None), (3, "..."), (None, "A b c, a"), (4, "Ü ñ W1"), (1, edge.prose(60, 1)), (5, "ß 漢字 😀"), (6, "unheard")]
    bench = spark.createDataFrame([(*i, 0, "x") for i in items], "item_id long, text string, rank int, doc_id string")
    want = ranked(brute.rows(docs), [{"item_id": i, "text": t} for i, t in items])
    for sizes in ({}, {"block_terms": 10, "block_docs": 2}):
        got = lexical.search(lexical.build(docs, **sizes), bench)
        assert brute.key_counts(brute.rows(got), COLS) == brute.key_counts(want, COLS)
    assert brute.rows(lexical.search(lexical.build(edge.empty_docs(spark)), bench)) == []
    assert brute.rows(lexical.search(lexical.build(docs), bench.limit(0))) == []
    assert len(brute.rows(lexical.search(lexical.build(docs), bench, k=2))) <= 2 * len(items)
