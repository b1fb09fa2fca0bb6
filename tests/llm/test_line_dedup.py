import random
from collections import Counter

import brute
import edge

from textmill.llm import line_dedup

SF = "/root/testdata/sf0.01"
COLS = ["doc_id", "n_lines", "n_exact", "n_near"]
BLANK = " \t\n\x0b\f\r"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def decided(docs):
    place, seen = {}, Counter()
    for d in docs:
        for no, x in enumerate((d["text"] or "").split("\n")):
            if x := x.strip(BLANK):
                p = (d["doc_id"] is None, d["doc_id"] or 0, no)
                place[x] = min(place.get(x, p), p)
    # lines one edit apart share one half: compare those only
    halves: dict = {}
    for x in place:
        for n in (len(x), len(x) - 1):
            for k in (("p", n, x[:n // 2]), ("s", n, x[len(x) - (n - n // 2):])):
                halves.setdefault(k, []).append(x)
    near = set()
    for xs in halves.values():
        for i, a in enumerate(xs):
            for b in xs[:i]:
                if place[a] != place[b] and one_apart(a, b):
                    near.add(max(a, b, key=place.get))
    out = []
    for d in docs:
        n = exact = close = 0
        dropped = []
        for no, x in enumerate((d["text"] or "").split("\n")):
            if x := x.strip(BLANK):
                n += 1
                e = (d["doc_id"] is None, d["doc_id"] or 0, no) > place[x]
                exact += e
                close += not e and x in near
                if e or x in near:
                    dropped.append(no)
        out.append({"doc_id": d["doc_id"], "n_lines": n, "n_exact": exact, "n_near": close, "dropped": tuple(dropped)})
    return out


def same(docs):
    got = [{**r, "dropped": tuple(r["dropped"])} for r in brute.rows(line_dedup.decide(docs))]
    want = decided(brute.rows(docs))
    assert brute.key_counts(got, [*COLS, "dropped"]) == brute.key_counts(want, [*COLS, "dropped"])
    return want


def test_whole_table(spark):
    assert sum(r["n_exact"] for r in same(spark.read.parquet(f"{SF}/documents.parquet"))) > 0


def test_edits_at_every_place(spark):
    r, texts = random.Random(2), []
    letters = "abcdeé漢😀 "
    for _ in range(60):
        base = "x" + "".join(r.choice(letters) for _ in range(r.randrange(12, 60))) + "x"
        group = [base]
        for _ in range(12):
            s = list(r.choice(group))
            for _ in range(r.choice([1, 1, 1, 2])):
                k, how = r.randrange(1, len(s) - 1), r.random()
                if how < 0.4:
                    s[k] = r.choice(letters)
                elif how < 0.7:
                    del s[k]
                else:
                    s.insert(k, r.choice(letters))
            group.append("".join(s))
        texts += group
    r.shuffle(texts)
    docs = [(i, "\n".join(texts[i * 6:i * 6 + 6]), "en", "s", 1) for i in range(len(texts) // 6)]
    want = same(spark.createDataFrame(docs, brute.DOCS).repartition(6))
    assert sum(r["n_near"] for r in want) > 100


def test_short_lines(spark):
    r, texts = random.Random(9), []
    for _ in range(250):
        texts.append("".join(r.choice("abcdefghijklmnopqrstuvwxyzé漢😀") for _ in range(r.choice([1, 2, 3, 5, 8, 14, 15, 16, 17, 18]))))
        for _ in range(2):
            x = texts[-1] or "z"
            k = r.randrange(len(x))
            texts.append(r.choice([x[:k] + x[k + 1:], x[:k] + "q" + x[k:], x[:k] + "q" + x[k + 1:]]))
    r.shuffle(texts)
    docs = [(i, "\n".join(texts[i * 5:i * 5 + 5]), "en", "s", 1) for i in range(len(texts) // 5)]
    want = same(spark.createDataFrame(docs, brute.DOCS).repartition(4))
    assert sum(w["n_near"] for w in want) > 200


def test_edges(spark):
    docs = edge.edge_docs(spark)
    want = same(docs)
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    got = {r["rid"]: r["text"] for r in brute.rows(out)}
    for i, (d, w) in enumerate(zip(brute.rows(docs), want)):
        lines = None if d["text"] is None else d["text"].split("\n")
        assert got[i] == (None if lines is None else "\n".join(x for k, x in enumerate(lines) if k not in w["dropped"]))
    assert line_dedup.decide(edge.empty_docs(spark)).count() == 0
