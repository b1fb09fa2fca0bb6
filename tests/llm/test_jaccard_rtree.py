import random
from collections import defaultdict

import brute
import edge
import numpy as np

from textmill.llm import jaccard_rtree as J

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def grouped(docs):
    sets = [shingles(d["text"]) for d in docs]
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in holds[x]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                top[root(i)] = root(j)
    least = {}
    for i, d in enumerate(docs):
        if sets[i] and d["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), d["doc_id"]), d["doc_id"])
    return [{"doc_id": d["doc_id"], "n_shingles": len(s), "component_id": least.get(root(i)) if s else d["doc_id"]}
            for i, (d, s) in enumerate(zip(docs, sets))]


COLS = ["doc_id", "n_shingles", "component_id"]


def same(docs):
    assert brute.key_counts(brute.rows(J.groups(docs)), COLS) == brute.key_counts(grouped(brute.rows(docs)), COLS)


def test_whole_table(spark):
    same(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edges(spark):
    docs = edge.edge_docs(spark)
    same(docs)
    kept = brute.rows(J.one_of_each(docs))
    assert [r for r in brute.rows(docs.limit(0))] == [] and J.groups(edge.empty_docs(spark)).count() == 0
    assert J.one_of_each(docs).columns == docs.columns
    assert sorted(r["rid"] for r in kept if r["doc_id"] != 9) == [0, 1, 2, 3, 4, 7, 10, 11, 12, 13]
    assert sum(r["doc_id"] == 9 for r in kept) == 1


def near(r, words, edits):
    w = list(words)
    for _ in range(edits):
        k, how = r.randrange(len(w)), r.random()
        if how < 0.4:
            w[k] = f"x{r.randrange(10 ** 6)}"
        elif how < 0.7 and len(w) > 1:
            del w[k]
        else:
            w.insert(k, f"y{r.randrange(10 ** 6)}")
    return w


def test_chains_of_edits_of_all_sizes(spark):
    r, rows = random.Random(3), []
    for family in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 3, 5, 6, 8, 9, 12, 20, 40, 90, 200, 700]))]
        for _ in range(10):
            rows.append(base)
            base = near(r, base, r.choice([0, 1, 1, 2, max(1, len(base) // 40), max(1, len(base) // 25)]))
    r.shuffle(rows)
    same(spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(rows)], brute.DOCS).repartition(7))


def test_large_group_of_independent_copies_in_chunks(spark, monkeypatch):
    """Copies of one text that only link through some of the others, with a shared passage in other texts."""
    monkeypatch.setattr(J, "CHUNK", 16)
    monkeypatch.setattr(J, "FANOUT", 3)
    monkeypatch.setattr(J, "ROWS", 50)
    r = random.Random(5)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    rows = [near(r, base, r.choice([1, 2, 3, 4])) for _ in range(150)]
    rows += [[f"v{r.randrange(9000)}" for _ in range(40)] + base[20:80] + [f"v{r.randrange(9000)}" for _ in range(r.randrange(30))]
             for _ in range(60)]
    same(spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(rows)], brute.DOCS).repartition(5))


def test_trees_decide_pairs_of_the_given_table(spark, monkeypatch):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    J.links(docs, seen=seen).count()
    # the trees rule pairs out before any set is compared, and lose no link
    assert seen["offered"] > seen["left"] >= seen["verified"] > 0


def test_inner_nodes_rule_out_points_below_them(monkeypatch):
    g, looked = np.random.default_rng(2), []
    points = g.poisson(3, (300, J.GROUPS)) * np.repeat([1, 4, 16], 100)[:, None]
    tree = J.RTree(points, points.sum(axis=1))
    assert len(tree.levels) == 4
    monkeypatch.setattr(J, "enough", lambda bound, sizes, f=J.enough: looked.append(len(bound)) or f(bound, sizes))
    assert 5 in tree.search(points[5], int(points[5].sum()))
    assert sum(looked) < 250


def test_tree_loses_nothing():
    g = np.random.default_rng(1)
    points = g.poisson(3, (500, J.GROUPS))
    points[100:200] = np.maximum(0, points[:100] + g.integers(-1, 2, (100, J.GROUPS)))
    sizes = points.sum(axis=1)
    tree = J.RTree(points, sizes)
    for i in range(500):
        both = np.minimum(points[i], points).sum(axis=1)
        want = np.flatnonzero(100 * both >= 80 * (sizes[i] + sizes - both))
        assert sorted(tree.search(points[i], int(sizes[i]))) == want.tolist()


def test_word_hashes_over_slices(monkeypatch):
    import pyarrow as pa

    from textmill.llm import hashed_words as H

    texts = ["a b  c", None, "", "A b", "x" * 5000, "x" * 5000 + " é É\u2003q\x0b" + "y", " ", "tail\n"] * 3
    want, whole = [], H.hashed_words(pa.array(texts))
    for t in texts:
        want.append(len((t or "").encode().split()))
    assert np.diff(whole[1]).tolist() == want
    monkeypatch.setattr(H, "SLICE", 8)
    H._powers.cache_clear()
    for arr in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        again = H.hashed_words(arr)
        assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
    words = {}
    for t, s, e in zip(texts, whole[1][:-1], whole[1][1:]):
        for w, h in zip((t or "").encode().lower().split(), whole[0][s:e].tolist()):
            assert words.setdefault(w, h) == h
    assert len(set(words.values())) == len(words)
    H._powers.cache_clear()
