import hashlib
import re
from collections import defaultdict

import brute
import edge
import pytest

from textmill.llm import wu_manber

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLS = ["doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated"]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def judged(docs, items, window=13):
    wins = defaultdict(set)
    for i in items:
        w = words(i["text"])
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k:k + n])].add("null" if i["item_id"] is None else str(i["item_id"]))
    lengths = {len(w) for w in wins}
    out = []
    for d in docs:
        w, hit, own = words(d["text"]), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k:k + n]))):
                    own |= got
                    hit.update(range(k, k + n))
        out.append({"doc_id": d["doc_id"], "n_words": len(w), "n_hit": len(hit), "n_items": len(own),
                    "sha": hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(),
                    "contaminated": len(hit) > 0 and 20 * len(hit) >= len(w)})
    return out


def digest(df):
    return [{**r, "n_items": len(r["items"]), "sha": hashlib.sha256(",".join(r["items"]).encode()).hexdigest()} for r in brute.rows(df)]


@pytest.mark.parametrize("part_bytes", [4 << 20, 2000])
def test_whole_table_matches_brute_force(spark, part_bytes):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    r = wu_manber.find(docs.select("doc_id", "text"), bench, part_bytes=part_bytes)
    got = digest(r.withColumn("contaminated", wu_manber.contaminated(r.n_words, r.n_hit)))
    want = judged(brute.read(spark, SF, "documents"), brute.read(spark, SF, "benchmark"))
    assert brute.key_counts(got, COLS) == brute.key_counts(want, COLS)
    assert any(r["contaminated"] for r in want)


def test_edges(spark):
    docs = edge.edge_docs(spark)
    items = [(1, "one"), (2, None), (3, "..."), (None, "a b c"), (4, "Ü ñ"), (1, edge.prose(60, 1)), (5, "ß 漢字 😀 ü")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = judged(brute.rows(docs), [{"item_id": i, "text": t} for i, t in items])
    for part_bytes in (1 << 20, 10):
        r = wu_manber.find(docs, bench, part_bytes=part_bytes)
        assert r.columns[:len(docs.columns)] == docs.columns
        assert brute.key_counts(digest(r), COLS[:-1]) == brute.key_counts(want, COLS[:-1])
    kept = brute.rows(wu_manber.clean_documents(docs, bench))
    assert sorted(r["rid"] for r in kept) == [i for i, r in enumerate(want) if not r["contaminated"]]
    assert wu_manber.find(edge.empty_docs(spark), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in brute.rows(wu_manber.find(docs, bench.limit(0))))


def test_a_full_part_stays_small():
    import pickle
    import random
    import time

    r = random.Random(1)
    items, size = [], 0
    while size < wu_manber.PART_BYTES:
        text = " ".join(f"{r.getrandbits(24):x}" for _ in range(40))
        items.append((str(len(items)), text))
        size += len(text)
    began = time.process_time()
    table = wu_manber.Patterns(items)
    built = time.process_time() - began
    data = pickle.dumps(table)
    began = time.process_time()
    pickle.loads(data)
    loaded = time.process_time() - began
    assert len(data) < 100 << 20 and loaded < 2 and built < 30, (len(data), loaded, built)
    import pyarrow as pa

    from textmill.llm.hashed_words import hashed_words

    text = "noise " * 20 + items[7][1] + " noise " + " ".join(items[900][1].split()[5:18])
    ids = table.numbers(hashed_words(pa.array([text]), terms=True)[0]).tolist()
    assert table.search(ids) == ([[20, 60], [61, 74]], ["7", "900"])
