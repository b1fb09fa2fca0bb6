import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import pytest

from textmill.llm import prefix_trie

SF = "/root/testdata/sf0.01"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def trie(rows):
    own = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            own[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, digest(role, text), role, text))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        # SQL's remainder has the sign of the number
        seq = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].add(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(who) - 1) * len(brute.words(k[-1][1])) if k else 0
    return [{"conv_id": min(who), "depth": len(k), "parent_conv_id": min(members[k[:-1]]) if k else None, "n_convs": len(who),
             "n_children": children[k], "n_leaves": leaves[k], "saved_tokens": saved[k],
             "ends_sha256": hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()} for k, who in members.items()]


@pytest.mark.parametrize("block", [20_000, 7])
def test_whole_table_matches_brute_force(spark, block):
    got = prefix_trie.trie(spark.read.parquet(f"{SF}/conversations.parquet"), block_nodes=block)
    assert got.columns == COLS
    assert brute.key_counts(brute.rows(got), COLS) == brute.key_counts(trie(brute.read(spark, SF, "conversations")), COLS)


def test_edges(spark, monkeypatch):
    long = "w " * 30_000
    rows = [(0, 0, "user", "a b"), (0, 1, None, "c"), (0, 2, "user", None), (0, None, "system", "first"), (1, 0, "user", "a b"), (2, 0, "user", long),
            (2, 0, "user", long), (2, 0, "user", "tie"), (2, 0, "bot", "tie"), (25, 0, "user", "no base"), (26, 0, "user", "x"), (27, 0, "user", "x"),
            (28, None, None, None), (None, 0, "user", "nobody"), (41, 0, "u", "x:y"), (42, 0, "u:", "xy"), (43, 3, "u", "xy"), (-7, 0, "user", "a b")]
    rows += [(c, t, "user", f"t{t}") for c in (60, 61, 62) for t in range(40)]
    rows += [(c, 0, "user", "same") for c in range(100, 400)]
    df = spark.createDataFrame([(*r, 1, "k", 5) for r in rows], SCHEMA + ", depth long, node string, words int")
    want = trie([dict(zip(["conv_id", "turn", "role", "text"], r)) for r in rows])
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    assert brute.key_counts(brute.rows(prefix_trie.trie(df, block_nodes=16)), COLS) == brute.key_counts(want, COLS)
    assert brute.rows(prefix_trie.trie(spark.createDataFrame([], SCHEMA))) == []
    assert brute.rows(prefix_trie.trie(df.where("conv_id is null"))) == []


def test_list_ranks_of_a_shuffled_list(spark):
    n, r = 500, random.Random(5)
    order = list(range(n))
    r.shuffle(order)
    arcs = spark.createDataFrame(list(zip(order, [*order[1:], None])), "arc long, next long")
    for block in (1, 64, 1000):
        got = {a: p for a, p in prefix_trie.list_ranks(arcs, n, block).select("arc", "place").collect()}
        assert got == {a: i for i, a in enumerate(order)}
