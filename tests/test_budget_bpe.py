"""Budget replay by composed functions, and merges found on stretches of words."""

import random

import numpy as np
import pytest
import rules

from textmill.functions import tokens as TK
from textmill.operators import bpe as BP
from textmill.operators import budget as B

DOCS = "group string, file string, line long, text string"


def test_composed_functions_take_what_a_walk_takes():
    r = random.Random(3)
    for _ in range(50):
        sources = [[r.randint(2, 40) for _ in range(r.randint(1, 8))] for _ in range(r.randint(1, 12))]
        starts = taken = np.zeros(1, np.int64)
        for s in sources:
            starts, taken = B.then(starts, taken, np.cumsum(s))
        assert (np.diff(starts) > 0).all()
        for budget in [0, 1, *(r.randint(0, 400) for _ in range(30)), 10_000]:
            got = int(taken[np.searchsorted(starts, budget, "right") - 1])
            assert got == sum(b for _, b in rules.budget_replay(sources, budget))


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_replay_of_many_sources(spark, block):
    r = random.Random(11)
    rows, sources = [], {}
    for g in ("a", "b", "c"):
        for f in range(40):
            # one source has very long documents, so that much is left for the others
            sizes = [r.randint(1, 600 if f == 5 else 25) for _ in range(r.randint(1, 9))]
            sources.setdefault(g, []).append([s + 2 for s in sizes])
            rows += [(g, f"f{f:02}", i, "x" * s) for i, s in enumerate(sizes)]
    docs = spark.createDataFrame(rows, DOCS).cache()
    totals = {g: sum(map(sum, s)) for g, s in sources.items()}
    for budget in ({"a": totals["a"] // 3, "b": sum(map(sum, sources["b"][:5])) + 590, "c": 0}, {"a": totals["a"], "b": 1}, 700, 0):
        got = {(x.group, x.file): (x.consumed_docs, x.consumed_bytes) for x in B.budget_replay(docs, budget, block_sources=block).collect()}
        for g, s in sources.items():
            b = budget.get(g, 0) if isinstance(budget, dict) else budget
            assert [got[g, f"f{f:02}"] for f in range(40)] == rules.budget_replay(s, b)
    docs.unpersist()


def _greedy(words, vocab_size, min_frequency=2):
    """One merge at a time, all pairs counted anew for each."""
    vocab = [t.encode() for t in TK.SPECIAL_TOKENS] + [b""] * 256
    for b in range(256):
        vocab[int(TK.BYTE_TO_ID[b])] = bytes([b])
    index = {v: i for i, v in enumerate(vocab) if i >= TK.N_SPECIAL}
    words, merges = [(list(s), n) for s, n in words], []
    while len(vocab) < vocab_size:
        counts = {}
        for s, n in words:
            for p in zip(s, s[1:]):
                counts[p] = counts.get(p, 0) + n
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < min_frequency:
            break
        string = vocab[best[0]] + vocab[best[1]]
        new = index.get(string)
        if new is None:
            new = index[string] = len(vocab)
            vocab.append(string)
        merges.append((*best, new))
        for s, _ in words:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == best:
                    s[i:i + 2] = [new]
                i += 1
    return merges


@pytest.mark.parametrize("limits", [{}, {"candidates": 3}, {"candidates": 40, "max_stretches": 25}])
def test_rounds_merge_what_greedy_merges(spark, limits):
    r = random.Random(7)
    # few letters: many ties, runs of one letter, and strings that arise in two ways
    texts = [" ".join("".join(r.choice("aabbc") for _ in range(r.randint(1, 9))) for _ in range(12)) for _ in range(40)] + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = [(TK.BYTE_TO_ID[np.frombuffer(x.word.encode(), np.uint8)].tolist(), x.freq) for x in BP.pretoken_counts(docs).collect()]
    model = BP.train_bpe(docs, 268 + 90, **limits)
    assert model["merges"] == _greedy(words, 268 + 90)
    assert len(model["touched"]) == model["rounds"] and all(0 < n <= len(words) for n in model["touched"])
    if not limits:
        assert model["rounds"] < len(model["merges"]) / 3


def test_a_string_that_arises_twice_ends_the_stretch_round():
    vocab = [b"a", b"b", b"c"]
    index = {v: i for i, v in enumerate(vocab)}
    got = BP.greedy_merges([[0, 1, 2], [1, 2], [0, 0]], [10, 4, 3], 0, vocab, index, 100)
    assert got == [(1, 2, 3), (0, 3, 4), (0, 0, 5)] and vocab[4] == b"abc"
    vocab, index = vocab[:3] + [b"abc"], {b"a": 0, b"b": 1, b"c": 2, b"abc": 3}
    assert BP.greedy_merges([[0, 1, 2], [1, 2]], [10, 4], 0, vocab, index, 100) == [(1, 2, 4), (0, 4, 3)]
