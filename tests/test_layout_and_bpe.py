"""Layout independence of ordered operators, and the BPE trainer against the
``tokenizers`` library (used only here, as an oracle)."""

import random

import pytest

from textmill.functions import tokens as TK
from textmill.operators import bpe as BP
from textmill.operators import budget as B
from textmill.operators import mixing as MX
from textmill.operators import packing as PK


def _corpus(spark, parts):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        g = ("main", "repeat", "capped")[i % 3]
        rows.append((g, f"f{rnd.randint(0, 4)}", i, "w" * rnd.randint(1, 40) + "é" * rnd.randint(0, 3)))
    return spark.createDataFrame(rows, "group string, file string, line long, text string").repartition(parts)


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_same_result_for_any_partitioning(spark, aqe):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        results = []
        for parts in (1, 3, 16):
            d = _corpus(spark, parts)
            kept = sorted((r.group, r.line, r.cum_bytes) for r in B.byte_budget_prefix(d, 900).collect())
            main, rep, cap = (d.where(d.group == g) for g in ("main", "repeat", "capped"))
            mix = MX.ratio_mix(main, rep, cap)
            order = [(r.mix_pos, r.line) for r in mix.orderBy("mix_pos").collect()]
            blocks = [list(r.input_ids) for r in
                      PK.pack_blocks(PK.token_offsets(mix), TK.byte_encode("text"), 64, 2, 4).orderBy("block_idx").collect()]
            results.append((kept, order, blocks))
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bpe_matches_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import json

    import duckdb
    texts = [r[0] for r in duckdb.sql(
        "select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 60").fetchall()]
    texts += ["한국어 토큰화 시험용 문장입니다.", "aaa aaaa  bb\n\n  x", "def f(x):\n    return x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = BP.train_bpe(df, 600)
    tok = tokenizers.ByteLevelBPETokenizer()
    tok.train_from_iterator(texts, vocab_size=600, min_frequency=2, special_tokens=TK.SPECIAL_TOKENS,
                            show_progress=False)
    theirs = json.loads(tok._tokenizer.to_str())["model"]["merges"]
    theirs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in theirs]
    alpha = TK.byte_alphabet()

    def s(i):
        return "".join(alpha[b] for b in model["vocab"][i])
    assert [(s(a), s(b)) for a, b, _ in model["merges"]] == theirs
    vocab = tok.get_vocab()
    assert all(vocab[s(n)] == n for _, _, n in model["merges"])
    enc = BP.make_bpe_encoder(model["merges"])
    got = [list(r.ids) for r in df.select("text", enc("text").alias("ids")).collect()]
    order = [r.text for r in df.collect()]
    assert got == [tok.encode(t).ids for t in order]


def test_pretokens_match_python_regex(spark):
    regex = pytest.importorskip("regex")
    texts = ["Hello  world\n\nit's 2024!!  ok ", "한국어\t\t텍스트  x", "a b   c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [list(r.p) for r in df.select(BP.pretokens("text").alias("p")).collect()]
    assert got == [regex.findall(BP.PRETOKEN_PATTERN_PY, t) for t in texts]


def test_safe_batch_rule():
    c = [(10, 1, 2), (9, 3, 4), (9, 2, 5), (8, 6, 7)]
    assert BP.safe_batch(c) == [(10, 1, 2)]  # (3,4) ties the blocked (2,5): not strictly above
    c = [(10, 1, 2), (9, 3, 4), (5, 2, 5), (4, 6, 7)]
    assert BP.safe_batch(c) == [(10, 1, 2), (9, 3, 4)]
    c = [(10, 1, 1), (9, 3, 4)]
    assert BP.safe_batch(c) == [(10, 1, 1)]


ORDERED_QUERIES = ["byte_budget_prefix", "round_robin", "ratio_mix", "pack_blocks", "pad_batches",
                   "optimizer_steps", "loss_smoothing", "holdout_text", "seeded_shuffle", "budget_replay",
                   "rouge_running_avg", "first_n_per_group", "byte_budget_truncate", "holdout_code"]


def test_registered_ordered_queries_layout_independent(spark):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    import __spark_entry__ as E
    from check_oracle import digest
    sf = "/root/testdata/sf0.001"
    qs = E.queries()
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        results = {}
        for parts, aqe in (("1", "false"), ("7", "true"), ("13", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            for name in ORDERED_QUERIES:
                df = qs[name](spark, sf)
                results.setdefault(name, []).append(digest(df.columns, [tuple(r) for r in df.collect()])[0])
        for name, ds in results.items():
            assert len(set(ds)) == 1, name
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def _encode_by_rank(syms, ranks):
    """Merges one rank at a time, left to right, scanning all pairs."""
    syms = list(syms)
    while True:
        known = [ranks[p] for p in zip(syms, syms[1:]) if p in ranks]
        if not known:
            return syms
        rank, new = min(known)
        out, i = [], 0
        while i < len(syms):
            hit = i + 1 < len(syms) and ranks.get((syms[i], syms[i + 1]), (None,))[0] == rank
            out.append(new if hit else syms[i])
            i += 2 if hit else 1
        syms = out


def test_heap_encoder_and_flat_merges():
    import random

    import numpy as np

    from textmill.operators import bpe as BP
    r = random.Random(1)
    for _ in range(200):
        merges, new = [], 10
        for _ in range(r.randrange(1, 12)):
            pair = (r.randrange(new), r.randrange(new))
            if pair not in {m[:2] for m in merges}:
                merges.append((*pair, new))
                new += 1
        ranks = {(a, b): (k, n) for k, (a, b, n) in enumerate(merges)}
        word = [r.randrange(4) for _ in range(r.randrange(0, 40))]
        assert BP.bpe_encode_word(word, ranks) == _encode_by_rank(word, ranks)
    words = [[r.randrange(3) for _ in range(r.randrange(1, 12))] for _ in range(300)]
    for mapping in ({1 * BP.PAIR_SHIFT + 1: 9}, {0 * BP.PAIR_SHIFT + 1: 9}, {2 * BP.PAIR_SHIFT + 2: 9}):
        pair = divmod(next(iter(mapping)), BP.PAIR_SHIFT)
        flat = np.concatenate([np.array(w, np.int32) for w in words])
        no = np.repeat(np.arange(len(words)), [len(w) for w in words])
        syms, word = BP.merge_flat(flat, no, mapping)
        want = [_encode_by_rank(w, {pair: (0, 9)}) for w in words]
        assert syms.tolist() == sum(want, []) and np.bincount(word).tolist() == [len(w) for w in want]


def test_reserved_atoms_are_single_tokens_for_the_trained_vocabulary(spark):
    tokenizers = pytest.importorskip("tokenizers")

    from textmill.functions import tokens as TK
    from textmill.operators import bpe as BP
    texts = ["hello world, hello spark", "byte level text 123", "call <NAME> at <PHONE> now"] * 5
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    m = BP.train_bpe(docs, 300)
    tok = tokenizers.ByteLevelBPETokenizer()
    tok.train_from_iterator(texts, vocab_size=300, min_frequency=2, special_tokens=TK.SPECIAL_TOKENS, show_progress=False)
    enc = BP.make_bpe_encoder(m["merges"])
    probe = ["x<NAME>y", "<NAME><EMAIL>", "a <URL", "", "hello <pad> world <unk>"]
    got = {r.text: list(r.ids) for r in spark.createDataFrame([(t,) for t in probe], "text string").select("text", enc("text").alias("ids")).collect()}
    assert got["x<NAME>y"] == [TK.BYTE_TO_ID[ord("x")], 7, TK.BYTE_TO_ID[ord("y")]] and got["<NAME><EMAIL>"] == [7, 8]
    assert got == {t: tok.encode(t).ids for t in probe}
