"""Registered queries without a DuckDB oracle, checked against brute force
(plain Python, Python ``regex``, the ``tokenizers`` library) on sf0.001."""

import json
import os
from collections import Counter

import pytest

import __spark_entry__ as E
import rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _duck(sql):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con.execute(sql).fetchall()


def _pairs():
    return _duck("""SELECT u.conv_id * 1048576 + u.turn, u.text, a.text FROM conversations u JOIN conversations a
                    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")


def _chars(t):
    return [c for c in (t or "").strip() if not c.isspace()]


def test_lcs_and_rouge_l_brute_force(spark):
    want = {i: rules.lcs(_chars(p), _chars(r)) for i, p, r in _pairs()}
    got = {r.id: r.lcs for r in E.queries()["lcs_length"](spark, SF).collect()}
    assert got == want
    rl = {r.id: r for r in E.queries()["rouge_l"](spark, SF).collect()}
    for i, p, r in _pairs():
        a, b = _chars(p), _chars(r)
        lcs = want[i]
        if a and b and lcs:
            pp, rr = lcs / len(a), lcs / len(b)
            assert rl[i].rl_f1 == pytest.approx(2 * pp * rr / (pp + rr), abs=1e-8)


def test_rouge_summary_brute_force(spark):
    ms = []
    for _, p, r in _pairs():
        a, b = _chars(p), _chars(r)
        m = {"rouge1": rules.rouge_n(a, b, 1), "rouge2": rules.rouge_n(a, b, 2)}
        lcs = rules.lcs(a, b)
        if a and b and lcs:
            pp, rr = lcs / len(a), lcs / len(b)
            m["rougeL"] = (pp, rr, 2 * pp * rr / (pp + rr))
        else:
            m["rougeL"] = (0.0, 0.0, 0.0)
        ms.append(m)
    got = E.queries()["rouge_summary"](spark, SF).first()
    assert got.samples == len(ms)
    for k in ("rouge1", "rouge2", "rougeL"):
        for j, s in enumerate(("p", "r", "f1")):
            assert got[f"{k}_{s}"] == pytest.approx(sum(m[k][j] for m in ms) / len(ms), abs=1e-8)


def test_pretoken_counts_brute_force(spark):
    import regex

    from textmill.operators.bpe import PRETOKEN_PATTERN_PY
    pat = regex.compile(PRETOKEN_PATTERN_PY)
    want = Counter(w for (t,) in _duck("SELECT text FROM documents") for w in pat.findall(t))
    got = {r.word: r.freq for r in E.queries()["pretoken_counts"](spark, SF).collect()}
    assert got == dict(want)


def test_bpe_queries_against_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from textmill.functions import tokens as TK
    texts = [t for (t,) in _duck("SELECT text FROM documents ORDER BY doc_id")]
    tok = tokenizers.ByteLevelBPETokenizer()
    tok.train_from_iterator(texts, vocab_size=TK.N_SPECIAL + 512, min_frequency=2,
                            special_tokens=TK.SPECIAL_TOKENS, show_progress=False)
    theirs = json.loads(tok._tokenizer.to_str())["model"]["merges"]
    theirs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in theirs]
    vocab = tok.get_vocab()
    merges = E.queries()["bpe_merges"](spark, SF).orderBy("merge_rank").collect()
    alpha = TK.byte_alphabet()

    def s(i):
        if i < TK.N_SPECIAL + 256:
            return alpha[int(TK.ID_TO_BYTE[i])]
        return "".join(alpha[b] for b in bytes.fromhex([m for m in merges if m.new_id == i][0].token_hex))
    assert [(s(m.left_id), s(m.right_id)) for m in merges] == theirs
    assert all(vocab[s(m.new_id)] == m.new_id for m in merges)
    enc = {r.doc_id: r for r in E.queries()["bpe_encode"](spark, SF).collect()}
    ids = _duck("SELECT doc_id, text FROM documents")
    import hashlib
    for d, t in ids:
        want = tok.encode(t).ids
        assert enc[d].n_tokens == len(want)
        assert enc[d].ids_md5 == hashlib.md5(",".join(map(str, want)).encode()).hexdigest()
        assert enc[d].roundtrip_ok
    cmp = {r.tokenizer: r for r in E.queries()["tokenizer_compare"](spark, SF).collect()}
    assert cmp["byte"].tokens == sum(len(t.encode()) for _, t in ids)
    full = [k for k in cmp if k != "byte" and cmp[k].vocab_size == TK.N_SPECIAL + 512]
    assert full and cmp[full[0]].tokens == sum(len(tok.encode(t).ids) for _, t in ids)


def test_bpe_pair_counts_brute_force(spark):
    import regex

    from textmill.functions import tokens as TK
    from textmill.operators.bpe import PRETOKEN_PATTERN_PY
    pat = regex.compile(PRETOKEN_PATTERN_PY)
    want = Counter()
    for (t,) in _duck("SELECT text FROM documents"):
        for w in pat.findall(t):
            s = [int(TK.BYTE_TO_ID[b]) for b in w.encode()]
            want.update(zip(s, s[1:]))
    got = {(r.left, r.right): r["count"] for r in E.queries()["bpe_pair_counts"](spark, SF).collect()}
    assert got == dict(want)


def test_tokenizer_quality_bpe_against_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from textmill.functions import tokens as TK
    rows = _duck("SELECT lang, text FROM documents ORDER BY doc_id")
    tok = tokenizers.ByteLevelBPETokenizer()
    tok.train_from_iterator([t for _, t in rows], vocab_size=TK.N_SPECIAL + 512, min_frequency=2,
                            special_tokens=TK.SPECIAL_TOKENS, show_progress=False)
    got = {r.group: r for r in E.queries()["tokenizer_quality_bpe"](spark, SF).collect()}
    for g in {lang for lang, _ in rows}:
        texts = [t for lang, t in rows if lang == g]
        ids = [tok.encode(t).ids for t in texts]
        assert got[g].docs == len(texts)
        assert got[g].chars == sum(len(t) for t in texts)
        assert got[g].tokens == sum(len(i) for i in ids)
        assert got[g].used_vocab == len({x for i in ids for x in i})
        assert got[g].roundtrip_success == len(texts)
