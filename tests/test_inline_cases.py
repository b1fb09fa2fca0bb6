"""Inline cases of FIXTURES part 3 plus randomized checks against the loop
statements in ``rules.py``."""

import math
import random

import pytest
from pyspark.sql import functions as F

import rules
from textmill.functions import text as TX
from textmill.functions import tokens as TK
from textmill.operators import budget as B
from textmill.operators import holdout as HO
from textmill.operators import mixing as MX
from textmill.operators import ordering as OR
from textmill.operators import packing as PK
from textmill.operators import rouge as RG
from textmill.operators import runlog as RL
from textmill.operators import sft as SF
from textmill.sources import jsonl as J

EDGE = ['{"text":" a "}', "", "bad{", '{"text":5}', '{"text":null}', '{"no":1}', "[1]",
        '{"text":"  "}', '{"text":true}']


def lines_df(spark, lines, file="f"):
    return spark.createDataFrame([(file, i + 1, s) for i, s in enumerate(lines)],
                                 "file string, line_no long, raw string")


def test_jsonl_strict_and_coerce(spark):
    d = lines_df(spark, EDGE)
    strict = [r.text for r in J.parse_jsonl_text(d, "strict").orderBy("line_no").collect()]
    coerce = [r.text for r in J.parse_jsonl_text(d, "coerce").orderBy("line_no").collect()]
    assert strict == ["a"]
    assert coerce == ["a", "5", "None", "True"]


def test_duplicate_key_last_wins(spark):
    d = lines_df(spark, ['{"text":"d1","text":"d2"}'])
    assert [r.text for r in J.parse_jsonl_text(d, "strict").collect()] == ["d2"]


def test_sft_falsiness(spark):
    cases = ['{"prompt":"","response":"x"}', '{"prompt":"  ","response":"x"}', '{"prompt":0,"response":"x"}',
             '{"prompt":null,"response":"x"}', '{"response":"x"}', "", '{"prompt":[],"response":"x"}',
             '{"prompt":{},"response":"x"}', '{"prompt":false,"response":"x"}', "nope"]
    rows = J.sft_rows(lines_df(spark, cases)).orderBy("line_no").collect()
    assert [r.status for r in rows] == ["bad", "valid", "bad", "bad", "bad", "blank", "bad", "bad", "bad", "bad"]
    q = J.sft_scan_quality(lines_df(spark, cases)).first()
    assert (q.blank_lines, q.bad_lines, q.valid_samples) == (1, 8, 1)


def test_generation_samples_ids(spark):
    d = lines_df(spark, ['{"id": "a1", "prompt": "p", "response": "r"}', "", '{"prompt": "p2", "response": "r2"}'])
    rows = J.generation_samples(d).orderBy("line_no").collect()
    assert [(r.id, r.prompt, r.reference) for r in rows] == [("a1", "p", "r"), ("3", "p2", "r2")]
    assert J.generation_samples(d, max_samples=1).count() == 1
    nul = lines_df(spark, ['{"id": null, "prompt": "p", "response": "r"}'])
    assert J.generation_samples(nul).first().id is None


def test_unicode_strip_and_code_points(spark):
    df = spark.createDataFrame([("　x\u001c",), ("a😀 한b",)], "t string")
    got = df.select(TX.strip_u("t").alias("s"), F.size(RG.rouge_tokens("t", "char")).alias("n")).collect()
    assert got[0].s == "x"
    assert got[1].n == 4


def test_byte_cut(spark):
    df = spark.createDataFrame([("한국",)], "t string")
    assert df.select(TX.utf8_prefix("t", F.lit(4)).alias("c")).first().c == "한"
    assert df.select(TX.utf8_prefix("t", F.lit(6)).alias("c")).first().c == "한국"
    assert df.select(TX.utf8_prefix("t", F.lit(2)).alias("c")).first().c == ""


def _docs(spark, rows):
    return spark.createDataFrame(rows, "group string, file string, line long, text string")


def test_budget_prefix_stops_group(spark):
    # sizes 5, 9, 3 (text + 2-byte separator), budget 10 -> first only
    docs = _docs(spark, [("g", "a", 1, "xxx"), ("g", "a", 2, "yyyyyyy"), ("g", "a", 3, "z")])
    kept = B.byte_budget_prefix(docs, 10).orderBy("line").collect()
    assert [r.line for r in kept] == [1]


def test_budget_replay_next_source(spark):
    docs = _docs(spark, [("g", "A", 1, "xxx"), ("g", "A", 2, "yyyyyyy"), ("g", "B", 1, "z")])
    u = {r.file: (r.consumed_docs, r.consumed_bytes) for r in B.budget_replay(docs, 10).collect()}
    assert u == {"A": (1, 5), "B": (1, 3)}


def test_budget_random_against_rules(spark):
    rnd = random.Random(7)
    rows, sources = [], []
    for f in range(4):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(0, 12))]
        sources.append([s + 2 for s in sizes])
        rows += [("g", f"f{f}", i, "x" * s) for i, s in enumerate(sizes)]
    docs = _docs(spark, rows)
    flat = [s for src in sources for s in src]
    for budget in (0, 7, 50, 150, 10_000):
        kept = B.byte_budget_prefix(docs, budget).count()
        assert kept == len(rules.budget_prefix(flat, budget))
        got = {r.file: (r.consumed_docs, r.consumed_bytes) for r in B.budget_replay(docs, budget).collect()}
        want = rules.budget_replay([s for s in sources if s], budget)
        files = [f"f{i}" for i, s in enumerate(sources) if s]
        assert [got[f] for f in files] == want


def test_round_robin(spark):
    docs = _docs(spark, [("g", "a", 1, "a1"), ("g", "a", 2, "a2"), ("g", "a", 3, "a3"), ("g", "c", 1, "c1")])
    got = [r.text for r in MX.round_robin(docs).orderBy("rr_pos").collect()]
    assert got == ["a1", "c1", "a2", "a3"] == rules.round_robin([["a1", "a2", "a3"], [], ["c1"]])


@pytest.mark.parametrize("k,n,c", [(13, 2, 1), (0, 3, 2), (7, 1, 0), (40, 5, 3), (25, 2, 9)])
def test_ratio_mix_against_generator(spark, k, n, c):
    main = _docs(spark, [("m", f"f{i % 3}", i, f"m{i}") for i in range(k)])
    rep = _docs(spark, [("r", "f0", i, f"r{i}") for i in range(n)])
    cap = _docs(spark, [("c", f"f{i % 2}", i, f"c{i}") for i in range(c)])
    got = [(r.role, r.text) for r in MX.ratio_mix(main, rep, cap).orderBy("mix_pos").collect()]
    m_order = rules.round_robin([[f"m{i}" for i in range(k) if i % 3 == j] for j in range(3)])
    c_order = rules.round_robin([[f"c{i}" for i in range(c) if i % 2 == j] for j in range(2)])
    want = rules.ratio_mix(m_order, [f"r{i}" for i in range(n)], c_order)
    assert got == want
    pos = [r.mix_pos for r in MX.ratio_mix(main, rep, cap).collect()]
    assert sorted(pos) == list(range(len(pos)))


def test_ratio_mix_fixture_case():
    plan = MX.mix_plan(13, 2, 1)
    assert plan["T"] == 20 and MX.pos_main(12, 1) == 19


def test_pack_blocks(spark):
    for sizes, n_blocks in (([5, 3, 4], 3), ([5, 3, 3], 2)):
        # one-byte characters: a document of n tokens is n - 1 bytes + EOS
        rows = [(i, "x" * (s - 1)) for i, s in enumerate(sizes)]
        df = spark.createDataFrame(rows, "mix_pos long, text string")
        offs = PK.token_offsets(df)
        blocks = PK.pack_blocks(offs, TK.byte_encode("text"), 4, 1, 2).orderBy("block_idx").collect()
        assert len(blocks) == n_blocks
        want = rules.pack([[int(TK.BYTE_TO_ID[ord("x")])] * (s - 1) for s in sizes], 4)
        assert [list(b.input_ids) for b in blocks] == want


def test_pack_random(spark):
    rnd = random.Random(3)
    texts = ["é" * rnd.randint(0, 9) + "ab" * rnd.randint(0, 20) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "mix_pos long, text string").repartition(3)
    blocks = PK.pack_blocks(PK.token_offsets(df), TK.byte_encode("text"), 16, 2, 3).orderBy("block_idx").collect()
    enc = [list(TK.BYTE_TO_ID[list(t.encode())]) if t else [] for t in texts]
    assert [list(b.input_ids) for b in blocks] == rules.pack(enc, 16)
    assert [b.split for b in blocks[:3]] == ["eval", "eval", "train"]


def test_block_lookup(spark):
    shards = spark.createDataFrame([(0, 3), (1, 5), (2, 1)], "shard long, n_blocks long")
    idx = spark.createDataFrame([(i,) for i in range(9)], "train_idx long")
    got = sorted((r.train_idx, r.shard, r.local_idx) for r in PK.block_lookup(idx, shards, bucket_width=2).collect())
    want = [(i, 0, i) for i in range(3)] + [(i, 1, i - 3) for i in range(3, 8)] + [(8, 2, 0)]
    assert got == want


def test_code_holdout_skip(spark):
    blocks = spark.createDataFrame([(1, "a" * 40, 4), (2, "b" * 40, 4), (3, "c" * 40, 4)],
                                   "block_index long, block_text string, block_bytes long")
    left = [r.block_index for r in HO.code_blocks_after_budget(blocks, 5).collect()]
    assert left == [3]


def test_prompt_truncation(spark):
    ids = list(range(100))
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    for room in (50, 20, 0, -3, 100, 32, 33):
        got = df.select(SF.truncate_keep_suffix("ids", F.lit(room)).alias("t")).first().t
        assert list(got) == rules.truncate_keep_suffix(ids, room)
    got50 = df.select(SF.truncate_keep_suffix("ids", F.lit(50)).alias("t")).first().t
    assert list(got50) == list(range(18)) + list(range(68, 100))


def test_long_response(spark):
    df = spark.createDataFrame([("pp", "x" * 9)], "prompt string, response string")  # 9 + EOS = 10 ids
    r = SF.encode_pairs(df, 8).first()
    assert list(r.input_ids) == [int(TK.BYTE_TO_ID[ord("x")])] * 7 + [TK.EOS_ID]
    assert r.n_prompt == 0 and list(r.labels) == list(r.input_ids)


def test_labels_and_padding(spark):
    df = spark.createDataFrame([(1, "ab", "c"), (2, "d", "efgh"), (3, "", "i")], "pid long, prompt string, response string")
    e = SF.encode_pairs(df, 64)
    first = e.where("pid = 1").first()
    assert list(first.labels)[:2] == [-100, -100] and first.labels[-1] == TK.EOS_ID
    padded = SF.pad_batches(e, 2, ["pid"], OR.id_bucket("pid", 10)).orderBy("pid").collect()
    assert padded[0].padded_len == padded[1].padded_len == 6
    assert len(padded[0].input_ids) == 6 and padded[0].labels[-1] == -100
    assert padded[2].padded_len == 2
    # a genuine pad id inside the sequence is masked too
    df2 = spark.createDataFrame([(1, [5, TK.PAD_ID, 7], [-100, 1, 2])], "pid long, input_ids array<int>, labels array<int>")
    m = SF.pad_batches(df2, 4, ["pid"], OR.id_bucket("pid", 10)).first().attention_mask
    assert list(m) == [1, 0, 1]


def test_supervised_count(spark):
    df = spark.createDataFrame([([-100, 5],), ([5, -100],), ([7],), ([],)], "labels array<int>")
    assert [r.n for r in df.select(SF.supervised_count("labels").alias("n")).collect()] == [1, 0, 0, 0]


def test_rouge_cases(spark):
    rows = [(1, "abc", "abc"), (2, "", "abc"), (3, "aab", "abb"), (4, "a", "a")]
    pairs = spark.createDataFrame(rows, "id long, prediction string, reference string")
    n = {r.id: r for r in RG.rouge_n(pairs).collect()}
    assert n[1].rouge1.f1 == 1.0 and n[2].rouge1.f1 == 0.0
    assert n[3].rouge1.p == round(2 / 3, 9)
    assert n[4].rouge2.f1 == 0.0  # one token: no bigram
    lc = {r.id: r.lcs for r in RG.rouge_l(pairs).collect()}
    assert lc[3] == 2


def test_rouge_random_against_rules(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(40):
        p = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 25)))
        r = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 25)))
        rows.append((i, p, r))
    pairs = spark.createDataFrame(rows, "id long, prediction string, reference string")
    got = {r.id: r for r in RG.compute_rouge(pairs).collect()}
    for i, p, r in rows:
        pt, rt = [c for c in p if not c.isspace()], [c for c in r if not c.isspace()]
        for n, key in ((1, "rouge1"), (2, "rouge2")):
            want = rules.rouge_n(pt, rt, n)
            g = got[i].rouge[key]
            assert (g.p, g.r, g.f1) == pytest.approx(want, abs=1e-9)
        assert RG.lcs_length_py(pt, rt) == rules.lcs(pt, rt)


def test_lcs_fixture():
    assert RG.lcs_length_py(list("abcbdab"), list("bdcaba")) == 4


def test_perplexity(spark):
    df = spark.createDataFrame([("a", 3.2576), ("b", 20.0), ("c", float("nan"))], "g string, loss double")
    got = {r.g: r for r in RL.eval_loss_ppl(df, ["g"]).collect()}
    assert round(got["a"].perplexity, 2) == 25.99
    assert math.isinf(got["b"].perplexity)
    assert math.isnan(got["c"].eval_loss) and math.isinf(got["c"].perplexity)


def test_run_plan(spark):
    df = spark.createDataFrame([(260031,)], "n long")
    upd, warm = SF.run_plan(F.col("n"))
    r = df.select(upd.alias("u"), warm.alias("w")).first()
    assert (r.u, r.w) == (32503, 975)


def test_log_windows_against_loop(spark):
    rnd = random.Random(5)
    n = 400
    losses = [round(rnd.random() * 5, 3) for _ in range(n)]
    valid = [rnd.random() > 0.2 for _ in range(n)]
    valid[7] = False  # an invalid loss on step 8
    log = spark.createDataFrame([(i + 1, losses[i], valid[i]) for i in range(n)],
                                "global_step long, loss double, valid boolean")
    for rule in ("base", "summary"):
        got = [(r.global_step, r.optimizer_step, r.train_loss)
               for r in RL.train_log_windows(log, rule).orderBy("optimizer_step").collect()]
        want = [(s, o, round(m, 9)) for s, o, m in rules.log_windows(losses, valid, rule)]
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [c for _, _, c in got] == pytest.approx([c for _, _, c in want], abs=1e-9)
    steps = RL.optimizer_steps(log, "base").where("global_step = 8").first()
    assert steps.is_update == 1
    steps = RL.optimizer_steps(log, "summary").where("global_step = 8").first()
    assert steps.is_update == 0


def test_rolling_mean_halo(spark):
    vals = [float(i % 7) for i in range(50)]
    s = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "idx long, loss double")
    for window, width in ((3, 4), (5, 6), (200, 1000), (2, 1000)):
        got = [r.smooth for r in RL.rolling_mean(s, "idx", "loss", window, bucket_width=width).orderBy("idx").collect()]
        assert got == pytest.approx(rules.rolling_mean(vals, window), abs=1e-9)


def test_retention(spark):
    df = spark.createDataFrame([("r", "step_10"), ("r", "step_9"), ("r", "step_x")], "run string, name string")
    assert [r.name for r in RL.checkpoint_retention(df, 1).collect()] == ["step_9"]
    assert RL.checkpoint_retention(df, 0).count() == 0


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("nan",), ("inf",), ("x",)], "s string")
    got = [r.v for r in df.select(RL.coerce_numeric("s").alias("v")).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] is None and math.isinf(got[3]) and got[4] is None


def test_seeded_sample_and_shuffle(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "k long")
    s = HO.seeded_sample(df, "k", 5).collect()
    assert len(s) == 5 and all(r.eligible == 50 for r in s)
    sh = HO.seeded_shuffle(df, "k", 42, 0).collect()
    assert sorted(r.shuffle_pos for r in sh) == list(range(50))


def test_pad_fallback_and_labels(spark):
    assert SF.resolve_pad_id(None, 3) == 3 and SF.resolve_pad_id(0, 3) == 0
    with pytest.raises(ValueError):
        SF.resolve_pad_id(0, None)
    b = spark.createDataFrame([(0, [1, 2])], "block_idx long, input_ids array<int>")
    assert list(PK.with_lm_labels(b).first().labels) == [1, 2]


def test_token_preview_and_tokenizer_object(spark):
    tok = TK.get_tokenizer("byte")
    assert tok.vocab_size == 268 and tok.eos_id == 3
    esc = TK.escaped_vocab(tok.vocab_tokens)
    df = spark.createDataFrame([("a b\n\\é",)], "t string").withColumn("ids", tok.encode("t"))
    got = list(df.select(TK.token_preview("ids", esc, 50).alias("p")).first().p)
    alpha = TK.byte_alphabet()
    want = [TK.unicode_escape(alpha[b]) for b in "a b\n\\é".encode()]
    assert got == want == ["a", "\\u0120", "b", "\\u010a", "\\\\", "\\xc3", "\\xa9"]
    assert df.select(tok.decode("ids").alias("d")).first().d == "a b\n\\é"


def test_reserved_atoms_encode_as_one_token(spark):
    df = spark.createDataFrame([("hi <NAME>!",)], "t string")
    ids = list(df.select(TK.byte_encode("t").alias("i")).first().i)
    assert ids[3] == TK.SPECIAL_TOKENS.index("<NAME>") and len(ids) == 5


def test_special_token_counts(spark):
    from textmill.operators import quality as QU
    d = spark.createDataFrame([("a", "x <NAME> y <NAME><EMAIL>"), ("a", "none"), ("b", "z")], "group string, text string")
    rows = sorted((r.group, r.token, r["count"]) for r in QU.special_token_counts(d).collect())
    assert [x for x in rows if x[2]] == [("a", "<EMAIL>", 1), ("a", "<NAME>", 2)]
    assert len(rows) == 2 * len(TK.SPECIAL_TOKENS)


def test_log_windows_per_run(spark):
    rnd = random.Random(9)
    rows = []
    for run in ("a", "b"):
        for i in range(300):
            rows.append((run, i + 1, round(rnd.random() * 4, 3), rnd.random() > 0.25))
    log = spark.createDataFrame(rows, "run string, global_step long, loss double, valid boolean")
    for rule in ("base", "summary"):
        both = {(r.run, r.optimizer_step): (r.global_step, r.train_loss)
                for r in RL.train_log_windows(log, rule, run="run").collect()}
        for run in ("a", "b"):
            one = RL.train_log_windows(log.where(F.col("run") == run), rule).collect()
            assert {(run, r.optimizer_step): (r.global_step, r.train_loss) for r in one} == \
                {k: v for k, v in both.items() if k[0] == run}


def test_rolling_mean_per_run(spark):
    rows = [(run, i, float((i * (3 if run == "a" else 5)) % 7)) for run in ("a", "b") for i in range(40)]
    s = spark.createDataFrame(rows, "run string, idx long, loss double")
    got = {(r.run, r.idx): r.smooth for r in RL.rolling_mean(s, "idx", "loss", 4, bucket_width=6, run="run").collect()}
    for run in ("a", "b"):
        vals = [v for r, _, v in rows if r == run]
        want = rules.rolling_mean(vals, 4)
        assert [got[(run, i)] for i in range(40)] == pytest.approx(want, abs=1e-9)
