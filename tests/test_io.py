"""File readers, sinks and the streaming operators on small files."""

import pytest
import glob
import json
import os

from pyspark.sql import functions as F

from textmill.operators import runlog as RL
from textmill.sinks import writers as W
from textmill.sources import jsonl as J
from textmill.streaming import logs as STR


def _write(path, text, mode="w"):
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(text)


def test_read_lines_numbers_and_scans(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "corpus_a.jsonl")
    b = os.path.join(tmpdir_path, "other.jsonl")
    _write(a, '{"text": "one"}\n\nbad{\n{"text": " two "}\r\n{"text": null}\n')
    _write(b, '{"text": "b1"}\n')
    lines = J.read_lines(spark, [a, b, os.path.join(tmpdir_path, "missing.jsonl")])
    got = sorted((os.path.basename(r.file), r.line_no, r.raw) for r in lines.collect())
    assert [(f, n) for f, n, _ in got] == [("corpus_a.jsonl", i) for i in range(1, 6)] + [("other.jsonl", 1)]
    strict = sorted((os.path.basename(r.file), r.line_no, r.text) for r in J.parse_jsonl_text(lines).collect())
    assert strict == [("corpus_a.jsonl", 1, "one"), ("corpus_a.jsonl", 4, "two"), ("other.jsonl", 1, "b1")]
    lin = J.jsonl_with_lineage(lines).where(F.col("text") == "None").first()
    assert lin.line_number == 5 and lin.train_block_bytes == 6
    try:
        J.read_lines(spark, [os.path.join(tmpdir_path, "nope.jsonl")], on_missing="error")
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_blocks_and_dispatch(spark, tmpdir_path):
    c = os.path.join(tmpdir_path, "code_test.txt")
    _write(c, "def f():\n  pass\r\n\r\n\n\nx = 1\n\n  \n\ny\n")
    blocks = J.read_blocks(spark, [c]).orderBy("block_index").collect()
    assert [b.block_text for b in blocks] == ["def f():\n  pass", "x = 1", "y"]
    # line endings are one character before blocks are split, so the CRLF gap counts like the others
    assert [b.block_index for b in blocks] == [1, 3, 5]
    j = os.path.join(tmpdir_path, "dump_wiki_b.txt")
    _write(j, '{"text": "wiki"}\n')
    texts = sorted(r.text for r in J.read_texts(spark, [c, j]).collect())
    assert texts == ["def f():\n  pass", "wiki", "x = 1", "y"]


def test_log_csv_candidates(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "log.csv")
    _write(p, "global_step,optimizer_step,epoch,train_loss,lr,eval_loss,eval_ppl\n8,1,1,2.5,0.1,,\n16,2,1,,0.1,3.0,20.1\n")
    rows = J.read_log_csv(spark, p).orderBy("step").collect()
    assert [(r.step, r.train_loss, r.eval_loss) for r in rows] == [(1.0, 2.5, None), (2.0, None, 3.0)]


def test_sinks(spark, tmpdir_path):
    docs = spark.createDataFrame([("en", "f1", 2, "b"), ("ko", "f2", 1, "a"), ("en", "f1", 1, "c"), ("xx", "f", 1, "z")],
                                 "group string, file string, line long, text string")
    out = os.path.join(tmpdir_path, "corpus")
    with pytest.raises(Exception, match="group without a place"):  # no group vanishes
        W.write_corpus(docs, out, ["ko", "en"], parts=3)
    W.write_corpus_groups(docs, out + "-groups")
    assert sorted(os.path.basename(p) for p in glob.glob(out + "-groups/group=*")) == ["group=en", "group=ko", "group=xx"]
    body = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(out + "-groups/group=en/part-*")))
    assert body == "c\n\nb\n\n"
    docs = docs.where("group != 'xx'")
    W.write_corpus(docs, out, ["ko", "en"], parts=3)
    body = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(out + "/part-*")))
    assert body == "a\n\nc\n\nb\n\n"
    blocks = spark.createDataFrame([(0, "eval", None, [1, 2]), (1, "train", 0, [3, 4]), (2, "train", 1, [5, 6])],
                                   "block_idx long, split string, shard long, input_ids array<int>")
    bp = os.path.join(tmpdir_path, "blocks")
    W.write_blocks(blocks, bp)
    back = spark.read.parquet(bp).where("split = 'train' AND shard = 1").collect()
    assert [list(r.input_ids) for r in back] == [[5, 6]]
    mp = os.path.join(tmpdir_path, "manifest")
    W.write_json_row(spark.createDataFrame([(42, 3)], "seed int, docs int"), mp)
    got = json.loads(open(glob.glob(mp + "/part-*")[0], encoding="utf-8").read())
    assert got == {"seed": 42, "docs": 3}
    cp = os.path.join(tmpdir_path, "points")
    W.write_points_csv(spark.createDataFrame([(1, 2.0)], "step long, loss double"), cp, bom=True)
    head = open(glob.glob(cp + "/part-*.csv")[0], encoding="utf-8").read()
    assert head.startswith("﻿step,loss")


def test_stream_log_windows_equals_batch(spark, tmpdir_path):
    rows = [(f"r{k}", i + 1, float((i * 7 + k) % 11), i % 3 > 0) for k in range(3) for i in range(400 + k)]
    log = spark.createDataFrame(rows, "run string, global_step long, loss double, valid boolean")
    src = os.path.join(tmpdir_path, "src")
    log.repartitionByRange(5, "global_step").write.parquet(src)
    got = STR.stream_run_windows(spark, src, os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck"))
    batch = RL.train_log_windows(log, "base", run="run")
    key = ["run", "optimizer_step", "global_step", "train_loss"]
    assert sorted(tuple(r) for r in got.select(key).collect()) == sorted(tuple(r) for r in batch.select(key).collect())


def test_stream_ingest(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(os.path.join(src, "group=en"))
    os.makedirs(os.path.join(src, "group=ko"))
    _write(os.path.join(src, "group=en", "a.jsonl"), '{"text": "ab"}\n{"text": 1}\n')
    _write(os.path.join(src, "group=ko", "b.jsonl"), '{"text": "한"}\nbad\n')
    got = STR.stream_ingest_counts(spark, src, os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck"))
    assert sorted(tuple(r) for r in got.collect()) == [("en", 1, 2), ("ko", 1, 3)]


def test_more_sinks(spark, tmpdir_path):
    from textmill.functions import tokens as TK
    from textmill.operators import quality as QU
    from textmill.operators import rouge as RG
    s = spark.createDataFrame([(3, '{"text": "c"}'), (1, '{"text": "a"}')], "line_number long, raw_line string")
    hp = os.path.join(tmpdir_path, "holdout")
    W.write_holdout_lines(s, hp)
    body = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(hp + "/part-*")))
    assert body == '{"text": "a"}\n{"text": "c"}\n'
    pairs = spark.createDataFrame([(1, "abc", "abd")], "id long, prediction string, reference string")
    scored = RG.compute_rouge(pairs).join(pairs, "id")
    pp = os.path.join(tmpdir_path, "pred")
    W.write_predictions(scored, pp)
    rec = json.loads(open(glob.glob(pp + "/part-*")[0], encoding="utf-8").readline())
    assert rec["id"] == 1 and set(rec["rouge"]) == {"rouge1", "rouge2", "rougeL"}
    lp = os.path.join(tmpdir_path, "log")
    row = spark.createDataFrame([(8, 1, 2.5)], "global_step long, optimizer_step long, train_loss double")
    W.append_log_csv(row, lp, resume=True)
    W.append_log_csv(row, lp, resume=True)
    assert spark.read.option("header", True).csv(lp).count() == 2
    W.append_log_csv(row, lp, resume=False)
    assert spark.read.option("header", True).csv(lp).count() == 1
    docs = spark.createDataFrame([("g", "f", 1, "ab"), ("g", "f", 2, "b")], "group string, file string, line long, text string")
    enc = QU.encode_docs(docs)
    rep = W.tokenizer_report(QU.tokenizer_quality(enc, 268), QU.top_tokens(enc, QU.vocab_frame(spark)),
                             QU.roundtrip_failures(enc)).first()
    assert rep.docs == 2 and [t.token for t in rep.top_used_tokens][:1] == ["b"]
    assert TK.EOS_ID == 3


def test_stateful_summary_stream_any_file_order(spark, tmpdir_path):
    import random
    import time
    rnd = random.Random(1)
    rows = [("r", i + 1, float(rnd.randint(0, 9)), rnd.random() > 0.2) for i in range(600)]
    log = spark.createDataFrame(rows, "run string, global_step long, loss double, valid boolean")
    src = os.path.join(tmpdir_path, "src")
    # write the files newest-step-first, each with its own modification time
    for k in reversed(range(5)):
        part = log.where((F.col("global_step") > k * 120) & (F.col("global_step") <= (k + 1) * 120))
        part.coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    got = STR.stream_run_windows(spark, src, os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck"), "summary")
    want = RL.train_log_windows(log, "summary")
    key = ["optimizer_step", "global_step", "train_loss", "n_losses"]
    assert sorted(tuple(r) for r in got.select(key).collect()) == sorted(tuple(r) for r in want.select(key).collect())


def test_line_numbers_across_many_splits(spark, tmpdir_path):
    """A file read as several splits still gets dense 1-based line numbers in
    file order (split offset + in-split order, two-level)."""
    p = os.path.join(tmpdir_path, "big.jsonl")
    texts = [f"line {i} " + "z" * (i % 37) for i in range(3000)]
    with open(p, "w", encoding="utf-8") as f:
        for i, t in enumerate(texts):
            f.write(("" if i % 11 == 5 else json.dumps({"text": t})) + "\n")
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(p).rdd.getNumPartitions() > 10  # the scan really is split
        lines = J.read_lines(spark, [p])
        got = sorted((r.line_no, r.raw) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    want = [(i + 1, "" if i % 11 == 5 else json.dumps({"text": t})) for i, t in enumerate(texts)]
    assert got == want


def test_blocks_with_either_line_ending(spark, tmpdir_path):
    import re
    body = "\n\n\na b\nc\n\nd\n \ne\n\n\nf\n\n\n\n\ng  \n\n" + "\n\n".join(f"x{i}\ny" for i in range(500)) + "\n"
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        for name, text in (("lf", body), ("crlf", body.replace("\n", "\r\n"))):
            p = os.path.join(tmpdir_path, name + ".txt")
            with open(p, "w", encoding="utf-8", newline="") as f:
                f.write(text)
            got = sorted((r.block_index, r.block_text) for r in J.read_blocks(spark, [p], bucket_width=64).collect())
            want = [(i + 1, b.strip()) for i, b in enumerate(re.split("\n\n", body)) if b.strip()]
            assert got == want, name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_block_index_across_many_splits(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "code_big.txt")
    blocks = [f"def f{i}():\n    return {i}" + " " * (i % 13) for i in range(1500)]
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n\n".join(blocks))
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.option("lineSep", "\n\n").text(p).rdd.getNumPartitions() > 5
        got = sorted((r.block_index, r.block_text) for r in J.read_blocks(spark, [p]).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert got == [(i + 1, b.strip()) for i, b in enumerate(blocks)]
