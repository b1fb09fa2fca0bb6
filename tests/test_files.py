"""Files as Python reads and writes them: undecodable bytes, raw text, block files, verbatim parts, jobs."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from textmill import jobs
from textmill.functions import tokens as TK
from textmill.functions.text import drop_undecodable
from textmill.operators import bpe as BP
from textmill.operators import packing as PK
from textmill.sinks import verbatim as V
from textmill.sinks import writers as W
from textmill.sources import jsonl as J


def _put(path, raw):
    with open(path, "wb") as f:
        f.write(raw)
    return path


def test_undecodable_bytes_go_as_python_drops_them(spark, tmpdir_path):
    r = random.Random(2)
    pieces = [b"a", b"\xe2\x82", b"\xe2\x82\xac", b"\xff", b"\xc3", b"\xc3\xbc", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80", b"\xf0\x9f\x98",
              b"\xc0\xaf", b"\x80", "�".encode(), "﷐".encode(), b"0", b"1", b"\xf5", b"\xf4\x90\x80\x80"]
    rows = [b"", *pieces, *(b"".join(r.choices(pieces, k=r.randint(1, 9))) for _ in range(400))]
    path = _put(os.path.join(tmpdir_path, "x.txt"), b"\n".join(rows) + b"\n")
    got = [x.raw for x in J.read_lines(spark, path, errors="ignore").orderBy("line_no").collect()]
    assert got == [x.decode("utf-8", errors="ignore") for x in rows]
    assert spark.range(1).select(drop_undecodable(F.lit(None).cast("string")).alias("x")).first().x is None
    line = b'{"text": "caf\xc3\xa9 \xe2\x82 \xffok"}'
    path = _put(os.path.join(tmpdir_path, "y.jsonl"), line + b"\n")
    assert J.read_texts(spark, [path]).first().text == json.loads(line.decode("utf-8", errors="ignore"))["text"]
    block = _put(os.path.join(tmpdir_path, "z.txt"), b"one\xff\n\n\xe2\x82two\n")
    assert [x.block_text for x in J.read_blocks(spark, [block]).orderBy("block_index").collect()] == ["one", "two"]


def test_raw_text_is_what_python_reads(spark, tmpdir_path):
    contents = [b"a\nb\n", b"a\nb", b"\n\n", b"x\r\ny\rz\r\n", b"tail\r", b"one \xff line", b"\r\r\n", b"e\n\n\xc3\xa9"]
    paths = [_put(os.path.join(tmpdir_path, f"f {i}.txt"), c) for i, c in enumerate(contents)]
    got = {}
    for x in J.raw_text(spark, [*paths, os.path.join(tmpdir_path, "none.txt")]).orderBy("file", "line").collect():
        got[x.file] = got.get(x.file, "") + x.text
    want = [open(p, encoding="utf-8", errors="ignore").read() for p in paths]
    assert [got[J.file_uris(spark, p)[0]] for p in paths] == want


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_verbatim_parts_are_the_joined_text(spark, tmpdir_path, parts):
    blocks = [(i, "block é\n" * (i % 3) + str(i)) for i in range(50)]
    path = os.path.join(tmpdir_path, "out")
    for _ in range(2):  # a second job replaces the first
        W.write_holdout_blocks(spark.createDataFrame(blocks, "block_index long, block_text string").repartition(5), path, parts=parts)
    want = "\n\n".join(t for _, t in blocks).encode()
    manifest = V.read_manifest(path)
    body = b"".join(open(os.path.join(path, p["file"]), "rb").read() for p in manifest["parts"])
    assert body == want and manifest["bytes"] == len(want)
    assert all(want[p["offset"]:p["offset"] + p["bytes"]] == open(os.path.join(path, p["file"]), "rb").read() for p in manifest["parts"])
    assert {p["file"] for p in manifest["parts"]} == {os.path.basename(f) for f in glob.glob(path + "/part-*")}
    assert sorted(p["file"] for p in manifest["parts"]) == [p["file"] for p in manifest["parts"]]


def test_verbatim_without_rows(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "none")
    W.write_holdout_blocks(spark.createDataFrame([], "block_index long, block_text string"), path)
    assert V.read_manifest(path)["bytes"] == 0


def test_block_files(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "blocks")
    rows = [(i, "train", i // 4, i % 4, list(range(i, i + 8))) for i in range(10)]
    blocks = spark.createDataFrame(rows, "block_idx long, split string, shard long, local_idx long, input_ids array<int>")
    W.write_blocks(blocks, path)
    got = PK.read_block_files(spark, path, 8).orderBy("file_idx", "row").collect()
    assert [x.block_idx for x in got] == list(range(10)) and [x.file_idx for x in got] == [0] * 4 + [1] * 4 + [2] * 2
    with pytest.raises(Exception, match="block is not 9 ids wide"):
        PK.read_block_files(spark, path, 9).select("file_idx").collect()
    W.write_blocks(blocks.withColumn("input_ids", F.when(F.col("block_idx") == 7, F.array().cast("array<int>")).otherwise(F.col("input_ids"))), path)
    with pytest.raises(Exception, match="but 0 in"):
        PK.read_block_files(spark, path, 8).count()
    os.makedirs(os.path.join(tmpdir_path, "empty"))
    for missing in ("empty", "nowhere"):
        with pytest.raises(FileNotFoundError):
            PK.read_block_files(spark, os.path.join(tmpdir_path, missing), 8)
    with pytest.raises(ValueError):
        PK.read_block_files(spark, path, 8, ids="split")


def test_observed_counts_and_the_supervised_job(spark, tmpdir_path):
    lines = ['{"prompt": "p one", "response": "r"}', "", "not json", '{"prompt": "", "response": "r"}', '{"prompt": "pp", "response": "a longer response"}',
             "   ", '{"prompt": "q", "response": "s"}']
    path = _put(os.path.join(tmpdir_path, "a b.jsonl"), "\n".join(lines).encode())
    out = os.path.join(tmpdir_path, "sft")
    counts = jobs.sft_dataset(spark, [path], out, max_length=16, batch_size=2).first()
    assert (counts.valid_samples, counts.bad_lines, counts.blank_lines) == (3, 2, 2)
    got = spark.read.parquet(out + "/batches").orderBy("sample_idx").collect()
    assert [(x.sample_idx, x.batch_id, x.line) for x in got] == [(0, 0, 1), (1, 0, 5), (2, 1, 7)]
    first = TK.BYTE_TO_ID[list(b"p one")].tolist() + TK.BYTE_TO_ID[list(b"r")].tolist() + [TK.EOS_ID]
    assert got[0].input_ids == first + [TK.PAD_ID] * (16 - len(first)) and len(got[1].input_ids) == 16 and len(got[2].input_ids) == 3
    assert got[0].labels[:6] == [-100] * 5 + first[5:6]
    bad = _put(os.path.join(tmpdir_path, "bad.jsonl"), b"nothing\n\n")
    with pytest.raises(ValueError, match="no valid samples"):
        jobs.sft_dataset(spark, bad, os.path.join(tmpdir_path, "no"), 16, 2)
    assert not os.path.exists(os.path.join(tmpdir_path, "no"))
    with pytest.raises(FileNotFoundError):
        jobs.sft_dataset(spark, os.path.join(tmpdir_path, "missing.jsonl"), out, 16, 2)


def _python_truncate(files, budget):
    out, written = "", 0
    for text in files:
        size = len(text.encode())
        if written + size > budget:
            return out + text.encode()[:max(0, budget - written)].decode("utf-8", errors="ignore")
        out, written = out + text + "\n\n", written + size + 2
    return out


def test_corpus_with_code_cut_at_its_budget(spark, tmpdir_path):
    contents = ["def é():\r\n    pass\r\n".encode(), b"x = 1", "y = 'ü' * 3\n\nz\n".encode()]
    code = [_put(os.path.join(tmpdir_path, f"c{i}.py"), c) for i, c in enumerate(contents)]
    docs = _put(os.path.join(tmpdir_path, "d.jsonl"), b'{"text": "one"}\n{"text": "two"}\n')
    texts = [open(p, encoding="utf-8", errors="ignore").read() for p in code]
    for budget in (6, 7, 30, 40, 10_000):
        out = os.path.join(tmpdir_path, f"out{budget}")
        used = {r.group: r for r in jobs.tokenizer_corpus(spark, {"en": [docs]}, {"en": 6, "code": budget}, out, {"code": code}).collect()}
        body = b"".join(open(f, "rb").read() for f in sorted(glob.glob(out + "/code/part-*")))
        want = _python_truncate(texts, budget).encode()
        assert body == want and used["code"].consumed_bytes == len(want) and used["en"].consumed_docs == 1


def test_report_falls_back_to_training_files(spark, tmpdir_path):
    a = _put(os.path.join(tmpdir_path, "a.jsonl"), b'{"text": "held out"}\n')
    b = _put(os.path.join(tmpdir_path, "b.jsonl"), b'{"text": "trained on"}\n{"text": "too"}\n')
    no = os.path.join(tmpdir_path, "no.jsonl")
    rep = {r.group: r for r in jobs.tokenizer_report(spark, {"ko": [a], "en": [no]}, os.path.join(tmpdir_path, "rep"),
                                                     training={"ko": [b], "en": [b], "code": [no]}).collect()}
    assert {g: (r.source, r.docs) for g, r in rep.items()} == {"ko": ("holdout", 1), "en": ("train_fallback", 2), "code": ("missing", None)}


def test_log_points(spark, tmpdir_path):
    rows = ["optimizer_step,train_loss,eval_loss", "20,3.0,", "10,5.0,9.0", "bad,1.0,1.0", "30,oops,7.0", "40,1.0,2.0", "50,2.0,"]
    path = _put(os.path.join(tmpdir_path, "log.csv"), "\n".join(rows).encode())
    got = jobs.log_points(spark, path, os.path.join(tmpdir_path, "plot"), train_window=2).collect()
    train = [(x.step, x.value, x.smooth) for x in sorted(got, key=lambda x: x.idx) if x.series == "train"]
    assert train == [(10, 5, 5), (20, 3, 4), (40, 1, 2), (50, 2, 1.5)]
    assert [(x.step, x.smooth) for x in sorted(got, key=lambda x: x.idx) if x.series == "eval"] == [(10, 9), (30, 8), (40, 6)]
    head = open(glob.glob(os.path.join(tmpdir_path, "plot", "points", "part-*.csv"))[0], encoding="utf-8").read()
    assert head.startswith("﻿step,train_loss,eval_loss\n20.0,3.0,")


def test_a_saved_vocabulary_encodes_alike(spark, tmpdir_path):
    docs = spark.createDataFrame([("the cat sat on the mat " * 3,), ("that cat <NAME> sat",), ("",), (None,)], "text string")
    model = BP.train_bpe(docs, 290)
    path = os.path.join(tmpdir_path, "model")
    BP.save_model(spark, model, path)
    back = BP.load_model(spark, path)
    assert back["merges"] == model["merges"] and back["vocab"] == model["vocab"]
    tok, again = TK.get_tokenizer("bpe", model), TK.get_tokenizer("bpe", back)
    r = docs.select("text", tok.encode("text").alias("a"), again.encode("text").alias("b")).select("*", again.decode("b").alias("t")).collect()
    assert all(x.a == x.b and x.t == x.text for x in r)
    rows = spark.read.parquet(path)
    for bad in (rows.where("merge_rank <> 1"), rows.withColumn("token_hex", F.lit("00"))):
        bad.write.mode("overwrite").parquet(path + "-bad")
        with pytest.raises(ValueError):
            BP.load_model(spark, path + "-bad")


def test_byte_codec_with_atoms_and_cut_characters(spark):
    texts = ["x<NAME>y", "<NAME><EMAIL>", "a <URL", "", None, "<<NAME>>", "<pad", "é<eos>漢", "<unk>" * 3, ">" * 3]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = [x.ids for x in d.select("i", TK.byte_encode("text").alias("ids")).orderBy("i").collect()]

    def one(t):
        out, k = [], 0
        while k < len(t):
            atom = next((a for a in TK.SPECIAL_TOKENS if t.startswith(a, k)), None)
            out += [TK.SPECIAL_TOKENS.index(atom)] if atom else TK.BYTE_TO_ID[list(t[k].encode())].tolist()
            k += len(atom) if atom else 1
        return out

    assert got == [None if t is None else one(t) for t in texts]
    ids = [x for x in got if x is not None] + [TK.BYTE_TO_ID[list("é".encode())].tolist()[:1], [999, -1, 3], []]
    back = spark.createDataFrame([(i, x) for i, x in enumerate([*ids, None])], "i long, ids array<int>").select("i", TK.byte_decode("ids").alias("t"))
    assert [x.t for x in back.orderBy("i").collect()] == [t for t in texts if t is not None] + ["�", "<eos>", "", None]


def test_a_repeated_batch_leaves_the_keyed_table_alone(spark, tmpdir_path):
    from textmill.streaming.logs import keyed_sink

    path = os.path.join(tmpdir_path, "table")
    sink = keyed_sink(path, "group")
    first = spark.createDataFrame([("en", 1), ("", 2), ("k/o", 3)], "group string, docs long")
    second = spark.createDataFrame([("en", 5)], "group string, docs long")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("group", "docs", "batch_id").collect())
    sink(first, 0)
    sink(second, 1)
    want = [("", 2, 0), ("en", 5, 1), ("k/o", 3, 0)]
    assert read() == want
    sink(second, 1)
    assert read() == want


def test_windows_close_alike_however_a_run_is_cut():
    import numpy as np
    import pandas as pd

    from textmill.streaming.logs import close_windows

    r = random.Random(4)
    log = pd.DataFrame({"global_step": range(1, 501), "loss": [float(r.randint(0, 9)) for _ in range(500)], "valid": [r.random() > 0.2 for _ in range(500)]})
    for rule in ("base", "summary"):
        whole, left = close_windows("r", rule, log, 0, 0.0, 0)
        for cuts in ([100], [1, 2, 3, 79, 80, 81], [80, 160, 499]):
            state, out = (0, 0.0, 0), []
            for part in np.split(log, cuts):
                got, state = close_windows("r", rule, part, *state)
                out += [] if got is None else [got]
            assert pd.concat(out, ignore_index=True).equals(whole.reset_index(drop=True)) and state == left
        assert len(whole) == (6 if rule == "base" else len(whole)) > 2
