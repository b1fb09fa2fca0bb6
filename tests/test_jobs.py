"""End-to-end jobs over temporary JSONL files."""

import glob
import json
import os

from textmill import jobs
from textmill.functions import tokens as TK


def _write_jsonl(path, texts):
    with open(path, "w", encoding="utf-8") as f:
        for t in texts:
            f.write(json.dumps({"text": t}, ensure_ascii=False) + "\n")
        f.write("\nnot json\n")


def test_jobs_end_to_end(spark, tmpdir_path):
    d = tmpdir_path
    a1, a2, b1, c1 = (os.path.join(d, n) for n in ("a1.jsonl", "a2.jsonl", "b1.jsonl", "c1.jsonl"))
    _write_jsonl(a1, [f"main text number {i} é" for i in range(40)])
    _write_jsonl(a2, [f"second main file {i}" for i in range(25)])
    _write_jsonl(b1, [f"repeat {i}" for i in range(4)])
    _write_jsonl(c1, [f"def f{i}(): return {i}" for i in range(3)])

    usage = {r.group: r for r in jobs.tokenizer_corpus(spark, {"ko": [a1, a2], "en": [b1]}, {"ko": 500, "en": 10_000},
                                                       os.path.join(d, "corpus")).collect()}
    assert usage["ko"].consumed_bytes <= 500 and usage["en"].consumed_docs == 4
    body = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(os.path.join(d, "corpus", "ko", "part-*"))))
    assert body.startswith("main text number 0 é\n\n") and body.count("\n\n") == usage["ko"].consumed_docs

    meta = jobs.packed_dataset(spark, {"ko": [a1, a2]}, {"en": [b1]}, {"code": [c1]}, os.path.join(d, "packed"),
                               block_size=64, eval_blocks=2, blocks_per_file=4).first()
    assert meta.total_docs == meta.docs_ko + meta.docs_en + meta.docs_code and meta.docs_ko == 65
    back = spark.read.parquet(os.path.join(d, "packed", "blocks"))
    assert back.count() == meta.total_blocks and back.where("size(input_ids) <> 64").count() == 0
    assert json.loads(open(glob.glob(os.path.join(d, "packed", "metadata", "part-*"))[0]).read())["block_size"] == 64

    rep = {r.group: r for r in jobs.tokenizer_report(spark, {"ko": [a1, a2], "code": [c1]}, os.path.join(d, "report"),
                                                     TK.get_tokenizer("byte")).collect()}
    assert rep["ko"].docs == 65 and rep["ko"].roundtrip_success_ratio == 1.0
    assert len(rep["ko"].top_used_tokens) == 20 and not rep["ko"].roundtrip_fail_examples


def test_holdout_and_summary_jobs(spark, tmpdir_path):
    d = tmpdir_path
    a, b = os.path.join(d, "a.jsonl"), os.path.join(d, "b.jsonl")
    _write_jsonl(a, [f"{'x' * 60} {i}" for i in range(30)])
    _write_jsonl(b, [f"{'y' * 60} {i}" for i in range(30)])
    code = os.path.join(d, "code.txt")
    with open(code, "w") as f:
        f.write("\n\n".join(f"def block_{i}():\n    return {i} + {i}" for i in range(40)))
    man = {(r.group, r.file.split(":")[0]): r for r in jobs.holdout_split(
        spark, {"g": [a, b]}, {"g": 1000}, code, 300, os.path.join(d, "holdout"), n_text=5, n_code=4).collect()}
    first = man[("g", "000000")]
    sizes = [len(f"{'x' * 60} {i}") + 2 for i in range(30)]
    want = max(k for k in range(31) if sum(sizes[:k]) <= 1000)
    assert first.consumed_docs == want and first.consumed_bytes == sum(sizes[:want]) and first.sampled == 5
    assert man[("g", "000001")].consumed_docs == 0 and man[("g", "000001")].eligible_unused == 30
    assert man[("code", code)].sampled == 4
    lines = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(d, "holdout", "text", "part-*"))))
    assert lines.count("\n") == 10
    t = os.path.join(d, "test.jsonl")
    with open(t, "w") as f:
        f.write(json.dumps({"id": "s1", "prompt": "p", "response": "abc"}) + "\n")
        f.write(json.dumps({"prompt": "q", "response": "abd"}) + "\n")
    preds = spark.createDataFrame([("s1", "abc"), ("2", "xyz")], "id string, prediction string")
    avg = jobs.summary_eval(spark, t, preds, os.path.join(d, "eval")).first()
    assert avg.samples == 2 and avg.rouge1_f1 == 0.5


def test_tokenizer_corpus_takes_text_files(spark, tmpdir_path):
    import os

    from textmill import jobs
    code = os.path.join(tmpdir_path, "code.txt")
    with open(code, "w", newline="") as f:
        f.write("def f():\r\n  pass\r\n\r\nx = 1\r\n\r\ny = 2\r\n")
    used = jobs.tokenizer_corpus(spark, {"code": [code]}, {"code": 10_000}, os.path.join(tmpdir_path, "out")).collect()
    assert [(r.group, r.consumed_docs) for r in used] == [("code", 3)]
