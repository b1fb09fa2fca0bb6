"""Work that must grow no faster than the input (findings of round 3)."""
import glob
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from textmill.functions import tokens as TK
from textmill.operators import bpe as BP
from textmill.plans import catalog
from textmill.session import configure
from textmill.streaming import logs as STR


class _State:
    """State of one bucket, counting the calls that a worker sends to the JVM."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def _call(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._call(self.value is not None)

    def get(self):
        return self._call(self.value)

    def update(self, value):
        self.value = self._call(value)

    def containsKey(self, key):
        return self._call(key in self.map)

    def getValue(self, key):
        return self._call(self.map[key])

    def updateValue(self, key, value):
        self.map[key] = self._call(value)

    def removeKey(self, key):
        self._call(self.map.pop(key))


def _windows(log, rule):
    """Brute force: ``run, global_step, optimizer_step, train_loss, n_losses``."""
    out = []
    for run in dict.fromkeys(r for r, *_ in log):
        updates, seen = 0, []
        for _, step, loss, valid in sorted(x for x in log if x[0] == run):
            if rule == "summary" and not valid:
                continue
            seen.append(loss)
            if step % 8 == 0:
                updates += 1
                if updates % 10 == 0:
                    out.append((str(run), step, updates, sum(seen) / len(seen), len(seen)))
                    seen = []
    return sorted(out)


def test_steps_ahead_of_a_gap_take_a_state_call_a_stretch():
    """Files in any order, rows that come again, a run without a name: before, a call for every waiting row."""
    r = random.Random(5)
    logs = {run: [(run, k, float(r.randint(0, 9)), r.random() > 0.1) for k in range(1, n + 1)] for run, n in (("a", 900), ("b", 400), (None, 333), ("c", 7))}
    log = [x for rows in logs.values() for x in rows]
    for rule in ("base", "summary"):
        for order in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)):
            state, out = _State(), []
            p = STR.WindowProcessor(rule)
            p.init(state)
            for k in order:
                part = [x for x in log if (x[1] - 1) // 100 % 4 == k or (x[1] - 1) // 100 == k + 4 or x[1] % 100 == 7]
                r.shuffle(part)
                frame = pd.DataFrame(part, columns=["run", "global_step", "loss", "valid"])
                for got in p.handleInputRows((0,), iter([frame[:50], frame[50:]]), None):
                    out += got.itertuples(index=False, name=None)
            assert [(*x[:3], round(x[3], 6), x[4]) for x in sorted((str(x[0]), *x[1:]) for x in out)] == [(*x[:3], round(x[3], 6), x[4]) for x in _windows(log, rule)]
            assert not state.map and state.calls < 400


def _documents(spark, folder, n):
    rows = [(k, f"doc {k} of words " * 40, ("en", "ko", "de")[k % 3], "web") for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return rows


def _codec(merges):
    return BP.Codec(np.array([a * BP.PAIR_SHIFT + b for a, b, _ in merges], np.int64), np.array([n for *_, n in merges], np.int32))


def test_new_pretokens_of_a_batch_are_merged_together(monkeypatch):
    """As word by word; before, a heap for every new pre-token."""
    r, (vocab, index) = random.Random(6), BP.base_vocabulary()
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(300)]
    syms = lambda w: TK.BYTE_TO_ID[np.frombuffer(w.encode(), np.uint8)].tolist()
    merges = BP.greedy_merges([syms(w) for w in words], [1] * len(words), 1, vocab, index, 340)
    a, b, ab = merges[0]
    reused = [*merges, (b, a, merges[1][2])]  # an id made twice: a merge may make a pair of an earlier one
    texts = [" ".join(words[:200]), None, "", "  a\t\tbb <NAME>cab's 'll 한글한글 x<URL>", "abcab" * 50, *words]
    slow, calls = BP.bpe_encode_word, []
    monkeypatch.setattr(BP, "bpe_encode_word", lambda *x: calls.append(1) or slow(*x))
    for model in (merges, reused, []):
        codec, want = _codec(model), []
        for t in texts:
            ids = []
            for k, piece in enumerate(codec.atoms.split(t or "")):
                ids += [TK.SPECIAL_TOKENS.index(piece)] if k % 2 else [x for w in codec.pattern.findall(piece) for x in slow(syms(w), codec.ranks)]
            want.append(None if t is None else ids)
        calls.clear()
        got = [codec(pa.array(texts[:4], pa.string())), codec(pa.array(texts[2:], pa.string()))]
        assert got[0].to_pylist() == want[:4] and got[1].to_pylist() == want[2:]
        if model is merges:
            assert len(calls) == 1  # the long one


def test_ids_that_are_decoded_are_encoded_once(spark):
    enc, dec = BP.make_bpe_encoder([]), BP.make_bpe_decoder(BP.base_vocabulary()[0])
    d = spark.createDataFrame([("ab <URL>",), (None,)], "text string").withColumn("ids", enc("text"))
    d = d.select(F.size("ids").alias("n"), (dec("ids") == F.col("text")).alias("ok"), "ids")
    assert "(enc(" not in d._jdf.queryExecution().executedPlan().toString()
    assert [(x.ids and x.n, x.ok) for x in d.collect()] == [(4, True), (None, None)]


def test_ingest_files_grow_with_the_scan(spark, tmp_path, monkeypatch):
    """Before, four tasks read all texts."""
    configure(spark)
    rows = _documents(spark, tmp_path, 3000)
    taken, ingest = [], STR.stream_ingest_counts
    monkeypatch.setattr(STR, "stream_ingest_counts", lambda *x: taken.append(x) or ingest(*x))
    conf = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions()
        got = {x.group: (x.docs, x.bytes) for x in catalog.QUERIES["stream_ingest_counts"](spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    src, most = taken[0][1].removeprefix("file:"), taken[0][4]
    files = glob.glob(f"{src}/group=en/part-*")
    assert n > 4 and len(files) == n and most == n // 4
    assert got == {g: (1000, sum(len(t.strip()) for _, t, lang, _ in rows if lang == g)) for g in ("en", "ko", "de")}
