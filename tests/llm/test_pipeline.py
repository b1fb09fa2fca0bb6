import hashlib
from collections import defaultdict

import brute
import corpus_pipeline
import edge
from test_jaccard_rtree import grouped
from test_wu_manber import judged

from textmill.llm import line_dedup, sharding
from textmill.llm.sharding import LIMIT_BYTES

SF = "/root/testdata/sf0.01"


def digest60(doc):
    parts = [str(doc["doc_id"])] * (doc["doc_id"] is not None) + [doc["text"]] * (doc["text"] is not None)
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:15], 16)


def cleaned(docs, min_docs=10, share=0.05):
    held, hosts = defaultdict(set), defaultdict(set)
    for d in docs:
        hosts[d["source"]].add(d["text"])
        for x in (d["text"] or "").split("\n"):
            if brute.WORD.search(x):
                held[d["source"], brute.norm_line(x)].add(d["text"])
    out = []
    for d, verdict in zip(docs, brute.quality(docs)):
        if verdict["kept"]:
            lines = [x for x in d["text"].split("\n") if not (
                len(held[d["source"], brute.norm_line(x)]) > min_docs
                and len(held[d["source"], brute.norm_line(x)]) > share * len(hosts[d["source"]]))]
            text = "\n".join(lines)
            out.append({**d, "text": text, "n_chars": d["n_chars"] if text == d["text"] else len(text)})
    return out


def one_each(docs):
    return [d for d, g in zip(docs, grouped(docs)) if g["component_id"] == d["doc_id"]]


def mixed(docs):
    sizes, by = defaultdict(int), defaultdict(list)
    for d in docs:
        n = len(brute.words(d["text"]))
        sizes[d["source"]] += n
        by[d["source"]].append((digest60(d), n, d))
    out = []
    for s, target in brute.targets(sizes).items():
        whole = min(2, int(target // sizes[s])) if sizes[s] else 0
        rest, before = target - whole * sizes[s], 0
        for _, n, d in sorted(by[s], key=lambda x: x[0]):
            extra = whole < 2 and n > 0 and (before + n <= rest or (before <= rest and 2 * (rest - before) >= n))
            out += [d] * (whole + extra)
            before += n
    return out


def sharded(docs, limit):
    total = defaultdict(int)
    for d in docs:
        for k in range(61):
            total[k, digest60(d) >> (60 - k)] += len((d["text"] or "").encode())
    out = []
    for d in docs:
        k = next(k for k in range(61) if total[k, digest60(d) >> (60 - k)] <= limit)
        out.append({**d, "shard": f"{digest60(d):060b}"[:k] or "*"})
    return out


COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_matches_brute_force(spark):
    docs, bench = brute.read(spark, SF, "documents"), brute.read(spark, SF, "benchmark")
    step1 = cleaned(docs)
    step2 = one_each(step1)
    step3 = [d for d, j in zip(step2, judged(step2, bench)) if not j["contaminated"]]
    step4 = mixed(step3)
    want = sharded(step4, LIMIT_BYTES)
    assert len(docs) > len(step1) > len(step2) > len(step3)
    got = brute.rows(corpus_pipeline.run(spark, SF))
    assert brute.key_counts(got, [*COLS, "shard"]) == brute.key_counts(want, [*COLS, "shard"])


def test_columns_of_working_names_are_kept(spark):
    """Extra columns named like those the operators work with come through every stage."""
    names = ["dkey", "dkey1", "h", "over", "hash", "slot", "slot_depth", "slot_bytes", "bits", "row", "row1", "ref", "comp", "n_words", "n_hit",
             "spans", "items", "host", "tkey", "kept", "gone_hashes", "whole", "threshold", "copy", "mix_source", "first_hash", "id1", "rid"]
    docs = edge.edge_docs(spark).drop("rid", "bytes", "size", "target")
    docs = docs.withColumns({n: line_dedup.F.concat(line_dedup.F.lit(n), line_dedup.F.col("doc_id").cast("string")) for n in names})
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns)
        rows = brute.rows(out)
        assert rows and all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in rows for n in names)
    out = brute.rows(line_dedup.deduplicated(docs))
    assert len(out) == docs.count() and all(n in out[0] for n in names)
    twins = docs.where("doc_id = 9").withColumn("text", line_dedup.F.lit("x" * 600))
    assert len(brute.rows(sharding.shard(twins, 1000))) == 2


def test_stages_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        assert out.columns[:5] == COLS and (k == 4 or out.columns == COLS), name
        assert step(spark, edge.empty_docs(spark), SF).count() == 0
        assert 0 < step(spark, edge.edge_docs(spark), SF).count()
