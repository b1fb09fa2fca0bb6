from collections import defaultdict

import brute
import edge
import pytest

from textmill.llm import line_frequency, mixing, sharding

SF = "/root/testdata/sf0.01"
COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed", "words_left",
        "base_failed", "depleted", "kept"]


def test_line_frequency_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.quality(brute.read(spark, SF, "documents"), min_docs=2)
    got = brute.rows(line_frequency.judge(docs, min_docs=2))
    assert brute.key_counts(got, COLS) == brute.key_counts(want, COLS)
    assert any(r["lines_removed"] for r in got) and any(not r["kept"] for r in got)


def test_line_frequency_edges(spark):
    docs = edge.edge_docs(spark)
    want = brute.quality(brute.rows(docs), min_docs=1, share=0.2)
    assert brute.key_counts(brute.rows(line_frequency.judge(docs, 1, 0.2)), COLS) == brute.key_counts(want, COLS)
    assert line_frequency.judge(edge.empty_docs(spark)).count() == 0
    kept = line_frequency.clean_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["rid"] for r in brute.rows(kept)) == sorted(i for i, r in enumerate(want) if not r["base_failed"])


def test_depleted_documents_go_and_others_lose_the_line(spark):
    common = "this very line stands in each document of the host and says nothing else"
    rs = [(i, f"{common}\n" + edge.prose(40 if i else 5, i), "en", "h", 1) for i in range(30)]
    docs = spark.createDataFrame(rs, brute.DOCS)
    out = {r["doc_id"]: r for r in brute.rows(line_frequency.clean_documents(docs))}
    assert set(out) == set(range(1, 30))
    assert all(common not in r["text"] and r["n_chars"] == len(r["text"]) for r in out.values())


def test_exact_copies_do_not_make_their_lines_frequent(spark):
    text = edge.prose(80, 5)
    docs = spark.createDataFrame([(i, text if i < 60 else edge.prose(50, i), "en", "h", 1) for i in range(100)], brute.DOCS)
    assert all(r["kept"] for r in brute.rows(line_frequency.judge(docs)))


@pytest.mark.parametrize("which", ["sf", "edge"])
def test_mix_meets_targets(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "sf" else edge.edge_docs(spark)
    size, most = defaultdict(int), defaultdict(int)
    for d in brute.rows(docs):
        n = len(brute.words(d["text"]))
        size[d["source"]] += n
        most[d["source"]] = max(most[d["source"]], n)
    want = brute.targets(size)
    got = brute.rows(mixing.mix(docs))
    assert len(got) == docs.count()
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in size:
        # the threshold falls on the nearer side of one document (two equal rows go together)
        assert abs(taken[s] - want[s]) <= (most[s] / 2 if which == "sf" else most[s])
    again = brute.rows(mixing.mix(docs.repartition(5)))
    assert brute.key_counts(got, ["doc_id", "taken"]) == brute.key_counts(again, ["doc_id", "taken"])
    rows = brute.rows(mixing.mixed_documents(docs))
    assert sum(len(brute.words(r["text"])) for r in rows) == sum(taken.values())


def test_mix_empty(spark):
    assert mixing.mix(edge.empty_docs(spark)).count() == 0
    assert mixing.mixed_documents(edge.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("limit,step", [(100_000, 10), (20_000, 2), (10 ** 9, 10)])
def test_shards_fit_and_split_only_when_needed(spark, limit, step):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = brute.rows(sharding.shard(docs, limit, step))
    assert len(got) == docs.count()
    sums = defaultdict(int)
    for r in got:
        sums[r["shard"]] += len(r["text"].encode())
        assert r["oversized"] == (r["bytes"] > limit)
    for r in got:
        assert r["shard_bytes"] == sums[r["shard"]]
        assert r["oversized"] or sums[r["shard"]] <= limit
    plain = {s: b for s, b in sums.items() if not s.startswith("alone")}
    for s in plain:
        if s != "*":
            assert sum(b for t, b in plain.items() if t.startswith(s[:-1])) > limit  # its parent had to split
    names = sorted(plain)
    assert not any(b != a and b.startswith(a) for a, b in zip(names, names[1:]))


def test_shards_edges(spark):
    docs = edge.edge_docs(spark)
    got = brute.rows(sharding.shard(docs, 400))
    assert len(got) == docs.count() and set(docs.columns) - {"bytes"} < set(got[0])
    assert sharding.shard(edge.empty_docs(spark)).count() == 0
    same = spark.createDataFrame([(1, "x" * 100, "en", "s", 100)] * 50, brute.DOCS)
    sums = defaultdict(int)
    for r in brute.rows(sharding.shard(same, 1000)):
        sums[r["shard"]] += 100
        assert r["shard"].startswith("twins-")
    assert sum(sums.values()) == 5000 and max(sums.values()) <= 1000


def test_repeated_oversized_rows_get_shards_of_their_own(spark):
    rows = [(1, "x" * 500, "en", "s", k) for k in range(7)] + [(2, "x" * 500, "en", "s", 7), (3, "y" * 600, "en", "s", 8), (None, "z" * 401, "en", "s", 9)] * 2
    rows += [(4, "w" * 700, "en", "s", 10), (5, "small", "en", "s", 11)] + [(6, "v" * 90, "en", "s", 12)] * 9
    docs = spark.createDataFrame(rows, brute.DOCS).repartition(5)
    got = brute.rows(sharding.shard(docs, 400))
    assert brute.key_counts(got, docs.columns) == brute.key_counts(brute.rows(docs), docs.columns)
    sums, members = defaultdict(int), defaultdict(int)
    for r in got:
        sums[r["shard"]] += len(r["text"])
        members[r["shard"]] += 1
    for r in got:
        assert r["shard_bytes"] == sums[r["shard"]] and r["oversized"] == (len(r["text"]) > 400)
        assert members[r["shard"]] == 1 if r["oversized"] else sums[r["shard"]] <= 400
    # a hash of one row is the whole name
    assert [r["shard"].count("-") for r in got if r["doc_id"] == 4] == [1]
    mixed = spark.createDataFrame([(8, "a b " * 200, "en", "s", 800)], brute.DOCS)
    assert len({r["shard"] for r in brute.rows(sharding.shard(mixed.unionByName(mixed), 400))}) == 2
