
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from textmill.operators import budget as B
from textmill.operators import holdout as HO
from textmill.plans import catalog as C
from textmill.sources.tables import corpus_docs

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_mix_positions_cover_stream_once(spark):
    pos = sorted(r.mix_pos for r in E.queries()["ratio_mix"](spark, SF).collect())
    assert pos == list(range(len(pos)))


def test_budget_prefix_is_maximal(spark):
    docs = corpus_docs(spark, SF)
    budgets = B.group_fraction_budgets(docs, C.BUDGET_FRACTION)
    kept = E.queries()["byte_budget_prefix"](spark, SF)
    last = {r.group: r for r in kept.groupBy("group").agg(F.max("cum_bytes").alias("m"), F.count("*").alias("n")).collect()}
    sizes = {}
    for r in docs.select("group", "file", "line", F.octet_length("text").alias("b")).collect():
        sizes.setdefault(r.group, []).append((r.file, r.line, r.b + 2))
    for g, rows in sizes.items():
        rows.sort()
        n, m = last[g].n, last[g].m
        assert m <= budgets[g]
        assert n == len(rows) or m + rows[n][2] > budgets[g]  # the next document would overflow


def test_holdout_never_overlaps_training_prefix(spark):
    docs, usage = C.replay_usage(spark, SF)
    sample, _ = HO.holdout_text(docs, usage, C.HOLDOUT_TEXT_N)
    idx = HO.in_source_index(docs).select("doc_id", "group", "file", "src_doc")
    s = sample.select("doc_id").join(idx, "doc_id").join(usage, ["group", "file"])
    assert s.where(F.col("src_doc") < F.col("consumed_docs")).count() == 0
    assert sample.where(F.char_length("text") < 50).count() == 0


def test_rouge_bounds_and_identity(spark):
    r = E.queries()["rouge_scores"](spark, SF)
    for c in ("r1_p", "r1_r", "r1_f1", "r2_p", "r2_r", "r2_f1"):
        assert r.where((F.col(c) < 0) | (F.col(c) > 1)).count() == 0
    from textmill.operators import rouge as RG
    same = C.prediction_pairs(spark, SF).withColumn("prediction", F.col("reference"))
    s = RG.compute_rouge(same).where(F.size(RG.rouge_tokens(F.lit("x"))) > 0)
    assert s.where((F.col("rouge.rouge1.f1") != 1.0) | (F.col("rouge.rougeL.f1") != 1.0)).count() == 0


def test_pad_batches_equal_lengths(spark):
    b = E.queries()["pad_batches"](spark, SF)
    per = b.groupBy("batch_id").agg(F.countDistinct("padded_len").alias("k"), F.count("*").alias("n"))
    assert per.where(F.col("k") != 1).count() == 0
    assert per.where(F.col("n") > C.SFT_BATCH).count() == 0


def test_byte_roundtrip_is_total(spark):
    q = E.queries()["tokenizer_quality"](spark, SF)
    assert q.where(F.col("roundtrip_success_ratio") != 1.0).count() == 0


def test_blocks_are_the_stream_prefix(spark):
    meta = E.queries()["pack_metadata"](spark, SF).first()
    blocks = E.queries()["pack_blocks"](spark, SF)
    assert blocks.count() == meta.total_blocks
    assert blocks.where(F.col("n_ids") != C.PACK_BLOCK).count() == 0
    assert meta.total_blocks * C.PACK_BLOCK <= meta.total_tokens < (meta.total_blocks + 1) * C.PACK_BLOCK


def test_no_cap_and_no_fixed_languages(spark, tmp_path):
    """12 000 documents of one language and a few of a fifth one: none is lost."""
    import __spark_entry__ as E
    docs = (spark.range(12_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang",
                                           "concat('src', id % 3) AS source")
            .unionByName(spark.range(12_000, 12_040).selectExpr("id AS doc_id", "concat('tekst ', id) AS text",
                                                                "element_at(array('nl', 'de', 'es', 'fr'), cast(id % 4 AS int) + 1) AS lang",
                                                                "'src0' AS source"))
            .selectExpr("*", "length(text) AS n_chars"))
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    qs = E.queries()
    rows = {r.group: r.docs for r in qs["tokenizer_quality"](spark, sf).collect()}
    assert rows == {"en": 12_000, "nl": 10, "de": 10, "es": 10, "fr": 10}
    mix = qs["ratio_mix"](spark, sf)
    assert mix.where("role = 'main'").count() == 12_020
    assert {r.group for r in qs["corpus_sink_stats"](spark, sf).collect()} == set(rows)
    assert {r.group for r in qs["byte_budget_truncate"](spark, sf).collect()} == set(rows)


def test_building_a_query_runs_nothing(spark):
    """Beyond reading the footer of the one table, no job starts before the action."""
    import __spark_entry__ as E
    qs, sc = E.queries(), spark.sparkContext
    for name in ("tokenizer_quality", "top_tokens", "rouge_scores", "rouge_l", "rouge_summary", "ngram_counts", "lcs_length"):
        sc.setJobGroup(f"build-{name}", name)
        qs[name](spark, "/root/testdata/sf0.001")
        assert len(sc.statusTracker().getJobIdsForGroup(f"build-{name}")) <= 1, name
    sc.setLocalProperty("spark.jobGroup.id", None)
