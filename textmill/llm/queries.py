"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import crf, jaccard_rtree, knn_quality, lattice, lexical, line_dedup, line_frequency, mixing, prefix_trie, secrets, sharding, warc, wu_manber
from textmill.llm.common import left_out, stage
from textmill.session import scratch_path
from textmill.sources.tables import table


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm-warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    # the narrow records are read twice, the archives once
    return warc.page_records(stage(warc.read(spark, path, payload=False), "warc-records"))


def op2_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = secrets.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return r.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
                    secrets.listed(F.concat(plain("base"), plain("linked"))).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = wu_manber.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "oversized")


def op7_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.groups(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decide(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_exact", "n_near", "dropped")


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    r = crf.tag(docs, crf.train(docs, labels, 3, 1))
    return r.select("doc_id", left_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    r = knn_quality.score(docs, knn_quality.train(docs, labels, 5, 0))
    return r.select("doc_id", left_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), left_out(7, 2))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_warc_salvage, op2_credential_links, op3_line_frequency, op4_mix_sources, op5_wu_manber, op6_extendible_shards,
                                   op7_jaccard_rtree, op8_line_dedup, op9_crf_toxicity, op10_knn_quality, op11_subword_lattice, op12_prefix_trie, op13_lexical_search)}
