"""Loading the driver tables and shaping them into the reference's inputs.

Stand-ins (see README):

* corpus documents: ``documents`` with group = ``lang``, file = ``source``
  (files ordered by name), line = ``doc_id``;
* prompt/response pairs: a ``user`` turn directly followed by an
  ``assistant`` turn of the same conversation;
* training log: ``events`` ordered by ``(ts, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, group, file, line, text)`` from ``documents``."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("group"), F.col("source").alias("file"),
                    F.col("doc_id").alias("line"), "text")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, conv_id, turn, prompt, response)``.

    An equi-join on ``(conv_id, turn + 1)``: both keys are hashed, so one very
    long conversation spreads over many tasks (a ``lead()`` window partitioned
    by conversation would put it in one).  ``pair_id = conv_id * 2^20 + turn``
    is unique and increases along ``(conv_id, turn)``.
    """
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    p = u.join(a, ["conv_id", "turn"])
    return p.select((F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("pair_id"),
                    "conv_id", "turn", "prompt", "response")


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a per-micro-step log: ``global_step`` = 1-based position
    in ``(ts, event_id)`` order, ``loss`` = ``value``, ``valid`` = not an
    ``error`` event.  The dense position uses range buckets on the full key,
    so a burst of events at one instant does not land in one task."""
    from textmill.operators.ordering import BK, dense_index, range_buckets

    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = range_buckets(e, ["ts", "event_id"])
    e = dense_index(e, [], ["ts", "event_id"], BK, out="global_step", base=1).drop(BK)
    return e.select("global_step", "event_id", "user_id", "event_type",
                    F.col("value").alias("loss"), (F.col("event_type") != "error").alias("valid"))
