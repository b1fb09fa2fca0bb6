"""Byte budgets over ordered corpora.

Rows are documents ``(group, file, line, text)``; the order inside a group is
``(file, line)`` (file order is the order of file names).  A document costs
``octet_length(text) + 2`` bytes: the text plus its ``"\\n\\n"`` separator.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import utf8_prefix
from textmill.operators.ordering import BK, dense_index, id_bucket, range_buckets, running_total

SEP_BYTES = 2


def budget_col(budget, group: str) -> Column:
    """Per-row budget: a number, a ``{group: bytes}`` dict or a Column."""
    if isinstance(budget, Column):
        return budget
    if isinstance(budget, dict):
        pairs = []
        for k, v in budget.items():
            pairs += [F.lit(k), F.lit(int(v)).cast("long")]
        return F.create_map(*pairs)[F.col(group)]
    return F.lit(int(budget)).cast("long")


def with_block_bytes(docs: DataFrame, text: str = "text", out: str = "block_bytes") -> DataFrame:
    return docs.withColumn(out, (F.octet_length(text) + F.lit(SEP_BYTES)).cast("long"))


def _doc_bucket(file: str, line: str, width: int) -> Column:
    # non-decreasing along (file, line); at most `width` rows when line is unique
    return F.struct(F.col(file).alias("f"), id_bucket(line, width).alias("b"))


def corpus_composition(docs: DataFrame, group: str = "group", text: str = "text") -> DataFrame:
    """A1: documents and bytes (with separators) per group and share of the total."""
    g = (with_block_bytes(docs, text)
         .groupBy(group)
         .agg(F.count(F.lit(1)).alias("docs"), F.sum("block_bytes").alias("bytes")))
    # window over the aggregated rows only (one row per group)
    total = F.sum("bytes").over(Window.partitionBy())
    return g.withColumn("byte_ratio", F.round(F.col("bytes") / total, 9))


def group_fraction_budgets(docs: DataFrame, fraction: float, group: str = "group",
                           text: str = "text") -> dict:
    """``floor(fraction * group bytes)`` per group; collects one row per group."""
    rows = (with_block_bytes(docs, text).groupBy(group)
            .agg(F.sum("block_bytes").alias("b")).collect())
    return {r[0]: int(r[1] * fraction) for r in rows}


def byte_budget_prefix(docs: DataFrame, budget, group: str = "group", file: str = "file",
                       line: str = "line", text: str = "text", bucket_width: int = 10_000,
                       keys: list[str] | None = None) -> DataFrame:
    """The documents a budgeted writer takes, stopping the whole group at
    the first document that would overflow.  Sizes are positive, so the kept
    rows are exactly those whose running total is within the budget.

    Adds ``block_bytes`` and ``cum_bytes``.  Buckets that start past the budget
    are pruned before the shuffle.  With ``keys`` only those columns (plus
    group, file, line) are kept: the byte sizes are taken in one scan and the
    narrow table is checkpointed, so the two passes of the running total do
    not read the text twice; join the text back on a key when needed.
    """
    b = budget_col(budget, group)
    d = with_block_bytes(docs, text)
    if keys is not None:
        d = d.select(*dict.fromkeys([group, file, line, *keys, "block_bytes"])).checkpoint(eager=True)
    r = running_total(d, [group], [file, line], "block_bytes",
                      _doc_bucket(file, line, bucket_width), out="cum_bytes", max_start=b)
    return r.where(F.col("cum_bytes") <= b)


def budget_usage(kept: DataFrame, group: str = "group") -> DataFrame:
    """Consumed documents and bytes per group from :func:`byte_budget_prefix`."""
    return kept.groupBy(group).agg(
        F.count(F.lit(1)).alias("consumed_docs"),
        F.coalesce(F.sum("block_bytes"), F.lit(0)).cast("long").alias("consumed_bytes"))


def source_prefix_sums(docs: DataFrame, group: str = "group", file: str = "file",
                       line: str = "line", text: str = "text", bucket_width: int = 10_000) -> DataFrame:
    """Running bytes inside each source (file) of each group."""
    d = with_block_bytes(docs, text)
    return running_total(d, [group, file], [line], "block_bytes",
                         id_bucket(line, bucket_width), out="cum_in_file")


#: Sources whose functions are composed together.
BLOCK_SOURCES = 1_000


def then(starts, taken, sums):
    """The composition of "what is taken of a remaining budget" with one more
    source.  ``taken[i]`` holds for budgets from ``starts[i]`` up to the next
    start; ``sums`` are the running bytes of the source's documents."""
    low = starts - taken
    high = np.r_[starts[1:] - taken[:-1], np.iinfo(np.int64).max]
    a, b = np.searchsorted(sums, low, "right"), np.searchsorted(sums, high, "left")
    reach = np.r_[0, sums]
    n = b - a + 1  # the interval itself and the sums inside it
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    more = reach[a[row] + nth]
    starts, taken = np.where(nth == 0, starts[row], taken[row] + more), taken[row] + more
    new = np.r_[True, taken[1:] != taken[:-1]]
    return starts[new], taken[new]


def _sources(rows):
    """``(file, running bytes)`` of a block's sources in name order."""
    for file, g in rows.groupby("file", sort=True):
        yield file, np.sort(g["cum"].to_numpy())


def _composed(rows):
    starts = taken = np.zeros(1, np.int64)
    for _, sums in _sources(rows):
        starts, taken = then(starts, taken, sums)
    return pd.DataFrame({"g": rows["g"].iloc[:1].to_numpy(), "block": rows["block"].iloc[:1].to_numpy(), "left": rows["left"].iloc[:1].to_numpy(),
                         "starts": [starts], "taken": [taken]})


def _entered(blocks):
    """What each of a group's blocks finds left."""
    blocks = blocks.sort_values("block")
    left, out = int(blocks["left"].iloc[0]), []
    for starts, taken in zip(blocks["starts"], blocks["taken"]):
        out.append(left)
        left -= int(taken[np.searchsorted(starts, left, "right") - 1])
    return pd.DataFrame({"g1": blocks["g"], "block1": blocks["block"], "entered": out})


def _walked(rows):
    left, out = int(rows["entered"].iloc[0]), []
    for file, sums in _sources(rows):
        n = int(np.searchsorted(sums, left, "right"))
        took = int(sums[n - 1]) if n else 0
        out.append((file, n, took))
        left -= took
    d = pd.DataFrame(out, columns=["f", "docs", "bytes"])
    d.insert(0, "g", rows["g"].iloc[0])
    return d


def budget_replay(docs: DataFrame, budget, group: str = "group", file: str = "file",
                  line: str = "line", text: str = "text", bucket_width: int = 10_000,
                  block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """A2: per source, the prefix a replay of a shared budget consumes.

    Sources are visited in name order; inside a source documents are taken
    until the first that would overflow the *remaining* budget, then the next
    source is tried with what is left (``on_overflow='next_source'``).  Once
    nothing remains, later sources consume nothing.

    Nothing is walked on the driver.  Sources whose running total (two-level)
    stays within the budget are taken whole; the first other source of a group
    is cut.  What is left then is less than one document, so of the later
    sources only documents whose running bytes fit into it can matter.  A source
    is a step function from what remains to what it takes; blocks of
    ``block_sources`` sources compose theirs, each group passes its remainder
    through its blocks' functions, and every block then takes its documents.
    Returns ``(group, file, consumed_docs, consumed_bytes)``.
    """
    from textmill.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    g, f = F.col("g"), F.col("f")
    cum = source_prefix_sums(docs, group, file, line, text, bucket_width)
    cum = cum.select(F.col(group).alias("g"), F.col(file).alias("f"), F.col("cum_in_file").alias("cum")).checkpoint(eager=True)
    src = cum.groupBy(g, f).agg(F.count(F.lit(1)).alias("n"), F.max("cum").alias("total"), F.min("cum").alias("first"))
    src = running_total(range_buckets(src, ["f"], ["g"]), ["g"], ["f"], "total", BK, out="upto")
    # a group without a budget has none
    src = src.withColumn("budget", F.coalesce(budget_col(budget, "g"), F.lit(0)).cast("long") if budget != {} else F.lit(0).cast("long")).checkpoint(eager=True)

    over = F.col("upto") > F.col("budget")
    cut = (src.where(over).groupBy(g).agg(F.min(F.struct("f", (F.col("budget") - F.col("upto") + F.col("total")).alias("room"))).alias("c"))
           .select(g.alias("g0"), F.col("c.f").alias("f0"), F.col("c.room").alias("room")))
    took = (cum.join(cut, (g == F.col("g0")) & (f == F.col("f0"))).where(F.col("cum") <= F.col("room"))
            .groupBy(g, f).agg(F.count(F.lit(1)).alias("docs"), F.max("cum").alias("bytes")))
    cut = (cut.join(took, (g == F.col("g0")), "left")
           .select("g0", "f0", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
                   (F.col("room") - F.coalesce("bytes", F.lit(0))).alias("left")).checkpoint(eager=True))

    later = src.join(cut.select("g0", "f0", "left"), (g == F.col("g0"))).where((f > F.col("f0")) & (F.col("first") <= F.col("left")))
    later = dense_index(later.select("g", "f", "left", BK), ["g"], ["f"], BK, out="at")
    later = later.select(g.alias("g2"), f.alias("f2"), "left", F.floor(F.col("at") / block_sources).alias("block"))
    heads = cum.join(later, (g == F.col("g2")) & (f == F.col("f2"))).where(F.col("cum") <= F.col("left"))
    heads = heads.select("g", f.alias("file"), "cum", "left", "block").checkpoint(eager=True)
    kind = src.schema["g"].dataType.simpleString()
    name = src.schema["f"].dataType.simpleString()
    blocks = heads.groupBy("g", "block").applyInPandas(_composed, f"g {kind}, block long, left long, starts array<long>, taken array<long>")
    entered = blocks.groupBy("g").applyInPandas(_entered, f"g1 {kind}, block1 long, entered long")
    heads = heads.join(entered, (g == F.col("g1")) & (F.col("block") == F.col("block1"))).select("g", "file", "cum", "block", "entered")
    rest = heads.groupBy("g", "block").applyInPandas(_walked, f"g {kind}, f {name}, docs long, bytes long")

    part = cut.select(F.col("g0").alias("g"), F.col("f0").alias("f"), "docs", "bytes").unionByName(rest)
    part = part.select(g.alias("g3"), f.alias("f3"), "docs", "bytes")
    out = src.join(part, (g == F.col("g3")) & (f == F.col("f3")), "left")
    whole = lambda c, p: F.when(over, F.coalesce(p, F.lit(0))).otherwise(F.col(c)).cast("long")
    return out.select(g.alias(group), f.alias(file), whole("n", "docs").alias("consumed_docs"), whole("total", "bytes").alias("consumed_bytes"))


def code_budget(source_bytes: Column, budget) -> tuple[Column, Column]:
    """A3: bytes a budgeted writer takes from a code file of ``source_bytes``
    (its text plus one unchecked separator), and whether that covers it."""
    b = budget if isinstance(budget, Column) else F.lit(int(budget)).cast("long")
    consumed = F.least(source_bytes + F.lit(SEP_BYTES), b)
    return consumed, consumed >= source_bytes


def byte_budget_truncate(pieces: DataFrame, budget, group: str = "group", file: str = "file",
                         line: str = "line", text: str = "text",
                         bucket_width: int = 10_000) -> DataFrame:
    """A raw-text writer that copies whole files, each followed by an
    unchecked ``"\\n\\n"``, and cuts the file crossing the budget at the last
    UTF-8 character boundary within the budget.

    A file's content is the concatenation of its ``text`` pieces in ``line``
    order.  Returns the written pieces with ``start`` (stream offset),
    ``kept_bytes`` and ``kept_text`` (the cut text for the crossing piece).
    Deviation: when a separator already overran the budget, the next file
    contributes nothing (the reference would slice with a negative length).
    """
    b = budget_col(budget, group)
    d = pieces.withColumn("piece_bytes", F.octet_length(text).cast("long"))
    d = running_total(d, [group, file], [line], "piece_bytes", id_bucket(line, bucket_width),
                      out="start_in_file", exclusive=True)
    sizes = d.groupBy(group, file).agg(F.sum("piece_bytes").alias("file_bytes"))
    w = Window.partitionBy(group).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, file, "file_bytes",
                          F.coalesce(F.sum(F.col("file_bytes") + SEP_BYTES).over(w), F.lit(0))
                          .alias("file_start"))
    starts = starts.where(F.col("file_start") <= b)
    d = d.join(starts, [group, file])
    start = F.col("file_start") + F.col("start_in_file")
    d = d.withColumn("start", start).where(F.col("start") < b)
    room = b - F.col("start")
    whole = F.col("piece_bytes") <= room
    cut = utf8_prefix(text, room)
    return (d.withColumn("kept_text", F.when(whole, F.col(text)).otherwise(cut))
             .withColumn("kept_bytes", F.octet_length("kept_text").cast("long"))
             .withColumn("file_done", (F.col("file_start") + F.col("file_bytes")) <= b)
             .drop("start_in_file"))


def truncate_written_bytes(written: DataFrame, group: str = "group", file: str = "file") -> DataFrame:
    """Total bytes W2 writes per group: kept bytes plus the separator of every
    completed file."""
    per_file = written.groupBy(group, file).agg(
        F.sum("kept_bytes").alias("kb"), F.max(F.col("file_done").cast("int")).alias("done"))
    return per_file.groupBy(group).agg(
        (F.sum("kb") + F.lit(SEP_BYTES) * F.sum("done")).cast("long").alias("written_bytes"))
