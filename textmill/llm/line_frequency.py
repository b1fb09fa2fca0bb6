"""Quality rules from cross-document line frequency, in DataFrame functions only.

Lines are normalised (outer white space off, inner runs to one space, lower
case) and hashed.  Per host the documents that hold a line are counted, each
text once, so exact copies and a line repeated inside a text add nothing.  A
line is frequent on a host when more documents hold it than both limits allow:
``min_docs`` and ``share`` of the host's texts.  Frequent lines are removed;
a document that keeps fewer than ``min_words`` words, or less than
``min_left`` of them, is depleted and rejected.  Independent of that, base
rules reject a document of under ``min_words`` words or with more than
``max_repeat`` of its words inside five-word windows that occur twice or more.

Defined results: a null text has no words and fails the base rules; null hosts
form one host; repeated rows each get the same verdict; an empty table gives an
empty result; other columns are kept by :func:`clean_documents` and ignored by
:func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import SPACES, fresh, stage, words

WINDOW = 5
MIN_DOCS = 10
SHARE = 0.05
MIN_WORDS = 10
MIN_LEFT = 0.3
MAX_REPEAT_PERCENT = 20
#: Copies of each frequent line, so that the rows holding one line join in several tasks.
SALTS = 16


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), r"\s+", " "))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not once per element inside a lambda."""
    return F.transform(F.array(value), use)[0]


def repeated_window_words(word_array: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words found twice or more.

    Windows are compared by a 64-bit hash.  Hashes are sorted with their
    positions, equal neighbours give the repeated positions, and the gaps
    between those the words covered: n log n for a text of n words.
    """
    n = F.size(word_array)

    def covered(found: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"))
        return F.aggregate(found, start, step, lambda acc: acc["n"])

    def repeats(by_hash: Column) -> Column:
        equal = lambda e, other: F.coalesce(F.get(by_hash, other)["h"] == e["h"], F.lit(False))
        hits = F.filter(by_hash, lambda e, k: equal(e, k - 1) | equal(e, k + 1))
        return covered(F.sort_array(F.transform(hits, lambda e: e["p"])))

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.cast("int").alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(pairs, repeats))

    starts = F.sequence(F.lit(1), n - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(word_array, i, window)))
    return F.when(n < window, F.lit(0)).otherwise(_bound(hashes, of_hashes)).cast("long")


def _measured(docs: DataFrame) -> DataFrame:
    """Staged: one row per document with its measures and ``lines``, an array
    of (hash, words) of its lines that have a word."""
    d = docs.select("doc_id", F.col("source").cast("string").alias("host"), F.col("text").alias("t"), words(F.col("text")).alias("w"))
    with_word = F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.select("doc_id", "host", "t", "w", F.coalesce(with_word, F.array().cast("array<string>")).alias("ls"))
    lines = F.transform(F.transform("ls", normalised),
                        lambda x: F.struct(F.xxhash64(x).alias("lh"), F.size(F.split(x, " ")).alias("lw")))
    return stage(d.select(
        "doc_id", "host", F.monotonically_increasing_id().alias("rid"), F.xxhash64("t").alias("tkey"),
        F.size("w").cast("long").alias("n_words"),
        F.coalesce(F.char_length(F.array_join("w", "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("t", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"), lines.alias("lines")), "quality-docs")


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``(host, lh, n_docs)`` of the lines above the limits of their host."""
    seen = measured.select("host", "tkey", F.explode(F.array_distinct(F.transform("lines", lambda e: e["lh"]))).alias("lh"))
    counts = seen.distinct().groupBy("host", "lh").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = (measured.select("host", "tkey").distinct().groupBy(F.col("host").alias("h1"))
             .agg(F.count(F.lit(1)).alias("host_docs")))
    return (counts.join(hosts, F.col("host").eqNullSafe(F.col("h1")))
            .where(F.col("n_docs") > share * F.col("host_docs")).select("host", "lh", "n_docs"))


def _judged(docs: DataFrame, min_docs: int, share: float, min_words: int, min_left: float) -> DataFrame:
    d = _measured(docs)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    frequent = stage(frequent_lines(d, min_docs, share), "quality-lines") \
        .select(F.col("host").alias("h1"), F.col("lh").alias("lh1"), salts.alias("salt1"))
    held = d.select("rid", "host", (F.col("rid") % SALTS).alias("salt"), F.explode("lines").alias("e")) \
        .select("rid", "host", "salt", F.col("e.lh").alias("lh"), F.col("e.lw").alias("lw"))
    removed = (held.join(frequent, F.col("host").eqNullSafe(F.col("h1")) & (F.col("lh") == F.col("lh1")) & (F.col("salt") == F.col("salt1")))
               .groupBy(F.col("rid").alias("rid1"))
               .agg(F.sum("lw").cast("long").alias("gone"), F.count(F.lit(1)).alias("gone_lines"), F.collect_set("lh").alias("gone_hashes")))
    j = d.drop("lines").join(removed, F.col("rid") == F.col("rid1"), "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("gone").isNotNull() & ((left < min_words) | (left < min_left * F.col("n_words")))
    return j.withColumns({"words_left": left, "lines_removed": F.coalesce("gone_lines", F.lit(0)),
                          "base_failed": base, "depleted": depleted, "kept": ~base & ~depleted})


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS,
          min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: the measures, what is left of it, and the verdict."""
    return _judged(docs, min_docs, share, min_words, min_left).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed", "words_left",
        "base_failed", "depleted", "kept")


def clean_documents(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS,
                    min_left: float = MIN_LEFT) -> DataFrame:
    """The kept rows of ``docs`` without their frequent lines; ``n_chars``,
    where there is one, follows the text."""
    names = ["doc_id", "host", "tkey", "kept", "gone_hashes"]
    id1, host1, tkey1, kept1, gone1 = mine = fresh(names, docs.columns)
    verdicts = _judged(docs, min_docs, share, min_words, min_left) \
        .where(~F.col("kept") | F.col("gone").isNotNull()).select(*[F.col(n).alias(m) for n, m in zip(names, mine)])
    verdicts = verdicts.dropDuplicates([id1, host1, tkey1])
    same = (F.col("doc_id").eqNullSafe(F.col(id1)) & F.col("source").cast("string").eqNullSafe(F.col(host1))
            & (F.xxhash64("text") == F.col(tkey1)))
    j = docs.join(verdicts, same, "left").where(F.coalesce(kept1, F.lit(True)))
    stays = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col(gone1), F.xxhash64(normalised(x))))
    text = F.when(F.col(gone1).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col(gone1).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(kind))
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
