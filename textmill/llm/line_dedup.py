"""Line dedup over all documents by a deletion-neighbourhood join.

A line (outer white space off) goes if an earlier one, by document id and line
number, equals it or is within one edit (insertion, deletion, substitution of a
code point); the earliest stays.

Two lines one edit apart share a variant: with the same place of both left out
(substitution), or the longer one without one code point is the shorter one.
All variants of all lines would be hundreds of keys a line, so they come in two
rounds.  The first leaves out whole quarters: lines one edit apart agree on all
but one quarter, and few other lines do.  The second emits, for lines that
share such a key, the variants of that quarter only.  Lines under ``SHORT`` code
points have few variants and emit all of them at once.  Equal variants join by
hashed key; per key only the earliest line is compared with the others, which
is exact since all lines that share a substitution key are one edit apart, and
for the others length tells which line is the variant itself.  Surviving pairs
are verified by their edit distance.

Defined results: a null text has no lines, blank lines are neither counted nor
removed; rows equal in ``doc_id`` and line number tie and are kept or dropped
alike; null ids come last; an empty table gives an empty result; other columns
are ignored by :func:`decide` and kept by :func:`deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import SPACES, fresh, stage
from textmill.llm.postings import shared, width_for

#: From this length in code points on a line and its partner share a quarter key first.
SHORT = 16
PARTS = 4


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))


def _cuts(n: int, part: int):
    """Where a part of a line of ``n`` code points begins and ends."""
    return part * n // PARTS, (part + 1) * n // PARTS


def quarter_keys(line: str) -> list:
    """``(key, code)`` of the line without each quarter, for lines of its own
    length (codes 0 to 3) and, as the longer one, of one less (4 to 7)."""
    n, out = len(line), []
    for longer in (0, 1):
        base = n - longer
        if base >= SHORT:
            for part in range(PARTS):
                a, b = _cuts(base, part)
                out.append((_hash(f"{base},{part}", line[:a], line[b + longer:]), part + PARTS * longer))
    return out


def variant_keys(line: str, codes) -> list:
    """Keys of the line's variants in the given quarters; the last bit tells
    substitutions (0) from deletions (1)."""
    n, out = len(line), set()
    whole = lambda text: _hash("variant", text) | 1
    for code in codes:
        longer, part = divmod(code, PARTS)
        a, b = _cuts(n - longer, part)
        if longer:
            out.update(whole(line[:i] + line[i + 1:]) for i in range(a, b + 1))
        else:
            out.update(_hash(f"{n},{i}", line[:i], line[i + 1:]) >> 1 << 1 for i in range(a, b))
            out.add(whole(line))
    return sorted(out)


def _occurrences(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, dkey, line_no, line)`` of every line, with null for
    blank ones and one such row at least per document."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("doc_id", "text").alias("dkey"), "text")
    d = d.select("rid", "doc_id", "dkey", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    trimmed = F.btrim("line", F.lit(SPACES))
    return d.withColumn("line", F.when(trimmed != "", trimmed))


def _texts(docs: DataFrame, least: int = 1) -> DataFrame:
    """``(lh, line)`` of every line from ``least`` code points on, repeats included."""
    return (docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.btrim("line", F.lit(SPACES)).alias("line"))
            .where(F.char_length("line") >= least).select(F.xxhash64("line").alias("lh"), "line"))


def _quarters(batches):
    import numpy as np

    for batch in batches:
        for lh, line in zip(batch.column("lh").to_pylist(), batch.column("line").to_pylist()):
            yield np.array([k >> 3 << 3 | code % PARTS for k, code in quarter_keys(line)], np.uint64), lh


def _variants(batches):
    import numpy as np

    for batch in batches:
        for lh, line, codes in zip(*(batch.column(c).to_pylist() for c in ("lh", "line", "codes"))):
            yield np.array(variant_keys(line, codes), np.uint64), lh


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Staged ``(lh, earlier)``: distinct lines that have an earlier line one
    edit away, with one such line; ``lines`` as :func:`decide` stages them."""
    spark = docs.sparkSession
    place = lines.select("lh", "first", "len")
    agree = shared(_texts(docs, SHORT), _quarters, width_for(spark, 2 * PARTS * lines.where(F.col("len") >= SHORT).count()), "lines-quarters")

    # the key names the quarter; members longer than the shortest take part as the longer line
    members = agree.select("key", F.col("ref").alias("lh")).distinct().join(place.select("lh", "len"), "lh")
    least = members.groupBy(F.col("key").alias("k1")).agg(F.min("len").alias("least"))
    code = F.pmod("key", F.lit(8)) + F.when(F.col("len") > F.col("least"), PARTS).otherwise(0)
    codes = members.join(least, F.col("key") == F.col("k1")).select("lh", "len", code.cast("int").alias("code"))
    # a line has no quarter keys in common with a short partner: all variants, of a line of SHORT those of one less
    own = F.when(F.col("len") < SHORT, F.sequence(F.lit(0), F.lit(2 * PARTS - 1))).otherwise(F.sequence(F.lit(PARTS), F.lit(2 * PARTS - 1)))
    codes = codes.unionByName(place.where(F.col("len") <= SHORT).select("lh", "len", F.explode(own).alias("code")))
    codes = stage(codes.groupBy("lh").agg(F.collect_set("code").alias("codes"), F.max("len").alias("len")), "lines-codes")
    text = stage(_texts(docs).join(codes.select("lh"), "lh", "left_semi").dropDuplicates(["lh"]), "lines-text")
    emitted = codes.agg(F.sum(F.size("codes") * F.col("len") / PARTS)).first()[0] or 0
    deep = shared(text.join(codes.select("lh", "codes"), "lh"), _variants, width_for(spark, int(emitted)), "lines-variants")

    members = deep.select("key", F.col("ref").alias("lh")).distinct().join(place, "lh")
    ends = members.groupBy(F.col("key").alias("k1")).agg(F.min(F.struct("len", "first", "lh")).alias("lo"),
                                                         F.min(F.struct((-F.col("len")).alias("minus"), "first", "lh")).alias("hi"))
    m = members.join(ends, F.col("key") == F.col("k1"))
    deletion = F.pmod("key", F.lit(2)) == 1
    other = (F.when(~deletion | (F.col("len") > F.col("lo.len")), F.struct(F.col("lo.first").alias("first"), F.col("lo.lh").alias("lh")))
             .when(-F.col("hi.minus") > F.col("lo.len"), F.struct(F.col("hi.first").alias("first"), F.col("hi.lh").alias("lh"))))
    pairs = m.select("lh", "first", other.alias("o")).where(F.col("o.first") < F.col("first")).select("lh", F.col("o.lh").alias("earlier")).distinct()
    both = (pairs.join(text, "lh").join(text.select(F.col("lh").alias("earlier"), F.col("line").alias("line1")), "earlier")
            .where(F.levenshtein("line", "line1") <= 1))
    return stage(both.groupBy("lh").agg(F.min("earlier").alias("earlier")), "lines-near")


def decide(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, dkey, n_lines, n_exact, n_near``
    (lines that go for an equal or a near earlier one) and ``dropped``, the
    sorted numbers of the lines that go, from 0."""
    place = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("line_no").alias("no"))
    at = _occurrences(docs.select("doc_id", "text"))
    at = stage(at.select("rid", "doc_id", "dkey", "line_no", F.when(F.col("line").isNotNull(), F.xxhash64("line")).alias("lh"),
                         F.char_length("line").alias("len")), "lines-all")
    lines = at.where("lh is not null").groupBy("lh").agg(F.min(place).alias("first"), F.max("len").alias("len"), F.count(F.lit(1)).alias("held"))
    lines = stage(lines, "lines-distinct")
    near = near_lines(docs, lines).select(F.col("lh").alias("near"))
    told = (lines.join(near, F.col("lh") == F.col("near"), "left").where("held > 1 or near is not null")
            .select(F.col("lh").alias("lh1"), "first", "near"))
    j = at.join(told, F.col("lh") == F.col("lh1"), "left")
    exact = F.coalesce(place > F.col("first"), F.lit(False))
    gone = exact | F.col("near").isNotNull()
    return (j.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("dkey").alias("dkey"), F.count("lh").alias("n_lines"),
        F.count_if(exact).alias("n_exact"), F.count_if(~exact & gone).alias("n_near"),
        F.sort_array(F.collect_list(F.when(gone, F.col("line_no")))).alias("dropped")).drop("rid"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the lines that go; ``n_chars``, where there
    is one, follows the text."""
    id1, dkey1, gone = fresh(["doc_id", "dkey", "dropped"], docs.columns)
    d = decide(docs).where(F.size("dropped") > 0).select(F.col("doc_id").alias(id1), F.col("dkey").alias(dkey1), F.col("dropped").alias(gone))
    d = d.dropDuplicates([id1, dkey1])
    j = docs.join(d, F.col("doc_id").eqNullSafe(F.col(id1)) & (F.xxhash64("doc_id", "text") == F.col(dkey1)), "left")
    stays = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    same = F.col(gone).isNull()
    new = {"text": F.when(same, F.col("text")).otherwise(F.array_join(stays, "\n"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType))
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
