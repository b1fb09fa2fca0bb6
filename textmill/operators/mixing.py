"""Interleaving corpora: round-robin across files and the ratio mix.

Both are expressed as *positions* computed per row, never as a sequential
merge: the round-robin position is a dense rank of ``(index in file, file
order)`` and the ratio-mix position has a closed form in the per-role index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.ordering import dense_index, id_bucket

RR_TARGET_BUCKET_ROWS = 50_000


def round_robin(docs: DataFrame, group: str = "group", file: str = "file", line: str = "line",
                out: str = "rr_pos", bucket_width: int = 10_000, materialize: bool = True) -> DataFrame:
    """Order of a reader taking one document from each file of a group in
    turn, skipping exhausted files.  Adds ``in_file`` (0-based index in the
    file), ``file_ord`` and ``out`` (0-based position in the group).

    Pass narrow rows (keys, not text): the in-file index is checkpointed
    before it feeds the second ranking, and the result is checkpointed when
    ``materialize`` (it is usually read twice: counts, then positions)."""
    d = dense_index(docs, [group, file], [line], id_bucket(line, bucket_width), out="in_file")
    d = d.checkpoint(eager=True) if materialize else d
    files = (d.select(group, file).distinct()
             .withColumn("file_ord", F.dense_rank().over(Window.partitionBy(group).orderBy(file)) - 1))
    max_files = files.groupBy(group).count().agg(F.max("count")).first()[0] or 1
    # a bucket of `width` consecutive in-file indexes holds <= width * files rows
    width = max(1, RR_TARGET_BUCKET_ROWS // int(max_files))
    d = d.join(files, [group, file])
    r = dense_index(d, [group], ["in_file", "file_ord"], id_bucket("in_file", width), out=out)
    return r.checkpoint(eager=True) if materialize else r


# --- ratio mix -------------------------------------------------------------
# Fixed values of the mix: cycles of 6 main + 3 repeated + 1 capped document,
# then 7 main + 3 repeated once the capped source is exhausted.
MAIN_P1, REP, CAP, MAIN_P2 = 6, 3, 1, 7
CYCLE = MAIN_P1 + REP + CAP  # 10 == MAIN_P2 + REP


def pos_main(j: int, c: int) -> int:
    if j < MAIN_P1 * (c + 1):
        return CYCLE * (j // MAIN_P1) + j % MAIN_P1
    k = j - MAIN_P1 * (c + 1)
    return CYCLE * c + MAIN_P1 + REP + CYCLE * (k // MAIN_P2) + k % MAIN_P2


def pos_rep(e: int, c: int) -> int:
    cyc, s = divmod(e, REP)
    if cyc <= c:
        return CYCLE * cyc + MAIN_P1 + s
    return CYCLE * c + MAIN_P1 + REP + CYCLE * (cyc - c - 1) + MAIN_P2 + s


def _pos_main_sql(j: str, c: int) -> str:
    p1 = MAIN_P1 * (c + 1)
    return (f"CASE WHEN {j} < {p1} THEN {CYCLE} * ({j} div {MAIN_P1}) + {j} % {MAIN_P1} "
            f"ELSE {CYCLE * c + MAIN_P1 + REP} + {CYCLE} * (({j} - {p1}) div {MAIN_P2}) "
            f"+ ({j} - {p1}) % {MAIN_P2} END")


def _pos_rep_sql(e: str, c: int) -> str:
    return (f"CASE WHEN {e} div {REP} <= {c} THEN {CYCLE} * ({e} div {REP}) + {MAIN_P1} + {e} % {REP} "
            f"ELSE {CYCLE * c + MAIN_P1 + REP} + {CYCLE} * ({e} div {REP} - {c + 1}) "
            f"+ {MAIN_P2} + {e} % {REP} END")


def mix_plan(k: int, n: int, c: int) -> dict:
    """Stream length T (positions 0..T-1) and repeated emissions E."""
    t = pos_main(k, c)
    lo, hi = 0, t + 1  # number of emissions e with pos_rep(e) < t
    while lo < hi:
        mid = (lo + hi) // 2
        if pos_rep(mid, c) < t:
            lo = mid + 1
        else:
            hi = mid
    e = lo
    caps = min(c, t // CYCLE)  # capped slots 10j+9 below t
    if e > 0 and n == 0:
        raise ValueError("the repeated source has no documents: the mix would never end")
    return {"T": t, "E": e, "caps": caps, "K": k, "N": n, "C": c}


def ratio_mix(main: DataFrame, repeat: DataFrame, capped: DataFrame,
              labels=("main", "repeat", "capped"), file: str = "file", line: str = "line",
              key: str | None = None, keep=()) -> DataFrame:
    """W4 + J6: the 6:3:1 then 7:3 interleave of three corpora.

    The main corpus is read once and ends the stream; the repeated corpus is
    re-read from its start whenever it runs out (emission ``e`` reads document
    ``e mod N``); the capped corpus is read once.  Inside each corpus
    documents come in round-robin order over its files.

    With ``key`` (a unique document column) only ``key``, ``file``, ``line``
    and the ``keep`` columns travel through the ordering shuffles; join the
    text back on ``key`` afterwards.  Without it every column is kept.
    Returns ``role``, ``src_idx`` (round-robin index) and ``mix_pos``
    (0-based stream position, unique) plus the carried columns.
    """
    parts = []
    for role, df in zip(labels, (main, repeat, capped)):
        cols = [key, file, line, *keep] if key else df.columns
        parts.append(df.select(*dict.fromkeys(cols)).withColumn("role", F.lit(role)))
    allk = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rr = round_robin(allk, "role", file, line, out="src_idx")
    counts = dict(rr.where(F.col("role").isin(*labels)).groupBy("role").count().collect())  # one row per role
    k, n, c = (int(counts.get(r, 0)) for r in labels)
    plan = mix_plan(k, n, c)
    t, e = plan["T"], plan["E"]
    role = F.col("role")
    rep_rows = rr.where((role == labels[1]) & (F.col("src_idx") < e))
    if n > 0:
        # one row per emission from a distributed range, not from an array in a
        # row: a document is emitted about e / n times, and where that is many
        # the repeated corpus has few rows and Spark broadcasts them
        emitted = rr.sparkSession.range(e).select((F.col("id") % n).alias("src_idx"), F.col("id").alias("emission"))
        rep_rows = (rep_rows.join(emitted, "src_idx").withColumn("mix_pos", F.expr(_pos_rep_sql("emission", c)))
                    .select(*rr.columns, "mix_pos"))
    else:
        rep_rows = rep_rows.withColumn("mix_pos", F.lit(None).cast("long"))
    other = (rr.where(role != labels[1])
             .withColumn("mix_pos", F.when(role == labels[0], F.expr(_pos_main_sql("src_idx", c)))
                         .otherwise(F.expr(f"{CYCLE} * src_idx + {MAIN_P1 + REP}")))
             .where((role == labels[0]) | ((F.col("src_idx") < c) & (F.col("mix_pos") < t))))
    out = other.unionByName(rep_rows)
    return out.withColumn("mix_pos", F.col("mix_pos").cast("long")).drop("in_file", "file_ord")
