"""Prefix trie of conversations, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns.  Its key is the sum of hashes of
(place, role, text) along the sequence: a running total, so a conversation of
any length is dealt over tasks.  Every node has an enter and an exit arc; the
successor of an arc is the first child's enter or the own exit, and the next
sibling's enter or the parent's exit.  The list of arcs is ranked without
following it: blocks of arcs contract the stretches that lie within them, in
numpy, and the heads of the stretches, one per block where neighbours in the
tour have neighbouring ids, are ranked by pointer jumping, whose rounds are the
logarithm of their number.  With the arcs in place, running totals of leaves
and of saved words along the tour give each subtree's sums as the difference
between its two arcs.

Nothing is gathered by conversation, parent or node: turns, siblings and arcs
are numbered by two-level running totals, and the ids of a node's ending
conversations are hashed as a stream of sorted chunks of bounded length (SHA-256
is sequential by definition).

Defined results: a null role or text is empty; a null turn comes first, equal
turns in order of a digest of role and text; repeated rows are turns of their
own; rows without a ``conv_id`` belong to no conversation; an empty table gives
no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import stage, trimmed, word_count
from textmill.operators.ordering import BK, dense_index, id_bucket, range_buckets, running_totals

#: Conversations that take their first turns from one base conversation.
FAMILY = 20
#: Up to so many turns less one are taken.
SHARED = 4
#: Nodes whose arcs a task contracts together.
BLOCK_NODES = 20_000
#: Ids in a chunk that is hashed at once, at most.
CHUNK = 10_000

_KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, digest, words)``: the turns of each conversation, numbered from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", word_count(text).alias("words"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    t = range_buckets(t, order, ["conv_id"])
    return dense_index(t, ["conv_id"], order, BK, out="place", base=1).select("conv_id", "place", "digest", "words")


def with_shared_turns(t: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """``(conv_id, depth, digest, words)`` of the rebuilt conversations: the
    first ``h`` turns of the family's base, then the own ones after the first ``h``."""
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string")) % shared
    convs = t.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    first = t.where(F.col("place") < shared).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "words")
    taken = convs.join(first, "base").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "digest", "words")
    held = first.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    own = t.withColumn("base", base).withColumn("h", h).where(F.col("place") > F.col("h")).join(held, "base", "left")
    depth = F.least(F.col("h"), F.coalesce("held", F.lit(0))) + F.col("place") - F.col("h")
    return taken.unionByName(own.select("conv_id", depth.alias("depth"), "digest", "words"))


def memberships(t: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``(conv_id, depth, k1, k2, p1, p2, words)``: each conversation's node of
    each depth, the root's included, by its key and its parent's."""
    place = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"))
    part = lambda a: F.conv(F.substring(place, a, 15), 16, 10).cast("decimal(20,0)")
    r = running_totals(rebuilt.withColumns({"h1": part(1), "h2": part(17)}), ["conv_id"], ["depth"],
                       {"k1": F.col("h1"), "k2": F.col("h2")}, id_bucket("depth"))
    number = lambda c: c.cast("decimal(38,0)")
    r = r.select("conv_id", "depth", number(F.col("k1")).alias("k1"), number(F.col("k2")).alias("k2"),
                 number(F.col("k1") - F.col("h1")).alias("p1"), number(F.col("k2") - F.col("h2")).alias("p2"), "words")
    zero = number(F.lit(0))
    root = t.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("k1"), zero.alias("k2"),
                                                 F.lit(None).cast("decimal(38,0)").alias("p1"), F.lit(None).cast("decimal(38,0)").alias("p2"),
                                                 F.lit(0).cast("long").alias("words"))
    return stage(r.unionByName(root), "trie-members")


def _nodes(members: DataFrame) -> DataFrame:
    """``(node, conv_id, depth, k1, k2, parent, parent_conv_id, n_convs, words)``;
    nodes are numbered in order of their least conversation and depth."""
    n = members.groupBy(*_KEY, "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    order = ["conv_id", "depth"]
    n = stage(dense_index(range_buckets(n, order), [], order, BK, out="node").drop(BK), "trie-nodes")
    up = n.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                  F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return stage(n.join(up, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "trie-parents")


def tour(nodes: DataFrame) -> DataFrame:
    """``(arc, next)`` from ``(node, parent)``: ``2 * node`` enters a node, ``2 * node + 1`` leaves it."""
    child = dense_index(nodes.where("parent is not null").select("node", "parent"), ["parent"], ["node"], id_bucket("node"), out="at")
    child = stage(child.select("node", "parent", "at"), "trie-children")
    first = child.where("at = 0").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    enter = nodes.select("node").join(first, "node", "left").select(
        (2 * F.col("node")).alias("arc"), F.coalesce(2 * F.col("child"), 2 * F.col("node") + 1).alias("next"))
    after = child.select("parent", (F.col("at") - 1).alias("at"), F.col("node").alias("sibling"))
    leave = child.join(after, ["parent", "at"], "left").select(
        (2 * F.col("node") + 1).alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"))
    end = nodes.where("parent is null").select((2 * F.col("node") + 1).alias("arc"), F.lit(None).cast("long").alias("next"))
    return stage(enter.unionByName(leave).unionByName(end), "trie-arcs")


def list_ranks(arcs: DataFrame, n_arcs: int, block: int = 2 * BLOCK_NODES) -> DataFrame:
    """``(arc, place)``: the places, from 0, along one list of ``(arc, next)`` whose arcs are 0 to ``n_arcs - 1``."""

    def contract(batches):
        import numpy as np
        import pyarrow as pa

        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).fill_null(-1).to_numpy(zero_copy_only=False)) for b in batches]
        if not got:
            return
        arc, then = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(arc)
        arc, then = arc[order], then[order]
        to = np.searchsorted(arc, then)
        inside = (to < len(arc)) & (arc[np.minimum(to, len(arc) - 1)] == then)
        # each arc points back along its stretch; a head points at itself
        back, far = np.arange(len(arc)), np.zeros(len(arc), np.int64)
        back[to[inside]] = np.flatnonzero(inside)
        far[to[inside]] = 1
        while True:
            further = back[back]
            if (further == back).all():
                break
            far += far[back]
            back = further
        last = ~inside
        yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(arc[back]), pa.array(far), pa.array(last),
                                          pa.array(then, mask=~last | (then < 0))], names=["arc", "head", "far", "last", "next"])

    width = -(-n_arcs // block)
    dealt = arcs.repartition(width, F.floor(F.col("arc") / block)).mapInArrow(trimmed(contract), "arc long, head long, far long, last boolean, next long")
    dealt = stage(dealt, "trie-stretches")
    # heads: how many arcs until the pointer's target, or the end
    heads = stage(dealt.where("last").select("head", "next", (F.col("far") + 1).alias("left")), "trie-heads")
    while not heads.where("next is not null").isEmpty():
        far = heads.select(F.col("head").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        heads = stage(heads.join(far, "next", "left").select(
            "head", F.col("next2").alias("next"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")), "trie-heads")
    return dealt.join(heads.select("head", "left"), "head").select("arc", (F.lit(n_arcs) - F.col("left") + F.col("far")).alias("place"))


def subtree_sums(nodes: DataFrame, values: dict, block: int = 2 * BLOCK_NODES) -> DataFrame:
    """``node`` and the sum of each of ``values`` (output column: expression)
    over its subtree, itself included, from staged ``(node, parent, ...)`` rows
    numbered from 0."""
    n_arcs = 2 * nodes.count()
    places = list_ranks(tour(nodes), n_arcs, block)
    weights = nodes.select((2 * F.col("node")).alias("arc"), *[v.cast("long").alias(k) for k, v in values.items()])
    w = places.join(weights, "arc", "left").select("arc", "place", *[F.coalesce(k, F.lit(0)).alias(k) for k in values])
    w = running_totals(w, [], ["place"], {f"{k}_before": F.col(k) for k in values}, id_bucket("place"), exclusive=True)
    sign = F.when(F.col("arc") % 2 == 0, -1).otherwise(1)
    return w.groupBy(F.floor(F.col("arc") / 2).alias("node")).agg(*[F.sum(sign * F.col(f"{k}_before")).alias(k) for k in values])


def _ends(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of the nodes at which conversations end."""
    length = members.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    chunk = members.join(length, ["conv_id", "depth"]).groupBy(*_KEY, id_bucket("conv_id", CHUNK).alias("chunk")) \
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    chunk = chunk.join(nodes.select(*_KEY, "node"), _KEY).select("node", "chunk", "ids")

    def digest(batches):
        import hashlib

        import pyarrow as pa

        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])
        now, sha = None, None
        for batch in batches:
            for node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node != now:
                    if sha is not None:
                        yield row()
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha is not None:
            yield row()

    return chunk.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(digest, "node long, ends_sha256 string")


def trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per node: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (the words that one copy of each shared turn of the subtree
    saves) and ``ends_sha256``."""
    t = stage(turns(conversations), "trie-turns")
    members = memberships(t, with_shared_turns(t, family, shared))
    nodes = _nodes(members)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    if nodes.isEmpty():
        return _result(nodes.withColumns({"n_leaves": F.lit(0).cast("long"), "saved_tokens": F.lit(0).cast("long"), "ends_sha256": F.lit("")}))
    sums = subtree_sums(nodes, {"n_leaves": F.col("n_children") == 0, "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}, 2 * block_nodes)
    out = nodes.join(sums, "node").join(_ends(members, nodes), "node", "left")
    return _result(out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))


def _result(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
