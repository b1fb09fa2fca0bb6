"""N-gram Jaccard self-join over whole texts with R-trees of count vectors.

A text's set holds the hashes of its distinct five-word shingles.  Two texts
link when their sets' Jaccard similarity is at least ``PERCENT`` / 100.  The
join is exact for components: no component is lost, but :func:`links` gives a
subset of the links that connects each, not every linked pair:

1. Texts with equal sets fall into one class; the rest works on classes.
2. Blocks.  Linked sets a, b differ in at most (a + b) / 9 shingles.  Shingles
   are hashed into more groups than that, so linked sets agree on all of some
   group; each class posts a key for each of its groups, once for the sizes
   around its own and once for the next smaller ones.  A group that is empty
   proves nothing: there are enough groups to do without the empty ones, and
   the few sets with too many empty groups post those too.  Keys that a single
   class posts are dropped.  As linked sets agree on a known number of groups,
   at least, each class also drops all but one of so many of its keys, those
   with most members, or all if it shares fewer.
3. R-trees.  Shingles are hashed into 256 groups and the group counts are
   points of an R-tree with a fan-out of four, packed in order of size: the
   overlap with anything below a node is at most the sum of the coordinate
   minima of the query and the node's upper corner.  Only pairs that survive the
   bounds of all nodes above them are verified on their sets.
4. Stars.  The classes that share a key with a lesser class, the least of that
   key, are that class's tree, which it searches.  The links found are joined to
   components: thousands of near copies of one text collapse here without all
   their pairs.
5. Blocks that still hold classes of different components become trees that all
   their members search, for partners in other components.  Trees of more than
   ``CHUNK`` points are dealt out in chunks, or pairs of chunks, so no task
   holds one whole.
6. Components of all verified links.

Defined results: words are lower-cased in A-Z; a text of fewer than five words
has its whole word sequence as its one shingle; a text without words, or null,
has the empty set and links with nothing; equal and repeated rows share a
component; null ids never name a component (a component without any id has a
null one); an empty table gives an empty result; other columns are ignored by
:func:`groups` and kept by :func:`one_of_each`.  Sets and classes are compared
by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import components, fresh, stage, text_slices, trimmed
from textmill.llm.hashed_words import hashed_words, mix
from textmill.llm.postings import shared, width_for

NGRAM = 5
PERCENT = 80
#: Count vectors have this many coordinates.
GROUPS = 256
#: A band of set sizes reaches from its least size to about this many times it.
BAND = 1.5
#: Members of a block that one task indexes; larger blocks are dealt out as pairs of chunks.
CHUNK = 4096
#: Parts in which the documents of one component are joined to its id.
SALTS = 16
#: Children of an R-tree node.
FANOUT = 4
#: Each class knows so many of its least open keys: a pair is left to the least block that both know.
KNOWN_KEYS = 64
#: Rows of blocks that a task takes up at once.
ROWS = 8192


def _sets(batches, column: str = "text"):
    """Each batch with the sorted distinct shingle hashes of its texts."""
    import numpy as np

    for batch in text_slices(batches, column):
        h, at = hashed_words(batch.column(column))
        x = np.full(max(0, len(h) - NGRAM + 1), NGRAM, np.uint64)
        for k in range(NGRAM):
            x = x * np.uint64(0x100000001B3) + h[k:k + len(x)]
        x, sets = mix(x), []
        for i in range(len(at) - 1):
            n = at[i + 1] - at[i]
            if n >= NGRAM:
                own = np.sort(x[at[i]:at[i + 1] - NGRAM + 1])
                sets.append(own[np.r_[True, own[1:] != own[:-1]]])
            else:
                whole = np.full(min(n, 1), n, np.uint64)
                for k in range(n):
                    whole = whole * np.uint64(0x100000001B3) + h[at[i] + k]
                sets.append(mix(whole))
        yield batch, sets


def set_id(x) -> int:
    import numpy as np
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(x.tobytes())], np.uint64).view(np.int64)[0])


def _bands():
    """``(least size, greatest size, differences, groups)`` by band."""
    lo, bands = 1, []
    while len(bands) < 64:
        hi = max(lo, int(lo * BAND) - 1)
        # a + b <= 2.25 * hi for a in the band and b up to a / 0.8
        differ = (9 * hi * (100 - PERCENT)) // (4 * (100 + PERCENT))
        bands.append((lo, hi, differ, differ + 1 + (differ // 4 + 3 if differ else 0)))
        lo = hi + 1
    return bands


_BANDS = _bands()


def band_of(n: int) -> int:
    import bisect

    return bisect.bisect_right(_BANDS, (n, 1 << 62)) - 1


def group_keys(x, band: int):
    """A set's keys in a band's partition of the shingles (the last six bits
    are the band), and how many of them a linked set has too, at least."""
    import numpy as np

    _, hi, differ, n = _BANDS[band]
    if not differ:
        return np.empty(0, np.uint64), 1  # only equal sets link
    at = (x % np.uint64(n)).astype(np.intp)
    total = np.zeros(n, np.uint64)
    np.add.at(total, at, x)
    keys = mix(total + np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band * 0x632BE59BD9B4E019 & 2**64 - 1))
    keys = keys >> np.uint64(6) << np.uint64(6) | np.uint64(band)
    held = np.bincount(at, minlength=n) > 0
    size = len(x)
    most = size * (100 - PERCENT) // PERCENT if size <= hi else (size + hi) * (100 - PERCENT) // (100 + PERCENT)
    agree = int(held.sum()) - most  # of the groups that aren't empty
    return (keys[held], agree) if agree > 0 else (keys, 1)


def set_keys(x):
    """Keys for the sizes around the set's own and, where it can be the larger
    of a pair, the band below, with the numbers that linked sets share."""
    import numpy as np

    if not len(x):
        return np.empty(0, np.uint64), 1, 1
    band = band_of(len(x))
    keys, own = group_keys(x, band)
    lower = 1
    if band and PERCENT * len(x) <= 100 * _BANDS[band - 1][1]:
        more, lower = group_keys(x, band - 1)
        keys = np.concatenate([keys, more])
    return keys, own, lower


def count_vector(x):
    import numpy as np

    return np.bincount((x >> np.uint64(56)).astype(np.intp), minlength=GROUPS).astype(np.uint32)


def _classes(docs: DataFrame) -> DataFrame:
    """Staged ``(doc_id, dkey, n, ref, band, own, lower, counts)``: size, class,
    key numbers and count vector of every document's set."""
    def run(batches):
        import pyarrow as pa

        for batch, sets in _sets(batches):
            shares = [set_keys(x)[1:] for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("dkey"), pa.array(map(len, sets), pa.int64()), pa.array(map(set_id, sets), pa.int64()),
                 pa.array([band_of(max(1, len(x))) for x in sets], pa.int32()), pa.array([s[0] for s in shares], pa.int32()),
                 pa.array([s[1] for s in shares], pa.int32()), pa.array([count_vector(x).tobytes() for x in sets], pa.binary())],
                names=["doc_id", "dkey", "n", "ref", "band", "own", "lower", "counts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return stage(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dkey"), "text").mapInArrow(
        trimmed(run), f"doc_id {id_type}, dkey long, n long, ref long, band int, own int, lower int, counts binary"), "jaccard-classes")


def _blocks(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Staged ``(key, leader, ref)``: the keys that classes keep, with their members and the least of these."""
    def emit(batches):
        for _, sets in _sets(batches):
            for x in sets:
                yield set_keys(x)[0], set_id(x)

    total = classes.agg(F.sum("n")).first()[0] or 0
    posted = shared(docs.select("text"), emit, width_for(docs.sparkSession, total // 2), "jaccard-posted")
    rows = posted.select("key", "ref").distinct()
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    facts = classes.where("n > 0").groupBy("ref").agg(F.first("band").alias("band"), F.first("own").alias("own"), F.first("lower").alias("lower"))
    at = F.pmod("key", F.lit(64))
    rows = (rows.join(held, "key").join(facts, "ref")
            .select("key", "ref", "held", at.alias("at"), F.when(at == F.col("band"), F.col("own")).otherwise(F.col("lower")).alias("agree")))
    # the least keys of a class, by holders and key: first whole ranges of keys by their counts, then within one range
    rows = rows.withColumn("range", F.shiftright("key", 60))
    spot, mine = ["ref", "at", "held", "range"], Window.partitionBy("ref", "at")
    before = F.coalesce(F.sum("c").over(mine.orderBy("held", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = (rows.groupBy(*spot).agg(F.count(F.lit(1)).alias("c"), F.first("agree").alias("agree"))
              .withColumns({"before": before, "quota": F.sum("c").over(mine) - F.col("agree") + 1}).where("before < quota"))
    rows = rows.drop("agree").join(ranges.select(*spot, "before", "quota"), spot)
    turn = F.row_number().over(Window.partitionBy(*spot).orderBy("key"))
    rows = rows.withColumn("turn", turn).where(F.col("before") + F.col("turn") <= F.col("quota"))
    rows = stage(rows.select("key", "ref"), "jaccard-kept")
    leaders = rows.groupBy("key").agg(F.min("ref").alias("leader"), F.count(F.lit(1)).alias("held")).where("held > 1").select("key", "leader")
    return stage(rows.join(leaders, "key").select("key", "leader", "ref"), "jaccard-blocks")


def enough(bound, sizes):
    """Whether an overlap of ``bound`` suffices for two sets with ``sizes`` elements together."""
    return (100 + PERCENT) * bound >= PERCENT * sizes


def _vectors(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, GROUPS)


def _overlaps(c, i, j):
    """Summed coordinate minima of the vectors ``c[i]`` and ``c[j]``, pair by pair."""
    import numpy as np

    parts = [np.minimum(c[i[k:k + ROWS]], c[j[k:k + ROWS]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), ROWS)]
    return np.concatenate([np.empty(0, np.int64), *parts])


def _whole_runs(batches, names: list):
    """The rows of sorted batches, cut only between runs of equal ``names``."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        cols = [batch.column(n).to_numpy() for n in names]
        turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        cut = int(turns[-1]) + 1 if len(turns) else 0
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None:
        yield rest


def _star_pairs(star: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """The pairs ``(a, b)`` that are left of the staged ``star`` when each
    ``a`` has searched the tree of its ``b``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in _whole_runs(batches, ["a", "chunk"]):
            a, chunk, ref = (batch.column(k).to_numpy() for k in ("a", "chunk", "ref"))
            n, c = batch.column("n").to_numpy(), _vectors(batch.column("counts"))
            # a run is the searching class, then the points
            cuts = np.r_[0, np.flatnonzero((a[1:] != a[:-1]) | (chunk[1:] != chunk[:-1])) + 1, len(a)]
            size = np.diff(cuts) - 1
            # trees of one leaf, all at once
            leaf = size <= FANOUT
            query = np.repeat(cuts[:-1], size + 1)
            point = np.flatnonzero(np.repeat(leaf, size + 1) & (query != np.arange(len(a))))
            hits = [point[enough(_overlaps(c, query[point], point), n[query[point]] + n[point])]]
            for s, e in zip(cuts[:-1][~leaf], cuts[1:][~leaf]):
                hits.append(RTree(c[s + 1:e], n[s + 1:e]).search(c[s], int(n[s])) + s + 1)
            hits = np.concatenate(hits)
            yield pa.RecordBatch.from_arrays([pa.array(a[hits]), pa.array(ref[hits])], names=["a", "b"])

    held = star.groupBy("a").agg(F.count(F.lit(1)).alias("held"))
    held = stage(held.join(vectors.select(F.col("ref").alias("a"), F.col("n").alias("na")), "a"), "jaccard-held")
    chunks = F.ceil(F.col("held") / CHUNK).cast("int")
    points = star.join(held, "a").select("a", "na", F.pmod(F.xxhash64("b"), chunks).cast("int").alias("chunk"), F.col("b").alias("ref"), F.lit(1).alias("turn"))
    searching = held.select("a", "na", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col("a").alias("ref"), F.lit(0).alias("turn"))
    rows = (points.unionByName(searching).join(vectors, "ref").where(enough(F.least("na", "n"), F.col("na") + F.col("n")))
            .select("a", "chunk", "turn", "ref", "n", "counts"))
    return (rows.repartition(width, "a", "chunk").sortWithinPartitions("a", "chunk", "turn")
            .mapInArrow(trimmed(run), "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Staged: the staged pairs whose sets link, by comparing the sets, made again from one text of each class."""
    if pairs.isEmpty():
        return pairs

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.int64()),
                                              pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["ref", "members"])

    refs = pairs.select(F.col("a").alias("ref")).unionByName(pairs.select(F.col("b").alias("ref"))).distinct()
    one = stage(classes.join(refs, "ref").groupBy("ref").agg(F.min("dkey").alias("dkey")).select("dkey"), "jaccard-wanted")
    text = docs.select(F.xxhash64("doc_id", "text").alias("dkey"), "text").join(one, "dkey").dropDuplicates(["dkey"])
    sets = stage(text.select("text").mapInArrow(trimmed(run), "ref long, members array<long>"), "jaccard-sets")
    side = lambda s: sets.select(F.col("ref").alias(s), F.col("members").alias(f"m{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("ma", "mb"))
    return stage(full.where(enough(both, F.size("ma") + F.size("mb"))).select("a", "b"), "jaccard-links")


class RTree:
    """Static R-tree over count vectors, packed by size and most varied coordinates."""

    def __init__(self, points, sizes):
        import numpy as np

        order = np.lexsort((*points.T[np.argsort(points.var(axis=0))][-4:], sizes)) if len(points) > FANOUT else np.arange(len(points))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []  # (upper corners, least sizes), leaves first
        top, least = self.points, self.sizes
        while len(top) > FANOUT:
            starts = np.arange(0, len(top), FANOUT)
            top, least = np.maximum.reduceat(top, starts), np.minimum.reduceat(least, starts)
            self.levels.append((top, least))

    def search(self, q, size: int):
        """Points whose overlap with ``q`` may reach the similarity."""
        import numpy as np

        def alive(points, sizes, at):
            # for a node: the least size below it and the upper corner give a bound for all of its points
            return at[enough(np.minimum(points[at], q).sum(axis=1, dtype=np.int64), size + sizes[at])]

        at = None
        for top, least in reversed(self.levels):
            at = alive(top, least, np.arange(len(top)) if at is None else at[at < len(top)])
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        at = np.arange(len(self.points)) if at is None else at[at < len(self.points)]
        return self.order[alive(self.points, self.sizes, at)]


def _block_pairs(block, key, known, ref, comp, chunk, within, n, c):
    """Pairs of different components in sorted runs of equal ``block`` that the
    count vectors don't rule out, but for those that both members know to
    share a lesser key: its block has them."""
    import numpy as np

    cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
    left, right = [], []
    for s, e in zip(cuts[:-1], cuts[1:]):
        if e - s <= FANOUT:  # one leaf, bounded below with the others
            i, j = np.triu_indices(e - s, 1)
            left.append(i + s)
            right.append(j + s)
        else:
            tree = RTree(c[s:e], n[s:e])
            for i in range(s, e):
                hits = tree.search(c[i], int(n[i])) + s
                hits = hits[hits > i]
                left.append(np.full(len(hits), i))
                right.append(hits)
    i, j = np.concatenate(left), np.concatenate(right)
    fit = (comp[i] != comp[j]) & (within[i] | (chunk[i] != chunk[j]))
    i, j = i[fit], j[fit]
    a, b = np.minimum(ref[i], ref[j]), np.maximum(ref[i], ref[j])
    _, once = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
    i, j, a, b = i[once], j[once], a[once], b[once]
    keep = np.flatnonzero(enough(_overlaps(c, i, j), n[i] + n[j]))
    sets: dict = {}

    def keys_of(row):
        if row not in sets:
            sets[row] = frozenset(known[row].as_py())
        return sets[row]

    first = [min(keys_of(i[p]) & keys_of(j[p]), default=key[i[p]]) >= key[i[p]] for p in keep]
    keep = keep[np.array(first, bool)]
    return a[keep], b[keep]


def _tree_pairs(members: DataFrame, width: int) -> DataFrame:
    """Candidate pairs ``(a, b)`` of different components from blocks ``(key, x, y, chunk, ref, comp, n, counts, known)``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(parts):
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            col = lambda k: t.column(k).to_numpy()
            block = np.cumsum(np.r_[0, (col("key")[1:] != col("key")[:-1]) | (col("x")[1:] != col("x")[:-1]) | (col("y")[1:] != col("y")[:-1])])
            a, b = _block_pairs(block, col("key"), t.column("known"), col("ref"), col("comp"), col("chunk"), col("x") == col("y"), col("n"), _vectors(t.column("counts")))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                # take up rows to the end of a block
                key = batch.column("key").to_numpy()
                take = batch.num_rows
                if rows + take > ROWS:
                    last = held[-1].column("key")[-1].as_py() if held else None
                    turns = np.flatnonzero(np.r_[key[0] != last if held else False, key[1:] != key[:-1]])
                    turns = turns[turns + rows >= ROWS]
                    take = int(turns[0]) if len(turns) else batch.num_rows
                    if take == 0 and held:
                        yield pairs(held)
                        held, rows = [], 0
                        continue
                held.append(batch.slice(0, take))
                rows += take
                batch = batch.slice(take)
                if batch.num_rows:
                    yield pairs(held)
                    held, rows = [], 0
        if held:
            yield pairs(held)

    return (members.repartition(width, "key", "x", "y").sortWithinPartitions("key", "x", "y")
            .mapInArrow(trimmed(run), "a long, b long").distinct())


def _open_blocks(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """Staged ``(key, ref, comp, held)`` of the keys with three or more classes
    of several components (two were compared as a star); of keys with the same
    members one is enough."""
    c = comps.select(F.col("node").alias("ref"), F.col("component"))
    rows = (blocks.select("key", "ref").join(c, "ref", "left")
            .select("key", "ref", F.coalesce("component", "ref").alias("comp")))
    mixed = (rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("held"),
                                     F.bit_xor(F.xxhash64("ref")).alias("who"), F.bit_xor(F.xxhash64("ref", F.lit(1))).alias("who2"))
             .where("lo < hi and held > 2"))
    one = mixed.groupBy("held", "who", "who2").agg(F.min("key").alias("key")).select("key", "held")
    return stage(rows.join(one, "key"), "jaccard-open")


def links(docs: DataFrame, classes: DataFrame | None = None, seen: dict | None = None) -> DataFrame:
    """Verified links ``(a, b)`` between classes (``ref`` of :func:`_classes`)
    that connect all linked classes.  ``seen``, if given, gets how many pairs
    the stars offered to the trees, the trees left over, and the sets verified."""
    docs = docs.select("doc_id", "text")
    classes = _classes(docs) if classes is None else classes
    blocks = _blocks(docs, classes)
    vectors = stage(classes.join(blocks.select("ref").distinct(), "ref").groupBy("ref")
                    .agg(F.first("n").alias("n"), F.first("counts").alias("counts")), "jaccard-vectors")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    star = stage(blocks.where("leader != ref").select(*pair("leader", "ref")).distinct(), "jaccard-stars")
    near = stage(_star_pairs(star, vectors, width_for(docs.sparkSession, 64 * star.count())), "jaccard-pairs")
    found = _verified(near, docs, classes)
    if seen is not None:
        seen.update(offered=star.count(), left=near.count(), verified=found.count())
    comps = components(found, "a", "b")
    open_ = _open_blocks(blocks, comps)
    if open_.isEmpty():
        return found
    known = open_.groupBy("ref").agg(F.slice(F.sort_array(F.collect_set("key")), 1, KNOWN_KEYS).alias("known"))
    chunks = F.ceil(F.col("held") / CHUNK).cast("int")
    at = open_.withColumn("chunk", F.pmod(F.xxhash64("ref"), chunks).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    at = at.join(vectors.join(known, "ref"), "ref").select(
        "key", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "ref", "comp", "n", "counts", "known")
    left = _tree_pairs(at, width_for(docs.sparkSession, 64 * open_.count())).join(star, ["a", "b"], "left_anti")
    return found.unionByName(_verified(stage(left, "jaccard-tree"), docs, classes))


def _grouped(docs: DataFrame) -> DataFrame:
    """``(doc_id, dkey, n, ref, comp)`` of every document."""
    classes = _classes(docs)
    comps = components(links(docs, classes), "a", "b").select(F.col("node").alias("ref"), "component")
    return classes.join(comps, "ref", "left").withColumn("comp", F.coalesce("component", "ref")).drop("component")


def groups(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id``: the size of its set
    and the smallest id that links reach from it, itself included."""
    g = stage(_grouped(docs.select("doc_id", "text")), "jaccard-groups")
    # only components of several documents are joined back, in salted copies: one may hold a third of all rows
    least = g.where("n > 0").groupBy(F.col("comp").alias("comp1")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held"))
    least = least.where("held > 1").withColumn("salt1", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = (F.col("n") > 0) & (F.col("comp") == F.col("comp1")) & (F.pmod("dkey", F.lit(SALTS)) == F.col("salt1"))
    return (g.join(least, mine, "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("held").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one, that with the
    smallest id (ids before null); texts without words stay."""
    g = stage(_grouped(docs.select("doc_id", "text")), "jaccard-groups").where("n > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("dkey"))).alias("best")
    stays = g.groupBy("comp").agg(best).select(F.col("best.dkey").alias("dkey"))
    key, other = fresh(["dkey", "dkey1"], docs.columns)
    ids = g.groupBy("dkey").agg(F.count(F.lit(1)).alias("rows"))
    goes = stage(ids.join(stays, "dkey", "left_anti").select(F.col("dkey").alias(other)), "jaccard-goes")
    twice = stage(ids.join(stays, "dkey").where("rows > 1").select(F.col("dkey").alias(other)), "jaccard-twice")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    kept = keyed.join(goes, F.col(key) == F.col(other), "left_anti")
    if not twice.isEmpty():
        single = kept.join(twice, F.col(key) == F.col(other), "left_anti")
        kept = single.unionByName(kept.join(twice, F.col(key) == F.col(other), "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)
