"""Byte-level BPE vocabulary training and encoding.

* B1: pre-tokens are extracted with the byte-level BPE pattern and counted
  with ``groupBy`` (the distinct-word table is far smaller than the corpus).
* B2: adjacent symbol pairs of every distinct word, weighted by its count.
* B3: greedy merging in rounds of many merges.  A round takes the most
  frequent pairs, all above a floor, and cuts every word into its stretches of
  neighbours that are such pairs.  Distinct stretches with their summed
  frequencies, a table of bounded size, are all that merges above the floor
  depend on: a pair across a cut never occurs more often than the floor.  The
  driver replays one-at-a-time greedy on them, with an inverted index from pair
  to stretches and count changes for the stretches a merge touches, until no
  pair is above the floor.  The merges are then applied to the words, which
  stay on the executors as blocks of flat numpy buffers.  The number of rounds
  is a small fraction of the number of merges.

Ids: 12 reserved tokens, the 256 byte symbols ordered by their visible
character, then merges in order.  Ties between equally frequent pairs go to
the smaller ``(left id, right id)``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import tokens as TK

# Fixed value: the byte-level BPE pre-tokenization pattern (Java regex, with
# Unicode whitespace).
PRETOKEN_PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern for Python's ``regex`` module (tests, per-row encoding).
PRETOKEN_PATTERN_PY = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MIN_FREQUENCY = 2
PAIR_SHIFT = 1 << 20  # ids stay below 2^20
CANDIDATES = 1024     # top pairs of the first round
MOST_CANDIDATES = 1 << 14  # of any round
MAX_STRETCHES = 200_000    # distinct stretches that the driver replays in a round


def pretokens(text) -> Column:
    """B1 per row: the pre-token strings of a text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(PRETOKEN_PATTERN), 0)


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """B1: ``(word, freq)`` over the corpus."""
    from textmill.operators.ordering import spread_small

    w = spread_small(docs.select(text)).select(F.explode(pretokens(text)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def word_symbols(words: DataFrame) -> DataFrame:
    """Distinct words as byte-symbol id arrays: ``(syms, freq)``."""
    return words.select(TK.byte_encode("word").alias("syms"), "freq")


def pair_counts(word_syms: DataFrame, syms: str = "syms", freq: str = "freq") -> DataFrame:
    """B2: ``(left, right, count)``; overlapping neighbours count once per
    position (``aaa`` holds ``(a, a)`` twice)."""
    s = F.col(syms)
    n = F.size(s) - 1
    pairs = F.when(n > 0, F.arrays_zip(F.slice(s, 1, n).alias("l"), F.slice(s, 2, n).alias("r")))
    e = word_syms.select(F.explode(pairs).alias("p"), F.col(freq).alias("f"))
    return e.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(
        F.sum("f").cast("long").alias("count"))


def safe_batch(cands: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Merges that one-at-a-time greedy would also make next, in order.

    ``cands``: ``(count, left, right)`` sorted by count desc, pair asc.  Take
    pairs while they share no symbol with the batch (a self-pair closes it);
    the first pair left out bounds every count that merging can create or
    change, so batch members after the first must be strictly above it.
    """
    if not cands:
        return []
    batch, used, bound = [], set(), None
    for i, (c, a, b) in enumerate(cands):
        if a in used or b in used:
            bound = c
            break
        batch.append((c, a, b))
        used.update((a, b))
        if a == b:
            bound = cands[i + 1][0] if i + 1 < len(cands) else None
            break
    else:
        bound = None
    if bound is None:
        if len(batch) == len(cands) and len(cands) >= CANDIDATES:
            bound = cands[-1][0]  # unseen pairs may tie the last candidate
        else:
            return batch
    return [batch[0]] + [p for p in batch[1:] if p[0] > bound]


def greedy_merges(stretches, weights, floor: int, vocab: list, index: dict, vocab_size: int) -> list:
    """``[(left, right, new_id)]``: what one-at-a-time greedy merges while the
    best pair is more frequent than ``floor``.

    ``stretches``: symbol lists, ``weights``: how often each occurs.  Equally
    frequent pairs go by ``(left, right)``.  ``vocab`` and ``index`` (string to
    id) grow.  A merge whose string already has an id is the last one: from
    there on a pair may also occur across the cuts between stretches."""
    held, counts = [list(s) for s in stretches], {}
    where: dict = {}
    for i, s in enumerate(held):
        for pair in zip(s, s[1:]):
            counts[pair] = counts.get(pair, 0) + weights[i]
            where.setdefault(pair, set()).add(i)
    heap = [(-n, *pair) for pair, n in counts.items() if n > floor]
    heapq.heapify(heap)
    out = []
    while heap and len(vocab) < vocab_size:
        n, a, b = heapq.heappop(heap)
        now = counts.get((a, b), 0)
        if now != -n:
            if now > floor:
                heapq.heappush(heap, (-now, a, b))
            continue
        string = vocab[a] + vocab[b]
        new = index.get(string)
        last = new is not None
        if not last:
            new = index[string] = len(vocab)
            vocab.append(string)
        out.append((a, b, new))
        if last:
            break
        grown = set()
        for i in where.pop((a, b)):
            s, w = held[i], weights[i]
            merged, k = [], 0
            while k < len(s):
                hit = s[k] == a and k + 1 < len(s) and s[k + 1] == b
                merged.append(new if hit else s[k])
                k += 2 if hit else 1
            if len(merged) == len(s):
                continue
            for pair in zip(s, s[1:]):
                counts[pair] -= w
            for pair in zip(merged, merged[1:]):
                counts[pair] = counts.get(pair, 0) + w
                if new in pair:
                    grown.add(pair)
                    where.setdefault(pair, set()).add(i)
            held[i] = merged
        for pair in grown:
            if counts[pair] > floor:
                heapq.heappush(heap, (-counts[pair], *pair))
    return out


#: Pre-tokens whose encodings a worker keeps, and their ids in all.
HELD_PRETOKENS = 1 << 18
HELD_IDS = 1 << 22
#: Symbols of a pre-token that is merged beside others.
SHORT = 64
#: Symbols in one block of words.
BLOCK_SYMBOLS = 1 << 20


def _pair_keys(syms):
    return syms[:-1].astype(np.int64) * PAIR_SHIFT + syms[1:]


def _found(keys, pair):
    """The place of each pair in the sorted ``keys``, -1 where it is not."""
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    return np.where(keys[at] == pair, at, -1)


def merge_flat(syms, word, mapping: dict):
    """Applies merges (``{pair key: new id}``, in their order) in a flat symbol
    buffer; ``word`` numbers the words, across which nothing merges.

    A merge only makes pairs of later merges, so in each step every word makes
    its earliest one, left to right, until none is left."""
    keys, new = np.fromiter(mapping, np.int64, len(mapping)), np.fromiter(mapping.values(), np.int32, len(mapping))
    rank_of, idle = np.argsort(keys), len(keys)
    keys = keys[rank_of]
    parts = []
    while len(syms) > 1:
        at = np.where(word[:-1] == word[1:], _found(keys, _pair_keys(syms)), -1)
        rank = np.r_[np.where(at >= 0, rank_of[at], idle), idle]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least, sizes = np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(syms)])
        done = np.repeat(least == idle, sizes)
        parts.append((syms[done], word[done]))
        syms, word, rank = syms[~done], word[~done], rank[~done]
        hit = np.flatnonzero(rank == np.repeat(least[least < idle], sizes[least < idle]))
        # only a pair of equal symbols can overlap itself: of a run of hits every second one counts
        run = np.r_[True, np.diff(hit) > 1][:len(hit)]
        first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        syms[hit] = new[rank[hit]]
        stays = np.ones(len(syms), bool)
        stays[hit + 1] = False
        syms, word = syms[stays], word[stays]
    syms, word = (np.concatenate(x) for x in zip(*parts, (syms, word)))
    order = np.argsort(word, kind="stable")
    return syms[order], word[order]


def _stretches(syms, sizes, freqs, keys):
    """``(stretch bytes, frequency)`` of a block's maximal runs of neighbours whose pairs are all among ``keys``."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    if len(syms) < 2:
        return [], []
    linked = (_found(keys, _pair_keys(syms)) >= 0) & (word[:-1] == word[1:])
    edge = np.diff(np.r_[0, linked.astype(np.int8), 0])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    length, weight = end - start, freqs[word[start]]
    found, counts = [], []
    for n in np.unique(length):
        mine = length == n
        rows = np.ascontiguousarray(syms[start[mine][:, None] + np.arange(n)]).view(np.dtype((np.void, 4 * int(n)))).ravel()
        some, at = np.unique(rows, return_inverse=True)
        found += [x.tobytes() for x in some]
        total = np.zeros(len(some), np.int64)
        np.add.at(total, at, weight[mine])
        counts += total.tolist()
    return found, counts


def _pair_rows(syms, word, freq):
    """``(pair keys, counts)`` of a block, overlapping neighbours included."""
    inside = word[:-1] == word[1:]
    pair = _pair_keys(syms)[inside]
    keys, at = np.unique(pair, return_inverse=True)
    count = np.zeros(len(keys), np.int64)
    np.add.at(count, at, freq[word[:-1][inside]])
    return keys, count


# kind 0: a block of words (flat symbols, word lengths, frequencies; n: the words that the last merges touched);
# kind 1: a pair and its count in a block
_ROUND = "kind int, syms binary, sizes binary, freqs binary, pair long, n long"


def _round_batch(block, pairs, touched: int):
    keys, counts = pairs
    none = [None] * len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array([0] + [1] * len(keys), pa.int32()), *[pa.array([x.tobytes()] + none, pa.binary()) for x in block],
         pa.array(np.r_[np.int64(0), keys]), pa.array(np.r_[np.int64(touched), counts])],
        names=["kind", "syms", "sizes", "freqs", "pair", "n"])


def _step(syms, sizes, freqs, mapping):
    """A block after merging, its pair counts and the words touched; words of one symbol leave."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    if mapping:
        syms, word = merge_flat(syms, word, mapping)
    size = np.bincount(word, minlength=len(sizes))
    stays = size > 1
    syms, left, freqs = syms[stays[word]], size[stays].astype(np.int32), freqs[stays]
    return (syms, left, freqs), _pair_rows(syms, np.repeat(np.arange(len(left)), left), freqs), int((size < sizes).sum())


def _to_blocks(batches):
    """Rows ``(syms, freq)`` as blocks with their pair counts."""
    held, n = [], 0

    def flush():
        return _round_batch(*_step(*(np.concatenate(x) for x in zip(*held)), None))

    for batch in batches:
        col = batch.column("syms")
        offsets = col.offsets.to_numpy()
        held.append((col.values.to_numpy()[offsets[0]:offsets[-1]].astype(np.int32), np.diff(offsets).astype(np.int32),
                     batch.column("freq").to_numpy().astype(np.int64)))
        n += len(held[-1][0])
        if n >= BLOCK_SYMBOLS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _blocks(batches):
    for batch in batches:
        for syms, sizes, freqs in zip(*(batch.column(c).to_pylist() for c in ("syms", "sizes", "freqs"))):
            yield np.frombuffer(syms, np.int32), np.frombuffer(sizes, np.int32), np.frombuffer(freqs, np.int64)


def _merging(mapping: dict):
    def run(batches):
        for block in _blocks(batches):
            yield _round_batch(*_step(*block, mapping))

    return run


def _cutting(keys):
    def run(batches):
        for block in _blocks(batches):
            found, counts = _stretches(*block, keys)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(counts, pa.int64())], names=["stretch", "n"])

    return run


def base_vocabulary() -> tuple[list, dict]:
    """The reserved tokens and the byte alphabet, and the ids of the latter's strings."""
    vocab: list[bytes] = [t.encode() for t in TK.SPECIAL_TOKENS] + [b""] * 256
    for b in range(256):
        vocab[int(TK.BYTE_TO_ID[b])] = bytes([b])
    return vocab, {v: i for i, v in enumerate(vocab) if i >= TK.N_SPECIAL}


def train_bpe(docs: DataFrame, vocab_size: int, text: str = "text", min_frequency: int = MIN_FREQUENCY,
              max_rounds: int | None = None, max_stretches: int = MAX_STRETCHES, candidates: int = CANDIDATES) -> dict:
    """Returns ``{"merges": [(left, right, new_id)], "vocab": [bytes per id],
    "rounds", "touched"}``; ``touched`` has the distinct words that each round's merges changed.

    The vocabulary starts with the reserved tokens and the byte alphabet; a
    merge whose string already exists reuses that id (so ``merges`` can
    outnumber new ids); training stops at ``vocab_size`` ids or when the best
    pair occurs fewer than ``min_frequency`` times.  A round takes
    ``candidates`` pairs, fewer if they cut the words into more than
    ``max_stretches`` distinct stretches, and more once there is room.
    """
    from textmill.session import checkpoint_dir

    spark = docs.sparkSession
    checkpoint_dir(spark)
    vocab, index = base_vocabulary()
    merges: list[tuple[int, int, int]] = []
    parts = max(1, spark.sparkContext.defaultParallelism)
    words = word_symbols(pretoken_counts(docs, text)).where(F.size("syms") > 1)
    # spread the rounds over all cores
    state = words.repartition(parts, "syms").mapInArrow(_to_blocks, _ROUND).checkpoint(eager=True)
    rounds, touched, most = 0, [], candidates
    while len(vocab) < vocab_size and (max_rounds is None or rounds < max_rounds):
        counts = state.where("kind = 1").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency)
        best = [(n, p) for p, n in counts.orderBy(F.col("n").desc(), "pair").limit(most + 1).collect()]
        if not best:
            break
        blocks = state.where("kind = 0").select("syms", "sizes", "freqs")
        batch: list = []
        while not batch:
            floor = best[most][0] if len(best) > most else min_frequency - 1
            top = np.sort(np.array([p for n, p in best[:most] if n > floor], np.int64))
            if not len(top):  # all tie
                batch = [m for _, a, b in safe_batch([(n, *divmod(p, PAIR_SHIFT)) for n, p in best])
                         for m in greedy_merges([[a, b]], [1], 0, vocab, index, vocab_size)]
                break
            cut = blocks.mapInArrow(_cutting(top), "stretch binary, n long").groupBy("stretch").agg(F.sum("n").alias("n"))
            rows = cut.limit(max_stretches + 1).collect()
            if len(rows) > max_stretches and most > 1:
                most = max(1, most // 2)
                continue
            batch = greedy_merges([np.frombuffer(r[0], np.int32).tolist() for r in rows], [r[1] for r in rows], floor, vocab, index, vocab_size)
            if len(rows) * 4 < max_stretches:
                most = min(2 * most, MOST_CANDIDATES)
        merges += batch
        mapping = {a * PAIR_SHIFT + b: new for a, b, new in batch}
        state = blocks.mapInArrow(_merging(mapping), _ROUND).checkpoint(eager=True)
        touched.append(state.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        rounds += 1
    return {"merges": merges, "vocab": vocab, "rounds": rounds, "touched": touched}


# --- encoding with a trained vocabulary (F1) ---------------------------------------
def bpe_encode_word(syms: list[int], ranks: dict) -> list[int]:
    """Apply merges by rank, lowest first, left to right within a rank.

    Symbols form a linked list; a heap holds the pairs with a merge, so a
    pre-token of n symbols takes n log n however long it is."""
    n = len(syms)
    syms, after, before = list(syms), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i, r[1], syms[i], syms[i + 1]) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if syms[i] != a or j >= n or syms[j] != b:
            continue  # one side has merged meanwhile
        syms[i], syms[j] = new, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (r := ranks.get((syms[left], syms[right]))) is not None:
                heapq.heappush(heap, (r[0], left, r[1], syms[left], syms[right]))
    return [s for s in syms if s is not None]


class Codec:
    """A trained vocabulary as a worker uses it: merge ranks and the encodings
    of pre-tokens seen so far, about ``HELD_PRETOKENS``.

    A batch becomes numbers of pre-tokens; those not yet seen are merged
    together in a flat buffer."""

    def __init__(self, pairs, new):
        import regex

        self.ranks = {(int(p) // PAIR_SHIFT, int(p) % PAIR_SHIFT): (r, int(n)) for r, (p, n) in enumerate(zip(pairs, new))}
        # where every merge makes a new id, it only makes pairs of later merges
        made = bool(len(new)) and len(self.ranks) == len(new) and new[0] >= TK.N_SPECIAL + 256 and bool((np.diff(new) > 0).all())
        self.mapping = {int(p): int(n) for p, n in zip(pairs, new)} if made else None
        self.pattern = regex.compile(PRETOKEN_PATTERN_PY)
        self.atoms = regex.compile(f"({TK.SPECIAL_RE})")
        self._clear()

    def _clear(self):
        # numbers of pre-tokens, behind those of the reserved atoms
        self.held, self.new = {}, []
        self.flat = np.arange(TK.N_SPECIAL, dtype=np.int32)
        self.start, self.size = np.arange(TK.N_SPECIAL), np.ones(TK.N_SPECIAL, np.int64)

    def _encode_new(self) -> None:
        raw, offs = TK.flat_bytes(pa.array(self.new, pa.string()))
        syms, n = TK.BYTE_TO_ID[raw].astype(np.int32), np.diff(offs)
        word, together = np.repeat(np.arange(len(n)), n), n <= (SHORT if self.mapping else 0)
        mine = together[word]
        parts = [merge_flat(syms[mine], word[mine], self.mapping)] if mine.any() else []
        for k in np.flatnonzero(~together):
            ids = bpe_encode_word(syms[offs[k]:offs[k + 1]].tolist(), self.ranks)
            parts.append((np.array(ids, np.int32), np.full(len(ids), k)))
        syms, word = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        size = np.bincount(word, minlength=len(n))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.size, self.flat, self.new = np.r_[self.size, size], np.r_[self.flat, syms[order]], []

    def __call__(self, arr: pa.Array) -> pa.Array:
        if len(self.size) >= HELD_PRETOKENS or len(self.flat) >= HELD_IDS:
            self._clear()
        found, ends, number = [], [0], self.held.get
        for t in arr.to_pylist():
            for k, piece in enumerate(self.atoms.split(t) if t and "<" in t else (t or "",)):
                if k % 2:  # a reserved atom inside the text is one token
                    found.append(TK.SPECIAL_TOKENS.index(piece))
                    continue
                words = self.pattern.findall(piece)
                got = list(map(number, words))
                if None in got:
                    for i, n in enumerate(got):
                        if n is None:
                            got[i] = number(words[i])
                            if got[i] is None:
                                got[i] = self.held[words[i]] = len(self.start) + len(self.new)
                                self.new.append(words[i])
                found += got
            ends.append(len(found))
        if self.new:
            self._encode_new()
        found = np.array(found, np.int64)
        n = self.size[found]
        end = np.r_[0, np.cumsum(n)]
        ids = self.flat[np.repeat(self.start[found] - end[:-1], n) + np.arange(end[-1])]
        mask = arr.is_null() if arr.null_count else None
        return pa.ListArray.from_arrays(pa.array(end[ends].astype(np.int32)), pa.array(ids, pa.int32()), mask=mask)


_CODECS: dict = {}


def make_bpe_encoder(merges: list[tuple[int, int, int]]):
    """An Arrow-batched column function: text -> ids with the trained merges.
    They travel as two flat arrays in a broadcast (bounded by the vocabulary
    size), and a worker builds its :class:`Codec` once.  A decoder over the ids
    would have Spark encode a second time within it; what counts as not
    deterministic is evaluated once."""
    pairs = np.array([a * PAIR_SHIFT + b for a, b, _ in merges], np.int64)
    new = np.array([n for _, _, n in merges], np.int32)
    shared = SparkSession.active().sparkContext.broadcast((pairs, new))

    def enc(arr: pa.Array) -> pa.Array:
        pairs, new = shared.value
        key = (len(pairs), hash(pairs.tobytes()), hash(new.tobytes()))
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(pairs, new)
        return _CODECS[key](arr)

    udf = F.arrow_udf(enc, T.ArrayType(T.IntegerType())).asNondeterministic()
    return lambda c: udf(F.col(c) if isinstance(c, str) else c)


def make_bpe_decoder(vocab: list[bytes]):
    """Ids -> text by the flat table of the vocabulary, in a broadcast."""
    shared = SparkSession.active().sparkContext.broadcast(TK.Speller(list(vocab)))
    udf = F.arrow_udf(lambda arr: shared.value(arr), T.StringType())
    return lambda c: udf(F.col(c) if isinstance(c, str) else c)


def save_model(spark, model: dict, path: str) -> None:
    """The vocabulary as a Parquet table of its merges, from which :func:`load_model` rebuilds it."""
    merges_frame(spark, model).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> dict:
    """The model written by :func:`save_model`; raises when ranks are missing
    or a merge does not spell its token."""
    vocab, index = base_vocabulary()
    merges = []
    for r in spark.read.parquet(path).orderBy("merge_rank").collect():
        if r.merge_rank != len(merges) or max(r.left_id, r.right_id) >= len(vocab):
            raise ValueError(f"{path}: merge {len(merges)} is missing or out of order")
        string = vocab[r.left_id] + vocab[r.right_id]
        if string not in index:
            index[string] = len(vocab)
            vocab.append(string)
        if index[string] != r.new_id or string.hex() != r.token_hex:
            raise ValueError(f"{path}: merge {r.merge_rank} does not spell its token")
        merges.append((r.left_id, r.right_id, r.new_id))
    return {"merges": merges, "vocab": vocab}


def merges_frame(spark, model: dict) -> DataFrame:
    """Merges as rows ``(merge_rank, left_id, right_id, new_id, token_hex)``."""
    rows = [(i, a, b, n, model["vocab"][n].hex()) for i, (a, b, n) in enumerate(model["merges"])]
    return spark.createDataFrame(rows, "merge_rank int, left_id int, right_id int, new_id int, token_hex string")
