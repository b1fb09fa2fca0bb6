"""Token codecs as Arrow-batched column functions.

Two tokenizers share one id layout: 12 reserved tokens first, then the
256-symbol byte alphabet, then (for BPE) merges.

* ``byte``: merge-free byte-level tokenizer.  Token count is the UTF-8 byte
  length, so DuckDB can check every result.
* ``bpe``: a vocabulary trained by :mod:`textmill.operators.bpe`.

Encoding runs in an Arrow UDF: a whole batch of strings is viewed as one
UTF-8 byte buffer and mapped through a 256-entry table with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The reserved tokens, in id order (ids 0..11).
SPECIAL_TOKENS = ["<pad>", "<unk>", "<bos>", "<eos>", "<system>", "<user>", "<assistant>",
                  "<NAME>", "<EMAIL>", "<PHONE>", "<ADDRESS>", "<URL>"]
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
N_SPECIAL = len(SPECIAL_TOKENS)


def _printable_byte(b: int) -> bool:
    # bytes shown as themselves by the byte-level alphabet
    return 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255


def byte_alphabet() -> list[str]:
    """Byte -> visible character: printable bytes map to themselves, the
    other 68 to U+0100, U+0101, ... in byte order."""
    out, nxt = [], 0
    for b in range(256):
        if _printable_byte(b):
            out.append(chr(b))
        else:
            out.append(chr(256 + nxt))
            nxt += 1
    return out


def byte_ranks() -> np.ndarray:
    """Byte -> rank of its visible character by code point (0..255)."""
    alpha = byte_alphabet()
    order = sorted(range(256), key=lambda b: ord(alpha[b]))
    ranks = np.empty(256, dtype=np.int32)
    for r, b in enumerate(order):
        ranks[b] = r
    return ranks


BYTE_TO_ID = byte_ranks() + N_SPECIAL        # byte -> token id
ID_TO_BYTE = np.full(N_SPECIAL + 256, -1, dtype=np.int32)
ID_TO_BYTE[BYTE_TO_ID] = np.arange(256, dtype=np.int32)


def byte_vocab() -> list[tuple[int, str]]:
    """``(token_id, token)`` rows of the merge-free vocabulary."""
    alpha = byte_alphabet()
    rows = [(i, t) for i, t in enumerate(SPECIAL_TOKENS)]
    rows += [(int(BYTE_TO_ID[b]), alpha[b]) for b in range(256)]
    return sorted(rows)


SPECIAL_RE = "|".join(SPECIAL_TOKENS)  # letters and angle brackets only: no escaping needed


_ATOMS = [np.frombuffer(t.encode(), np.uint8) for t in SPECIAL_TOKENS]


def flat_bytes(arr: pa.Array):
    """``(bytes, offsets)`` of a string column; null rows are empty."""
    b = arr.cast(pa.large_binary())
    offs = np.frombuffer(b.buffers()[1], np.int64)[b.offset: b.offset + len(b) + 1] if len(b) else np.zeros(1, np.int64)
    data = b.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def atoms_in(raw, offs):
    """``(starts, token ids)`` of the reserved atoms in a flat buffer of texts, in order.

    An atom begins with its only ``<``, so none overlaps another."""
    at = np.flatnonzero(raw == ord("<"))
    end = offs[np.searchsorted(offs, at, "right")] if len(at) else at
    starts, ids = [], []
    for i, atom in enumerate(_ATOMS):
        mine = at[at + len(atom) <= end]
        for k in range(1, len(atom)):
            mine = mine[raw[mine + k] == atom[k]]
        starts.append(mine)
        ids.append(np.full(len(mine), i, np.int32))
    starts, ids = np.concatenate(starts), np.concatenate(ids)
    order = np.argsort(starts)
    return starts[order], ids[order]


def _one_array(arr):
    return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr


def _encode_bytes_arrow(arr: pa.Array) -> pa.Array:
    """Bytes by table; a reserved atom inside a text is one token."""
    arr = _one_array(arr)
    raw, offs = flat_bytes(arr)
    vals = BYTE_TO_ID[raw]
    starts, ids = atoms_in(raw, offs)
    if len(starts):
        vals[starts] = ids
        length = np.array([len(t) for t in _ATOMS])[ids] - 1
        stays = np.ones(len(vals), bool)
        stays[np.repeat(starts + 1, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = False
        offs = np.r_[0, np.cumsum(stays)][offs]
        vals = vals[stays]
    mask = arr.is_null() if arr.null_count else None
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(vals, pa.int32()), mask=mask)


class Speller:
    """Ids to text by a flat table of the tokens' bytes; ids outside it spell nothing."""

    def __init__(self, tokens: list):
        size = np.array([len(t) for t in tokens], np.int64)
        self.size = np.r_[size, 0]
        self.start = np.r_[np.cumsum(size) - size, 0]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, arr: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        arr = _one_array(arr)
        ids = arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        n = self.size[ids]
        end = np.r_[0, np.cumsum(n)]
        raw = self.flat[np.repeat(self.start[ids] - end[:-1], n) + np.arange(end[-1])]
        rows = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False))]
        out = pa.Array.from_buffers(pa.large_binary(), len(arr), [None, pa.py_buffer(end[rows].astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
        try:
            text = out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # some ids cut a character
            text = pa.array([v.decode("utf-8", errors="replace") for v in out.to_pylist()], pa.string())
        return pc.if_else(arr.is_valid(), text, pa.scalar(None, pa.string())) if arr.null_count else text


def _byte_tokens() -> list:
    out = [t.encode() for t in SPECIAL_TOKENS] + [b""] * 256
    for b in range(256):
        out[int(BYTE_TO_ID[b])] = bytes([b])
    return out


_decode_bytes_arrow = Speller(_byte_tokens())


_encode_udf = F.arrow_udf(_encode_bytes_arrow, T.ArrayType(T.IntegerType()))
_decode_udf = F.arrow_udf(lambda arr: _decode_bytes_arrow(arr), T.StringType())


def byte_encode(text) -> Column:
    """Token ids of ``text`` with the byte tokenizer (no special tokens added)."""
    return _encode_udf(F.col(text) if isinstance(text, str) else text)


def byte_decode(ids) -> Column:
    return _decode_udf(F.col(ids) if isinstance(ids, str) else ids)


def byte_token_count(text) -> Column:
    """Token count without encoding: one token per UTF-8 byte."""
    return F.octet_length(F.col(text) if isinstance(text, str) else text)


def append_eos(ids) -> Column:
    """The document's ids followed by EOS."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(c, F.array(F.lit(EOS_ID)))


def ids_md5(ids) -> Column:
    """Digest of an id list, identical to DuckDB's ``md5(array_to_string(ids, ','))``."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.md5(F.array_join(c, ","))


# --- escaped token preview (B6) ---------------------------------------------------
def unicode_escape(s: str) -> str:
    """Python's ``s.encode('unicode_escape').decode('ascii')``."""
    return s.encode("unicode_escape").decode("ascii")


def escaped_vocab(vocab_tokens: list[str]) -> list[str]:
    return [unicode_escape(t) for t in vocab_tokens]


def byte_vocab_tokens() -> list[str]:
    """Token string per id of the merge-free vocabulary (id order)."""
    return [t for _, t in byte_vocab()]


def token_preview(ids, escaped: list[str], n: int = 50) -> Column:
    """The first ``n`` tokens as escaped strings (a lookup in an id-indexed
    array built from the vocabulary; no Python per row)."""
    table = F.array(*[F.lit(t) for t in escaped])
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(F.slice(c, 1, n), lambda i: F.element_at(table, i + 1))


# --- pluggable tokenizer (F3) -------------------------------------------------------
class Tokenizer:
    """What the corpus jobs need from a tokenizer: column functions for encode
    and decode, the vocabulary size and the reserved ids."""

    def __init__(self, name, encode, decode, vocab_tokens, eos_id=EOS_ID, pad_id=PAD_ID, unk_id=UNK_ID,
                 count=None):
        self.name, self.encode, self.decode = name, encode, decode
        self.vocab_tokens = vocab_tokens
        self.vocab_size = len(vocab_tokens)
        self.eos_id, self.pad_id, self.unk_id = eos_id, pad_id, unk_id
        self.count = count  # token count without encoding, when the codec allows it

    def vocab_rows(self) -> list[tuple[int, str]]:
        return list(enumerate(self.vocab_tokens))


def get_tokenizer(kind: str = "byte", model: dict | None = None) -> Tokenizer:
    """``byte`` (merge-free, checkable by SQL) or ``bpe`` (a model returned by
    :func:`textmill.operators.bpe.train_bpe`)."""
    if kind == "byte":
        return Tokenizer("byte", byte_encode, byte_decode, byte_vocab_tokens(), count=byte_token_count)
    if kind == "bpe":
        from textmill.operators import bpe
        if model is None:
            raise ValueError("a trained model is required for the bpe tokenizer")
        alpha = byte_alphabet()
        toks = [t if i < N_SPECIAL else "".join(alpha[b] for b in v)
                for i, (t, v) in enumerate(zip(SPECIAL_TOKENS + [None] * (len(model["vocab"]) - N_SPECIAL),
                                               model["vocab"]))]
        return Tokenizer("bpe", bpe.make_bpe_encoder(model["merges"]), bpe.make_bpe_decoder(model["vocab"]), toks)
    raise ValueError(f"unknown tokenizer {kind!r}")
