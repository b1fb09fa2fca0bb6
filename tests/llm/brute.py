"""Plain-Python versions of the training-data operators, and small frames to try them on."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def read(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def base_quality(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    cov = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cov),
            "base_failed": len(w) < 10 or 100 * len(cov) > 20 * len(w)}


def norm_line(x):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", x.strip(" \t\n\x0b\f\r")).lower()


def quality(docs, min_docs=10, share=0.05, min_words=10, min_left=0.3):
    held, hosts = defaultdict(set), defaultdict(set)
    for d in docs:
        hosts[d["source"]].add(d["text"])
        for x in (d["text"] or "").split("\n"):
            if WORD.search(x):
                held[d["source"], norm_line(x)].add(d["text"])
    often = {k for k, v in held.items() if len(v) > min_docs and len(v) > share * len(hosts[k[0]])}
    out = []
    for d in docs:
        b = base_quality(d["text"])
        lines = [x for x in (d["text"] or "").split("\n") if WORD.search(x)]
        gone = [x for x in lines if (d["source"], norm_line(x)) in often]
        left = b["n_words"] - sum(len(words(x)) for x in gone)
        depleted = bool(gone) and (left < min_words or left < min_left * b["n_words"])
        out.append(b | {"doc_id": d["doc_id"], "lines_removed": len(gone), "words_left": left, "depleted": depleted,
                        "kept": not b["base_failed"] and not depleted})
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, got = share * sum(sizes.values()), set(order), {}
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if each * w[s] >= most * sizes[s]}
        if not full:
            return got | {s: each * w[s] for s in open_}
        for s in full:
            got[s] = float(most * sizes[s])
            left -= got[s]
        open_ -= full
    return got


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def key_counts(rs, cols):
    return Counter(tuple(r[c] for c in cols) for r in rs)
