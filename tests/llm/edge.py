"""Documents with nulls, blanks, ties, repeated rows, very long texts and clashing extra columns."""

from __future__ import annotations

import random


def prose(n, seed, vocab=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def edge_docs(spark):
    long = prose(20_000, 7, 50_000)
    body = prose(60, 1)
    rs = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 3), (4, "one", None, "b", 3),
          (5, body, "en", "b", 9), (6, body, "en", "a", 9), (7, body + " tail", "en", None, 9), (None, prose(40, 2), "en", "b", 9),
          (9, prose(40, 3), "de", "b", 9), (9, prose(40, 3), "de", "b", 9), (10, long, "en", "a", 9),
          (11, "ü ñ ß 漢字 😀 " * 12, "de", "c", 9), (12, "a b c d e " * 50, "en", "c", 9), (13, "x\r\nx\r\n y \n\n y", "en", "c", 9)]
    return spark.createDataFrame(
        [r + (i, "k", 1.0, i) for i, r in enumerate(rs)],
        "doc_id long, text string, lang string, source string, n_chars long, rid long, bytes string, size double, target long")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
