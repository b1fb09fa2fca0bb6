"""Plain-Python statements of the rules: the slow oracles of the pytest
specs (never used by the library).  Each is written from the rule as stated
"""

from __future__ import annotations


def budget_prefix(sizes, budget):
    """Indexes kept when a writer stops at the first document that overflows."""
    kept, total = [], 0
    for i, s in enumerate(sizes):
        total += s
        if total > budget:
            return kept
        kept.append(i)
    return kept


def budget_replay(sources, budget):
    """(docs, bytes) per source: each source takes its longest prefix that
    fits the budget left by the previous sources."""
    out, left = [], budget
    for sizes in sources:
        if left <= 0:
            out.append((0, 0))
            continue
        prefix = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
        k = max(k for k, p in enumerate(prefix) if p <= left)
        out.append((k, prefix[k]))
        left -= prefix[k]
    return out


def round_robin(files):
    """Take the i-th document of every file that still has one, for i = 0, 1, ..."""
    depth = max((len(f) for f in files), default=0)
    return [f[i] for i in range(depth) for f in files if i < len(f)]


def ratio_mix(main, rep, cap):
    """Slots are laid out cycle by cycle: while the capped corpus still has a
    document at its slot the cycle is main*6, repeat*3, capped; the first
    cycle whose capped slot finds nothing ends without it, and every later
    cycle is main*7, repeat*3.  The repeated corpus wraps around; the stream
    ends at the first main slot without a main document."""
    slots, cap_left = [], len(cap)
    while len([s for s in slots if s == "main"]) <= len(main):
        if cap_left is not None:
            slots += ["main"] * 6 + ["repeat"] * 3
            if cap_left > 0:
                slots.append("capped")
                cap_left -= 1
            else:
                cap_left = None
        else:
            slots += ["main"] * 7 + ["repeat"] * 3
    counters = {"main": 0, "repeat": 0, "capped": 0}
    stream = []
    for s in slots:
        i = counters[s]
        if s == "main" and i == len(main):
            break
        if s == "repeat" and not rep:
            raise ValueError("empty repeated corpus")
        stream.append((s, {"main": main, "capped": cap}.get(s, rep)[i % len(rep) if s == "repeat" else i]))
        counters[s] += 1
    return stream


def pack(docs_ids, block, eos=3):
    """The token stream (each non-empty document + EOS) cut into full blocks."""
    stream = [t for ids in docs_ids if ids for t in list(ids) + [eos]]
    return [stream[i:i + block] for i in range(0, len(stream) - block + 1, block)]


def truncate_keep_suffix(ids, room, suffix=32):
    """Keep ids whose index is in the head ``room - suffix`` or the last
    ``min(room, suffix)``; nothing when room <= 0; everything when it fits."""
    n = len(ids)
    if n <= room:
        return list(ids)
    if room <= 0:
        return []
    tail = min(room, suffix)
    head = room - tail
    keep = [i for i in range(n) if i < head or i >= n - tail]
    return [ids[i] for i in keep]


def rouge_n(p, r, n):
    def grams(t):
        out = {}
        for i in range(len(t) - n + 1):
            g = tuple(t[i:i + n])
            out[g] = out.get(g, 0) + 1
        return out
    a, b = grams(p), grams(r)
    total_a, total_b = sum(a.values()), sum(b.values())
    overlap = sum(min(c, b[g]) for g, c in a.items() if g in b)
    if total_a == 0 or total_b == 0 or overlap == 0:
        return 0.0, 0.0, 0.0
    prec, rec = overlap / total_a, overlap / total_b
    return prec, rec, 2 * prec * rec / (prec + rec)


def lcs(a, b):
    """Full (len(a)+1) x (len(b)+1) table of LCS lengths of prefixes."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[len(a)][len(b)]


def rolling_mean(values, window):
    out = []
    for i in range(len(values)):
        w = values[max(0, i - window + 1):i + 1]
        out.append(sum(w) / len(w))
    return out


def log_windows(losses, valid, rule, accum=8, log_steps=10):
    """(global_step, optimizer_step, mean loss) rows a training log holds.

    Micro-step s (1-based) updates when s is a multiple of ``accum`` (summary
    rule: and its loss is valid).  Contributing losses (base: all; summary:
    valid) accumulate between logs; a log row is written at every
    ``log_steps``-th update with their mean."""
    contributes = [True] * len(losses) if rule == "base" else list(valid)
    updates = [(s % accum == 0) and contributes[s - 1] for s in range(1, len(losses) + 1)]
    rows, since_last, n_upd = [], [], 0
    for s in range(1, len(losses) + 1):
        if contributes[s - 1]:
            since_last.append(losses[s - 1])
        if updates[s - 1]:
            n_upd += 1
            if n_upd % log_steps == 0:
                rows.append((s, n_upd, sum(since_last) / max(len(since_last), 1)))
                since_last = []
    return rows
