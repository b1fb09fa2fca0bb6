"""DuckDB oracles, written from the rules (not from the Spark plans).

Views ``documents``, ``conversations``, ``events``, ... are registered by the
caller.  DuckDB ``strlen`` counts bytes and ``length`` code points.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# documents as the corpus: group = lang, file = source, line = doc_id
DOCS = "(SELECT doc_id, lang AS \"group\", source AS file, doc_id AS line, text FROM documents)"

SQL["corpus_composition"] = f"""
SELECT "group", count(*) AS docs, CAST(sum(strlen(text) + 2) AS BIGINT) AS bytes,
       round(sum(strlen(text) + 2) / sum(sum(strlen(text) + 2)) OVER (), 9) AS byte_ratio
FROM {DOCS} d GROUP BY "group"
"""

_BUDGETS = f"""
budgets AS (SELECT "group", CAST(floor(sum(strlen(text) + 2) * 0.6) AS BIGINT) AS budget
            FROM {DOCS} d GROUP BY "group"),
run AS (SELECT d."group", d.file, d.doc_id, CAST(strlen(d.text) + 2 AS BIGINT) AS block_bytes,
               CAST(sum(strlen(d.text) + 2) OVER (PARTITION BY d."group" ORDER BY d.file, d.line
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_bytes,
               b.budget
        FROM {DOCS} d JOIN budgets b USING ("group"))
"""

SQL["byte_budget_prefix"] = f"""
WITH {_BUDGETS}
SELECT "group", file, doc_id, block_bytes, cum_bytes FROM run WHERE cum_bytes <= budget
"""

SQL["budget_usage"] = f"""
WITH {_BUDGETS}
SELECT "group", count(*) AS consumed_docs, CAST(sum(block_bytes) AS BIGINT) AS consumed_bytes
FROM run WHERE cum_bytes <= budget GROUP BY "group"
"""


# --- mixing and packing ------------------------------------------------------
def byte_rank(b: str) -> str:
    """Rank of a byte's visible character in the byte-level alphabet."""
    return (f"CASE WHEN {b} BETWEEN 33 AND 126 THEN {b} - 33 WHEN {b} BETWEEN 161 AND 172 THEN {b} - 67 "
            f"WHEN {b} BETWEEN 174 AND 255 THEN {b} - 68 WHEN {b} <= 32 THEN {b} + 188 "
            f"WHEN {b} BETWEEN 127 AND 160 THEN {b} + 94 ELSE 255 END")


def byte_ids(text: str) -> str:
    """Byte-tokenizer ids of a text (no EOS)."""
    b = "('0x' || h)::INTEGER"
    return (f"list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            f"lambda h: ({byte_rank(b)}) + 12)")


SQL["round_robin"] = f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY "group", file ORDER BY line) - 1 AS in_file FROM {DOCS} d)
SELECT "group", doc_id, in_file,
       row_number() OVER (PARTITION BY "group" ORDER BY in_file, file) - 1 AS rr_pos
FROM f
"""


def _role(ph: str, sl: str) -> str:
    return (f"CASE WHEN ({ph} = 1 AND {sl} < 6) OR ({ph} = 2 AND {sl} < 7) THEN 'main' "
            f"WHEN {ph} = 1 AND {sl} = 9 THEN 'capped' ELSE 'repeat' END")


# The mix generator walked one slot at a time: phase 1 cycles are 6 main,
# 3 repeat, 1 capped; when the capped source has nothing left at its slot,
# phase 2 cycles of 7 main, 3 repeat begin.  The walk stops at the first main
# slot with no main document left.
MIX_CTE = f"""
docs AS (SELECT CASE WHEN lang = 'de' THEN 'repeat' WHEN lang = 'es' THEN 'capped' ELSE 'main' END AS role,
                lang || '/' || source AS file, doc_id AS line, doc_id, text FROM documents),
rr1 AS (SELECT *, row_number() OVER (PARTITION BY role, file ORDER BY line) - 1 AS in_file
        FROM docs WHERE role IS NOT NULL),
rr AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY in_file, file) - 1 AS src_idx FROM rr1),
cnt AS (SELECT count(*) FILTER (WHERE role = 'main') AS k, count(*) FILTER (WHERE role = 'repeat') AS n,
               count(*) FILTER (WHERE role = 'capped') AS c FROM rr),
walk(pos, phase, slot, ki, ei, ci, role) AS (
  SELECT 0, 1, 0, 0, 0, 0, 'main' FROM cnt WHERE k > 0
  UNION ALL
  SELECT pos, phase, slot, ki, ei, ci, {_role('phase', 'slot')} FROM (
    SELECT w.pos + 1 AS pos,
           CASE WHEN w.phase = 1 AND w.slot = 8 AND w.ci >= cnt.c THEN 2 ELSE w.phase END AS phase,
           CASE WHEN w.phase = 1 AND w.slot = 8 AND w.ci >= cnt.c THEN 0 ELSE (w.slot + 1) % 10 END AS slot,
           w.ki + CAST(w.role = 'main' AS INTEGER) AS ki,
           w.ei + CAST(w.role = 'repeat' AS INTEGER) AS ei,
           w.ci + CAST(w.role = 'capped' AS INTEGER) AS ci,
           cnt.k AS k
    FROM walk w, cnt) t
  WHERE NOT ({_role('phase', 'slot')} = 'main' AND ki >= k)
),
mix AS (SELECT CAST(w.pos AS BIGINT) AS mix_pos, w.role,
               CASE w.role WHEN 'main' THEN w.ki WHEN 'repeat' THEN w.ei % cnt.n ELSE w.ci END AS src_idx
        FROM walk w, cnt),
mixed AS (SELECT m.mix_pos, m.role, rr.doc_id, m.src_idx, rr.text
          FROM mix m JOIN rr ON rr.role = m.role AND rr.src_idx = m.src_idx)
"""

SQL["ratio_mix"] = f"""
WITH RECURSIVE {MIX_CTE}
SELECT mix_pos, role, doc_id, src_idx FROM mixed
"""

_OFFS = f"""
offs AS (SELECT mix_pos, role, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens,
                CAST(coalesce(sum(strlen(text) + 1) OVER (ORDER BY mix_pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tok_start,
                text
         FROM mixed WHERE strlen(text) > 0)
"""

SQL["token_offsets"] = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS}
SELECT mix_pos, n_tokens, tok_start FROM offs
"""

_BLOCKS = f"""
toks AS (SELECT tok_start, {byte_ids('text')} || [3] AS ids FROM offs),
flat AS (SELECT tok_start + unnest(range(len(ids))) AS off, unnest(ids) AS id FROM toks),
nb AS (SELECT sum(n_tokens) // 4096 AS n_blocks FROM offs),
blocks AS (SELECT off // 4096 AS block_idx, count(*) AS n_ids,
                  md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY off)) AS ids_md5
           FROM flat GROUP BY off // 4096),
kept AS (SELECT b.* FROM blocks b, nb WHERE b.block_idx < nb.n_blocks)
"""

SQL["pack_blocks"] = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS}, {_BLOCKS}
SELECT CAST(block_idx AS BIGINT) AS block_idx,
       CASE WHEN block_idx < 100 THEN 'eval' ELSE 'train' END AS split,
       CAST(CASE WHEN block_idx < 100 THEN NULL ELSE (block_idx - 100) // 128 END AS BIGINT) AS shard,
       CAST(CASE WHEN block_idx < 100 THEN block_idx ELSE (block_idx - 100) % 128 END AS BIGINT) AS local_idx,
       CAST(n_ids AS INTEGER) AS n_ids, ids_md5
FROM kept
"""

SQL["pack_metadata"] = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS}
SELECT 4096 AS block_size, 128 AS blocks_per_file, count(*) AS total_docs,
       count(*) FILTER (WHERE role = 'main') AS docs_main,
       count(*) FILTER (WHERE role = 'repeat') AS docs_repeat,
       count(*) FILTER (WHERE role = 'capped') AS docs_capped,
       CAST(sum(n_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(n_tokens) // 4096 AS BIGINT) AS total_blocks,
       CAST(least(sum(n_tokens) // 4096, 100) AS BIGINT) AS eval_blocks,
       CAST(greatest(sum(n_tokens) // 4096 - 100, 0) AS BIGINT) AS train_blocks
FROM offs
"""

_TRAIN_IDX = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS},
nb AS (SELECT CAST(sum(n_tokens) // 4096 AS BIGINT) AS n_blocks FROM offs),
tr AS (SELECT CAST(i AS BIGINT) AS block_idx, CAST(i - 100 AS BIGINT) AS train_idx
       FROM nb, range(100, nb.n_blocks) t(i))
"""

SQL["block_lookup"] = _TRAIN_IDX + """
SELECT train_idx, train_idx // 128 AS shard, train_idx % 128 AS local_idx FROM tr
"""

SQL["resume_skip"] = _TRAIN_IDX + """
SELECT block_idx, train_idx FROM tr WHERE train_idx >= 3 * 8
"""

SQL["packed_validate"] = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS}, {_BLOCKS}
SELECT CAST(block_idx AS BIGINT) AS block_idx, CASE WHEN block_idx < 100 THEN 'eval' ELSE 'train' END AS split,
       CAST(CASE WHEN block_idx < 100 THEN NULL ELSE (block_idx - 100) // 128 END AS BIGINT) AS shard,
       CAST(CASE WHEN block_idx % 50 = 0 THEN 100 ELSE n_ids END AS INTEGER) AS width
FROM kept WHERE n_ids <> 4096 OR block_idx % 50 = 0
"""


# --- scans over derived JSON lines -------------------------------------------
# Unicode White_Space code points plus U+001C..U+001F, i.e. the
# characters Python's str.strip() removes.
_WS = r"\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def ustrip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def jesc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), "
            f"chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')")


def _values(rows: list[str]) -> str:
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i + 1}, {q(s)})" for i, s in enumerate(rows))


def _edge(name: str):
    from textmill.plans import fixtures
    return getattr(fixtures, name)


DOC_LINES = f"""
lines AS (
  SELECT source AS file, doc_id * 4 + k + 1 AS line_no, raw FROM (
    SELECT doc_id, source, 0 AS k, '{{"text": "' || {jesc('text')} || '", "doc_id": ' || doc_id || '}}' AS raw FROM documents
    UNION ALL SELECT doc_id, source, 1, '{{"text": ' || n_chars || '}}' FROM documents
    UNION ALL SELECT doc_id, source, 2, '{{"text": "' || {jesc('text')} FROM documents
    UNION ALL SELECT doc_id, source, 3, '' FROM documents) d
  UNION ALL SELECT 'inline', line_no, raw FROM (VALUES {{edge}}) t(line_no, raw)),
parsed AS (SELECT file, line_no, raw, {ustrip('raw')} AS s FROM lines),
j AS (SELECT *, CASE WHEN s <> '' AND json_valid(s) THEN json_type(s) END AS jt,
             CASE WHEN s <> '' AND json_valid(s) AND json_type(s) = 'OBJECT' THEN json_type(s, '$.text') END AS tt
      FROM parsed)
"""


def _doc_lines() -> str:
    return DOC_LINES.replace("{edge}", _values(_edge("TEXT_EDGE_LINES")))


def _coerced() -> str:
    return f"""
coerced AS (SELECT file, line_no, raw, {ustrip('''CASE tt WHEN 'VARCHAR' THEN s->>'$.text' WHEN 'NULL' THEN 'None'
                 WHEN 'BOOLEAN' THEN CASE WHEN s->>'$.text' = 'true' THEN 'True' ELSE 'False' END
                 ELSE CAST(json_extract(s, '$.text') AS VARCHAR) END''')} AS text
            FROM j WHERE tt IS NOT NULL)
"""


def _define_sql():
    SQL["jsonl_scan_strict"] = f"""
WITH {_doc_lines()}
SELECT file, line_no, {ustrip("s->>'$.text'")} AS text FROM j
WHERE tt = 'VARCHAR' AND length({ustrip("s->>'$.text'")}) > 0
"""
    SQL["jsonl_scan_coerce"] = f"""
WITH {_doc_lines()}, {_coerced()}
SELECT file, line_no, text FROM coerced WHERE length(text) > 0
"""
    SQL["jsonl_scan_lineage"] = f"""
WITH {_doc_lines()}, {_coerced()}
SELECT file, line_no AS line_number, md5(raw) AS raw_md5, text, CAST(strlen(text) + 2 AS BIGINT) AS train_block_bytes
FROM coerced WHERE length(text) > 0
"""
    SQL["strip_nonempty"] = f"""
WITH {_doc_lines()}
SELECT file, line_no, CAST(length(s) AS INTEGER) AS n_chars FROM parsed WHERE length(s) > 0
"""
    SQL["sft_scan_quality"] = f"""
WITH {_sft_lines()}
SELECT count(*) FILTER (WHERE status = 'blank') AS blank_lines,
       count(*) FILTER (WHERE status = 'bad') AS bad_lines,
       count(*) FILTER (WHERE status = 'valid') AS valid_samples
FROM st
"""
    SQL["generation_samples"] = f"""
WITH {_sft_lines()}
SELECT line_no, CASE WHEN id_type IS NULL THEN CAST(line_no AS VARCHAR) WHEN id_type = 'NULL' THEN NULL
                     ELSE id_value END AS id, prompt, response AS reference
FROM st WHERE status = 'valid'
"""


def _falsy(path: str) -> str:
    t = f"json_type(s, '{path}')"
    v = f"(s->>'{path}')"
    return (f"({t} IS NULL OR {t} = 'NULL' OR ({t} = 'VARCHAR' AND {v} = '') "
            f"OR ({t} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({v} AS DOUBLE) = 0) "
            f"OR ({t} = 'BOOLEAN' AND {v} = 'false') OR ({t} = 'ARRAY' AND json_array_length(s, '{path}') = 0) "
            f"OR ({t} = 'OBJECT' AND CAST(json_extract(s, '{path}') AS VARCHAR) = '{{}}'))")


def _pystr(path: str) -> str:
    t = f"json_type(s, '{path}')"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 'VARCHAR' THEN s->>'{path}' WHEN {t} = 'NULL' THEN 'None' "
            f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN s->>'{path}' = 'true' THEN 'True' ELSE 'False' END "
            f"ELSE CAST(json_extract(s, '{path}') AS VARCHAR) END")


PAIRS = """
pairs AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response,
                 u.conv_id * 1048576 + u.turn AS pair_id
          FROM conversations u JOIN conversations a
            ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
          WHERE u.role = 'user')
"""


def _sft_lines() -> str:
    idl = "'\"c' || conv_id || '-' || turn || '\"'"
    pe, re_ = jesc("prompt"), jesc("response")
    return f"""{PAIRS},
lines AS (
  SELECT 'sft' AS file, pair_id * 8 + k + 1 AS line_no, raw FROM (
    SELECT pair_id, 0 AS k, '{{"prompt": "' || {pe} || '", "response": "' || {re_} || '"}}' AS raw FROM pairs
    UNION ALL SELECT pair_id, 1, '{{"prompt": "' || {pe} || '", "response": ""}}' FROM pairs
    UNION ALL SELECT pair_id, 2, '{{"id": ' || {idl} || ', "prompt": 0, "response": "' || {re_} || '"}}' FROM pairs
    UNION ALL SELECT pair_id, 3, '{{"id": ' || {idl} || ', "prompt": "' || {pe} || '", "response": "' || {re_} || '"}}' FROM pairs
    UNION ALL SELECT pair_id, 4, '' FROM pairs) d
  UNION ALL SELECT 'sft_inline', line_no, raw FROM (VALUES {_values(_edge('SFT_EDGE_LINES'))}) t(line_no, raw)),
parsed AS (SELECT file, line_no, raw, {ustrip('raw')} AS s FROM lines),
st AS (SELECT file, line_no,
              CASE WHEN s = '' THEN 'blank'
                   WHEN NOT json_valid(s) THEN 'bad'
                   WHEN json_type(s) <> 'OBJECT' THEN 'bad'
                   WHEN {_falsy('$.prompt')} OR {_falsy('$.response')} THEN 'bad'
                   ELSE 'valid' END AS status,
              CASE WHEN s <> '' AND json_valid(s) AND json_type(s) = 'OBJECT' THEN {_pystr('$.prompt')} END AS prompt,
              CASE WHEN s <> '' AND json_valid(s) AND json_type(s) = 'OBJECT' THEN {_pystr('$.response')} END AS response,
              CASE WHEN s <> '' AND json_valid(s) AND json_type(s) = 'OBJECT' THEN {_pystr('$.id')} END AS id_value,
              CASE WHEN s <> '' AND json_valid(s) AND json_type(s) = 'OBJECT' THEN json_type(s, '$.id') END AS id_type
       FROM parsed)
"""


SQL["block_scan"] = f"""
WITH t AS (SELECT doc_id, string_split(replace(replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10)
                  ELSE chr(13) || chr(10) || chr(13) || chr(10) END), chr(13) || chr(10), chr(10)), chr(10) || chr(10)) AS bs FROM documents),
b AS (SELECT doc_id, unnest(bs) AS blk, unnest(range(1, len(bs) + 1)) AS block_index FROM t)
SELECT doc_id, CAST(block_index AS BIGINT) AS block_index, md5({ustrip('blk')}) AS block_md5,
       CAST(strlen({ustrip('blk')}) + 2 AS BIGINT) AS block_bytes
FROM b WHERE length({ustrip('blk')}) > 0
"""


def all_sql() -> dict[str, str]:
    return dict(SQL)


# --- supervised examples -------------------------------------------------------
def trunc(p: str, room: str) -> str:
    return (f"CASE WHEN len({p}) <= ({room}) THEN {p} WHEN ({room}) <= 0 THEN CAST([] AS INTEGER[]) "
            f"WHEN ({room}) <= 32 THEN {p}[len({p}) - ({room}) + 1:len({p})] "
            f"ELSE {p}[1:({room}) - 32] || {p}[len({p}) - 31:len({p})] END")


SFT_CTE = f"""{PAIRS},
enc AS (SELECT pair_id, {byte_ids('prompt')} AS p, {byte_ids('response')} || [3] AS r FROM pairs),
e2 AS (SELECT pair_id, CASE WHEN len(r) >= 1024 THEN r[1:1023] || [3] ELSE r END AS r,
              CASE WHEN len(r) >= 1024 THEN CAST([] AS INTEGER[]) ELSE p END AS p FROM enc),
e3 AS (SELECT pair_id, r, {trunc('p', '1024 - len(r)')} AS p FROM e2),
ex AS (SELECT pair_id, p || r AS input_ids, list_transform(p, lambda x: -100) || r AS labels,
              len(p) AS n_prompt FROM e3)
"""

SQL["sft_encode"] = f"""
WITH {SFT_CTE}
SELECT pair_id, CAST(len(input_ids) AS INTEGER) AS n_input, CAST(n_prompt AS INTEGER) AS n_prompt,
       md5(array_to_string(input_ids, ',')) AS input_md5, md5(array_to_string(labels, ',')) AS labels_md5
FROM ex
"""

SQL["truncate_prompt"] = f"""
WITH {PAIRS}, enc AS (SELECT pair_id, {byte_ids('prompt')} AS p FROM pairs),
t AS (SELECT pair_id, {trunc('p', '64')} AS ids FROM enc)
SELECT pair_id, CAST(len(ids) AS INTEGER) AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM t
"""

SQL["generation_prompts"] = f"""
WITH {PAIRS}, enc AS (SELECT pair_id, {byte_ids('prompt')} AS p FROM pairs),
t AS (SELECT pair_id, {trunc('p', '1024 - 128')} AS ids FROM enc)
SELECT pair_id, CAST(len(ids) AS INTEGER) AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM t
"""

SQL["sft_valid_labels"] = f"""
WITH {SFT_CTE},
s AS (SELECT pair_id, len(list_filter(labels[2:len(labels)], lambda x: x <> -100)) AS n_supervised FROM ex)
SELECT pair_id, CAST(n_supervised AS INTEGER) AS n_supervised FROM s WHERE n_supervised > 0
"""

SQL["pad_batches"] = f"""
WITH {SFT_CTE},
b AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // 8 AS batch_id FROM ex),
m AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS padded_len FROM b),
p AS (SELECT pair_id, batch_id, padded_len,
             input_ids || list_transform(range(padded_len - len(input_ids)), lambda i: 0) AS ids,
             labels || list_transform(range(padded_len - len(labels)), lambda i: -100) AS lab
      FROM m)
SELECT pair_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(padded_len AS INTEGER) AS padded_len,
       md5(array_to_string(ids, ',')) AS input_md5, md5(array_to_string(lab, ',')) AS labels_md5,
       CAST(len(list_filter(ids, lambda x: x <> 0)) AS INTEGER) AS mask_sum
FROM p
"""

SQL["run_plan"] = f"""
WITH {PAIRS}, n AS (SELECT count(*) AS n_samples FROM pairs),
u AS (SELECT n_samples, CAST(greatest(1, n_samples * 3 // 8) AS BIGINT) AS total_updates FROM n)
SELECT n_samples, total_updates, CAST(floor(total_updates * 0.03) AS BIGINT) AS warmup_steps,
       CAST(least(total_updates, 100) AS BIGINT) AS updates_capped_min,
       CAST(100 AS BIGINT) AS updates_capped_replace, CAST(floor(100 * 0.03) AS BIGINT) AS warmup_capped_replace
FROM u
"""


# --- ROUGE ---------------------------------------------------------------------
_CHARS = f"'[^{_WS}]'"
_WORDS = f"'[^{_WS}]+'"


def _prf(o: str, pn: str, rn: str, name: str) -> str:
    z = f"({pn} = 0 OR {rn} = 0 OR {o} = 0)"
    p, r = f"({o} / {pn})", f"({o} / {rn})"
    return (f"round(CASE WHEN {z} THEN 0.0 ELSE {p} END, 9) AS {name}_p, "
            f"round(CASE WHEN {z} THEN 0.0 ELSE {r} END, 9) AS {name}_r, "
            f"round(CASE WHEN {z} THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END, 9) AS {name}_f1")


ROUGE_CTE = f"""{PAIRS},
tok AS (SELECT pair_id AS id, regexp_extract_all({ustrip("coalesce(prompt, '')")}, {_CHARS}) AS p,
               regexp_extract_all({ustrip("coalesce(response, '')")}, {_CHARS}) AS r FROM pairs),
g AS (SELECT id, 1 AS n, 'p' AS side, unnest(p) AS gram FROM tok
      UNION ALL SELECT id, 1, 'r', unnest(r) FROM tok
      UNION ALL SELECT id, 2, 'p', unnest(list_transform(range(1, len(p)), lambda i: p[i] || chr(1) || p[i + 1])) FROM tok
      UNION ALL SELECT id, 2, 'r', unnest(list_transform(range(1, len(r)), lambda i: r[i] || chr(1) || r[i + 1])) FROM tok),
c AS (SELECT id, n, gram, count(*) FILTER (WHERE side = 'p') AS cp, count(*) FILTER (WHERE side = 'r') AS cr
      FROM g GROUP BY id, n, gram),
o AS (SELECT id, n, sum(least(cp, cr)) AS o, sum(cp) AS pn, sum(cr) AS rn FROM c GROUP BY id, n),
s AS (SELECT t.id,
             coalesce(max(o.o) FILTER (WHERE o.n = 1), 0) AS o1, coalesce(max(o.pn) FILTER (WHERE o.n = 1), 0) AS pn1,
             coalesce(max(o.rn) FILTER (WHERE o.n = 1), 0) AS rn1,
             coalesce(max(o.o) FILTER (WHERE o.n = 2), 0) AS o2, coalesce(max(o.pn) FILTER (WHERE o.n = 2), 0) AS pn2,
             coalesce(max(o.rn) FILTER (WHERE o.n = 2), 0) AS rn2
      FROM tok t LEFT JOIN o ON o.id = t.id GROUP BY t.id),
sc AS (SELECT id, {_prf('o1', 'pn1', 'rn1', 'r1')}, {_prf('o2', 'pn2', 'rn2', 'r2')} FROM s)
"""

# The longest common subsequence by bit vectors: bit j of a reference's vector is 0 once its first j tokens have gained
# a match.  A vector is a list of 60-bit parts, a step per token of the prediction adds the matched bits with carry.
LCS_CTE = f"""{ROUGE_CTE},
part AS (SELECT id, p, r, unnest(range(0, (len(r) + 59) // 60)) AS k FROM tok WHERE len(p) > 0),
bits AS (SELECT id, t, (j - 1) // 60 AS k, CAST(sum(1::BIGINT << CAST((j - 1) % 60 AS INTEGER)) AS BIGINT) AS m
         FROM (SELECT id, unnest(r) AS t, unnest(range(1, len(r) + 1)) AS j FROM tok) GROUP BY ALL),
step AS (SELECT x.id, i, list(coalesce(m, 0::BIGINT) ORDER BY x.k) AS m
         FROM (SELECT id, k, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS i FROM part) x
         LEFT JOIN bits b ON b.id = x.id AND b.t = x.t AND b.k = x.k GROUP BY x.id, i),
full_ AS (SELECT id, list(CASE WHEN len(r) >= 60 * k + 60 THEN (1::BIGINT << 60) - 1
                               ELSE (1::BIGINT << CAST(len(r) - 60 * k AS INTEGER)) - 1 END ORDER BY k) AS f FROM part GROUP BY id),
v AS (SELECT id, any_value(f) AS f, list_reduce([any_value(f)] || list(m ORDER BY i), lambda v, m: list_reduce(
             [[0::BIGINT]] || list_transform(range(1, len(m) + 1), lambda k: [v[k], m[k]]),
             lambda a, e: [(e[1] + (e[1] & e[2]) + a[1]) >> 60] || a[2:] || [((e[1] + (e[1] & e[2]) + a[1]) & 1152921504606846975) | (e[1] & ~e[2])])[2:]) AS v
      FROM step JOIN full_ USING (id) GROUP BY id),
l AS (SELECT tok.id, len(p) AS pl, len(r) AS rl,
             coalesce(list_sum(list_transform(range(1, len(f) + 1), lambda k: bit_count(f[k]) - bit_count(f[k] & v[k]))), 0) AS lcs
      FROM tok LEFT JOIN v USING (id)),
sl AS (SELECT id, lcs, {_prf('lcs', 'pl', 'rl', 'rl')} FROM l)
"""

SQL["lcs_length"] = f"""
WITH {LCS_CTE}
SELECT id, CAST(pl AS INTEGER) AS pred_len, CAST(rl AS INTEGER) AS ref_len, CAST(lcs AS INTEGER) AS lcs FROM l
"""

SQL["rouge_l"] = f"""
WITH {LCS_CTE}
SELECT id, CAST(lcs AS INTEGER) AS lcs, rl_p, rl_r, rl_f1 FROM sl
"""

SQL["rouge_summary"] = f"""
WITH {LCS_CTE}
SELECT count(*) AS samples, {', '.join(f"round(coalesce(avg({m}_{x}), 0), 9) AS {n}_{x}" for m, n in (('r1', 'rouge1'), ('r2', 'rouge2'), ('rl', 'rougeL')) for x in ('p', 'r', 'f1'))}
FROM sc JOIN sl USING (id)
"""

SQL["rouge_tokens"] = f"""
WITH {PAIRS}
SELECT pair_id AS id,
       CAST(len(regexp_extract_all({ustrip("coalesce(prompt, '')")}, {_CHARS})) AS INTEGER) AS pred_chars,
       CAST(len(regexp_extract_all({ustrip("coalesce(response, '')")}, {_CHARS})) AS INTEGER) AS ref_chars,
       CAST(len(regexp_extract_all({ustrip("coalesce(prompt, '')")}, {_WORDS})) AS INTEGER) AS pred_words,
       CAST(len(regexp_extract_all({ustrip("coalesce(response, '')")}, {_WORDS})) AS INTEGER) AS ref_words
FROM pairs
"""

SQL["ngram_counts"] = f"""
WITH {ROUGE_CTE}
SELECT id, n, count(*) AS distinct_ngrams, CAST(sum(cp) AS BIGINT) AS pred_total,
       CAST(sum(cr) AS BIGINT) AS ref_total, CAST(sum(least(cp, cr)) AS BIGINT) AS overlap
FROM c GROUP BY id, n
"""

SQL["rouge_scores"] = f"""
WITH {ROUGE_CTE}
SELECT * FROM sc
"""

SQL["rouge_summary_n"] = f"""
WITH {ROUGE_CTE}
SELECT count(*) AS samples,
       round(coalesce(avg(r1_p), 0), 9) AS rouge1_p, round(coalesce(avg(r1_r), 0), 9) AS rouge1_r,
       round(coalesce(avg(r1_f1), 0), 9) AS rouge1_f1, round(coalesce(avg(r2_p), 0), 9) AS rouge2_p,
       round(coalesce(avg(r2_r), 0), 9) AS rouge2_r, round(coalesce(avg(r2_f1), 0), 9) AS rouge2_f1
FROM sc
"""

SQL["rouge_running_avg"] = f"""
WITH {ROUGE_CTE},
ra AS (SELECT row_number() OVER (ORDER BY id) AS idx,
              sum(r1_f1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM sc)
SELECT CAST(idx AS BIGINT) AS idx, round(s / idx, 9) AS running_mean FROM ra WHERE idx % 10 = 0
"""


# --- run logs ------------------------------------------------------------------
LOG = """
log AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS global_step, event_id, user_id, event_type,
               value AS loss, event_type <> 'error' AS valid FROM events)
"""

SQL["eval_loss_ppl"] = f"""
WITH {LOG},
g AS (SELECT user_id, avg(loss) FILTER (WHERE valid) AS m, count(*) FILTER (WHERE valid) AS valid_steps,
             count(*) FILTER (WHERE NOT valid) AS skipped_steps FROM log GROUP BY user_id)
SELECT user_id, coalesce(round(m, 9), 'nan'::DOUBLE) AS eval_loss,
       CASE WHEN m IS NULL THEN 'inf'::DOUBLE WHEN m < 20 THEN round(exp(m), 9) ELSE 'inf'::DOUBLE END AS perplexity,
       valid_steps, skipped_steps, skipped_steps AS nan_steps
FROM g
"""

SQL["masked_nll"] = f"""
WITH {LOG}, f AS (SELECT user_id, min(global_step) AS first FROM log GROUP BY user_id)
SELECT l.user_id AS seq, round(avg(l.loss), 9) AS mean_nll, count(*) AS n_tokens
FROM log l JOIN f USING (user_id) WHERE l.global_step > f.first AND l.valid GROUP BY l.user_id
"""

_OPT = f"""
{LOG},
o AS (SELECT *, CAST(global_step % 8 = 0 AS BIGINT) AS ub, CAST(global_step % 8 = 0 AND valid AS BIGINT) AS us
      FROM log),
o2 AS (SELECT *, sum(ub) OVER (ORDER BY global_step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sb,
              sum(us) OVER (ORDER BY global_step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ss FROM o)
"""

SQL["optimizer_steps"] = f"""
WITH {_OPT}
SELECT global_step, ub AS update_base, CAST(sb AS BIGINT) AS opt_step_base,
       us AS update_summary, CAST(ss AS BIGINT) AS opt_step_summary FROM o2
"""


def _win(rule: str) -> str:
    upd, cum, contrib = ("ub", "sb", "TRUE") if rule == "base" else ("us", "ss", "valid")
    return f"""
SELECT '{rule}' AS rule, max(global_step) FILTER (WHERE {upd} = 1 AND {cum} % 10 = 0) AS global_step,
       CAST((w + 1) * 10 AS BIGINT) AS optimizer_step,
       round(coalesce(sum(loss) FILTER (WHERE {contrib}), 0) / greatest(count(*) FILTER (WHERE {contrib}), 1), 9)
         AS train_loss,
       count(*) FILTER (WHERE {contrib}) AS n_losses
FROM (SELECT *, ({cum} - {upd}) // 10 AS w FROM o2) t
GROUP BY w HAVING max(global_step) FILTER (WHERE {upd} = 1 AND {cum} % 10 = 0) IS NOT NULL
"""


SQL["train_log_windows"] = f"WITH {_OPT} {_win('base')} UNION ALL {_win('summary')}"

_POINTS = f"""
{LOG},
txt AS (SELECT CAST(global_step AS VARCHAR) AS step_txt,
               CASE WHEN event_type = 'error' THEN 'nan' WHEN event_type = 'signup' THEN ''
                    ELSE CAST(loss AS VARCHAR) END AS train_txt,
               CASE WHEN event_type = 'purchase' THEN CAST(loss AS VARCHAR) ELSE '' END AS eval_txt FROM log),
pts AS (SELECT CAST(TRY_CAST(step_txt AS DOUBLE) AS BIGINT) AS step,
               CASE WHEN isnan(TRY_CAST(train_txt AS DOUBLE)) THEN NULL ELSE TRY_CAST(train_txt AS DOUBLE) END AS train_loss,
               CASE WHEN isnan(TRY_CAST(eval_txt AS DOUBLE)) THEN NULL ELSE TRY_CAST(eval_txt AS DOUBLE) END AS eval_loss
        FROM txt)
"""

SQL["log_points"] = f"WITH {_POINTS} SELECT * FROM pts"

SQL["loss_smoothing"] = f"""
WITH {_POINTS}
SELECT 'train' AS series, step, round(avg(train_loss) OVER (ORDER BY step ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 9) AS smooth
FROM pts WHERE train_loss IS NOT NULL
UNION ALL
SELECT 'eval', step, round(avg(eval_loss) OVER (ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9)
FROM pts WHERE eval_loss IS NOT NULL
"""

SQL["retention_list"] = """
WITH n AS (SELECT p_brand AS run, 'step_' || p_partkey AS name FROM part
           UNION ALL SELECT 'inline', x FROM (VALUES ('step_10'), ('step_9'), ('step_x'), ('step_')) t(x)),
s AS (SELECT run, name, TRY_CAST(split_part(name, '_', -1) AS BIGINT) AS step FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, name DESC) AS rk FROM s WHERE step IS NOT NULL)
SELECT run, name, step FROM r WHERE rk > 3
"""


# --- holdout splits --------------------------------------------------------------
REPLAY = f"""
budgets AS (SELECT "group", CAST(floor(sum(strlen(text) + 2) * 0.6) AS BIGINT) AS budget FROM {DOCS} d GROUP BY "group"),
src AS (SELECT "group", file, dense_rank() OVER (PARTITION BY "group" ORDER BY file) AS k
        FROM (SELECT DISTINCT "group", file FROM {DOCS} d0) x),
cum AS (SELECT "group", file, sum(strlen(text) + 2) OVER (PARTITION BY "group", file ORDER BY line
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM {DOCS} d1),
rec("group", k, remaining, file, consumed_docs, consumed_bytes) AS (
  SELECT "group", 0, budget, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM budgets
  UNION ALL
  SELECT r."group", r.k + 1, r.remaining - coalesce(max(c.c) FILTER (WHERE c.c <= r.remaining), 0), s.file,
         count(*) FILTER (WHERE c.c <= r.remaining), CAST(coalesce(max(c.c) FILTER (WHERE c.c <= r.remaining), 0) AS BIGINT)
  FROM rec r JOIN src s ON s."group" = r."group" AND s.k = r.k + 1
       JOIN cum c ON c."group" = s."group" AND c.file = s.file
  GROUP BY r."group", r.k, r.remaining, s.file),
usage AS (SELECT "group", file, CAST(consumed_docs AS BIGINT) AS consumed_docs, consumed_bytes FROM rec WHERE k > 0),
idx AS (SELECT d.*, row_number() OVER (PARTITION BY "group", file ORDER BY line) - 1 AS src_doc FROM {DOCS} d),
elig AS (SELECT i.* FROM idx i JOIN usage u USING ("group", file)
         WHERE i.src_doc >= u.consumed_docs AND length(i.text) >= 50),
ecnt AS (SELECT "group", file, count(*) AS eligible FROM elig GROUP BY "group", file)
"""

SQL["budget_replay"] = f"WITH RECURSIVE {REPLAY} SELECT * FROM usage"

SQL["holdout_text"] = f"""
WITH RECURSIVE {REPLAY},
rk AS (SELECT e.*, row_number() OVER (PARTITION BY "group", file ORDER BY md5('42:' || line)) AS r FROM elig e)
SELECT "group", file, doc_id, eligible FROM rk JOIN ecnt USING ("group", file) WHERE r <= 10
"""

SQL["split_manifest"] = f"""
WITH RECURSIVE {REPLAY}
SELECT u."group", u.file, u.consumed_docs, u.consumed_bytes, coalesce(e.eligible, 0) AS eligible_unused_docs,
       CAST(least(coalesce(e.eligible, 0), 10) AS BIGINT) AS sampled_docs
FROM usage u LEFT JOIN ecnt e USING ("group", file)
"""

CODE = f"""
srcb AS (SELECT CAST(sum(strlen(text)) + greatest(count(*) - 1, 0) AS BIGINT) AS source_bytes FROM documents),
cons AS (SELECT least(source_bytes + 2, CAST(floor(source_bytes * 0.5) AS BIGINT)) AS consumed FROM srcb),
pd AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS np FROM documents),
ps AS (SELECT *, coalesce(sum(np) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece_start FROM pd),
pcs AS (SELECT piece_start, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS blk,
               unnest(range(1, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) + 1)) AS pos FROM ps),
blocks AS (SELECT piece_start + pos AS block_index, {ustrip('blk')} AS block_text,
                  strlen({ustrip('blk')}) + 2 AS block_bytes FROM pcs WHERE length({ustrip('blk')}) > 0),
skip AS (SELECT *, sum(block_bytes) OVER (ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                   - block_bytes AS skipped_before FROM blocks),
celig AS (SELECT s.* FROM skip s, cons WHERE s.skipped_before >= cons.consumed AND length(s.block_text) >= 30)
"""

SQL["code_budget"] = f"""
WITH {CODE}
SELECT source_bytes, least(source_bytes + 2, CAST(floor(source_bytes * 0.5) AS BIGINT)) AS consumed_bytes,
       least(source_bytes + 2, CAST(floor(source_bytes * 0.5) AS BIGINT)) >= source_bytes AS fully_consumed
FROM srcb
"""

SQL["holdout_code"] = f"""
WITH {CODE}
SELECT CAST(block_index AS BIGINT) AS block_index, md5(block_text) AS block_md5,
       (SELECT count(*) FROM celig) AS eligible
FROM celig ORDER BY md5('42:' || block_index) LIMIT 50
"""

SQL["seeded_sample"] = """
SELECT doc_id, (SELECT count(*) FROM documents) AS eligible FROM documents ORDER BY md5('42:' || doc_id) LIMIT 100
"""

SQL["seeded_shuffle"] = f"""
WITH {PAIRS}
SELECT e AS epoch, pair_id, row_number() OVER (PARTITION BY e ORDER BY md5('42:' || e || ':' || pair_id)) - 1 AS shuffle_pos
FROM pairs, (VALUES (0), (1)) t(e)
"""

SQL["first_n_per_group"] = f"""
SELECT "group", doc_id, idx FROM (
  SELECT "group", doc_id, row_number() OVER (PARTITION BY "group" ORDER BY file, line) - 1 AS idx FROM {DOCS} d) t
WHERE idx < 100
"""

SQL["ordered_union"] = f"""
SELECT "group", doc_id, row_number() OVER (PARTITION BY "group" ORDER BY file, line) - 1 AS pos FROM {DOCS} d
"""


def _is_start(h: str, p: str) -> str:
    """Byte p (1-based) of the hex string h begins a character (or lies past the end)."""
    return f"(({p}) * 2 > length({h}) OR substr({h}, 2 * ({p}) - 1, 1) NOT IN ('8', '9', 'A', 'B'))"


SQL["byte_budget_truncate"] = f"""
WITH d AS (SELECT lang AS "group", source AS file, doc_id, text || chr(10) AS text FROM documents),
b AS (SELECT "group", CAST(floor(sum(strlen(text) + 2) * 0.5) AS BIGINT) AS budget FROM d GROUP BY "group"),
p AS (SELECT *, strlen(text) AS piece_bytes,
             CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY "group", file ORDER BY doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_in_file FROM d),
f AS (SELECT "group", file, CAST(sum(piece_bytes) AS BIGINT) AS file_bytes FROM p GROUP BY "group", file),
fs AS (SELECT *, CAST(coalesce(sum(file_bytes + 2) OVER (PARTITION BY "group" ORDER BY file
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_start FROM f),
w AS (SELECT p.*, fs.file_start + p.start_in_file AS start, b.budget - (fs.file_start + p.start_in_file) AS room,
             hex(encode(p.text)) AS h
      FROM p JOIN fs USING ("group", file) JOIN b USING ("group")
      WHERE fs.file_start <= b.budget AND fs.file_start + p.start_in_file < b.budget),
c AS (SELECT *, CASE WHEN piece_bytes <= room THEN piece_bytes
                     WHEN {_is_start('h', 'room + 1')} THEN room
                     WHEN {_is_start('h', 'room')} THEN room - 1
                     WHEN {_is_start('h', 'room - 1')} THEN room - 2 ELSE room - 3 END AS cut FROM w),
k AS (SELECT *, left(text, CAST(len(list_filter(regexp_extract_all(substr(h, 1, 2 * cut), '..'),
                lambda x: substr(x, 1, 1) NOT IN ('8', '9', 'A', 'B'))) AS BIGINT)) AS kept_text FROM c)
SELECT "group", file, doc_id, CAST(start AS BIGINT) AS start, CAST(strlen(kept_text) AS BIGINT) AS kept_bytes,
       md5(kept_text) AS kept_md5
FROM k
"""


# --- tokenizer evaluation ---------------------------------------------------------
def byte_token(b: str) -> str:
    """Visible character of a byte in the byte-level alphabet."""
    return (f"CASE WHEN {b} BETWEEN 33 AND 126 OR {b} BETWEEN 161 AND 172 OR {b} BETWEEN 174 AND 255 THEN chr({b}) "
            f"WHEN {b} <= 32 THEN chr(256 + {b}) WHEN {b} BETWEEN 127 AND 160 THEN chr(256 + {b} - 94) "
            f"ELSE chr(256 + 67) END")


_HEX_OF_ID = "[" + ", ".join(f"'{b:02X}'" for b in sorted(range(256), key=lambda b: (
    b - 33 if 33 <= b <= 126 else b - 67 if 161 <= b <= 172 else b - 68 if b >= 174 else b + 188 if b <= 32 else b + 94 if b <= 160 else 255))) + "]"


EVAL_DOCS = f"""
ed AS (SELECT d.*, row_number() OVER (PARTITION BY "group" ORDER BY file, line) - 1 AS doc_idx FROM {DOCS} d),
tk AS (SELECT "group", file, line, unnest({byte_ids('text')}) AS token_id,
              unnest(range(strlen(text))) AS pos FROM ed),
tc AS (SELECT "group", token_id, count(*) AS cnt, min({{'f': file, 'l': line, 'p': pos}}) AS first
       FROM tk GROUP BY "group", token_id)
"""

SQL["encode_docs"] = f"""
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5
FROM (SELECT doc_id, CASE WHEN head = '' THEN []::INTEGER[] ELSE [7] END || {byte_ids('text')}
             || CASE WHEN tail = '' THEN []::INTEGER[] ELSE {byte_ids("'x'")} || [11, 11] END AS ids
      FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE '' END AS head,
                   CASE WHEN doc_id % 10 = 0 THEN 'u' ELSE '' END AS tail FROM documents))
"""

#: Ids back to bytes through the inverse table.
SQL["roundtrip_check"] = f"""
SELECT doc_id, array_to_string(list_transform({byte_ids('text')}, lambda i: list_extract({_HEX_OF_ID}, i - 11)), '') = hex(encode(text)) AS roundtrip_ok
FROM documents
"""

SQL["tokenizer_quality"] = f"""
WITH {EVAL_DOCS},
g AS (SELECT "group", count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars,
             CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(ids, lambda i: i = 1))) AS BIGINT) AS unk_count,
             count(CASE WHEN array_to_string(list_transform(ids, lambda i: list_extract({_HEX_OF_ID}, i - 11)), '') = hex(encode(text)) THEN 1 END) AS roundtrip_success
      FROM (SELECT *, {byte_ids('text')} AS ids FROM ed) GROUP BY "group"),
u AS (SELECT "group", count(*) AS used_vocab FROM tc GROUP BY "group")
SELECT g."group", docs, chars, tokens, round(chars / docs, 9) AS avg_chars_per_doc,
       round(tokens / docs, 9) AS avg_tokens_per_doc,
       round(CASE WHEN tokens > 0 THEN chars / tokens ELSE 0 END, 9) AS avg_token_length_in_chars,
       round(CASE WHEN tokens > 0 THEN chars / tokens ELSE 0 END, 9) AS chars_per_token,
       round(CASE WHEN chars > 0 THEN tokens / chars ELSE 0 END, 9) AS tokens_per_char,
       unk_count, round(CASE WHEN tokens > 0 THEN unk_count / tokens ELSE 0 END, 9) AS unk_ratio,
       roundtrip_success, round(roundtrip_success / docs, 9) AS roundtrip_success_ratio, docs - roundtrip_success AS roundtrip_fail,
       round((docs - roundtrip_success) / docs, 9) AS roundtrip_fail_ratio, coalesce(used_vocab, 0) AS used_vocab,
       round(coalesce(used_vocab, 0) / 268.0, 9) AS used_vocab_ratio
FROM g LEFT JOIN u USING ("group")
"""

SQL["top_tokens"] = f"""
WITH {EVAL_DOCS},
r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY cnt DESC, first) AS rank FROM tc),
ranked AS (SELECT r.*, ranks.b FROM r JOIN (SELECT b, ({byte_rank('b')}) + 12 AS id FROM (SELECT CAST(range AS INTEGER) AS b FROM range(256)) t) ranks
           ON ranks.id = r.token_id)
SELECT "group", CAST(rank AS INTEGER) AS rank, token_id, {byte_token('b')} AS token, cnt AS count
FROM ranked WHERE rank <= 20
"""

SQL["roundtrip_failures"] = f"""
SELECT "group", line, left(text, 200) AS input_preview, left(text, 200) AS decoded_preview FROM (
  SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY file, line) AS k FROM {DOCS} d WHERE strlen(text) > 2000) WHERE k <= 3
"""

_MASKED = """(SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN '<NAME>' ELSE '' END AS head, text,
        CASE WHEN doc_id % 10 = 0 THEN 'x<URL><URL>' ELSE '' END AS tail FROM documents)"""

_SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>", "<system>", "<user>", "<assistant>",
             "<NAME>", "<EMAIL>", "<PHONE>", "<ADDRESS>", "<URL>"]

SQL["special_token_counts"] = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_SPECIALS))}) v(token_id, token)),
g AS (SELECT DISTINCT lang AS "group" FROM documents)
SELECT g."group", t.token_id, t.token,
       (SELECT CAST(coalesce(sum(len(regexp_extract_all(d.head || d.text || d.tail, t.token))), 0) AS BIGINT)
        FROM {_MASKED} d WHERE d.lang = g."group") AS count
FROM g, t
"""


# --- streaming ------------------------------------------------------------------
_RUNS = """
log AS (SELECT CAST(user_id AS VARCHAR) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS global_step,
               value AS loss, event_type <> 'error' AS valid FROM events),
o AS (SELECT *, CAST(global_step % 8 = 0 AS BIGINT) AS ub, CAST(global_step % 8 = 0 AND valid AS BIGINT) AS us FROM log),
o2 AS (SELECT *, sum(ub) OVER r AS sb, sum(us) OVER r AS ss FROM o
       WINDOW r AS (PARTITION BY run ORDER BY global_step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def _run_windows(rule: str) -> str:
    return f"WITH {_RUNS} " + _win(rule).replace("\nSELECT '", "\nSELECT run, '", 1).replace("GROUP BY w", "GROUP BY run, w")


SQL["stream_log_windows"] = _run_windows("base")

SQL["stream_ingest_counts"] = """
SELECT lang AS "group", count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang
"""


def _define_sql_more():
    SQL["source_fallback"] = f"""
WITH RECURSIVE {REPLAY},
hold AS (SELECT DISTINCT d."group", d.file FROM {DOCS} d JOIN ecnt e USING ("group", file) WHERE e.eligible > 0),
any_hold AS (SELECT DISTINCT "group" FROM hold)
SELECT "group", file, 'holdout' AS source FROM hold
UNION ALL
SELECT DISTINCT d."group", d.file, 'train_fallback' FROM {DOCS} d WHERE d."group" NOT IN (SELECT "group" FROM any_hold)
"""


def _esc_sql(c: str) -> str:
    """unicode_escape of one byte-alphabet character (printable ASCII, Latin-1
    as \\xNN, U+0100.. as \\uNNNN)."""
    cp = f"unicode({c})"
    return (f"CASE WHEN {cp} = 92 THEN '\\\\' WHEN {cp} BETWEEN 32 AND 126 THEN {c} "
            f"WHEN {cp} < 256 THEN '\\x' || lower(lpad(to_hex({cp}), 2, '0')) "
            f"ELSE '\\u' || lower(lpad(to_hex({cp}), 4, '0')) END")


def _define_sql_more2():
    SQL["token_preview"] = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..')[1:50] AS hx FROM documents),
c AS (SELECT doc_id, list_transform(hx, lambda h: {_esc_sql(byte_token("('0x' || h)::INTEGER"))}) AS pv FROM t)
SELECT doc_id, CAST(len(pv) AS INTEGER) AS n_tokens, md5(array_to_string(pv, ' ')) AS preview_md5 FROM c
"""
    SQL["corpus_sink_stats"] = f"""
WITH {_BUDGETS}
SELECT "group", count(*) AS docs, CAST(sum(block_bytes) AS BIGINT) AS bytes FROM run WHERE cum_bytes <= budget GROUP BY "group"
"""
    SQL["pack_shards"] = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS}, {_BLOCKS}
SELECT CASE WHEN block_idx < 100 THEN 'eval' ELSE 'train' END AS split,
       CAST(CASE WHEN block_idx < 100 THEN -1 ELSE (block_idx - 100) // 128 END AS INTEGER) AS shard,
       count(*) AS n_blocks, CAST(min(block_idx) AS BIGINT) AS first_block, CAST(sum(n_ids) AS BIGINT) AS n_tokens
FROM kept GROUP BY ALL
"""


def _define_sql_more3():
    SQL["pack_overlap"] = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS},
nb AS (SELECT CAST(sum(n_tokens) // 4096 AS BIGINT) AS n_blocks FROM offs),
sp AS (SELECT doc_id, tok_start // 4096 AS first_b,
              least((tok_start + n_tokens - 1) // 4096, nb.n_blocks - 1) AS last_b
       FROM offs JOIN mixed USING (mix_pos), nb WHERE tok_start < nb.n_blocks * 4096)
SELECT doc_id, count(*) AS emissions FROM sp GROUP BY doc_id
HAVING max(CAST(first_b < 100 AS INTEGER)) = 1 AND max(CAST(last_b >= 100 AS INTEGER)) = 1
"""


def _define_sql_more4():
    SQL["pack_split"] = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS}, {_BLOCKS}
SELECT CASE WHEN block_idx < 100 THEN 'eval' ELSE 'train' END AS split, count(*) AS n_blocks,
       CAST(min(block_idx) AS BIGINT) AS first_block, CAST(max(block_idx) AS BIGINT) AS last_block
FROM kept GROUP BY 1
"""


def _define_sql_more5():
    SQL["stream_summary_windows"] = _run_windows("summary")


# The pre-token pattern without look-ahead: a mark goes before the last space
# character of a run that a visible one follows, runs end at the mark, and the
# marks themselves are left out again.
_SP = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PRETOKENS = (
    "pt AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '([" + _SP + "])([" + _SP + "][^" + _SP + r"])', '\1' || chr(1) || '\2', 'g'), "
    + r"'''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\x01" + _SP + r"\p{L}\p{N}]+|[" + _SP + "]+')) AS word FROM documents),\n"
    "pc AS (SELECT word, count(*) AS freq FROM pt GROUP BY word)\n")

SQL["pretoken_counts"] = f"WITH {_PRETOKENS} SELECT word, freq FROM pc"

SQL["bpe_pair_counts"] = f"""
WITH {_PRETOKENS},
s AS (SELECT {byte_ids('word')} AS ids, freq FROM pc),
p AS (SELECT unnest(ids[:len(ids) - 1]) AS "left", unnest(ids[2:]) AS "right", freq FROM s WHERE len(ids) > 1)
SELECT "left", "right", CAST(sum(freq) AS BIGINT) AS count FROM p GROUP BY ALL
"""


# SQL that refers to the shared fixed inputs, defined once the helpers exist
_define_sql()
_define_sql_more()
_define_sql_more2()
_define_sql_more3()
_define_sql_more4()
_define_sql_more5()


# --- files written from the tables and read back -----------------------------------
SQL["raw_text_scan"] = """
SELECT "group", CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(strlen(t)) AS BIGINT) AS bytes
FROM (SELECT lang AS "group", replace(replace(text || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents) GROUP BY "group"
"""

SQL["format_dispatch"] = f"""
SELECT name, count(*) AS docs, CAST(sum(strlen(t)) AS BIGINT) AS bytes
FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'some.jsonl' WHEN 1 THEN 'wiki_dump' ELSE 'plain.txt' END AS name, {ustrip('text')} AS t FROM documents)
WHERE t <> '' GROUP BY name
"""

SQL["log_columns"] = f"""
WITH {LOG}
SELECT count(*) AS steps, CAST(sum(global_step) AS BIGINT) AS step_sum, round(sum(loss), 6) AS train_sum,
       count(CASE WHEN global_step % 7 = 0 THEN loss END) AS evals, round(sum(CASE WHEN global_step % 7 = 0 THEN loss END), 6) AS eval_sum
FROM log
"""

SQL["predictions_sink"] = f"""
WITH {LCS_CTE}
SELECT sc.id, md5(prompt) AS prediction_md5, md5(response) AS reference_md5, r1_f1 AS rouge1_f1, r2_f1 AS rouge2_f1, rl_f1 AS rougel_f1
FROM sc JOIN sl USING (id) JOIN pairs ON pair_id = sc.id
"""

SQL["points_sink"] = f"""
WITH {LOG}
SELECT hex(encode(chr(65279) || 'step')) AS head, count(*) AS points, CAST(sum(global_step) AS BIGINT) AS step_sum, round(sum(loss), 6) AS loss_sum FROM log
"""

SQL["log_append_sink"] = f"""
WITH w AS ({SQL["train_log_windows"]})
SELECT optimizer_step, count(*) AS rows, CAST(sum(global_step) AS BIGINT) AS step_sum
FROM (SELECT optimizer_step, global_step FROM w WHERE rule = 'base' UNION ALL SELECT optimizer_step, global_step FROM w WHERE rule = 'base' AND optimizer_step % 20 = 0)
GROUP BY optimizer_step
"""

SQL["report_sink"] = f"""
WITH q AS ({SQL["tokenizer_quality"]}), t AS ({SQL["top_tokens"]})
SELECT "group", docs, tokens, used_vocab, CAST(count(*) AS INTEGER) AS n_top,
       any_value(token_id) FILTER (WHERE rank = 1) AS top_id, any_value(count) FILTER (WHERE rank = 1) AS top_count
FROM q JOIN t USING ("group") GROUP BY "group", docs, tokens, used_vocab
"""

SQL["pad_eos_batches"] = f"""
WITH {SFT_CTE},
m AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS padded_len
      FROM (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // 8 AS batch_id FROM ex)),
p AS (SELECT pair_id, input_ids || list_transform(range(padded_len - len(input_ids)), lambda i: 3) AS ids FROM m)
SELECT pair_id, md5(array_to_string(ids, ',')) AS input_md5, CAST(len(list_filter(ids, lambda x: x <> 3)) AS INTEGER) AS mask_sum FROM p
"""

SQL["lm_labels"] = f"""
WITH RECURSIVE {MIX_CTE}, {_OFFS}, {_BLOCKS}
SELECT CAST(block_idx AS BIGINT) AS block_idx, ids_md5 AS labels_md5 FROM kept
"""

SQL["holdout_sink"] = f"""
WITH {CODE}, s AS (SELECT block_text FROM celig ORDER BY md5('42:' || block_index) LIMIT 50)
SELECT md5(block_text) AS block_md5, CAST((SELECT sum(strlen(block_text)) + 2 * (count(*) - 1) FROM s) AS BIGINT) AS bytes FROM s
"""
