"""SQL with the results of the registered training-data queries, where SQL can
express them.  The classifiers, and sharding of rows that all have one hash,
have no such form; tests hold them against brute force and held-out labels.
"""

from __future__ import annotations

SPACE = r"[ \t\n\x0b\f\r]+"
TRIM = r"E' \t\n\x0b\f\r'"


def _words(text: str) -> str:
    return f"CASE WHEN coalesce(trim({text}, {TRIM}), '') = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(trim({text}, {TRIM}), '{SPACE}') END"


HASH = "('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 15))::BIGINT"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS b, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(s, (5 * i + 1)::INT, 5))::INT) AS n FROM d)
SELECT page_id, b::BIGINT AS payload_bytes,
       list_aggregate(list_transform(n, lambda x: list_aggregate(list_transform([15, 10, 5, 0],
           lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((x >> k) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper OR (page_id IS NULL AND keeper IS NOT NULL) THEN keeper END AS refers_to
FROM v
"""

_TO = """["'']? *[:=] *["'']?"""
_NAMES = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_SPANS = {
    "assign": (_NAMES + _TO + "([A-Za-z0-9+/_.=-]+)", 2, "length(g) >= 8"),
    "short": (_NAMES + _TO + "([A-Za-z0-9+/_.=-]+)", 2, "length(g) BETWEEN 4 AND 7"),
    "access": ("(AKIA[A-Z0-9]+)", 1, "length(g) >= 16"),
    "hex": ("([0-9a-f]+)", 1, "length(g) >= 32"),
    "identifier": (r"(?i)\b(?:access_key_id|client_id|account(?:_id)?|user(?:name)?|login)" + _TO + "([A-Za-z0-9_.@-]{3,})", 1, "TRUE"),
    "key": ("([A-Za-z0-9+/=_-]+)", 1, "regexp_full_match(g, '[A-Za-z0-9+/]{40}') AND regexp_matches(g, '[a-z]') AND regexp_matches(g, '[A-Z]') AND regexp_matches(g, '[0-9]')"),
    "endpoint": (r"""(\b(?:https?|jdbc:[a-z]+|s3a?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x09-\x0D "''<>]{4,})""", 1, "TRUE"),
}


def _spans(kind: str) -> str:
    pattern, group, keep = _SPANS[kind]
    return f"""SELECT rid, '{'key' if kind == 'short' else kind}' AS kind, s AS start, s + length(m) AS stop FROM (
  SELECT rid, unnest(ms) AS m, unnest(gs) AS g, unnest(list_transform(range(1, len(ms) + 1),
         lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s
  FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs,
               regexp_split_to_array(t, '{pattern}') AS ps FROM d)) WHERE {keep}"""


_LISTED = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, array_position(['assign', 'access', 'hex', 'identifier', 'key', 'endpoint'], kind), stop), '')"
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(_spans(k) for k in ('assign', 'access', 'hex'))}),
weak AS (SELECT * FROM ({' UNION ALL '.join(_spans(k) for k in ('short', 'identifier', 'key', 'endpoint'))}) w
         WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.start < w.stop AND b.stop > w.start)),
parts AS (SELECT p.*, CASE WHEN kind IN ('access', 'identifier') THEN 'identifier' WHEN kind = 'endpoint' THEN kind ELSE 'secret' END AS role,
                 len(regexp_extract_all(substr(t, 1, start::BIGINT), '\\n[ \\t\\r]*\\n')) AS scope
          FROM (SELECT *, FALSE AS w FROM base UNION ALL SELECT *, TRUE FROM weak) p JOIN d USING (rid)),
linked AS (SELECT a.rid, a.kind, a.start, a.stop FROM parts a JOIN parts b
           ON a.rid = b.rid AND a.scope = b.scope AND a.role <> b.role AND greatest(a.start - b.stop, b.start - a.stop) <= 400 WHERE a.w
           GROUP BY a.rid, a.kind, a.start, a.stop, a.role
           HAVING (a.role = 'identifier' AND bool_or(b.role = 'secret')) OR a.role = 'secret' OR count(DISTINCT b.role) = 2),
b AS (SELECT rid, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
             {_LISTED} AS s FROM base GROUP BY rid),
a AS (SELECT rid, {_LISTED} AS s, count_if(kind IN ('identifier', 'key', 'endpoint')) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans, coalesce(a.n, 0)::BIGINT AS n_linked
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, text AS t, {_words('text')} AS w FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) >= 5),
win2 AS (SELECT rid, p, array_to_string(w[p:p + 4], ' ') AS k FROM win),
rep AS (SELECT rid, count(DISTINCT p + o) AS n FROM (
          SELECT rid, p, unnest([0, 1, 2, 3, 4]) AS o FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM win2) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, host, t, x, lower(regexp_replace(trim(x, {TRIM}), '{SPACE}', ' ', 'g')) AS norm
      FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS x FROM d) WHERE trim(x, {TRIM}) <> ''),
hosts AS (SELECT host, count(DISTINCT t) + max((t IS NULL)::INT) AS docs FROM d GROUP BY host),
often AS (SELECT l.host, norm FROM l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host GROUP BY l.host, norm, h.docs
          HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > 0.05 * h.docs),
lines AS (SELECT rid, count(*) - count(DISTINCT x) AS dup, count(o.norm) AS gone_lines,
                 sum(CASE WHEN o.norm IS NOT NULL THEN len(string_split(l.norm, ' ')) END) AS gone
          FROM l LEFT JOIN often o ON l.norm = o.norm AND l.host IS NOT DISTINCT FROM o.host GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
             coalesce(len(regexp_extract_all(t, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone_lines, 0)::BIGINT AS lines_removed, gone,
             (len(w) - coalesce(gone, 0))::BIGINT AS words_left
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             gone IS NOT NULL AND (words_left < 10 OR words_left < 0.3 * n_words) AS depleted FROM m)
SELECT * EXCLUDE (gone), NOT base_failed AND NOT depleted AS kept FROM j
"""

MIX = f"""
WITH d AS (SELECT doc_id, source, len({_words('text')})::BIGINT AS size, {HASH} AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w, 2.0::DOUBLE * source_size AS cap FROM s),
c AS (SELECT *, row_number() OVER by_ratio AS k, sum(cap) OVER by_ratio AS capped, sum(w) OVER by_ratio AS used,
             1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w, cap / w AS ratio
      FROM r WINDOW by_ratio AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT max(each) AS each FROM (
            SELECT budget / all_w AS each FROM c UNION ALL
            SELECT (budget - capped) / (all_w - used) FROM c a WHERE all_w > used
              AND NOT EXISTS (SELECT 1 FROM c b WHERE b.k <= a.k AND b.ratio > (a.budget - a.capped) / (a.all_w - a.used)))),
t AS (SELECT source, source_size, least(cap, each * w) AS target FROM r, level),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS s, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, f.source_size, f.target,
       (d.size * (f.whole + CASE WHEN f.whole < 2 AND (g.before + g.s <= f.target - f.whole * f.source_size
          OR (g.before <= f.target - f.whole * f.source_size AND 2 * (f.target - f.whole * f.source_size - g.before) >= g.s)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""

_FOLDED = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BENCHMARK = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_FOLDED}, []) AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_FOLDED} AS w, least(13, len({_FOLDED})) AS n FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM i WHERE n > 0)),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (
         SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT rid, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM hit)) GROUP BY rid),
o AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN o USING (rid)
"""

SHARDS = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, {HASH} AS h FROM documents),
s AS (SELECT n, h >> (60 - n) AS p, sum(bytes) AS b FROM d, range(0, 61) r(n) WHERE bytes <= 1048576 GROUP BY ALL),
leaf AS (SELECT doc_id, h, bytes, min(n) AS depth, min_by(b, n) AS shard_bytes FROM d JOIN s ON s.p = d.h >> (60 - s.n)
         WHERE bytes <= 1048576 AND b <= 1048576 GROUP BY doc_id, h, bytes)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '*' ELSE substr(lpad(bin(h), 60, '0'), 1, depth::INT) END AS shard, depth::INT AS depth,
       shard_bytes::BIGINT AS shard_bytes, FALSE AS oversized FROM leaf
UNION ALL SELECT doc_id, bytes, 'alone-' || lpad(lower(hex(h)), 15, '0'), 60, bytes, TRUE FROM d WHERE bytes > 1048576
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_words(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[p:p + 4], ' ') || chr(10) || least(len(w), 5) AS k
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM s x JOIN s y ON x.k = y.k AND x.rid <> y.rid GROUP BY ALL)
      JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN c ON c.a = d.rid LEFT JOIN n USING (rid)
"""

_TERMS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS t FROM benchmark),
g AS (SELECT count_if(len(t) > 0)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, n_docs),
q AS (SELECT iid, term, count(*) AS q FROM (SELECT iid, unnest(t) AS term FROM i) GROUP BY ALL),
m AS (SELECT rid, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM d, g WHERE len(t) > 0),
s AS (SELECT iid, rid, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY iid, rid),
r AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN i USING (iid) WHERE rank <= 20
"""

#: crc32 of a number's decimal digits, a bit at a time.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
TRIE = f"""
WITH t AS (SELECT conv_id, role, txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || txt)) AS p
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, p AS d, role, txt FROM c JOIN t ON t.conv_id = c.base WHERE p <= h
      UNION ALL SELECT conv_id, least(h, coalesce(n, 0)) + p - h, role, txt FROM t JOIN c USING (conv_id) LEFT JOIN b USING (base) WHERE p > h),
k AS (SELECT conv_id, d, txt, string_agg(strlen(role) || ':' || role || strlen(txt) || ':' || txt, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
      UNION ALL SELECT conv_id, 0, '', '' FROM c),
v AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(len({_words('txt')})) AS words FROM k GROUP BY d, key),
u AS (SELECT v.*, w.conv_id AS parent_conv_id, w.key AS up FROM v LEFT JOIN k ON k.conv_id = v.conv_id AND k.d = v.d - 1 LEFT JOIN v w ON w.d = k.d AND w.key = k.key),
n AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM u GROUP BY ALL) USING (d, key)),
s AS (SELECT k.d, k.key, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
      FROM n JOIN k ON k.conv_id = n.conv_id AND k.d <= n.d GROUP BY ALL),
e AS (SELECT d, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM k JOIN (SELECT conv_id, max(d) AS d FROM k GROUP BY conv_id) USING (conv_id, d) GROUP BY d, key)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN s USING (d, key) LEFT JOIN e USING (d, key)
"""

SQL: dict[str, str] = {
    "op1_warc_salvage": WARC,
    "op2_credential_links": SECRETS,
    "op3_line_frequency": QUALITY,
    "op4_mix_sources": MIX,
    "op5_wu_manber": BENCHMARK,
    "op6_extendible_shards": SHARDS,
    "op7_jaccard_rtree": JACCARD,
    "op12_prefix_trie": TRIE,
    "op13_lexical_search": LEXICAL,
}
