"""DuckDB SQL for the corpus queries that SQL can express, from the tables alone."""

from __future__ import annotations

#: The contract's word, and the base patterns with letters in either case spelled out.
WORD = r"[^\x20\x09-\x0D]+"
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
DOCS = "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents)"


def crc32(x: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = f"list_transform(range(0, 8 * length({x})), lambda i: CAST((ascii(substring({x}, CAST(i // 8 + 1 AS INTEGER), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT))"
    step = "CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce({bits}, lambda c, b: {step}, 4294967295), 4294967295)"


def base32(digest: str) -> str:
    """RFC 4648 of a 160-bit hexadecimal digest: five digits are four characters."""
    number = f"CAST('0x' || substring({digest}, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT)"
    letter = f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({number} >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)"
    return f"array_to_string(list_transform(range(0, 32), lambda i: {letter}), '')"


def found(kind: str, pattern: str, least: str) -> str:
    """Spans of a pattern's matches: starts from the lengths of what lies before."""
    return f"""
{kind}0 AS (SELECT rid, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d WHERE regexp_matches(text, '{pattern}')),
{kind}1 AS (SELECT rid, unnest(m) AS x, unnest(list_transform(range(1, len(m) + 1), lambda i:
    length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')))) AS s FROM {kind}0),
{kind} AS (SELECT rid, s AS a, s + length(x) AS b FROM {kind}1 WHERE {least})"""


SECRET_BASE = f"""WITH {DOCS}, {found("assign", ASSIGN, f"length(regexp_extract(x, '{ASSIGN}', 2)) >= 8")}, {found("access", "AKIA[A-Z0-9]+", "length(x) >= 16")},
{found("hex", "[0-9a-f]{32,}", "true")},
s AS (SELECT rid, a, b, 0 AS k, 'assign' AS n FROM assign UNION ALL SELECT rid, a, b, 1, 'access' FROM access UNION ALL SELECT rid, a, b, 2, 'hex' FROM hex),
j AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
        string_agg(n || ':' || a || ':' || b, ',' ORDER BY a, k) AS t FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(t, '')) AS base_sha256
FROM d LEFT JOIN j USING (rid)"""

SUFFIX = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT rid, i, hash(x[i + 1:i + 200]) AS h FROM (SELECT rid, x, unnest(range(0, octet_length(x) - 199)) AS i FROM d WHERE octet_length(x) >= 200)),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT rid, i, i > 200 + max(i) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM w SEMI JOIN t USING (h)),
g AS (SELECT rid, i, sum(CAST(coalesce(far, true) AS INT)) OVER (PARTITION BY rid ORDER BY i) AS run FROM r),
s AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY rid, run),
k AS (SELECT rid, b AS a, lead(a) OVER (PARTITION BY rid ORDER BY a) AS b FROM (SELECT rid, a, b FROM s UNION ALL SELECT rid, -1, 0 FROM d)),
p AS (SELECT k.rid, k.a, d.x[k.a + 1:coalesce(k.b, octet_length(d.x))] AS x FROM k JOIN d USING (rid)),
j AS (SELECT rid, list_reduce(list(x ORDER BY a), lambda u, v: u || v) AS kept FROM p GROUP BY rid),
c AS (SELECT rid, sum(b - a) AS n, count(*) AS m FROM s GROUP BY rid)
SELECT doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans, sha256(kept) AS kept_sha256
FROM d JOIN j USING (rid) LEFT JOIN c USING (rid)"""

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {base32("sha1(html)")} AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM p"""

SALVAGE = f"SELECT page_id, payload_bytes, record_type FROM ({WARC}) WHERE NOT coalesce(page_id % 7 = 3 OR page_id % 11 = 5 OR page_id % 13 = 2, false)"

LM_BASE = f"""WITH {DOCS},
o AS (SELECT rid, doc_id, {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 1 AS held_out,
        list_append(list_transform(regexp_extract_all(text, '{WORD}'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS w FROM d),
k AS (SELECT rid, held_out, unnest(w) AS t FROM o),
c AS (SELECT t, count(*) AS c FROM k WHERE NOT held_out GROUP BY t),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS s FROM k CROSS JOIN n LEFT JOIN c USING (t) GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, CAST(round(s * 1000) AS BIGINT) AS base_milli FROM o JOIN s USING (rid) CROSS JOIN n"""

MIX_TARGETS = f"""WITH {DOCS},
z AS (SELECT doc_id, source, len(regexp_extract_all(text, '{WORD}')) AS size FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM z GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS cap, CASE WHEN source_size > 0 THEN [3.0, 1.0, 2.0][CAST((k - 1) % 3 + 1 AS INTEGER)] ELSE 0.0 END AS w FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY cap / w, k) AS n FROM c WHERE w > 0),
l AS (SELECT n, cap / w AS ratio, (1.5 * (SELECT sum(size) FROM z) - (sum(cap) OVER (ORDER BY n) - cap)) / (sum(w) OVER () - (sum(w) OVER (ORDER BY n) - w)) AS level FROM f),
t AS (SELECT level FROM l WHERE level <= ratio ORDER BY n LIMIT 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(coalesce(least(w * CAST((SELECT level FROM t) AS DOUBLE), cap), cap) AS DOUBLE) AS target
FROM z JOIN c ON z.source IS NOT DISTINCT FROM c.source"""

RULES = (
    "n_words < 50",
    "100 * n_repeat_words > 50 * n_words",
    "100 * n_symbols > 30 * n_words",
    "n_upper + n_lower > 0 AND 100 * n_upper > 60 * (n_upper + n_lower)",
    "word_chars < 2 * n_words OR word_chars > 25 * n_words",
    "n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines",
    "100 * n_same_next > 25 * n_words",
    "n_words >= 50 AND 100 * n_distinct_words < 5 * n_words",
)
LEDGER = f"""WITH {DOCS},
a AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
x AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM a),
r AS (SELECT rid, i FROM x QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
c AS (SELECT rid, count(DISTINCT i + j) AS n FROM r CROSS JOIN (VALUES (0), (1), (2)) AS v(j) GROUP BY rid),
m AS (SELECT a.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
        len(list_distinct(w)) AS n_distinct_words, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_same_next FROM a LEFT JOIN c USING (rid)),
f AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES))} AS failures FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failures & 3 <> 0 AS base_failed, failures & 127 = 0 AS kept, CAST(failures AS BIGINT) AS failures FROM f"""

ABLATIONS = f"""WITH l AS ({LEDGER}),
r AS (SELECT unnest(['few_words', 'repeated_words', 'symbols', 'shouting', 'word_length', 'repeated_lines', 'same_next_word']) AS rule, unnest(range(0, 7)) AS i)
SELECT rule, count(*) FILTER (WHERE failures & (1 << CAST(i AS INTEGER)) <> 0) AS n_failed, count(*) FILTER (WHERE failures & 127 = 1 << CAST(i AS INTEGER)) AS n_only_this
FROM r CROSS JOIN l GROUP BY rule"""

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(list_transform(regexp_extract_all(text, '{TERM}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
w AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM w JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""


def vector_rounds(rounds: int, parts: int = 16, size: int = 64) -> str:
    """Assignment a0..a{rounds} and codebooks b0..b{rounds}, one after the other."""
    near = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    mean = "(s - ((s % n) + n) % n) // n"
    out = f"""WITH e AS (SELECT row_number() OVER () AS rid, * FROM embeddings),
v AS (SELECT rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM e
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
o AS (SELECT rid, row_number() OVER (ORDER BY vec_id, x) - 1 AS entry FROM v),
b0 AS (SELECT part, entry, x FROM p JOIN o USING (rid) WHERE entry < {size})"""
    for i in range(rounds + 1):
        out += f""",
d{i} AS MATERIALIZED (SELECT p.rid, p.part, b.entry, {near} AS d FROM p JOIN b{i} b USING (part)),
a{i} AS MATERIALIZED (SELECT rid, part, min(d) AS d, arg_min(entry, d * {size} + entry) AS entry FROM d{i} GROUP BY rid, part)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT part, entry, j, sum(y) AS s, count(*) AS n FROM (SELECT part, a.entry, unnest(p.x) AS y, unnest(range(len(p.x))) AS j FROM p JOIN a{i} a USING (rid, part)) GROUP BY part, entry, j),
m{i} AS (SELECT part, entry, list({mean} ORDER BY j) AS x FROM s{i} GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry))"""
    return out


VECTOR_CODES = f"""{vector_rounds(2)},
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j)) AS h FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS j FROM b2)),
r AS (SELECT rid, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256, label FROM v JOIN r USING (rid) CROSS JOIN h"""

SPANS = f"""WITH {DOCS},
k AS (SELECT rid, doc_id, regexp_extract_all(text, '{WORD}') AS w FROM d),
x AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS t FROM k),
f AS (SELECT t, min(doc_id) AS first FROM x GROUP BY t HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (t) WHERE doc_id > first),
y AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM k),
j AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM y ANTI JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN j USING (rid)"""
