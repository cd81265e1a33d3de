"""DuckDB SQL that computes the registered queries from the same tables, without our code."""

from __future__ import annotations

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
LF = "chr(10)"
TOKENS = "CAST(floor(length(regexp_replace({0}, '[^一-鿿]', '', 'g')) * 1.5 + (length({0}) - length(regexp_replace({0}, '[^一-鿿]', '', 'g'))) / 4.0) AS INTEGER)"
BLANK = r"regexp_full_match({0}, '\s*')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SEPARATOR = (
    r"(len(string_split(trim({0}, ' |'), '|')) >= 2 AND len(list_filter(string_split(trim({0}, ' |'), '|'), "
    r"lambda p: trim(p) <> '' AND NOT regexp_full_match(trim(p), ':?-{{2,}}:?'))) = 0)"
)
DOCS = "docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"


def tokens(x: str) -> str:
    return TOKENS.format(x)


def conversations(head: str = "", text: str = "text", extra: str = "''") -> str:
    head = head or "CASE WHEN role = 'assistant' THEN '### Reply ' || turn ELSE '## Turn ' || turn || ' ' || role END"
    return f"""
m AS (SELECT conv_id AS doc_id, '# Conversation ' || conv_id || {LF} || {LF} ||
        string_agg({head} || {LF} || {LF} || {text} || {extra}, {LF} || {LF} ORDER BY turn, role, text) AS text
      FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id)"""


TITLES = (
    "'# ' || CASE turn % 5 WHEN 0 THEN '(' || turn || ') item' WHEN 1 THEN 'Note' || turn WHEN 2 THEN 'Example a' "
    "WHEN 3 THEN '例子1：' || turn ELSE 'Topic ' || turn END"
)

REGIONS = f"""
nt AS (SELECT n_regionkey, n_nationkey, n_name, '## ' || n_name || {LF} || {LF} || 'Customers of ' || n_name || {LF} || {LF} ||
         '| c_custkey | c_name | c_mktsegment |' || {LF} || '| --- | --- | --- |' || {LF} ||
         string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |', {LF} ORDER BY c_custkey) || {LF} AS part
       FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey, n_name),
m AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, '# Region ' || n_regionkey || {LF} || {LF} || '| key | nation |' || {LF} || '| --- | --- |' || {LF} ||
        string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', {LF} ORDER BY n_nationkey) || {LF} || {LF} ||
        string_agg(part, {LF} ORDER BY n_nationkey) AS text
      FROM nt GROUP BY n_regionkey)"""

LINES = f"""
ln AS (SELECT doc_id, unnest(string_split(text, {LF})) AS line, generate_subscripts(string_split(text, {LF}), 1) - 1 AS pos FROM m)"""

SECTIONS = rf"""{LINES},
fl AS (SELECT *, regexp_matches(line, '^\s*```') AS fence FROM ln),
hl AS (SELECT *, NOT fence AND regexp_matches(line, '{HEADING}') AND
         sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 0 AS h FROM fl),
sl AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM hl),
s0 AS (SELECT doc_id, CAST(sec AS INTEGER) AS sec,
         CAST(coalesce(max(CASE WHEN h THEN length(regexp_extract(line, '{HEADING}', 1)) END), 0) AS INTEGER) AS level,
         coalesce(max(CASE WHEN h THEN regexp_extract(line, '{HEADING}', 2) END), '') AS heading,
         trim(coalesce(string_agg(CASE WHEN NOT h THEN line END, {LF} ORDER BY pos), ''), {LF}) AS body
       FROM sl GROUP BY doc_id, sec),
s AS (SELECT * FROM s0 WHERE level > 0 OR body <> '')"""

_OPEN = ", ".join(
    f"last_value(CASE WHEN level BETWEEN 1 AND {k} THEN {{'level': level, 'heading': heading}} END IGNORE NULLS) "
    f"OVER (PARTITION BY doc_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS o{k}"
    for k in range(1, 7)
)
_CRUMB = ", ".join(f"CASE WHEN o{k}.level = {k} AND level >= {k} THEN o{k}.heading END" for k in range(1, 7))
WALKED = f"""{SECTIONS},
op AS (SELECT *, {_OPEN} FROM s),
b AS (SELECT doc_id, sec, level, heading, body, list_filter([{_CRUMB}], lambda x: x IS NOT NULL) AS breadcrumb FROM op),
lc AS (SELECT doc_id, level, count(*) AS n FROM s WHERE level > 0 GROUP BY ALL),
pl AS (SELECT d.doc_id, CAST(coalesce(min(CASE WHEN n >= 2 THEN level END), min(level), 2) AS INTEGER) AS primary_level
       FROM (SELECT DISTINCT doc_id FROM s) d LEFT JOIN lc USING (doc_id) GROUP BY d.doc_id),
ti AS (SELECT doc_id, arg_min(heading, sec) AS title FROM s WHERE level = 1 AND heading <> '' GROUP BY doc_id)"""

MERGED = rf"""{WALKED},
w AS (SELECT b.*, primary_level, title, sum(CAST(level = primary_level AS INT)) OVER (PARTITION BY doc_id ORDER BY sec) AS g
      FROM b JOIN pl USING (doc_id) LEFT JOIN ti USING (doc_id)),
gr AS (SELECT doc_id, g, count(*) AS n, min(sec) AS first_sec, {STRIP.format(rf'''
         coalesce(string_agg(CASE WHEN level = primary_level AND sec = first THEN CASE WHEN {BLANK.format("body")} THEN NULL ELSE body END
           ELSE regexp_replace(repeat('#', level) || ' ' || heading || {LF} || body, '[ \n\t\r]+$', '') END, {LF} || {LF} ORDER BY sec), '')''')} AS merged
       FROM (SELECT *, min(sec) OVER (PARTITION BY doc_id, g) AS first FROM w WHERE g > 0) GROUP BY doc_id, g),
mg AS (SELECT w.doc_id, sec, level, heading, CASE WHEN length(merged) <= 1800 OR n = 1 THEN merged ELSE body END AS body, breadcrumb, title
       FROM w JOIN gr USING (doc_id, g)
       WHERE sec = first_sec AND (length(merged) <= 1800 OR n = 1 OR NOT {BLANK.format("body")}) OR sec > first_sec AND NOT (length(merged) <= 1800 OR n = 1)
       UNION ALL
       SELECT doc_id, sec, level, heading, body, breadcrumb, title FROM w WHERE g = 0 AND NOT (level = 0 AND {BLANK.format("body")})),
ts AS (SELECT doc_id, sec, level, heading, body, title,
         CASE WHEN title IS NOT NULL AND coalesce(breadcrumb[1], '') <> title THEN list_concat([title], breadcrumb) ELSE breadcrumb END AS breadcrumb
       FROM mg WHERE NOT {BLANK.format("body")})"""

_SUM_CANDIDATES = f"list_filter(range(greatest(over - 8, 0) + 1, over), lambda j: {BLANK.format('lines[j + 1]')} OR ltrim(lines[j + 1])[1] = '#')"
SUMMARY = rf"""
su0 AS (SELECT *, string_split(body, {LF}) AS lines, len(string_split(substring(body, 1, 300), {LF})) AS over FROM ts),
su1 AS (SELECT *, list_max({_SUM_CANDIDATES}) AS j FROM su0),
su AS (SELECT * EXCLUDE (lines, over, j), CASE WHEN length(body) <= 300 THEN body ELSE
         {STRIP.format(f"substring(body, 1, CASE WHEN over < len(lines) AND j IS NOT NULL THEN length(array_to_string(lines[1:j], {LF})) + 1 ELSE 300 END)")}
         END AS summary FROM su1)"""

CONV = conversations()
CHUNKED = f"""{CONV}, {MERGED}, {SUMMARY},
ch0 AS (SELECT doc_id, sec, level, heading, array_to_string(breadcrumb, ' > ') AS breadcrumb, length(body) > 1800 AS is_long,
          CASE WHEN length(body) > 1800 THEN summary ELSE body END AS content FROM su),
ch AS (SELECT *, '# ' || breadcrumb || {LF} || {LF} || content AS context FROM ch0)"""

BLOCKS = f"""{REGIONS}, {LINES.replace("ln AS", "l0 AS")},
l1 AS (SELECT *, contains(line, '|') AND trim(line) <> '' AS pipe,
         lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l0),
l2 AS (SELECT *, pipe AND coalesce({SEPARATOR.format("nxt")}, false) AS starts,
         sum(CAST(NOT pipe AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l1),
l3 AS (SELECT *, min(CASE WHEN starts THEN pos END) OVER (PARTITION BY doc_id, run) AS first FROM l2),
l4 AS (SELECT *, pipe AND coalesce(pos >= first, false) AS tbl FROM l3),
l5 AS (SELECT *, CASE WHEN tbl THEN run ELSE -1 END AS k FROM l4),
l6 AS (SELECT *, CASE WHEN coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY pos), -2) <> k THEN 1 ELSE 0 END AS new FROM l5),
l7 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS bk FROM l6),
l8 AS (SELECT doc_id, bk, tbl, string_agg(line, {LF} ORDER BY pos) AS raw FROM l7 GROUP BY ALL),
l9 AS (SELECT doc_id, bk, CASE WHEN tbl THEN 'table' ELSE 'prose' END AS kind, CASE WHEN tbl THEN raw ELSE trim(raw, {LF}) END AS text FROM l8),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bk) AS INTEGER) AS blk, kind, text FROM l9 WHERE text <> '')"""

PACKED = f"""{BLOCKS},
tr AS (SELECT doc_id, blk, text, list_filter(string_split(text, {LF}), lambda x: trim(x) <> '') AS rows FROM blocks WHERE kind = 'table'),
pk AS (SELECT *, list_reduce(rows[3:], lambda a, x: CASE WHEN a.n + length(x) + 1 > 1800 AND len(a.cur) > 0
           THEN {{'out': list_append(a.out, a.cur), 'cur': [x], 'n': a.h + length(x) + 1, 'h': a.h}}
           ELSE {{'out': a.out, 'cur': list_append(a.cur, x), 'n': a.n + length(x) + 1, 'h': a.h}} END,
         {{'out': CAST([] AS VARCHAR[][]), 'cur': CAST([] AS VARCHAR[]), 'n': length(rows[1]) + length(rows[2]) + 2, 'h': length(rows[1]) + length(rows[2]) + 2}}) AS a FROM tr),
gs AS (SELECT doc_id, blk, rows, CASE WHEN length(text) <= 1800 THEN [rows[3:]] ELSE list_append(a.out, a.cur) END AS groups FROM pk),
parts AS (SELECT doc_id, blk, rows, CAST(len(groups) AS INTEGER) AS parts, unnest(groups) AS g, CAST(generate_subscripts(groups, 1) AS INTEGER) AS part FROM gs)"""

GRAM_CTE = f"""{DOCS},
pg AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_no, substring(text, i * 1000 + 1, 1000) AS text
       FROM (SELECT doc_id, text, unnest(range((greatest(length(text), 1) - 1) // 1000 + 1)) AS i FROM docs)),
ck AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS chunk, substring(text, i * 620 + 1, 700) AS content, source AS section_title
       FROM (SELECT doc_id, source, text, unnest(range((greatest(length(text), 1) - 1) // 620 + 1)) AS i FROM docs)
       UNION ALL SELECT doc_id + 1, 0, substring(text, 1, 700), source FROM docs)"""


def normal(x: str) -> str:
    return STRIP.format(rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '\s*([，。！？；：、])\s*', '\1', 'g')")


def bare(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', '', 'g')"


def grams(column: str) -> str:
    """The different five-character substrings of a column without blanks, as hashes; the column must not be an expression."""
    return f"CASE WHEN length({column}) < 5 THEN [hash({column})] ELSE list_distinct(list_transform(range(1, length({column}) - 3), lambda i: hash(substring({column}, i, 5)))) END"


_PROSE = "list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x[1] <> '|' AND x[1] <> '#' AND x[1:2] <> '- ')"
MATCHED = f"""{GRAM_CTE},
pt AS (SELECT doc_id, page_no, {normal("text")} AS text FROM pg WHERE NOT {BLANK.format("text")}),
pb AS MATERIALIZED (SELECT doc_id, page_no, {bare("text")} AS b FROM pt),
gp AS MATERIALIZED (SELECT doc_id, page_no, unnest({grams("b")}) AS gram FROM pb),
a0 AS (SELECT doc_id, chunk, content, section_title, {_PROSE} AS p FROM ck),
a1 AS (SELECT doc_id, chunk, [CASE WHEN len(p) > 0 THEN {normal("array_to_string(p[1:3], ' ')")} END,
         CASE WHEN len(p) > 6 THEN {normal("array_to_string(p[len(p) // 2 + 1:len(p) // 2 + 3], ' ')")} END,
         CASE WHEN section_title <> '' THEN {normal("section_title || ' ' || content")} END] AS l FROM a0),
a2 AS (SELECT doc_id, chunk, unnest(l) AS text, generate_subscripts(l, 1) AS anchor FROM a1),
ab AS MATERIALIZED (SELECT doc_id, chunk, anchor, {bare("text")} AS b FROM a2 WHERE text IS NOT NULL AND length(text) >= 20),
a3 AS (SELECT doc_id, chunk, anchor, {grams("b")} AS gs FROM ab),
a4 AS (SELECT doc_id, chunk, anchor, len(gs) AS n, unnest(gs) AS gram FROM a3 WHERE len(gs) >= 4),
sc AS (SELECT a4.doc_id, chunk, anchor, page_no, count(*) AS hits, max(n) AS n FROM a4 JOIN gp ON a4.doc_id = gp.doc_id AND a4.gram = gp.gram GROUP BY ALL),
mt AS MATERIALIZED (SELECT doc_id, chunk, page_no AS page_start FROM sc WHERE hits * 4 >= n
       QUALIFY row_number() OVER (PARTITION BY doc_id, chunk ORDER BY anchor, hits DESC, page_no) = 1)"""

RANGED = f"""{MATCHED},
tp AS (SELECT doc_id, count(*) AS total FROM pt GROUP BY doc_id),
tl AS (SELECT mt.doc_id, mt.chunk, page_start, total, right({normal("content")}, 150) AS tail FROM mt JOIN ck USING (doc_id, chunk) JOIN tp USING (doc_id)),
tb AS MATERIALIZED (SELECT doc_id, chunk, page_start, total, {bare("tail")} AS b FROM tl WHERE length(tail) >= 40),
t1 AS (SELECT doc_id, chunk, page_start, total, {grams("b")} AS gs FROM tb),
t2 AS (SELECT doc_id, chunk, page_start, len(gs) AS n, gs, unnest(range(1, least(4, total - page_start + 1))) AS step FROM t1 WHERE len(gs) >= 5),
t3 AS (SELECT doc_id, chunk, step, n, page_start + step AS page_no, unnest(gs) AS gram FROM t2),
t4 AS (SELECT t3.doc_id, chunk, step, max(n) AS n, count(gp.gram) AS hits FROM t3 LEFT JOIN gp ON t3.doc_id = gp.doc_id AND t3.page_no = gp.page_no AND t3.gram = gp.gram GROUP BY ALL),
t5 AS (SELECT doc_id, chunk, step, min(CAST(hits * 5 >= n AS INT)) OVER (PARTITION BY doc_id, chunk ORDER BY step) AS ok FROM t4),
t6 AS (SELECT doc_id, chunk, max(CASE WHEN ok = 1 THEN step END) AS steps FROM t5 GROUP BY ALL),
rg AS (SELECT mt.doc_id, mt.chunk, page_start, CAST(page_start + coalesce(steps, 0) AS INTEGER) AS page_end FROM mt LEFT JOIN t6 ON mt.doc_id = t6.doc_id AND mt.chunk = t6.chunk)"""

NOISY = f"""m AS (SELECT doc_id, CASE doc_id % 12
    WHEN 0 THEN 'a $ 1 2 . 5 $ b $ 3 \\% $ ' WHEN 1 THEN '$^ 4 5 \\%$ ' WHEN 2 THEN '$ . 5 0 \\%$ ' WHEN 3 THEN 'x$\\ddagger$ y $^ +$ '
    WHEN 4 THEN '![i](u)' || {LF} || {LF} || 'next ' WHEN 5 THEN 'one<br>two<BR/>three '
    WHEN 6 THEN 'AB' || {LF} || {LF} || 'AB' || {LF} || {LF} || 'C' || {LF} || ' ' || {LF} || 'text' || {LF} || '. dot' || {LF}
    WHEN 7 THEN 'a' || chr(13) || {LF} || 'b' || chr(13) || 'c $5 $10 ' WHEN 8 THEN '\\textcircled {{ \\textbf {{ 7 }} }} \\% '
    WHEN 9 THEN '$ \\left ( {{ \\mathfrak {{ b }} }} \\right ) $ ' WHEN 10 THEN '25 $^ \\circ$ ' ELSE '$ 12.5 % $ ' END || coalesce(text, '') ||
    '  ' || {LF} || {LF} || {LF} || {LF} || '· item  ' || {LF} || {LF} || 'OK' || {LF} || {LF} || 'end' || chr(9) || {LF} AS text FROM documents)"""


def chain(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        to = "chr(10)" if to == "\n" else "chr(10) || chr(10)" if to == "\n\n" else f"'{to}'"
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


CLEAN = [
    (r"!\[[^\]]*\]\([^)]+\)\s*", ""),
    (r"(?m)^#\s*$", ""),
    (r"(?i)<br\s*/?>", ""),
    (r"(?m)^[ \t]*[·•]\s*", "- "),
    (r"(?m)^[ \t]*\.\s+(\S)", r"- \1"),
    (r"\n\s*[A-Z]{1,3}\s*\n", "\n"),
    (r"\r\n?", "\n"),
    (r"[ \t\f\v\r]+(\n|\z)", r"\1"),
    (r"\n{3,}", "\n\n"),
    (r"\A\s+|\s+\z", ""),
]
LATEX = [
    (r"\\textcircled\s*\{\s*\\textbf\s*\{\s*(\d+)\s*\}\s*\}\s*\\%", r"\1%"),
    (r"\$\s*\\left\s*\(\s*\{\s*\\mathfrak\s*\{\s*(\w+)\s*\}\s*\}\s*\\right\s*\)\s*\$", r"(\1)"),
    (r"\$\s*\\ddagger\s*\$", "‡"),
    (r"\$\s*\^\s*\+\s*\$", "⁺"),
    (r"\$\s*\^\s*\\circ\s*\$", ""),
    (r"\$\s*(\d+(?:\.\d+)?)\s*%\s*\$", r"\1%"),
    (r"\$\s*\^\s*([\d\s]+?)\s*\\%\s*\$", r"\1%"),
    (r"\$\s*\.\s*(\d[\d\s]*?)\s*\\?\s*%\s*\$", r"0.\1%"),
]
NUMBER = r"\$\s*[\d\s.,]{1,20}\s*(?:\\%)?\s*\$"
NUMBER_PARTS = r"\$\s*([\d\s.,]{1,20})\s*(\\%)?\s*\$"

SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ", " ")


def recursive(source: str, most: int = 1800, overlap: int = 80) -> str:
    """parts(doc_id, parts): texts of ``source`` (doc_id, text) cut separator by separator, then joined from the finest level up.

    Every level appends a number to a piece's path; on the way back pieces with one parent are joined.
    """
    quoted = lambda x: " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in x)
    out = f"f0 AS (SELECT doc_id, CAST([] AS INTEGER[]) AS path, text FROM {source})"
    for d, sep in enumerate(SEPARATORS):
        out += f""",
g{d} AS MATERIALIZED (SELECT *, length(text) > {most} AND contains(text, {quoted(sep)}) AS cut FROM f{d}),
k{d} AS (SELECT doc_id, path, unnest(string_split(text, {quoted(sep)})) AS x, generate_subscripts(string_split(text, {quoted(sep)}), 1) AS i, len(string_split(text, {quoted(sep)})) AS n FROM g{d} WHERE cut),
f{d + 1} AS (SELECT doc_id, list_append(path, CAST(i AS INTEGER)) AS path, CASE WHEN i < n THEN x || {quoted(sep)} ELSE x END AS text FROM k{d} WHERE x <> ''
  UNION ALL SELECT doc_id, list_append(path, 0), text FROM g{d} WHERE NOT cut)"""
    last = len(SEPARATORS)
    out += f""",
o{last} AS (SELECT doc_id, path, CASE WHEN length(text) > {most} THEN list_transform(range((length(text) - 1) // {most - overlap} + 1), lambda i: substring(text, i * {most - overlap} + 1, {most})) ELSE [text] END AS parts FROM f{last})"""
    for d in reversed(range(last)):
        out += f""",
q{d} AS (SELECT doc_id, path[1:{d}] AS path, flatten(list(parts ORDER BY path)) AS parts FROM o{d + 1} GROUP BY doc_id, path[1:{d}]),
r{d} AS (SELECT doc_id, path, cut, parts, CASE WHEN cut THEN list_reduce(parts, lambda a, p: CASE WHEN a.cur = '' OR length(a.cur) + length(p) <= {most} THEN {{'out': a.out, 'cur': a.cur || p}}
  ELSE {{'out': list_append(a.out, a.cur), 'cur': CASE WHEN length(a.cur) > {overlap} THEN right(a.cur, {overlap}) ELSE '' END || p}} END, {{'out': CAST([] AS VARCHAR[]), 'cur': ''}}) END AS a
  FROM q{d} JOIN g{d} USING (doc_id, path)),
o{d} AS MATERIALIZED (SELECT doc_id, path, CASE WHEN NOT cut THEN parts WHEN a.cur <> '' THEN list_append(a.out, a.cur) ELSE a.out END AS parts FROM r{d})"""
    return out + ",\nprose_parts AS (SELECT doc_id, parts FROM o0)"

#: Conversations and regions as one set of documents, as ``registry._all_docs`` has them.
ALL_DOCS = f"""{CONV.replace("m AS", "mc AS")}, {REGIONS.replace("m AS (SELECT CAST", "mr AS (SELECT CAST")},
m AS (SELECT doc_id, 'conv_' || doc_id AS id_prefix, text FROM mc UNION ALL SELECT -1 - doc_id, 'region_' || doc_id, text FROM mr)"""

CLEAN_FIRST = [(r"!\[[^\]]*\]\([^)]+\)\s*", ""), (r"(?m)^#\s*$", "")]
CLEAN_LAST = [
    (r"(?i)<br\s*/?>", ""),
    (r"(?m)^[ \t]*[·•]\s*", "- "),
    (r"(?m)^[ \t]*\.\s+(\S)", r"- \1"),
    (r"\n\s*[A-Z]{1,3}\s*\n", "\n"),
    (r"[ \t\f\v\r]+(\n|\z)", r"\1"),
    (r"\n{3,}", "\n\n"),
    (r"\A\s+|\s+\z", ""),
    (r"\r\n?", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"[ \t\f\v\r]+(\n|\z)", r"\1"),
    (r"\A\s+|\s+\z", ""),
]


def cleaned(source: str, out: str, keep: str = "doc_id") -> str:
    """The cleaning of texts without HTML tables, folded blocks, compared numbers and pipe tables that repeat."""
    return f"""{out}0 AS (SELECT {keep}, {chain(chain("text", CLEAN_FIRST), LATEX)} AS text FROM {source}),
{out}1 AS (SELECT {keep}, text, regexp_extract_all(text, '{NUMBER}') AS found, regexp_split_to_array(text, '{NUMBER}') AS gaps FROM {out}0),
{out}2 AS (SELECT *, list_transform(found, lambda x: CASE
    WHEN regexp_replace(regexp_extract(x, '{NUMBER_PARTS}', 1), '\\s+', '', 'g') = '' AND regexp_extract(x, '{NUMBER_PARTS}', 2) = '' THEN x
    ELSE regexp_replace(regexp_extract(x, '{NUMBER_PARTS}', 1), '\\s+', '', 'g') || CASE WHEN regexp_extract(x, '{NUMBER_PARTS}', 2) <> '' THEN '%' ELSE '' END END) AS made FROM {out}1),
{out}3 AS (SELECT {keep}, CASE WHEN len(found) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(made[i], '')), '') END AS text FROM {out}2),
{out} AS (SELECT {keep}, {chain("text", CLEAN_LAST)} || {LF} AS text FROM {out}3)"""


_TABLE_LINES = f"len(list_filter(range(1, len(lines)), lambda i: contains(lines[i], '|') AND coalesce({SEPARATOR.format('lines[i + 1]')}, false))) > 0"
_BLOCK = BLOCKS.removeprefix(REGIONS + ", ").removeprefix(LINES.replace("ln AS", "l0 AS")).lstrip(",\n")


def chunked(docs: str) -> str:
    """rows(...): all chunks of m (doc_id, id_prefix, text), which the CTEs ``docs`` define, with the fields of the review rows."""
    blocks = _BLOCK.replace("PARTITION BY doc_id", "PARTITION BY doc_id, sec").replace("SELECT doc_id", "SELECT doc_id, sec")
    packed = PACKED.removeprefix(BLOCKS).lstrip(",\n").replace("doc_id, blk", "doc_id, sec, blk")
    summary = SUMMARY.replace("su0 AS (SELECT *,", f"su0 AS (SELECT *, {_TABLE_LINES.replace('lines', f'string_split(body, {LF})')} AS has_table,")
    summary = summary.replace("ELSE\n         regexp", f"ELSE CASE WHEN has_table THEN '本章节包含表格数据: ' || heading || {LF} || {LF} ELSE '' END ||\n         regexp")
    none, text = "CAST(NULL AS INTEGER)", "CAST(NULL AS VARCHAR)"
    return f"""{docs}, {MERGED}, {summary},
sec_chunks AS MATERIALIZED (SELECT doc_id, sec, level, heading, body, breadcrumb, has_table, length(body) > 1800 AS is_long, CASE WHEN length(body) > 1800 THEN summary ELSE body END AS content FROM su),
l0 AS (SELECT doc_id, sec, unnest(string_split(body, {LF})) AS line, generate_subscripts(string_split(body, {LF}), 1) - 1 AS pos FROM sec_chunks WHERE is_long),
{blocks}, {packed},
table_texts AS (SELECT doc_id, sec, blk, part, parts, rows, rows[1] || {LF} || rows[2] || {LF} AS head, g, rows[1] || {LF} || rows[2] || {LF} || array_to_string(g, {LF}) AS content FROM parts),
tw AS (SELECT doc_id, sec, blk, part, head || unnest(g) AS content, CAST(generate_subscripts(g, 1) AS INTEGER) AS row FROM table_texts WHERE parts > 1),
prose_texts AS (SELECT {{'d': doc_id, 's': sec, 'b': blk}} AS doc_id, text FROM blocks WHERE kind = 'prose'), {recursive("prose_texts")},
pr AS (SELECT doc_id.d AS doc_id, doc_id.s AS sec, doc_id.b AS blk, CAST(generate_subscripts(parts, 1) AS INTEGER) AS part, unnest(parts) AS content FROM prose_parts),
hs AS (SELECT doc_id, string_agg('- ' || heading, {LF} ORDER BY sec) AS h FROM s JOIN pl USING (doc_id) WHERE level = primary_level AND heading <> '' GROUP BY doc_id),
ds AS (SELECT m.doc_id, title, coalesce(title, id_prefix || '.md') AS name, coalesce(title, id_prefix || '.md') || {LF} || {LF} || CASE WHEN h IS NULL THEN '' ELSE '本文件包含以下章节:' || {LF} || h END AS content
  FROM m LEFT JOIN ti USING (doc_id) LEFT JOIN hs USING (doc_id)),
crumb AS (SELECT doc_id, sec, heading, level, array_to_string(breadcrumb, ' > ') AS path FROM sec_chunks),
u0 AS (SELECT doc_id, -1 AS sec, 0 AS blk, 0 AS part, 0 AS row, 'doc_summary' AS chunk_type, coalesce(title, '') AS breadcrumb, name AS section_title, 1 AS heading_level, false AS has_table, {text} AS table_caption,
    false AS is_split_part, {none} AS split_part_index, {none} AS split_part_total, 'prose' AS content_type, content, '# ' || name || {LF} || {LF} || content AS context, {tokens("content")} AS est_token_count FROM ds
  UNION ALL SELECT doc_id, sec, 0, 0, 0, 'section', path, heading, level, has_table, CASE WHEN has_table AND NOT is_long THEN heading END, false, {none}, {none}, CASE WHEN has_table THEN 'table' ELSE 'prose' END, content,
    '# ' || path || {LF} || {LF} || content, CASE WHEN is_long THEN {tokens("content")} ELSE {tokens(f"('# ' || path || {LF} || {LF} || content)")} END FROM sec_chunks JOIN crumb USING (doc_id, sec, heading, level)
  UNION ALL SELECT doc_id, sec, blk, part, 0, 'leaf', path, heading, level, true, CASE WHEN parts > 1 THEN heading || '（子表 ' || part || '/' || parts || '）' ELSE heading END, parts > 1,
    CASE WHEN parts > 1 THEN part END, CASE WHEN parts > 1 THEN parts END, 'table', content, '# ' || path || {LF} || {LF} || content, {tokens(f"('# ' || path || {LF} || {LF} || content)")} FROM table_texts JOIN crumb USING (doc_id, sec)
  UNION ALL SELECT doc_id, sec, blk, part, row, 'table_row', path, heading, level, true, heading || ' 行 ' || row, false, {none}, {none}, 'table', content, '# ' || path || {LF} || {LF} || content, {tokens("content")} FROM tw JOIN crumb USING (doc_id, sec)
  UNION ALL SELECT doc_id, sec, blk, part, 0, 'leaf', path, heading, level, false, {text}, false, {none}, {none}, 'prose', content, '# ' || path || {LF} || {LF} || content, {tokens(f"('# ' || path || {LF} || {LF} || content)")}
    FROM pr JOIN crumb USING (doc_id, sec)),
u1 AS MATERIALIZED (SELECT u0.*, id_prefix, printf('%s_%04d', id_prefix, row_number() OVER (PARTITION BY doc_id ORDER BY sec, blk, part, row)) AS chunk_id FROM u0 JOIN m USING (doc_id)),
kd AS (SELECT doc_id, chunk_type, sec, blk, part, chunk_id FROM u1 WHERE chunk_type <> 'table_row'),
u2 AS (SELECT c.*, p.chunk_id AS parent_id FROM u1 c LEFT JOIN kd p ON p.doc_id = c.doc_id AND CASE c.chunk_type WHEN 'section' THEN p.chunk_type = 'doc_summary'
    WHEN 'leaf' THEN p.chunk_type = 'section' AND p.sec = c.sec WHEN 'table_row' THEN p.chunk_type = 'leaf' AND p.sec = c.sec AND p.blk = c.blk AND p.part = c.part ELSE false END),
ch1 AS (SELECT doc_id, parent_id AS chunk_id, string_agg(chunk_id, ', ' ORDER BY sec, blk, part) AS children_ids FROM u2 WHERE chunk_type IN ('section', 'leaf') GROUP BY ALL),
sb AS (SELECT a.doc_id, a.chunk_id, string_agg(b.chunk_id, ', ' ORDER BY b.part) AS sibling_ids FROM u1 a JOIN u1 b ON a.doc_id = b.doc_id AND a.sec = b.sec AND a.blk = b.blk AND a.part <> b.part
    AND b.chunk_type = 'leaf' WHERE a.chunk_type = 'leaf' AND a.is_split_part GROUP BY ALL),
rows AS MATERIALIZED (SELECT doc_id, chunk_id, chunk_type, id_prefix || '.md' AS source, '' AS company, breadcrumb, section_title, heading_level, CAST(length(content) AS INTEGER) AS char_count, est_token_count, has_table,
    coalesce(table_caption, '') AS table_caption, is_split_part, coalesce(CAST(split_part_index AS VARCHAR), '') AS split_part_index, coalesce(CAST(split_part_total AS VARCHAR), '') AS split_part_total,
    coalesce(parent_id, '') AS parent_id, coalesce(children_ids, '') AS children_ids, coalesce(sibling_ids, '') AS sibling_ids, content_type, content, context AS content_with_context
  FROM u2 LEFT JOIN ch1 USING (doc_id, chunk_id) LEFT JOIN sb USING (doc_id, chunk_id))"""


CHUNKS = chunked(ALL_DOCS)


def prepared(level: str) -> str:
    """rows as by ``chunked``, of documents that are cleaned and have their levels by the heuristic ``level``; rg(doc_id, chunk, page_start, page_end)."""
    docs = rf"""{ALL_DOCS.replace("m AS (SELECT doc_id, 'conv_'", "raw AS (SELECT doc_id, 'conv_'")}, {cleaned("raw", "cl", "doc_id, id_prefix")},
lr AS (SELECT doc_id, id_prefix, unnest(string_split(text, {LF})) AS line, generate_subscripts(string_split(text, {LF}), 1) AS pos FROM cl),
lh AS (SELECT *, regexp_matches(line, '{HEADING}') AS h, regexp_extract(line, '{HEADING}', 2) AS text FROM lr),
lf AS (SELECT *, CASE WHEN pos = min(CASE WHEN h THEN pos END) OVER (PARTITION BY doc_id) THEN 1 ELSE {level} END AS own FROM lh),
m AS (SELECT doc_id, id_prefix, string_agg(CASE WHEN h THEN repeat('#', own) || ' ' || text ELSE line END, {LF} ORDER BY pos) AS text FROM lf GROUP BY doc_id, id_prefix)"""
    pages = f"""pg AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_no, substring(text, i * 1000 + 1, 1000) AS text
  FROM (SELECT doc_id, text, unnest(range((greatest(length(text), 1) - 1) // 1000 + 1)) AS i FROM raw)),
ck AS (SELECT doc_id, chunk_id AS chunk, content, section_title FROM rows)"""
    return f"{chunked(docs)}, {pages}, {RANGED.removeprefix(GRAM_CTE).lstrip(',')}"
