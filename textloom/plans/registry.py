"""The registered queries of the document-preparation operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, html_table, text
from ..operators import blocks, chunks, pages, sections, stats, structure
from ..session import shared_folder, written
from ..sources import files
from ..streaming import answers
from . import inputs
from . import oracles as sql
from .prepare import prepare_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LF = sql.LF


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has any."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


# Scalar text functions.


@query(f"WITH {sql.DOCS} SELECT doc_id, {sql.tokens('text')} AS est_tokens FROM docs")
def token_estimate(spark, sf_dir):
    return inputs.text_docs(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("est_tokens"))


@query(
    "SELECT page_id, CASE WHEN s = '' THEN 'chunk' ELSE s END AS id_prefix FROM "
    "(SELECT page_id, lower(trim(regexp_replace(url, '[^A-Za-z0-9一-鿿]+', '_', 'g'), '_')) AS s FROM pages)"
)
def slug_ids(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("id_prefix"))


@query(f"WITH {sql.NOISY} SELECT doc_id, {sql.chain('text', sql.CLEAN)} AS cleaned FROM m")
def clean_regex_chain(spark, sf_dir):
    c = F.col("text")
    for step in (cleaning.drop_images, cleaning.drop_empty_headings, cleaning.drop_breaks, cleaning.normalize_bullets, cleaning.drop_stray_lines):
        c = step(c)
    c = text.strip(cleaning.collapse_newlines(text.rstrip_lines(F.regexp_replace(c, "\r\n?", "\n"))))
    return inputs.noisy_docs(spark, sf_dir).select("doc_id", c.alias("cleaned"))


@query(f"WITH {sql.NOISY} SELECT doc_id, {sql.chain('text', sql.LATEX)} AS fixed FROM m")
def latex_numbers(spark, sf_dir):
    return inputs.noisy_docs(spark, sf_dir).select("doc_id", cleaning.replaced(F.col("text"), cleaning.LATEX_PLAIN).alias("fixed"))


@query(
    f"""WITH {sql.NOISY},
    f AS (SELECT doc_id, text, regexp_extract_all(text, '{sql.NUMBER}') AS found, regexp_split_to_array(text, '{sql.NUMBER}') AS gaps FROM m),
    n AS (SELECT *, list_transform(found, lambda x: CASE
            WHEN regexp_replace(regexp_extract(x, '{sql.NUMBER_PARTS}', 1), '\\s+', '', 'g') = '' AND regexp_extract(x, '{sql.NUMBER_PARTS}', 2) = '' THEN x
            ELSE regexp_replace(regexp_extract(x, '{sql.NUMBER_PARTS}', 1), '\\s+', '', 'g') || CASE WHEN regexp_extract(x, '{sql.NUMBER_PARTS}', 2) <> '' THEN '%' ELSE '' END END) AS made FROM f)
    SELECT doc_id, CASE WHEN len(found) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(made[i], '')), '') END AS fixed FROM n"""
)
def latex_unwrap(spark, sf_dir):
    return inputs.noisy_docs(spark, sf_dir).select("doc_id", cleaning.unwrap_numbers(F.col("text")).alias("fixed"))


@query(f"WITH {sql.NOISY}, {sql.cleaned('m', 'c')} SELECT doc_id, text AS cleaned FROM c")
def clean_documents(spark, sf_dir):
    """The whole cleaning chain."""
    return cleaning.clean_markdown(inputs.noisy_docs(spark, sf_dir)).select("doc_id", F.col("text").alias("cleaned"))


# Structure.

_HEADINGS = rf"""{sql.LINES},
hd AS (SELECT doc_id, pos, CAST(length(regexp_extract(line, '{sql.HEADING}', 1)) AS INTEGER) AS level, regexp_extract(line, '{sql.HEADING}', 2) AS text
       FROM ln WHERE regexp_matches(line, '{sql.HEADING}'))"""


_SNIPPETS = """nx AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM hd),
    bl AS (SELECT h.doc_id, h.pos, l.pos - h.pos AS k, trim(l.line) AS t FROM nx h JOIN ln l ON l.doc_id = h.doc_id
           AND l.pos BETWEEN h.pos + 1 AND h.pos + 4 AND (h.stop IS NULL OR l.pos < h.stop)),
    cu AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bl),
    sn AS (SELECT doc_id, pos, substring(string_agg(t, ' ' ORDER BY k), 1, 80) AS snippet FROM cu WHERE before < 80 AND t <> '' GROUP BY ALL)"""


@query(
    f"""WITH {sql.conversations()}, {_HEADINGS}, {_SNIPPETS}
    SELECT hd.doc_id, CAST(hd.pos + 1 AS INTEGER) AS line, level, text, coalesce(snippet, '') AS snippet FROM hd LEFT JOIN sn USING (doc_id, pos)"""
)
def headings_extract(spark, sf_dir):
    return structure.extract_headings(inputs.conversation_docs(spark, sf_dir))


_BATCHED = "hb AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 3 AS INTEGER) AS batch FROM hd)"
_BAD = """CASE WHEN doc_id % 5 = 0 AND batch = 1 OR doc_id % 5 = 3 AND batch = 2 THEN 'no object' WHEN doc_id % 5 = 1 AND batch = 0 THEN 'no JSON' END"""
_LEVEL = r"""CASE WHEN regexp_matches(text, '^[\(（]?\d+[\)）]|^備註$|^備註[：:]|^注[：:]|^Note\d*\b') THEN 4
 WHEN regexp_matches(text, '^表[一二三四五六七八九十]|^說明例子|^例子\d*|^Example\b|資料一覽表|保障知多點|^適用於|^紅利|^不保事項') THEN 3 ELSE 2 END"""
_RELEVELLED = rf"""
SELECT doc_id, string_agg(CASE WHEN level IS NULL THEN line ELSE repeat('#', level) || ' ' || regexp_extract(line, '{sql.HEADING}', 2) END, {LF} ORDER BY pos) AS text"""


@query(
    f"""WITH {sql.conversations(sql.TITLES)}, {_HEADINGS},
    lv AS (SELECT doc_id, pos, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 THEN 1 ELSE {_LEVEL} END AS level FROM hd)
    {_RELEVELLED} FROM ln LEFT JOIN lv USING (doc_id, pos) GROUP BY doc_id"""
)
def heuristic_levels(spark, sf_dir):
    return structure.heuristic_recover(inputs.conversation_docs(spark, sf_dir, "titles")).select("doc_id", "text")


def _given_levels(docs: DataFrame) -> DataFrame:
    """Levels for every heading whose line is no multiple of three."""
    heads = structure.extract_headings(docs).where("line % 3 <> 0")
    return heads.select("doc_id", "line", (F.col("line") % 4 + 1).alias("level"))


@query(
    f"""WITH {sql.conversations()}, {_HEADINGS},
    lv AS (SELECT doc_id, pos, CAST((pos + 1) % 4 + 1 AS INTEGER) AS level FROM hd WHERE (pos + 1) % 3 <> 0)
    {_RELEVELLED} FROM ln LEFT JOIN lv USING (doc_id, pos) GROUP BY doc_id"""
)
def apply_level_map(spark, sf_dir):
    docs = inputs.conversation_docs(spark, sf_dir)
    return structure.apply_levels(docs, _given_levels(docs)).select("doc_id", "text")


@query(
    f"""WITH {sql.conversations(sql.TITLES)}, {_HEADINGS}, {_SNIPPETS}, {_BATCHED}
    SELECT doc_id, batch, 'Rules.' || {LF} || string_agg('L' || (pos + 1) || ': ' || text || CASE WHEN contains(lower(text), 'table') THEN ' [含表格]' ELSE '' END ||
      {LF} || '   上下文: ' || coalesce(snippet, ''), {LF} ORDER BY pos) || {LF} || 'As JSON.' AS prompt
    FROM hb LEFT JOIN sn USING (doc_id, pos) GROUP BY ALL"""
)
def structure_prompt(spark, sf_dir):
    heads = structure.extract_headings(inputs.conversation_docs(spark, sf_dir, "titles"))
    return structure.structure_prompt(structure.prompt_batches(heads, 3), "Rules.\n", "\nAs JSON.")


def _answers(heads: DataFrame) -> DataFrame:
    """Answers to batches of headings, some of them bad, some with lines left out."""
    named = (F.col("doc_id") % 5 != 2) | (F.col("line") % 3 != 0)
    entry = F.format_string('"L%d": {"level": %d, "parent": null}', "line", F.col("line") % 4 + 1)
    made = heads.groupBy("doc_id", "batch").agg(F.array_join(F.collect_list(F.when(named, entry)), ",\n").alias("e"))
    kind = F.col("doc_id") % 5
    bad = F.when((kind == 0) & (F.col("batch") == 1), F.lit("sorry")).when((kind == 1) & (F.col("batch") == 0), F.lit('{"L1": }'))
    none = (kind == 3) & (F.col("batch") == 2)
    return made.select("doc_id", "batch", F.when(~none, F.coalesce(bad, F.concat(F.lit("{"), "e", F.lit("}")))).alias("response"))


@query(
    f"""WITH {sql.conversations(sql.TITLES)}, {_HEADINGS}, {_BATCHED},
    a AS (SELECT doc_id, batch, {_BAD} AS error, count(*) AS n_headings, count(*) FILTER (WHERE doc_id % 5 <> 2 OR (pos + 1) % 3 <> 0) AS named FROM hb GROUP BY ALL),
    b AS (SELECT *, CASE WHEN error IS NULL THEN named ELSE 0 END AS n_levels FROM a)
    SELECT doc_id, batch, n_headings, n_levels, n_levels * 100 < n_headings * 80 AS low_coverage, error FROM b"""
)
def answer_report(spark, sf_dir):
    """What answers to batches of three headings cover, and which couldn't be read."""
    heads = structure.prompt_batches(structure.extract_headings(inputs.conversation_docs(spark, sf_dir, "titles")), 3)
    return structure.answer_report(heads, _answers(heads))


@query(
    f"""WITH {sql.conversations(sql.TITLES)}, {_HEADINGS}, {_BATCHED},
    bad AS (SELECT DISTINCT doc_id FROM hb WHERE {_BAD} IS NOT NULL),
    lv AS (SELECT doc_id, pos, CASE WHEN doc_id NOT IN (SELECT doc_id FROM bad) THEN CASE WHEN doc_id % 5 <> 2 OR (pos + 1) % 3 <> 0 THEN (pos + 1) % 4 + 1 END
      WHEN row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 THEN 1 ELSE {_LEVEL} END AS level FROM hd)
    {_RELEVELLED} FROM ln LEFT JOIN lv USING (doc_id, pos) GROUP BY doc_id"""
)
def levels_from_answers(spark, sf_dir):
    """Levels of good answers; documents with a bad one get the heuristic."""
    docs = inputs.conversation_docs(spark, sf_dir, "titles")
    answers = _answers(structure.prompt_batches(structure.extract_headings(docs), 3))
    return structure.recover_from_answers(docs, answers).select("doc_id", "text")


_LATE = f"({_BAD} IS NOT NULL OR (doc_id % 5 = 4 AND batch = 1))"


@query(
    f"""WITH {sql.conversations(sql.TITLES)}, {_HEADINGS}, {_BATCHED},
    bad AS (SELECT DISTINCT doc_id FROM hb WHERE {_LATE}),
    lv AS (SELECT doc_id, pos, CASE WHEN doc_id NOT IN (SELECT doc_id FROM bad) THEN CASE WHEN doc_id % 5 <> 2 OR (pos + 1) % 3 <> 0 THEN (pos + 1) % 4 + 1 END
      WHEN row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 THEN 1 ELSE {_LEVEL} END AS level FROM hd)
    {_RELEVELLED} FROM ln LEFT JOIN lv USING (doc_id, pos) GROUP BY doc_id"""
)
def levels_from_late_answers(spark, sf_dir):
    """Levels of answers that come as a stream: a second batch that comes too late leaves its document to the heuristic."""
    docs = written(inputs.conversation_docs(spark, sf_dir, "titles"), "docs")
    heads = structure.prompt_batches(structure.extract_headings(docs), 3)
    at = F.timestamp_seconds(F.when((F.col("doc_id") % 5 == 4) & (F.col("batch") == 1), 9000).otherwise(F.col("batch") % 60 * 60 + 60))
    told = written(_answers(heads).withColumn("at", at), "answers")
    n = F.coalesce("n_batches", F.lit(0)).cast("int").alias("n_batches")
    counted = docs.select("doc_id").join(heads.groupBy("doc_id").agg(F.countDistinct("batch").alias("n_batches")), "doc_id", "left")
    asked = written(counted.select("doc_id", F.timestamp_seconds(F.lit(60)).alias("at"), n), "asked")
    stream = lambda df: spark.readStream.schema(df.schema).parquet(df.inputFiles()[0].rsplit("/", 1)[0])
    out = shared_folder(spark, "settled")
    made = answers.recovered_stream(docs.select("doc_id", "text"), stream(asked), stream(told))
    made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


@query(
    f"""WITH {sql.conversations()}, {_HEADINGS}
    SELECT doc_id, CAST(pos + 1 AS INTEGER) AS line, level, CASE WHEN level > 1 THEN 'L1' END AS parent FROM hd"""
)
def parse_level_json(spark, sf_dir):
    """Levels written as JSON with a trailing comma in a code fence, as models answer, and read back."""
    heads = structure.extract_headings(inputs.conversation_docs(spark, sf_dir))
    parent = F.when(F.col("level") > 1, F.lit('"L1"')).otherwise("null")
    entry = F.concat(F.lit('"L'), F.col("line").cast("string"), F.lit('": {"level": '), F.col("level").cast("string"), F.lit(', "parent": '), parent, F.lit(",}"))
    answers = heads.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("e"))
    return structure.parse_levels(answers.select("doc_id", F.concat(F.lit("```json\n{"), "e", F.lit(",}\n```")).alias("response")))


# Sections.


@query(f"WITH {sql.conversations(extra=f'''CASE WHEN turn <= 1 THEN {LF} || '```' || {LF} || '# not a heading' || {LF} || '```' ELSE '' END''')}, {sql.SECTIONS} SELECT * FROM s")
def sections_parse(spark, sf_dir):
    return sections.parse_sections(inputs.conversation_docs(spark, sf_dir, "fenced"))


@query(f"WITH {sql.CONV}, {sql.WALKED} SELECT doc_id, sec, level, array_to_string(breadcrumb, ' > ') AS breadcrumb FROM b")
def breadcrumbs(spark, sf_dir):
    walked = sections.with_breadcrumbs(sections.parse_sections(inputs.conversation_docs(spark, sf_dir)))
    return walked.select("doc_id", "sec", "level", F.array_join("breadcrumb", " > ").alias("breadcrumb"))


@query(f"WITH {sql.CONV}, {sql.WALKED} SELECT doc_id, primary_level, title FROM pl LEFT JOIN ti USING (doc_id)")
def primary_level(spark, sf_dir):
    found = sections.parse_sections(inputs.conversation_docs(spark, sf_dir))
    return sections.primary_levels(found).join(sections.document_titles(found), "doc_id", "left")


@query(f"WITH {sql.CONV}, {sql.MERGED} SELECT doc_id, sec, level, heading, body FROM mg")
def merge_small_sections(spark, sf_dir):
    merged = sections.merge_small_sections(sections.walked_sections(inputs.conversation_docs(spark, sf_dir)))
    return merged.select("doc_id", "sec", "level", "heading", "body")


@query(
    f"""WITH {sql.CONV}, {sql.WALKED},
    hs AS (SELECT doc_id, string_agg('- ' || heading, {LF} ORDER BY sec) AS h FROM s JOIN pl USING (doc_id) WHERE level = primary_level AND heading <> '' GROUP BY doc_id)
    SELECT doc_id, title, title || {LF} || {LF} || CASE WHEN h IS NULL THEN '' ELSE '本文件包含以下章节:' || {LF} || h END AS content
    FROM pl LEFT JOIN ti USING (doc_id) LEFT JOIN hs USING (doc_id)"""
)
def doc_summary(spark, sf_dir):
    return chunks.document_summaries(inputs.conversation_docs(spark, sf_dir)).select("doc_id", "title", "content")


@query(f"""WITH {sql.conversations(text=f"replace(text, {LF}, {LF} || {LF})")}, {sql.MERGED}, {sql.SUMMARY} SELECT doc_id, sec, summary FROM su""")
def section_summary(spark, sf_dir):
    found = chunks.titled_sections(inputs.conversation_docs(spark, sf_dir, "paragraphs"))
    return found.select("doc_id", "sec", sections.section_summary(F.col("body"), F.col("heading"), F.lit(False)).alias("summary"))


@query(
    f"""WITH {sql.CHUNKED}
    SELECT doc_id, sec, level, heading, breadcrumb, content, context, CASE WHEN is_long THEN {sql.tokens("content")} ELSE {sql.tokens("context")} END AS est_token_count FROM ch"""
)
def section_chunks(spark, sf_dir):
    made = chunks.section_chunks(chunks.titled_sections(inputs.conversation_docs(spark, sf_dir)))
    return made.select("doc_id", "sec", "level", "heading", F.array_join("breadcrumb", " > ").alias("breadcrumb"), "content", "context", "est_token_count")


@query(
    f"""WITH {sql.CHUNKED}, t AS (SELECT length(content) AS c, CASE WHEN is_long THEN {sql.tokens("content")} ELSE {sql.tokens("context")} END AS k FROM ch)
    SELECT count(*) AS n_chunks, CAST(min(c) AS INTEGER) AS min_chars, CAST(sum(c) // count(*) AS BIGINT) AS avg_chars, CAST(max(c) AS INTEGER) AS max_chars,
      min(k) AS min_tokens, CAST(sum(k) // count(*) AS BIGINT) AS avg_tokens, max(k) AS max_tokens, 0::BIGINT AS n_table, 0::BIGINT AS table_percent, 0::BIGINT AS n_split,
      count(*) FILTER (WHERE c < 80) AS n_tiny FROM t"""
)
def section_stats(spark, sf_dir):
    """Statistics of the section layer alone."""
    made = chunks.section_chunks(chunks.titled_sections(inputs.conversation_docs(spark, sf_dir)))
    return stats.chunk_stats(made.withColumns({"char_count": F.length("content"), "is_split_part": F.lit(False)}))


@query(f"WITH {sql.CHUNKED} SELECT CASE WHEN is_long THEN 'summary' ELSE 'whole' END AS chunk_type, count(*) AS n FROM ch GROUP BY ALL")
def section_types(spark, sf_dir):
    """How many sections are whole and how many stand for leaves."""
    made = chunks.section_chunks(chunks.titled_sections(inputs.conversation_docs(spark, sf_dir)))
    return stats.chunk_types(made.withColumn("chunk_type", F.when(F.col("is_long"), "summary").otherwise("whole")))


def _all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations (prose) and regions (tables), told apart by the sign of their ids."""
    return inputs.conversation_docs(spark, sf_dir).unionByName(inputs.nation_docs(spark, sf_dir).withColumn("doc_id", -1 - F.col("doc_id")))


@query(
    f"""WITH {sql.CHUNKS} SELECT count(*) AS n_chunks, min(char_count) AS min_chars, CAST(sum(char_count) // count(*) AS BIGINT) AS avg_chars, max(char_count) AS max_chars,
      min(est_token_count) AS min_tokens, CAST(sum(est_token_count) // count(*) AS BIGINT) AS avg_tokens, max(est_token_count) AS max_tokens, count(*) FILTER (WHERE has_table) AS n_table,
      CAST(count(*) FILTER (WHERE has_table) * 100 // count(*) AS BIGINT) AS table_percent, count(*) FILTER (WHERE is_split_part) AS n_split, count(*) FILTER (WHERE char_count < 80) AS n_tiny FROM rows"""
)
def chunk_stats(spark, sf_dir):
    """Statistics of all chunks of all documents."""
    return stats.chunk_stats(chunks.chunk_documents(_all_docs(spark, sf_dir)))


@query(f"WITH {sql.CHUNKS} SELECT chunk_type, count(*) AS n FROM rows GROUP BY ALL")
def chunk_types(spark, sf_dir):
    return stats.chunk_types(chunks.chunk_documents(_all_docs(spark, sf_dir)))


# Blocks and tables.


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as bodies of one section."""
    return inputs.nation_docs(spark, sf_dir).select("doc_id", F.lit(0).alias("sec"), F.col("text").alias("body"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.table_parts(blocks.split_blocks(_bodies(spark, sf_dir)))


@query(f"WITH {sql.BLOCKS} SELECT * FROM blocks")
def table_blocks(spark, sf_dir):
    return blocks.split_blocks(_bodies(spark, sf_dir)).select("doc_id", "blk", "kind", "text")


@query(f"WITH {sql.PACKED} SELECT doc_id, blk, parts, part, rows[1] || {LF} || rows[2] || {LF} || array_to_string(g, {LF}) AS content FROM parts")
def table_row_pack(spark, sf_dir):
    return _tables(spark, sf_dir).select("doc_id", "blk", "parts", "part", "content")


@query(
    f"""WITH {sql.PACKED}, rw AS (SELECT doc_id, blk, part, rows, unnest(g) AS line, CAST(generate_subscripts(g, 1) AS INTEGER) AS row FROM parts WHERE parts > 1)
    SELECT doc_id, blk, part, row, rows[1] || {LF} || rows[2] || {LF} || line AS row_content FROM rw"""
)
def table_row_chunks(spark, sf_dir):
    return chunks.row_chunks(_tables(spark, sf_dir)).select("doc_id", "blk", "part", "row", "row_content")


@query(
    f"""WITH {sql.PACKED} SELECT a.doc_id, a.blk, a.part, coalesce(string_agg(b.part, ',' ORDER BY b.part), '') AS siblings
    FROM parts a LEFT JOIN parts b ON a.doc_id = b.doc_id AND a.blk = b.blk AND a.part <> b.part
    WHERE a.doc_id IN (SELECT doc_id FROM l0 GROUP BY doc_id HAVING length(trim(string_agg(regexp_replace(line, '^#+ ', ''), {LF} ORDER BY pos), {LF} || ' ')) > 1800) GROUP BY ALL"""
)
def table_siblings(spark, sf_dir):
    """Siblings of the tables of documents that are too long for one chunk; shorter ones have no leaves."""
    made = chunks.chunk_documents(inputs.nation_docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(?m)^#+ ", "")))
    leaf = made.where("chunk_type = 'leaf' and has_table").select("doc_id", "blk", "part", "chunk_id", "sibling_ids")
    named = leaf.select("doc_id", "chunk_id", F.col("part").alias("other"))
    listed = leaf.select("doc_id", "blk", "part", F.explode_outer("sibling_ids").alias("chunk_id")).join(named, ["doc_id", "chunk_id"], "left")
    parts = F.array_sort(F.collect_list("other"))
    return listed.groupBy("doc_id", "blk", "part").agg(F.array_join(F.transform(parts, lambda x: x.cast("string")), ",").alias("siblings"))


@query(f"WITH {sql.CHUNKS} SELECT doc_id, chunk_id, replace(children_ids, ', ', ',') AS children FROM rows WHERE children_ids <> ''")
def chunk_children(spark, sf_dir):
    """Every chunk that has children, in all layers."""
    made = chunks.chunk_documents(_all_docs(spark, sf_dir))
    return made.where("size(children_ids) > 0").select("doc_id", "chunk_id", F.array_join("children_ids", ",").alias("children"))


# Splitting of prose.


@query(
    f"""WITH {sql.DOCS} SELECT doc_id, CAST(i AS INTEGER) AS part, substring(text, i * 1720 + 1, 1800) AS content FROM
    (SELECT doc_id, text, unnest(range((length(text) - 1) // 1720 + 1)) AS i FROM docs WHERE text <> '')"""
)
def hard_split(spark, sf_dir):
    return inputs.text_docs(spark, sf_dir).select("doc_id", F.posexplode(blocks.hard_split(F.col("text"))).alias("part", "content"))


_KEPT = "list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i] = '' THEN NULL WHEN i < len(p) THEN p[i] || '. ' ELSE p[i] END), lambda x: x IS NOT NULL)"


@query(f"WITH {sql.DOCS}, k AS (SELECT doc_id, {_KEPT} AS k FROM (SELECT doc_id, string_split(text, '. ') AS p FROM docs)) SELECT doc_id, CAST(generate_subscripts(k, 1) - 1 AS INTEGER) AS part, unnest(k) AS content FROM k")
def split_keep_sep(spark, sf_dir):
    return inputs.text_docs(spark, sf_dir).select("doc_id", F.posexplode(blocks.split_keeping(F.col("text"), ". ")).alias("part", "content"))


@query(
    f"""WITH {sql.DOCS}, k AS (SELECT doc_id, {_KEPT} AS k FROM (SELECT doc_id, string_split(text, '. ') AS p FROM docs)),
    r AS (SELECT doc_id, list_reduce(k, lambda a, p: CASE WHEN a.cur = '' OR length(a.cur) + length(p) <= 1800 THEN {{'out': a.out, 'cur': a.cur || p}}
      ELSE {{'out': list_append(a.out, a.cur), 'cur': CASE WHEN length(a.cur) > 80 THEN right(a.cur, 80) ELSE '' END || p}} END, {{'out': CAST([] AS VARCHAR[]), 'cur': ''}}) AS a FROM k),
    o AS (SELECT doc_id, CASE WHEN a.cur <> '' THEN list_append(a.out, a.cur) ELSE a.out END AS o FROM r)
    SELECT doc_id, CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS part, unnest(o) AS content FROM o"""
)
def merge_overlap(spark, sf_dir):
    pieces = inputs.text_docs(spark, sf_dir).select("doc_id", blocks.split_keeping(F.col("text"), ". ").alias("pieces"))
    return pieces.select("doc_id", F.posexplode_outer(blocks.merge_with_overlap("pieces")).alias("part", "content")).where("part is not null")


@query(f"WITH {sql.DOCS}, {sql.recursive('docs')} SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part, unnest(parts) AS content FROM prose_parts")
def recursive_split(spark, sf_dir):
    return inputs.text_docs(spark, sf_dir).select("doc_id", F.posexplode_outer(blocks.recursive_split("text")).alias("part", "content"))


@query(
    """WITH e AS (SELECT CAST(label AS BIGINT) AS doc_id, vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings),
    q AS (SELECT *, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * v[i])) AS a, list_sum(list_transform(range(1, len(nx) + 1), lambda i: nx[i] * nx[i])) AS b,
      list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * nx[i])) AS d FROM e),
    z AS (SELECT doc_id, vec_id, CASE WHEN nx IS NOT NULL THEN round(d / (CASE WHEN a = 0 THEN 1 ELSE sqrt(a) END * CASE WHEN b = 0 THEN 1 ELSE sqrt(b) END), 6) END AS sim FROM q),
    w AS (SELECT *, avg(sim) OVER (PARTITION BY doc_id ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM z),
    k AS (SELECT *, coalesce(lag(m > 0 AND sim < m * 0.6) OVER (PARTITION BY doc_id ORDER BY vec_id), false) AS brk FROM w)
    SELECT doc_id, vec_id, CAST(sum(CAST(brk AS INT)) OVER (PARTITION BY doc_id ORDER BY vec_id) AS BIGINT) AS grp FROM k"""
)
def semantic_breaks(spark, sf_dir):
    vectors = inputs.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("para"), "embedding")
    return blocks.semantic_groups(vectors).select("doc_id", F.col("para").alias("vec_id"), "grp")


@query()
def semantic_leaves(spark, sf_dir):
    """Leaves of all conversations, long prose cut by made-up vectors of its paragraphs; the tests hold such leaves against plain Python."""
    docs = inputs.conversation_docs(spark, sf_dir, "paragraphs")
    n = F.length("text")
    vectors = chunks.paragraphs_to_embed(docs).withColumn("embedding", F.array(n % 7 - 3, n % 5 - 2, n % 3 + 1))
    made = chunks.chunk_documents(docs, vectors=vectors).where("chunk_type = 'leaf'")
    return made.select("doc_id", "chunk_id", "sec", "blk", "part", "content")


# HTML tables, continued and repeated tables.


@query(
    f"""SELECT CAST(c_nationkey AS BIGINT) AS doc_id, '| key | name | segment |' || {LF} || '| --- | --- | --- |' || {LF} ||
    string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' x |', {LF} ORDER BY c_custkey) AS md FROM customer GROUP BY c_nationkey"""
)
def html_tables(spark, sf_dir):
    return inputs.html_tables(spark, sf_dir).select("doc_id", html_table.table_to_markdown(F.col("html")).alias("md"))


@query(
    f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE c_custkey % 6
      WHEN 0 THEN '| key | ' || c_name || ' first | ' || c_name || ' last |' || {LF} || '| --- | --- | --- |' || {LF} || '| 1 | a | b |'
      WHEN 1 THEN '| k | v |' || {LF} || '| --- | --- |' || {LF} || '| 1 | 2 |' || {LF} || {LF} || 'note ' || c_name
      WHEN 2 THEN '| ' || c_name || ' |' || {LF} || '| --- |' || {LF} || '| one |' || {LF} || {LF} || 'two'
      WHEN 3 THEN '| a | x tail tail |' || {LF} || '| --- | --- |' || {LF} || '| 1 | ' || c_name || ' \\| y |'
      WHEN 4 THEN '| a |  |' || {LF} || '| --- | --- |' || {LF} || '| ' || c_name || ' | 1 |'
      ELSE '| ' || c_name || ' | 1 |  |' || {LF} || '| --- | --- | --- |' || {LF} || '| ' || c_name || ' | 2 |  |' || {LF} || '| ' || c_name || ' | 3 | more |' END AS md FROM customer"""
)
def html_spans(spark, sf_dir):
    """Tables with spans in rows and columns, joined headers, notes, blank rows and repeated words."""
    return inputs.spanned_tables(spark, sf_dir).select("doc_id", html_table.table_to_markdown(F.col("html")).alias("md"))


@query(
    f"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '# ' || n_name || {LF} || CASE WHEN n_nationkey % 2 = 0
      THEN '<table>' || {LF} || '<tr><td>a</td><td>' || n_name || '</td></tr>' || {LF} || '<tr><td>b</td><td>' || n_name || '</td></tr>' || {LF} || '</table>'
      ELSE '<table><tr><td>a</td><td>' || n_name || '</td></tr></table>' || {LF} || {LF} || '# ' || n_name || '(other)' || {LF} || 'foot line' || {LF} ||
           '<table><tr><td>b</td><td>' || n_name || '</td></tr></table>' END || {LF} || 'after' AS text FROM nation"""
)
def stitch_tables(spark, sf_dir):
    return inputs.continued_docs(spark, sf_dir).select("doc_id", cleaning.stitch_tables(F.col("text")).alias("text"))


@query(
    f"""WITH d AS (SELECT CAST(floor(doc_id / 20) AS BIGINT) AS doc_id, coalesce(doc_id, 0) AS k, translate(coalesce(text, ''), '<#', '  ') AS t FROM documents),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, t) AS i FROM d),
    f AS (SELECT *, i > 1 AND k % 5 <> 0 AND k % 7 <> 0 AS goes_on, '<tr><td>' || t || '</td></tr>' AS cells,
      '# Part ' || k || CASE WHEN k % 5 = 0 THEN '' WHEN k % 2 = 0 THEN '(續)' ELSE '(Cont''d)' END || {LF} || CASE WHEN k % 7 = 0
        THEN '1' || {LF} || '2' || {LF} || '3' || {LF} || '4' || {LF} || '5' ELSE 'foot' || {LF} || 'more' END || {LF} AS head FROM c),
    g AS (SELECT *, coalesce(lead(goes_on) OVER (PARTITION BY doc_id ORDER BY i), false) AS more FROM f)
    SELECT doc_id, string_agg(CASE WHEN goes_on THEN {LF} || cells || CASE WHEN more THEN '' ELSE {LF} || '</table>' END
      ELSE CASE WHEN i > 1 THEN {LF} ELSE '' END || head || CASE WHEN more THEN '<table>' || {LF} || cells ELSE '<table>' || cells || '</table>' END END,
      '' ORDER BY i) || {LF} AS text FROM g GROUP BY doc_id"""
)
def stitch_runs(spark, sf_dir):
    """Runs of many continued tables in one document, and headings too far above their table."""
    return inputs.table_run_docs(spark, sf_dir).select("doc_id", cleaning.stitch_tables(F.col("text")).alias("text"))


@query(
    f"""WITH r AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, '| key | nation |' || {LF} || '| --- | --- |' || {LF} ||
      string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', {LF} ORDER BY n_nationkey) || {LF} AS t FROM nation GROUP BY n_regionkey)
    SELECT doc_id, t || {LF} || 'middle' || {LF} || {LF} || {LF} || '| key | nation |' || {LF} || '| --- | --- |' || {LF} || '| 99 | other |' || {LF} || '| 1 | x |' || {LF} ||
      {LF} || 'last' || {LF} || {LF} AS text FROM r"""
)
def dedup_tables(spark, sf_dir):
    return inputs.repeated_table_docs(spark, sf_dir).select("doc_id", cleaning.dedup_tables(F.col("text")).alias("text"))


# Pages.


@query(
    """SELECT CAST(floor(doc_id / 100) AS BIGINT) AS file, CAST(row_number() OVER (PARTITION BY floor(doc_id / 100) ORDER BY doc_id, t) AS INTEGER) AS page_no, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), chr(12) || chr(13), '  ') AS t FROM documents)"""
)
def page_files(spark, sf_dir):
    """Pages written to text files and read again, each with its number in its file."""
    found = files.read_pages(spark, inputs.page_files(spark, sf_dir))
    return found.select(F.regexp_extract("path", r"/file=(-?\d+)/", 1).try_cast("long").alias("file"), "page_no", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {sql.MATCHED} SELECT doc_id, chunk, page_start FROM mt")
def page_match(spark, sf_dir):
    return pages.match_pages(inputs.chunks_of_docs(spark, sf_dir), inputs.pages_of_docs(spark, sf_dir))


@query(f"WITH {sql.RANGED} SELECT doc_id, chunk, page_start, page_end FROM rg")
def page_range(spark, sf_dir):
    return pages.page_ranges(inputs.chunks_of_docs(spark, sf_dir), inputs.pages_of_docs(spark, sf_dir))


@query(f"WITH {sql.RANGED} SELECT doc_id, chunk, page_start, page_end FROM rg")
def page_range_indexed(spark, sf_dir):
    """The pages of every chunk by the index of grams, as for documents that don't fit in a task."""
    return pages.page_ranges(inputs.chunks_of_docs(spark, sf_dir), inputs.pages_of_docs(spark, sf_dir), task_chars=0, block_chars=1 << 16)


@query(f"WITH {sql.RANGED} SELECT doc_id, chunk, section_title, page_start, page_end FROM ck LEFT JOIN rg USING (doc_id, chunk)")
def attributed_chunks(spark, sf_dir):
    """Every chunk with its pages, null where none matches."""
    made = pages.attribute_pages(inputs.chunks_of_docs(spark, sf_dir), inputs.pages_of_docs(spark, sf_dir))
    return made.select("doc_id", "chunk", "section_title", "page_start", "page_end")


@query(
    f"""WITH {sql.MATCHED}, j AS (SELECT page_start FROM ck LEFT JOIN mt USING (doc_id, chunk))
    SELECT count(page_start) AS matched, count(*) - count(page_start) AS unmatched, CAST(count(page_start) * 100 // count(*) AS BIGINT) AS matched_percent,
      CAST((count(*) - count(page_start)) * 100 // count(*) AS BIGINT) AS unmatched_percent FROM j"""
)
def page_match_rate(spark, sf_dir):
    held = inputs.chunks_of_docs(spark, sf_dir)
    found = pages.match_pages(held, inputs.pages_of_docs(spark, sf_dir))
    return stats.match_rate(held.select("doc_id", "chunk").join(found, ["doc_id", "chunk"], "left"))


# Review output, batches, the whole.


@query(f"WITH {sql.CHUNKS} SELECT * EXCLUDE (doc_id) FROM rows")
def review_projection(spark, sf_dir):
    """Flat rows of all chunks of all documents, with ids, links, contexts and captions."""
    return chunks.review_rows(chunks.chunk_documents(_all_docs(spark, sf_dir)))


_PATHS = "p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)"


@query(
    f"""WITH {_PATHS} SELECT host AS company, '/base/' || host || '/docs' AS dir, 'page_' || page_id AS stem, '/base/' || host || '/docs/page_' || page_id || '.md' AS md_path,
    CASE WHEN page_id % 2 = 0 THEN '/base/' || host || '/docs/page_' || page_id || '.pdf' END AS pdf_path FROM p"""
)
def pdf_pairing(spark, sf_dir):
    return files.pair_pages(inputs.file_paths(spark, sf_dir), "/base")


@query(f"WITH {_PATHS} SELECT host AS company, 'page_' || page_id AS stem FROM p WHERE page_id % 3 <> 0")
def pending_tasks(spark, sf_dir):
    tasks = files.pair_pages(inputs.file_paths(spark, sf_dir), "/base")
    done = tasks.where("cast(substring(stem, 6) as long) % 3 = 0").select("company", "stem")
    return files.pending(tasks, done).select("company", "stem")


@query("SELECT CASE WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def batch_report(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("source", F.when(F.length("text") % 7 == 0, "too odd").alias("error"))
    return stats.batch_report(docs)


@query("SELECT source AS company, 'd' || doc_id AS name, 'too odd' AS error FROM documents WHERE length(text) % 7 = 0")
def batch_failures(spark, sf_dir):
    error = F.when(F.length("text") % 7 == 0, "too odd").alias("error")
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("source").alias("company"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), error)
    return stats.batch_failures(docs)


@query(
    f"""WITH {_PATHS}, q AS (SELECT host AS company, '/base/' || host || '/docs/page_' || page_id || '.md' AS md_path FROM p)
    SELECT *, CAST(row_number() OVER (PARTITION BY company ORDER BY md_path) AS INTEGER) AS file_no FROM q"""
)
def ordered_tasks(spark, sf_dir):
    return files.in_order(files.pair_pages(inputs.file_paths(spark, sf_dir), "/base")).select("company", "md_path", "file_no")


@query()
def review_document(spark, sf_dir):
    return stats.review_markdown(chunks.chunk_documents(inputs.nation_docs(spark, sf_dir)))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _all_docs(spark, sf_dir)
    return prepare_documents(docs, pages=inputs.paged(docs))


@query()
def full_pipeline(spark, sf_dir):
    """Clean, recover levels, chunk, attribute pages: the 22 fields of every chunk. ``prepared_rows`` has the same with its lists joined, and SQL."""
    return chunks.chunk_records(_prepared(spark, sf_dir))


_PREPARED = sql.prepared(_LEVEL)


@query(f"WITH {_PREPARED} SELECT rows.* EXCLUDE (doc_id), page_start, page_end FROM rows LEFT JOIN rg ON rg.doc_id = rows.doc_id AND rg.chunk = chunk_id")
def prepared_rows(spark, sf_dir):
    """The whole preparation, all layers, with pages."""
    return chunks.review_rows(_prepared(spark, sf_dir), pages=True)


@query(
    f"""WITH {_PREPARED} SELECT count(rg.chunk) AS matched, count(*) - count(rg.chunk) AS unmatched, CAST(count(rg.chunk) * 100 // count(*) AS BIGINT) AS matched_percent,
      CAST((count(*) - count(rg.chunk)) * 100 // count(*) AS BIGINT) AS unmatched_percent FROM rows LEFT JOIN rg ON rg.doc_id = rows.doc_id AND rg.chunk = chunk_id"""
)
def prepared_match_rate(spark, sf_dir):
    """How many chunks of the whole preparation have pages."""
    return stats.match_rate(_prepared(spark, sf_dir))
