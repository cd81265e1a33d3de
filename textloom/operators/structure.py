"""Headings: extraction with context, heuristic levels, and levels from outside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_level, heading_text, let, strip

#: Fixed patterns: titles of level 4, then of level 3; every other heading but the first has level 2.
LEVEL_4 = r"(?U)^[\(（]?\d+[\)）]|^備註$|^備註[：:]|^注[：:]|^Note\d*\b"
LEVEL_3 = r"(?U)^表[一二三四五六七八九十]|^說明例子|^例子\d*\b|^Example\b|資料一覽表|保障知多點|^適用於|^紅利|^不保事項"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) for each LF-separated line, from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def extract_headings(docs: DataFrame, snippet_chars: int = 80) -> DataFrame:
    """(doc_id, line, level, text, snippet): the snippet joins up to four lines below, to the next heading.

    Heading lines are found within their document's array, so nothing is shuffled.
    """
    all_lines = F.split("text", "\n", -1)
    marked = docs.select("doc_id", all_lines.alias("lines")).select(
        "doc_id", "lines", F.explode(F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: heading_level(F.get("lines", i)) > 0)).alias("i")
    )
    below = F.slice("lines", F.col("i") + 2, 4)
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("parts"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        part = strip(x)
        more = F.when(part != "", F.array_append(acc["parts"], part)).otherwise(acc["parts"])
        n = acc["n"] + F.length(part)
        stop = acc["done"] | (heading_level(x) > 0)
        return F.when(stop, F.struct(F.lit(True).alias("done"), acc["parts"].alias("parts"), acc["n"].alias("n"))).otherwise(
            F.struct((n >= snippet_chars).alias("done"), more.alias("parts"), n.alias("n"))
        )

    parts = F.aggregate(below, start, step)["parts"]
    own = F.get("lines", F.col("i"))
    return marked.select(
        "doc_id",
        (F.col("i") + 1).alias("line"),
        heading_level(own).alias("level"),
        heading_text(own).alias("text"),
        F.substring(F.array_join(parts, " "), 1, snippet_chars).alias("snippet"),
    )


def heuristic_level(text: Column) -> Column:
    return F.when(text.rlike(LEVEL_4), 4).when(text.rlike(LEVEL_3), 3).otherwise(2)


def rewritten(docs: DataFrame, level_of: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``docs`` with every heading for which ``level_of(line number, text, is first)`` is not null written at that level."""

    def whole(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: heading_level(x) > 0), True)

        def line(own: Column, i: Column, at: Column) -> Column:
            made = let(level_of(i + 1, heading_text(own), i + 1 == at), lambda n: F.when(n.isNull(), own).otherwise(F.concat(F.repeat(F.lit("#"), n), F.lit(" "), heading_text(own))))
            return F.when(own.startswith("#") & (heading_level(own) > 0), made).otherwise(own)

        return let(first, lambda at: F.array_join(F.transform(lines, lambda own, i: line(own, i, at)), "\n"))

    return docs.withColumn("text", let(F.split("text", "\n", -1), whole))


def heuristic_recover(docs: DataFrame) -> DataFrame:
    """The first heading becomes level 1, the others get their level from their wording."""
    return rewritten(docs, lambda i, text, is_first: F.when(is_first, 1).otherwise(heuristic_level(text)))


def level_maps(levels: DataFrame) -> DataFrame:
    """(doc_id, levels map<line, level>) from rows (doc_id, line, level), and ``batch`` if there is one.

    Of several levels for a line that of the last batch holds; within a batch, or without one, the largest.
    """
    batch = F.col("batch") if "batch" in levels.columns else F.lit(0)
    one = levels.groupBy("doc_id", "line").agg(F.max_by("level", F.struct(batch, "level")).alias("level"))
    return one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "level"))).alias("levels"))


def apply_levels(docs: DataFrame, levels: DataFrame) -> DataFrame:
    """Headings that ``levels`` (doc_id, line, level) has get its level; other lines stay."""
    joined = docs.join(level_maps(levels), "doc_id", "left")
    return rewritten(joined, lambda i, text, is_first: F.try_element_at("levels", i)).drop("levels")


def recover_structure(docs: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Levels from outside where a document has any, the heuristic for whole documents that have none."""
    return heuristic_recover(docs) if levels is None else recovered(docs, level_maps(levels))


def recovered(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """``docs`` by their map of levels (doc_id, levels), those without one by the heuristic."""
    return with_levels(docs.join(maps, "doc_id", "left"))


def with_levels(docs: DataFrame) -> DataFrame:
    """``docs`` by their column ``levels``, a map, where it is null by the heuristic."""
    own = lambda i, text, is_first: F.when(
        F.col("levels").isNull(), F.when(is_first, 1).otherwise(heuristic_level(text))
    ).otherwise(F.try_element_at("levels", i))
    return rewritten(docs, own).drop("levels")


def recover_from_answers(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Levels from model answers (doc_id, response, and batch for documents asked in batches).

    One bad answer discards all answers of its document, which then gets the heuristic, as do
    documents without an answer. A good answer that names no line leaves its document as it is.
    """
    good = read_answers(answers).groupBy("doc_id").agg(F.bool_and(F.col("error").isNull()).alias("good")).where("good")
    maps = good.join(level_maps(parse_levels(answers)), "doc_id", "left")
    none = F.create_map().cast("map<int, int>")
    return recovered(docs, maps.select("doc_id", F.coalesce("levels", none).alias("levels")))


def prompt_batches(headings: DataFrame, size: int = 80) -> DataFrame:
    """Add ``batch``, from 0: ``size`` headings of a document in the order of their lines."""
    return with_rank(headings).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("int")).drop("n")


def structure_prompt(headings: DataFrame, before: str = "", after: str = "") -> DataFrame:
    """(doc_id, prompt): a document's headings with their context, one entry each, for an outside model.

    Headings with a ``batch`` give a prompt for each (doc_id, batch). ``before`` and ``after`` are the
    rules and the wanted form of the answer, which the caller words.
    """
    keys = ["doc_id", "batch"] if "batch" in headings.columns else ["doc_id"]
    tags = F.array_compact(
        F.array(
            F.when(F.col("text").contains("表") | F.lower("text").contains("table"), F.lit("含表格")),
            F.when(F.col("text").contains("續") | F.lower("text").contains("continued"), F.lit("续表")),
        )
    )
    tag = F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, ", "), F.lit("]"))).otherwise("")
    entry = F.concat(F.lit("L"), F.col("line").cast("string"), F.lit(": "), "text", tag, F.lit("\n   上下文: "), F.substring("snippet", 1, 80))
    rows = headings.withColumn("entry", entry).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "entry"))).alias("e"))
    entries = F.array_join(F.transform("e", lambda x: x["entry"]), "\n")
    return rows.select(*keys, F.concat(F.lit(before), entries, F.lit(after)).alias("prompt"))


def repair_json(c: Column) -> Column:
    for pattern, to in (
        (r"(?U)\A```(?:json)?\s*", ""),
        (r"(?U)\s*```\z", ""),
        (r"(?U)([}\]])\s*\n\s*\"", '$1,\n"'),
        (r"(?U),\s*}", "}"),
        (r"(?U),\s*]", "]"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c


def read_answers(answers: DataFrame) -> DataFrame:
    """Model answers with ``parsed``, a map of their lines, and ``error``, null if they could be read.

    Broken JSON is repaired once. A null or empty answer has no object.
    """
    raw = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    shape = "map<string, struct<level: int, parent: string>>"
    parsed = F.coalesce(F.from_json(raw, shape), F.from_json(repair_json(raw), shape))
    error = F.when(F.coalesce(raw, F.lit("")) == "", "no object").when(F.col("parsed").isNull(), "no JSON")
    return answers.withColumn("parsed", parsed).withColumn("error", error)


def parse_levels(responses: DataFrame) -> DataFrame:
    """(doc_id, line, level, parent) from model answers (doc_id, response), and their ``batch`` if they have one."""
    keys = ["doc_id", "batch"] if "batch" in responses.columns else ["doc_id"]
    entries = read_answers(responses).select(*keys, F.explode(F.map_entries("parsed")).alias("e"))
    line = F.expr("try_cast(substring(e.key, 2) AS int)")
    return entries.select(*keys, line.alias("line"), F.col("e.value.level").alias("level"), F.col("e.value.parent").alias("parent")).where("line is not null")


def answer_report(headings: DataFrame, answers: DataFrame, least_per_cent: int = 80) -> DataFrame:
    """For every (doc_id, batch) asked: n_headings, n_levels, whether that is under ``least_per_cent``, and the error.

    ``headings`` and ``answers`` have a ``batch``. What was never answered has the error 'no answer'.
    """
    asked = headings.groupBy("doc_id", "batch").agg(F.count("*").alias("n_headings"))
    told = read_answers(answers).select("doc_id", "batch", F.lit(True).alias("told"), F.coalesce(F.size("parsed"), F.lit(0)).alias("size"), "error")
    n_levels = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")
    return asked.join(told, ["doc_id", "batch"], "left").select(
        "doc_id",
        "batch",
        "n_headings",
        n_levels.alias("n_levels"),
        (n_levels * 100 < F.col("n_headings") * least_per_cent).alias("low_coverage"),
        F.when(F.col("told").isNull(), "no answer").otherwise(F.col("error")).alias("error"),
    )


def with_rank(headings: DataFrame) -> DataFrame:
    """Headings numbered within their document."""
    return headings.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")))
