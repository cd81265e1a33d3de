"""Cleaning of extracted Markdown as chains of regular expressions over whole documents.

The patterns are fixed values, without which results differ. Null stays null in all functions but ``clean_markdown``'s last
step, which gives null too; an empty text becomes one line feed there. Repeated rows are cleaned each, an empty table gives
an empty one, and columns other than ``text`` pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_table import convert_html_tables
from .text import BLANK, let, rstrip_lines, strip, where_has


def replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def drop_images(c: Column) -> Column:
    return where_has(c, ("![",), lambda x: F.regexp_replace(x, r"(?U)!\[[^\]]*\]\([^)]+\)\s*", ""))


def drop_empty_headings(c: Column) -> Column:
    return where_has(c, ("#",), lambda x: F.regexp_replace(x, r"(?mdU)^#\s*$", ""))


def unwrap_details(c: Column) -> Column:
    """Folded blocks become a bold summary and, if there is one, their body."""
    head = r"(?isU)<details>\s*<summary>\s*([^<]*?)\s*</summary>"
    rules = [(head + r"\s*</details>", "**$1**"), (head + r"\s*(.*?)\s*</details>", "**$1**\n\n$2")]
    return where_has(c, ("<",), lambda x: replaced(x, rules))


def drop_breaks(c: Column) -> Column:
    return where_has(c, ("<",), lambda x: F.regexp_replace(x, r"(?iU)<br\s*/?>", ""))


def normalize_bullets(c: Column) -> Column:
    dotted = where_has(c, ("·", "•"), lambda x: F.regexp_replace(x, r"(?mdU)^[ \t]*[·•]\s*", "- "))
    return where_has(dotted, (".",), lambda x: F.regexp_replace(x, r"(?mdU)^[ \t]*\.\s+(?=\S)", "- "))


def drop_stray_lines(c: Column) -> Column:
    """Lines of one to three capitals, with the blank lines around them."""
    return F.regexp_replace(c, r"(?U)\n\s*[A-Z]{1,3}\s*\n", "\n")


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


#: Fixed patterns of formula debris with a plain replacement, in the order they apply.
LATEX_PLAIN = [
    (r"(?U)\\textcircled\s*\{\s*\\textbf\s*\{\s*(\d+)\s*\}\s*\}\s*\\%", "$1%"),
    (r"(?U)\$\s*\\left\s*\(\s*\{\s*\\mathfrak\s*\{\s*(\w+)\s*\}\s*\}\s*\\right\s*\)\s*\$", "($1)"),
    (r"(?U)\$\s*\\ddagger\s*\$", "‡"),
    (r"(?U)\$\s*\^\s*\+\s*\$", "⁺"),
    (r"(?U)\$\s*\^\s*\\circ\s*\$", ""),
    (r"(?U)\$\s*(\d+(?:\.\d+)?)\s*%\s*\$", "$1%"),
    (r"(?U)\$\s*\^\s*([\d\s]+?)\s*\\%\s*\$", "$1%"),
    (r"(?U)\$\s*\.\s*(\d[\d\s]*?)\s*\\?\s*%\s*\$", "0.$1%"),
]
#: Fixed patterns of formula debris that is rebuilt from its parts.
LATEX_COMPARED = r"(?U)\$\s*\{\s*\}\s*\^\s*\{\s*([<>])\s*\}\s*([\d\s]+?)\s*\$"
LATEX_TT = r"(?U)\$\s*\{\s*\\tt\s*([<>])\s*\}\s*([\d\s]+?)\s*(?:\{\s*\\tt\s*\)\s*\})?\s*\$"
LATEX_NUMBER = r"(?U)\$\s*([\d\s.,]{1,20})\s*(\\%)?\s*\$"


def each_match(c: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """``c`` with every match replaced by ``made(match)``: the gaps and the new texts, interleaved."""

    def replaced_in(text: Column) -> Column:
        new = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)
        fill = lambda found: F.array_join(F.transform(F.split(text, pattern, -1), lambda g, i: F.concat(g, F.coalesce(F.get(found, i), F.lit("")))), "")
        return F.when(text.rlike(pattern), let(new, fill)).otherwise(text)

    return let(c, replaced_in)


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){BLANK}+", "")


def unwrap_numbers(c: Column) -> Column:
    """``$ 1 2 . 5 \\% $`` to ``12.5%``; a body of blanks stays unless it has a percent sign."""

    def made(m: Column) -> Column:
        number = without_blanks(F.regexp_extract(m, LATEX_NUMBER, 1))
        percent = F.regexp_extract(m, LATEX_NUMBER, 2) != ""
        return F.when((number == "") & ~percent, m).otherwise(F.concat(number, F.when(percent, F.lit("%")).otherwise("")))

    return each_match(c, LATEX_NUMBER, made)


def fix_latex(c: Column) -> Column:
    return where_has(c, ("$", "\\textcircled"), latex_fixed)


def latex_fixed(c: Column) -> Column:
    compared = each_match(
        c, LATEX_COMPARED, lambda m: F.concat(F.regexp_extract(m, LATEX_COMPARED, 1), without_blanks(F.regexp_extract(m, LATEX_COMPARED, 2)))
    )
    close = lambda m: F.when(m.contains("\\tt )") | m.contains("\\tt  )"), F.lit(")")).otherwise("")
    tt = each_match(
        compared, LATEX_TT, lambda m: F.concat(F.regexp_extract(m, LATEX_TT, 1), without_blanks(F.regexp_extract(m, LATEX_TT, 2)), close(m))
    )
    return unwrap_numbers(replaced(tt, LATEX_PLAIN))


#: Fixed pattern: a Markdown table for deduplication: lines that start and end with a pipe, each with its LF. Possessive,
#: since nothing follows: Java takes such lines in a loop, and others by a call in a call, which overflows the stack at some thousand.
PIPE_TABLE = r"(?md)(?:^\|.+\|\n)++"


def fingerprint(t: Column) -> Column:
    rows = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(rf"(?U)\A{BLANK}*\z") & ~x.contains("---"))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    return let(rows, lambda r: F.concat_ws("|", F.floor(pipes / F.greatest(F.size(r), F.lit(1))).cast("string"), F.array_join(F.slice(r, 1, 2), "|")))


def dedup_tables(c: Column) -> Column:
    """Later tables with the column count and first two rows of an earlier one go."""

    def kept_of(found: Column) -> Column:
        first = lambda marks: F.transform(found, lambda t, i: F.when(F.array_position(marks, F.get(marks, i)) == i + 1, t).otherwise(""))
        return let(F.transform(found, fingerprint), first)

    def done(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(PIPE_TABLE), F.lit(0))
        fill = lambda kept: F.array_join(F.transform(F.split(text, PIPE_TABLE, -1), lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))), "")
        return F.when(text.rlike(PIPE_TABLE), let(let(found, kept_of), fill)).otherwise(text)

    return let(c, done)


#: Fixed patterns: an HTML table, and a heading that says that the table before it goes on.
HTML_TABLE = r"(?is)<table[^>]*>.*?</table>"
CONTINUED = r"(?iU)^#{1,6}\s+.+\((續|cont'?d|continued)\)\s*$"
HAS_CONTINUED = CONTINUED.replace("(?iU)", "(?imU)")
#: A character that stands for no text.
MARK = "\x01"


def continued_lines(text: Column) -> Column:
    """For each HTML table in order, whether one of the five lines before the line it starts on says that it goes on.

    Tables get a mark of one character, so that the lines that hold marks are the lines they start on; every line is
    looked at once, and a table looks back by position.
    """
    says = F.transform(F.split(text, "\n", -1), lambda x: x.rlike(CONTINUED))
    marked = F.regexp_replace(F.translate(text, MARK, " "), HTML_TABLE, MARK + "$0")
    marks = lambda x: F.length(x) - F.length(F.translate(x, MARK, ""))
    lines = F.flatten(F.transform(F.split(marked, "\n", -1), lambda x, i: F.array_repeat(i, marks(x))))
    before = lambda held, at: reduce(or_, (F.coalesce(F.get(held, at - k), F.lit(False)) for k in range(1, 6)))
    return let(says, lambda held: F.transform(lines, lambda at, i: (i > 0) & before(held, at)))


def stitch_tables(c: Column) -> Column:
    """HTML tables under a heading marked as continued join the table before them.

    A table continues if one of the five lines before the line it starts on is such a heading;
    what stands between the parts goes. The work grows with the text, however many tables it has. Null stays null;
    a text without tables or without such headings stays as it is.
    """

    inner = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?i)\A<table[^>]*>", ""), r"(?iU)</table>\s*\z", "")

    def joined(tables: Column, gaps: Column, flags: Column) -> Column:
        more = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
        opened = lambda t, i: F.when(more(i), F.concat(F.lit("\n"), inner(t))).when(more(i + 1), F.concat(F.lit("<table>\n"), inner(t))).otherwise(t)
        part = lambda t, i: F.concat(
            F.when(more(i), F.lit("")).otherwise(F.get(gaps, i)), opened(t, i), F.when(more(i) & ~more(i + 1), F.lit("\n</table>")).otherwise("")
        )
        return F.concat(F.array_join(F.transform(tables, part), ""), F.element_at(gaps, -1))

    def done(text: Column) -> Column:
        both = F.struct(F.regexp_extract_all(text, F.lit(HTML_TABLE), F.lit(0)).alias("t"), F.split(text, HTML_TABLE, -1).alias("g"))
        stitched = let(both, lambda x: let(continued_lines(text), lambda f: joined(x["t"], x["g"], f)))
        return F.when(text.rlike(HAS_CONTINUED) & text.rlike(HTML_TABLE), stitched).otherwise(text)

    return let(c, done)


def clean_markdown(docs: DataFrame, stitch: bool = True, dedup: bool = True) -> DataFrame:
    """``docs`` with ``text`` cleaned. Each step is a projection of its own, so that none is worked out twice."""
    if stitch:
        docs = docs.withColumn("text", stitch_tables(F.col("text")))
    docs = docs.withColumn("text", fix_latex(drop_empty_headings(drop_images(F.col("text")))))
    docs = docs.withColumn("text", convert_html_tables(F.col("text")))
    docs = docs.withColumn("text", drop_stray_lines(normalize_bullets(drop_breaks(unwrap_details(F.col("text"))))))
    if dedup:
        docs = docs.withColumn("text", dedup_tables(F.col("text")))
    return docs.withColumn("text", post_clean(strip(collapse_newlines(rstrip_lines(F.col("text"))))))


def post_clean(c: Column) -> Column:
    c = F.regexp_replace(c, "\r\n?", "\n")
    rules = [(r"(?mdU)^\|\s*\|\s*$", ""), (r"(?U)\n\|\s*(?::?-{2,}:?\s*\|\s*)+(?::?-{2,}:?)\s*\|?\s*\n(?![|\-])", "\n")]
    c = where_has(c, ("|",), lambda x: replaced(x, rules))
    return F.concat(strip(rstrip_lines(collapse_newlines(c))), F.lit("\n"))
