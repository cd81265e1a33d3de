"""String column helpers whose blanks, lines and lengths mean what they mean for Unicode text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns, which results hang on.
#: White space of Unicode, with the four information separators that Java's class lacks.
BLANK = r"[\s\x1c-\x1f]"
#: Line ends other than LF that end a line when a whole document is cut into lines.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
HEADING = r"(?dU)^(#{1,6})\s+(.+?)\s*$"
FENCE = r"(?U)^\s*```"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){BLANK}+\z", "")


def strip_lf(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def rstrip_lines(c: Column) -> Column:
    """Every LF-separated line without the blanks at its end."""
    return F.regexp_replace(c, rf"(?U)[{BLANK[1:-1]}&&[^\n]]+(?=\n|\z)", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"(?U)[^{BLANK[1:-1]}]")


def heading_level(line: Column) -> Column:
    """1 to 6, or 0 for a line that is no heading."""
    return F.when(line.startswith("#"), F.length(F.regexp_extract(line, HEADING, 1))).otherwise(0)


def heading_text(line: Column) -> Column:
    return F.when(line.startswith("#"), strip(F.regexp_extract(line, HEADING, 2))).otherwise("")


def is_fence(line: Column) -> Column:
    return line.contains("```") & line.rlike(FENCE)


def where_has(c: Column, marks: tuple[str, ...], body: Callable[[Column], Column]) -> Column:
    """``body(c)`` for texts with one of ``marks``, without which the body changes nothing: a plain search spares its patterns."""

    def tried(x: Column) -> Column:
        has = x.contains(marks[0])
        for m in marks[1:]:
            has = has | x.contains(m)
        return F.when(has, body(x)).otherwise(x)

    return let(c, tried)


def token_estimate(c: Column) -> Column:
    """1.5 tokens for each CJK ideograph and one for four other characters, rounded down."""
    cjk = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    return F.floor(cjk * 1.5 + (F.length(c) - cjk) / 4.0).cast("int")


def slug(c: Column) -> Column:
    """Letters, digits and ideographs, other runs as one underscore; 'chunk' if nothing is left."""
    runs = F.regexp_replace(c, "[^A-Za-z0-9一-鿿]+", "_")
    trimmed = F.lower(F.regexp_replace(runs, r"\A_+|_+\z", ""))
    return F.when(trimmed == "", F.lit("chunk")).otherwise(trimmed)


def is_table_separator(line: Column) -> Column:
    """Two cells or more, of which each that isn't empty is dashes with optional colons."""
    dashes = r"(?:\s*(?::?-{2,}:?)?\s*)"
    inner = strip(F.regexp_replace(strip(line), r"\A\|+|\|+\z", ""))
    return inner.rlike(rf"(?U)\A{dashes}(?:\|{dashes})+\z")


def contains_table(body: Column) -> Column:
    """Whether a line with a pipe is followed by a separator."""

    def pairs(lines: Column) -> Column:
        after = lambda i: F.coalesce(is_table_separator(F.get(lines, i + 1)), F.lit(False))
        return F.size(F.filter(lines, lambda x, i: x.contains("|") & after(i))) > 0

    return body.contains("|") & let(F.split(body, "\n", -1), pairs)


def context_text(breadcrumb: Column, body: Column) -> Column:
    path = F.when(F.size(breadcrumb) > 0, F.array_join(breadcrumb, " > ")).otherwise("(preamble)")
    return F.concat(F.lit("# "), path, F.lit("\n\n"), body)


def char_ngrams(c: Column, n: int = 5) -> Column:
    """64-bit hashes of the set of ``n``-character substrings without blanks; a shorter text is its own only member.

    The substrings are taken from an array of characters, since finding the i-th character of a
    string costs i steps. Hashes are half the size of the strings and sort faster.
    """
    def grams(chars: Column) -> Column:
        size = F.size(chars)
        places = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
        joined = lambda i: F.concat(*(F.get(chars, i + (k - 1)) for k in range(n)))
        whole = F.array(F.xxhash64(F.array_join(chars, "")))
        return F.when(size < n, whole).otherwise(F.array_distinct(F.transform(places, lambda i: F.xxhash64(joined(i)))))

    bare = F.regexp_replace(c, rf"(?U){BLANK}+", "")
    return let(F.filter(F.split(bare, ""), lambda x: x != ""), grams)
