"""Goldens of the text functions, one for each behaviour that is easy to get wrong."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import cleaning, text
from textloom.functions.html_table import table_markdown


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def one(spark, f, value):
    return apply(spark, f, value)[0]


def test_tokens(spark):
    assert apply(spark, text.token_estimate, "保險ab12", "", "abcd", "abc") == [4, 0, 1, 0]


def test_slug(spark):
    assert apply(spark, text.slug, "A b-保險!", "__", "x") == ["a_b_保險", "chunk", "x"]


def test_strip_is_unicode(spark):
    assert apply(spark, text.strip, " a　", "\u001cb ", " \n") == ["a", "b", ""]


def test_rstrip_lines(spark):
    assert one(spark, text.rstrip_lines, "a \t\nb \n\nc ") == "a\nb\n\nc"


@pytest.mark.parametrize(
    ("line", "level", "heading"), [("## x  ", 2, "x"), ("####### x", 0, ""), ("#x", 0, ""), ("# a # b", 1, "a # b"), ("#　x", 1, "x")]
)
def test_headings(spark, line, level, heading):
    assert one(spark, text.heading_level, line) == level
    assert one(spark, text.heading_text, line) == heading


def test_table_separator(spark):
    values = ["| --- | --- |", "| --- |", "|:--|--:|", "| - | --- |", "", "| --- | |", "a | b", "---|---"]
    assert apply(spark, text.is_table_separator, *values) == [True, False, True, False, False, True, False, True]


def test_contains_table(spark):
    assert apply(spark, text.contains_table, "a | b\n--- | ---", "a\n--- | ---", "| a |\n\n| --- | --- |") == [True, False, False]


def test_images_eat_the_blanks_after_them(spark):
    assert one(spark, cleaning.drop_images, "text ![i](u)\n\n# head") == "text # head"



def test_stray_lines(spark):
    assert one(spark, cleaning.drop_stray_lines, "a\n\nOK\n\nb") == "a\nb"
    assert one(spark, cleaning.drop_stray_lines, "a\nAB\nCD\nb") == "a\nCD\nb"
    assert one(spark, cleaning.drop_stray_lines, "a\nABCD\nb") == "a\nABCD\nb"


def test_bullets(spark):
    assert one(spark, cleaning.normalize_bullets, "· a\n  • b\n . c\n.d") == "- a\n- b\n- c\n.d"


def test_details(spark):
    assert one(spark, cleaning.unwrap_details, "<details><summary> s </summary> b\n</details>") == "**s**\n\nb"
    assert one(spark, cleaning.unwrap_details, "<DETAILS>\n<summary>s</summary>\n</DETAILS>") == "**s**"


@pytest.mark.parametrize(
    ("before", "after"),
    [
        (r"${ }^{>}3 0$", ">30"),
        (r"${ \tt > } 3 5 { \tt ) }$", ">35)"),
        (r"\textcircled { \textbf { 5 } } \%", "5%"),
        (r"$\left( { \mathfrak { g } } \right)$", "(g)"),
        (r"$\ddagger$", "‡"),
        (r"$^ +$", "⁺"),
        (r"a$^ \circ$", "a"),
        (r"$12.5%$", "12.5%"),
        (r"$^ 4 5 \%$", "4 5%"),
        (r"$ . 5 0 \%$", "0.5 0%"),
        (r"$ 1 2 . 5 \% $", "12.5%"),
        (r"cost $5 $10", "cost 510"),
        (r"$ \% $", "%"),
        (r"$ x $", "$ x $"),
    ],
)
def test_latex(spark, before, after):
    assert one(spark, cleaning.fix_latex, before) == after


def test_dedup_compares_two_rows_only(spark):
    t = "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    other = t + "| 9 | 9 |\n"
    assert one(spark, cleaning.dedup_tables, t + "x\n" + t + "y\n" + other) == t + "x\ny\n"
    assert one(spark, cleaning.dedup_tables, t + "x\n" + t[:-1]) == t + "x\n" + t[:-1]


def test_stitch(spark):
    doc = "<table><tr><td>a</td></tr></table>\n# T(續)\nx\n<table><tr><td>b</td></tr></table>\nend"
    assert one(spark, cleaning.stitch_tables, doc) == "<table>\n<tr><td>a</td></tr>\n<tr><td>b</td></tr>\n</table>\nend"
    far = doc.replace("x\n", "x\n" * 6)
    assert one(spark, cleaning.stitch_tables, far) == far
    wide = doc.replace("(續)", "（續）")
    assert one(spark, cleaning.stitch_tables, wide) == wide


def stitched(doc):
    """By looking at the five lines before every table."""
    found = list(re.finditer(r"(?is)<table[^>]*>.*?</table>", doc))
    goes_on = [i > 0 and any(re.match(r"(?i)#{1,6}\s+.+\((續|cont'?d|continued)\)\s*$", x) for x in doc[: m.start()].split("\n")[-6:-1]) for i, m in enumerate(found)]
    out, at = "", 0
    for i, m in enumerate(found):
        cells = re.sub(r"(?i)\A<table[^>]*>|</table>\s*\Z", "", m[0])
        more = goes_on[i + 1] if i + 1 < len(found) else False
        if goes_on[i]:
            out += "\n" + cells + ("" if more else "\n</table>")
        else:
            out += doc[at : m.start()] + ("<table>\n" + cells if more else m[0])
        at = m.end()
    return out + doc[at:]


def test_stitch_like_brute_force(spark):
    parts = ["<table>\n<tr></tr>\n</table>", "<TABLE a='b'><tr>1</tr></TABLE>", "\n", "\n", "\n", "x", "# T(續)", "## U (Cont'd) ", "### V(continued)\n", "\x01", "# W", "<table"]
    rng = random.Random(5)
    docs = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(300)]
    assert apply(spark, cleaning.stitch_tables, *docs, None, "") == [*map(stitched, docs), None, ""]
    assert sum(stitched(d) != d for d in docs) > 30


def test_stitch_of_many_tables(spark):
    took = []
    for n in (2_000, 20_000):
        doc = "\n".join(f"# T{i}(續)\n<table><tr><td>{i}</td></tr></table>" for i in range(n))
        start = time.perf_counter()
        assert one(spark, cleaning.stitch_tables, doc).count("<table>") == 1
        took.append(time.perf_counter() - start)
    assert took[1] < 20 * took[0] + 5


def test_post_clean(spark):
    assert one(spark, cleaning.post_clean, "a\r\nb\rc  \n\n\n\nd\n|  |\n") == "a\nb\nc\n\nd\n"
    assert one(spark, cleaning.post_clean, "a\n| --- | --- |\nb") == "a\nb\n"
    assert one(spark, cleaning.post_clean, "a\n| --- | --- |\n| 1 | 2 |") == "a\n| --- | --- |\n| 1 | 2 |\n"


def html(*rows):
    return "<table>" + "".join("<tr>" + "".join(r) + "</tr>" for r in rows) + "</table>"


def td(x, **spans):
    return "<td" + "".join(f' {k}="{v}"' for k, v in spans.items()) + f">{x}</td>"


def lines(x):
    return table_markdown(x).split("\n")


def test_html_plain():
    assert lines(html([td("a"), td("b|c")], [td("x x"), td("")], [td(""), td("")])) == ["| a | b\\|c |", "| --- | --- |", "| x |  |"]


def test_html_spans_and_header():
    got = lines(html([td("k", rowspan=2), td("v", colspan=2)], [td("a"), td("b")], [td("1"), td("2"), td("3")]))
    assert got == ["| k | v a | v b |", "| --- | --- | --- |", "| 1 | 2 | 3 |"]


def test_html_footnote_and_one_column():
    assert lines(html([td("a"), td("b")], [td("1"), td("2")], [td("note", colspan=2)]))[-2:] == ["", "note"]
    assert lines(html([td("a")], [td("b")])) == ["| a |", "| --- |", "", "b"]


def test_html_odd_input():
    assert table_markdown("<table></table>") == ""
    assert lines(html([td("1.2 2"), td("a a a", colspan="x")])) == ["| 1.2 | a a |", "| --- | --- |"]


def test_cleaning_leaves_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["text"] for r in cleaning.clean_markdown(df).orderBy("doc_id").collect()] == [None, "\n"]
