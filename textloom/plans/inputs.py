"""Markdown, HTML and page inputs derived from the tables, for queries and benchmarks.

The tables hold no Markdown structure; these build it from their rows, the same way in Spark and
in the SQL of ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def joined(order: list, piece: Column, sep: str = "\n") -> Column:
    """Aggregate: pieces in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, piece.alias("piece"))))
    return F.array_join(F.transform(rows, lambda r: r["piece"]), sep)


def described(docs: DataFrame, prefix: str) -> DataFrame:
    """Add the columns that chunking wants."""
    name = F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.concat(name, F.lit(".md")).alias("source"), name.alias("id_prefix"), F.lit("").alias("company"), "text")


def conversation_docs(spark: SparkSession, sf_dir: str, variant: str = "") -> DataFrame:
    """One document per conversation, a heading for each turn.

    Variants: 'paragraphs' doubles line feeds in texts, 'fenced' adds a code block with a comment
    after the first turn, 'titles' varies the headings' wording.
    """
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    turn = F.col("turn").cast("string")
    if variant == "titles":
        kind = F.col("turn") % 5
        head = F.concat(
            F.lit("# "),
            F.when(kind == 0, F.concat(F.lit("("), turn, F.lit(") item")))
            .when(kind == 1, F.concat(F.lit("Note"), turn))
            .when(kind == 2, F.lit("Example a"))
            .when(kind == 3, F.concat(F.lit("例子1："), turn))
            .otherwise(F.concat(F.lit("Topic "), turn)),
        )
    else:
        head = F.when(F.col("role") == "assistant", F.concat(F.lit("### Reply "), turn)).otherwise(F.concat(F.lit("## Turn "), turn, F.lit(" "), F.col("role")))
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")) if variant == "paragraphs" else F.col("text")
    piece = F.concat(head, F.lit("\n\n"), text)
    if variant == "fenced":
        piece = F.concat(piece, F.when(F.col("turn") <= 1, F.lit("\n```\n# not a heading\n```")).otherwise(""))
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(joined(["turn", "role", "text"], piece, "\n\n").alias("body"))
    title = F.concat(F.lit("# Conversation "), F.col("doc_id").cast("string"), F.lit("\n\n"))
    return described(docs.select("doc_id", F.concat(title, "body").alias("text")), "conv_")


def nation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per region: its nations as a table, and a section with a customer table for each nation."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    row = F.concat_ws(" | ", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    held = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(joined(["c_custkey"], F.concat(F.lit("| "), row, F.lit(" |"))).alias("rows"))
    text = F.concat(
        F.lit("## "), "n_name", F.lit("\n\nCustomers of "), "n_name", F.lit("\n\n| c_custkey | c_name | c_mktsegment |\n| --- | --- | --- |\n"), "rows", F.lit("\n")
    )
    named = nation.join(held, "n_nationkey").withColumn("part", text)
    small = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    docs = named.groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(joined(["n_nationkey"], small).alias("small"), joined(["n_nationkey"], F.col("part")).alias("parts"))
    whole = F.concat(F.lit("# Region "), F.col("doc_id").cast("string"), F.lit("\n\n| key | nation |\n| --- | --- |\n"), "small", F.lit("\n\n"), "parts")
    return described(docs.select("doc_id", whole.alias("text")), "region_")


def noisy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with extraction debris put in, by the remainder of their id."""
    kind = F.col("doc_id") % 12
    noise = F.lit("")
    for k, text in NOISE.items():
        noise = F.when(kind == k, F.lit(text)).otherwise(noise)
    return text_docs(spark, sf_dir).select("doc_id", F.concat(noise, "text", F.lit("  \n\n\n\n· item  \n\nOK\n\nend\t\n")).alias("text"))


NOISE = {
    0: "a $ 1 2 . 5 $ b $ 3 \\% $ ",
    1: "$^ 4 5 \\%$ ",
    2: "$ . 5 0 \\%$ ",
    3: "x$\\ddagger$ y $^ +$ ",
    4: "![i](u)\n\nnext ",
    5: "one<br>two<BR/>three ",
    6: "AB\n\nAB\n\nC\n \ntext\n. dot\n",
    7: "a\r\nb\rc $5 $10 ",
    8: "\\textcircled { \\textbf { 7 } } \\% ",
    9: "$ \\left ( { \\mathfrak { b } } \\right ) $ ",
    10: "25 $^ \\circ$ ",
    11: "$ 12.5 % $ ",
}


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tbl, html): a table of its customers for each nation, without spans."""
    customer = table(spark, sf_dir, "customer")
    cells = F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("</td><td>"), "c_name", F.lit("</td><td> "), "c_mktsegment", F.lit(" x x</td></tr>"))
    rows = customer.groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(joined(["c_custkey"], cells, "").alias("rows"))
    head = "<table><tr><th>key</th><th>name</th><th>segment</th></tr>"
    return rows.select("doc_id", F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html"))


SPANNED = (
    ("<tr><th rowspan=2>key</th><th colspan='2'>", "</th></tr><tr><th>first</th><th>last</th></tr><tr><td>1</td><td>a</td><td>b</td></tr>"),
    ("<tr><td>k</td><td>v</td></tr><tr><td>1</td><td>2</td></tr><tr><td colspan=2>note ", "</td></tr>"),
    ("<tr><td>", "</td></tr><tr><td>one</td></tr><tr><td>two</td></tr>"),
    ("<tr><td>a</td><td>x x tail tail tail</td></tr><tr><td>1</td><td>", " | y</td></tr>"),
    ("<tr><td>a</td><td></td></tr><tr></tr><tr><td> </td><td></td></tr><tr><td>", "</td><td>1</td></tr>"),
    ("<tr><td rowspan=9>", "</td><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td><td>more</td></tr>"),
)


def spanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, html): for each customer one of six tables with spans, notes, one column, repeated words, blanks, or spans past the end."""
    # Small rows with much work each: a file of a few megabytes, which a task would read alone, is spread over all.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(tasks)
    kind, html = F.col("c_custkey") % len(SPANNED), F.lit("")
    for k, (head, tail) in enumerate(SPANNED):
        html = F.when(kind == k, F.concat(F.lit(f"<table>{head}"), "c_name", F.lit(f"{tail}</table>"))).otherwise(html)
    return customer.select(F.col("c_custkey").cast("long").alias("doc_id"), html.alias("html"))


def continued_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's HTML table, cut in two by a heading that says so for even keys, and by another for odd ones."""
    nation = table(spark, sf_dir, "nation")
    mark = F.when(F.col("n_nationkey") % 2 == 0, "(續)").otherwise("(other)")
    text = F.concat(
        F.lit("# "), "n_name", F.lit("\n<table><tr><td>a</td><td>"), "n_name", F.lit("</td></tr></table>\n\n# "), "n_name", mark,
        F.lit("\nfoot line\n<table><tr><td>b</td><td>"), "n_name", F.lit("</td></tr></table>\nafter"),
    )
    return nation.select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))


def table_run_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of twenty ids as one document of tables: most go on after the one before, some stand too far below the heading that says so."""
    key = F.coalesce("doc_id", F.lit(0))
    says = F.when(key % 5 == 0, "").when(key % 2 == 0, "(續)").otherwise("(Cont'd)")
    lines = F.when(key % 7 == 0, "\n1\n2\n3\n4\n5\n").otherwise("\nfoot\nmore\n")
    held = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "<#", "  ").alias("t"))
    piece = F.concat(F.lit("# Part "), key.cast("string"), says, lines, F.lit("<table><tr><td>"), "t", F.lit("</td></tr></table>\n"))
    return held.groupBy(F.floor(F.col("doc_id") / 20).alias("doc_id")).agg(joined([key, F.col("t")], piece, "").alias("text"))


def page_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files: the texts of a hundred ids each, in order, as pages that end with a form feed."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("file"), "doc_id", F.translate(F.coalesce("text", F.lit("")), "\f\r", "  ").alias("value"))
    folder = shared_folder(spark, "pages")
    docs.repartition("file").sortWithinPartitions("file", "doc_id", "value").drop("doc_id").write.mode("overwrite").partitionBy("file").text(folder, lineSep="\f")
    return folder


def repeated_table_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's table of nations three times, the last time with another last row."""
    nation = table(spark, sf_dir, "nation")
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    docs = nation.groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(joined(["n_nationkey"], row).alias("rows"))
    head, other = "| key | nation |\n| --- | --- |\n", "| 99 | other |\n| 1 | x |\n"
    table_text = F.concat(F.lit(head), "rows", F.lit("\n"))
    text = F.concat(table_text, F.lit("\nmiddle\n\n"), table_text, F.lit("\n"), F.lit(head + other), F.lit("\nlast\n\n"), F.lit(head), "rows", F.lit("\n| 7 | more |\n"))
    return docs.select("doc_id", text.alias("text"))


def pages_of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): a document's text in stretches of 1,000 characters."""
    return paged(text_docs(spark, sf_dir))


def paged(docs: DataFrame) -> DataFrame:
    # One pass over the text: finding the i-th character of a string costs i steps, for each page anew. Possessive, so that nothing is kept to go back to.
    cut = F.when(F.length("text") > 0, F.regexp_extract_all("text", F.lit(r"(?s).{1,1000}+"), F.lit(0))).otherwise(F.array("text"))
    return docs.select("doc_id", F.posexplode(cut).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page_no"), "text")


def chunks_of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk, content, section_title): stretches of 700 characters that overlap by 80, and as chunk 0 one of the next smaller id."""
    docs = text_docs(spark, sf_dir)
    at = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / 620).cast("int"))
    own = docs.select("doc_id", "source", "text", F.explode(at).alias("i")).select("doc_id", (F.col("i") + 1).alias("chunk"), F.expr("substring(text, i * 620 + 1, 700)").alias("content"), F.col("source").alias("section_title"))
    foreign = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.lit(0).alias("chunk"), F.substring("text", 1, 700).alias("content"), F.col("source").alias("section_title"))
    return own.unionByName(foreign)


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): an .md for every page, a .pdf beside it for even ids."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    stem = F.concat(F.lit("/base/"), host, F.lit("/docs/page_"), F.col("page_id").cast("string"))
    md = pages.select(F.concat(stem, F.lit(".md")).alias("path"))
    return md.unionByName(pages.where("page_id % 2 = 0").select(F.concat(stem, F.lit(".pdf")).alias("path")))
