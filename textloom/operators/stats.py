"""Statistics and review output of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_stats(chunks: DataFrame, min_chars: int = 80) -> DataFrame:
    """One row: counts, and least, mean (rounded down) and most of characters and tokens."""
    n = F.count("*")
    mean = lambda c: F.floor(F.sum(c) / n).cast("long")
    return chunks.agg(
        n.alias("n_chunks"),
        F.min("char_count").alias("min_chars"),
        mean("char_count").alias("avg_chars"),
        F.max("char_count").alias("max_chars"),
        F.min("est_token_count").alias("min_tokens"),
        mean("est_token_count").alias("avg_tokens"),
        F.max("est_token_count").alias("max_tokens"),
        F.count_if("has_table").alias("n_table"),
        F.floor(F.count_if("has_table") * 100 / n).cast("long").alias("table_percent"),
        F.count_if("is_split_part").alias("n_split"),
        F.count_if(F.col("char_count") < min_chars).alias("n_tiny"),
    )


def chunk_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"))


def match_rate(chunks: DataFrame) -> DataFrame:
    """Chunks with and without pages, and whole per cents."""
    n, hit = F.count("*"), F.count("page_start")
    return chunks.agg(
        hit.alias("matched"),
        (n - hit).alias("unmatched"),
        F.floor(hit * 100 / n).cast("long").alias("matched_percent"),
        F.floor((n - hit) * 100 / n).cast("long").alias("unmatched_percent"),
    )


def review_markdown(chunks: DataFrame, min_chars: int = 80) -> DataFrame:
    """(doc_id, md): each document's review text of statistics, contents and chunks."""
    doc = Window.partitionBy("doc_id")
    path = F.when(F.size("breadcrumb") > 0, F.array_join("breadcrumb", " > ")).otherwise("(前言)")
    table = F.when(F.col("has_table"), " [表]").otherwise("")
    note = F.when(F.col("is_split_part"), F.format_string(" *(子块 %d/%d)*", "split_part_index", "split_part_total")).otherwise("")
    toc = F.concat(F.format_string("%d. `%s` [%s]", "out_seq", "chunk_id", "chunk_type"), table, F.lit(" — "), path, note)
    count_of = lambda c, label: F.when(F.size(c) > 0, F.format_string(f"**{label}**: %d 个", F.size(c)))
    meta = F.concat_ws(
        " · ",
        F.format_string("**类型**: %s", "chunk_type"),
        F.concat(F.lit("**路径**: "), path),
        F.format_string("**章节**: %s (H%d)", F.when(F.col("section_title") != "", F.col("section_title")).otherwise("(无)"), "heading_level"),
        F.format_string("**%d 字符 ≈ %d tokens**", "char_count", "est_token_count"),
        F.when(F.coalesce("parent_id", F.lit("")) != "", F.format_string("**父块**: %s", "parent_id")),
        count_of("children_ids", "子块"),
        count_of("sibling_ids", "兄弟块"),
        F.when(F.col("is_split_part"), F.format_string("**子块**: %d / %d", "split_part_index", "split_part_total")),
        F.when(F.coalesce("table_caption", F.lit("")) != "", F.format_string("**表格**: %s", "table_caption")),
    )
    anchor = F.format_string('<a id="%s"></a>', F.translate(F.lower("chunk_id"), "_", "-"))
    head = F.concat(F.format_string("## 块 %d / %d: `%s` ", "out_seq", "n", "chunk_id"), table)
    body = F.concat_ws("\n", F.lit("---\n"), anchor, head, F.lit(""), meta, F.lit(""), F.regexp_replace("content", r"(?U)\s+\z", ""), F.lit(""))
    rows = chunks.withColumn("n", F.count("*").over(doc)).withColumns({"toc": toc, "body": body})
    found = rows.groupBy("doc_id").agg(
        F.max("n").alias("n"),
        F.max("source").alias("source"),
        F.max("company").alias("company"),
        *[f(c).alias(f"{a}_{c}") for c in ("char_count", "est_token_count") for a, f in (("min", F.min), ("sum", F.sum), ("max", F.max))],
        F.count_if("has_table").alias("n_table"),
        F.count_if("is_split_part").alias("n_split"),
        F.count_if(F.col("char_count") < min_chars).alias("n_tiny"),
        F.array_sort(F.collect_list(F.struct("out_seq", "toc", "body"))).alias("rows"),
    )
    span = lambda c, label: F.format_string(
        f"- **{label}** (min / avg / max): %d / %d / %d", f"min_{c}", F.floor(F.col(f"sum_{c}") / F.col("n")), f"max_{c}"
    )
    part = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "\n")
    md = F.concat_ws(
        "\n",
        F.format_string("# 切分输出: %s", "source"),
        F.when(F.col("company") != "", F.format_string("**公司**: %s", "company")),
        F.lit("\n## 总览统计\n"),
        F.format_string("- **总块数**: %d", "n"),
        span("char_count", "字符数"),
        span("est_token_count", "估算 token"),
        F.format_string("- **含表格的块数**: %d (%d%%)", "n_table", F.floor(F.col("n_table") * 100 / F.col("n"))),
        F.format_string("- **被进一步切开的子块数**: %d", "n_split"),
        F.format_string(f"- **过短 (<{min_chars} 字符) 的块数**: %d", "n_tiny"),
        F.lit("\n## 目录\n"),
        part("toc"),
        F.lit(""),
        part("body"),
    )
    return found.select("doc_id", md.alias("md"))


def batch_report(results: DataFrame) -> DataFrame:
    """(status, n) of a batch (company, name, error): succeeded and failed documents."""
    status = F.when(F.col("error").isNull(), "succeeded").otherwise("failed")
    return results.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def batch_failures(results: DataFrame) -> DataFrame:
    """(company, name, error) of the documents that failed, a row each, so that any number of them is no burden."""
    return results.where("error is not null").select("company", "name", "error")
