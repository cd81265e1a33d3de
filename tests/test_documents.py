"""Sections, blocks, chunks and pages against plain Python on small and derived documents."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import cleaning, html_table
from textloom.operators import blocks, chunks, pages, sections, structure
from textloom.plans import inputs
from textloom.plans.prepare import prepare_documents
from textloom.sources import files


def docs(spark, *texts):
    rows = [(i, f"s{i}.md", f"s{i}", "co", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, source string, id_prefix string, company string, text string")


def test_sections_and_fences(spark):
    got = sections.parse_sections(docs(spark, "pre\n\n# A\nx\n```\n# no\n```\n## B\n", "\n\n", "a\x0b# h b")).orderBy("doc_id", "sec").collect()
    assert [(r.doc_id, r.sec, r.level, r.heading, r.body) for r in got] == [
        (0, 0, 0, "", "pre"), (0, 1, 1, "A", "x\n```\n# no\n```"), (0, 2, 2, "B", ""), (2, 0, 0, "", "a"), (2, 1, 1, "h", "b"),
    ]


def test_breadcrumbs_follow_a_stack(spark):
    random.seed(5)
    texts = ["\n".join("#" * random.randint(1, 6) + f" h{i}" for i in range(30)) for _ in range(5)]
    got = sections.with_breadcrumbs(sections.parse_sections(docs(spark, *texts))).collect()
    for d, t in enumerate(texts):
        open_, want = [], {}
        for i, line in enumerate(t.split("\n")):
            level = line.index(" ")
            open_ = [x for x in open_ if x[0] < level] + [(level, f"h{i}")]
            want[i + 1] = [h for _, h in open_]
        assert {r.sec: r.breadcrumb for r in got if r.doc_id == d} == want


def test_primary_level(spark):
    got = sections.primary_levels(sections.parse_sections(docs(spark, "# a\n## b\n## c", "# a\n### b", "x"))).orderBy("doc_id").collect()
    assert [r.primary_level for r in got] == [2, 1, 2]


def test_merge_takes_in_higher_levels(spark):
    walked = sections.walked_sections(docs(spark, "## a\nx\n# t\ny\n## b\n" + "z" * 50 + "\n### c\n" + "w" * 50))
    got = sections.merge_small_sections(walked, 60).orderBy("sec").collect()
    assert [(r.heading, r.body) for r in got] == [("a", "x\n\n# t\ny"), ("b", "z" * 50), ("c", "w" * 50)]


def test_summary_cuts_at_blank_lines(spark):
    body = "a" * 120 + "\n\n" + "b" * 120 + "\n\n" + "c" * 120 + "\n\nd"
    df = spark.createDataFrame([(body,), ("x" * 400,), ("short",)], "body string")
    got = [r[0] for r in df.select(sections.section_summary(F.col("body"), F.lit("T"), F.lit(False))).collect()]
    assert got == ["a" * 120 + "\n\n" + "b" * 120, "x" * 300, "short"]


def test_blocks(spark):
    body = "intro\n| a | b |\n| --- | --- |\n| 1 | 2 |\nafter\n\n| x | y |\nz"
    got = blocks.split_blocks(docs(spark, body).select("doc_id", F.lit(1).alias("sec"), F.col("text").alias("body"))).orderBy("blk").collect()
    assert [(r.blk, r.kind, r.text) for r in got] == [
        (1, "prose", "intro"), (2, "table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), (3, "prose", "after\n\n| x | y |\nz"),
    ]


def test_table_packing_keeps_rows(spark):
    rows = [f"| {i} | {'v' * (i % 17)} |" for i in range(60)]
    table = "\n".join(["| a | b |", "| --- | --- |", *rows])
    df = spark.createDataFrame([(table,)], "t string")
    native = df.select(blocks.split_table(F.col("t"), 200)).first()[0]
    assert [x for p in native for x in p.split("\n")[2:]] == rows
    assert all(len(p) <= 200 and p.startswith("| a | b |\n| --- | --- |\n") for p in native)


def test_packing_of_many_pieces(spark):
    """200,000 pieces and 100,000 rows in one text; the work per piece doesn't grow with their number."""
    pieces = spark.range(1).select(F.transform(F.sequence(F.col("id") + 1, F.col("id") + 200_000), lambda i: F.concat(i.cast("string"), F.lit(" "))).alias("p"))
    start = time.perf_counter()
    pieces = pieces.persist()
    made = pieces.select(blocks.merge_with_overlap("p").alias("m")).select(F.posexplode_outer("m").alias("i", "x")).agg(F.max("i") + 1, F.max(F.length("x"))).first()
    want, n = 0, 0
    for i in range(1, 200_001):
        size = len(str(i)) + 1
        want, n = (want + 1, 80 + size) if n and n + size > 1800 else (want, n + size)
    assert tuple(made) == (want + 1, 1800)
    rows = F.array_join(F.transform(F.sequence(F.col("id") + 1, F.col("id") + 100_000), lambda i: F.concat(F.lit("| "), i.cast("string"), F.lit(" |"))), "\n")
    table = spark.range(1).select(F.concat(F.lit("| n |\n| --- |\n"), rows).alias("t"))
    counts = table.select(F.transform(blocks.split_table(F.col("t")), lambda x: F.size(F.split(x, "\n")) - 2).alias("c")).first()[0]
    assert sum(counts) == 100_000
    assert time.perf_counter() - start < 90


@pytest.mark.parametrize("overlap", [0, 3])
def test_hard_split(spark, overlap):
    df = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz",), ("",)], "t string")
    got = [r[0] for r in df.select(blocks.hard_split(F.col("t"), 10, overlap)).collect()]
    assert got[1] == []
    assert got[0] == [("abcdefghijklmnopqrstuvwxyz")[i : i + 10] for i in range(0, 26, 10 - overlap)]


def test_keep_separator_drops_empty_pieces(spark):
    df = spark.createDataFrame([("a\n\n\n\nb",)], "t string")
    assert df.select(blocks.split_keeping(F.col("t"), "\n\n")).first()[0] == ["a\n\n", "b"]


def test_merge_may_pass_the_limit(spark):
    df = spark.createDataFrame([(["x" * 60, "y" * 100],)], "p array<string>")
    assert [len(x) for x in df.select(blocks.merge_with_overlap("p", 100, 10)).first()[0]] == [60, 110]


def cut_by_hand(text, most, overlap, separators=blocks.SEPARATORS):
    """Recursion in plain Python: what the columns of ``recursive_split`` are to return."""
    if len(text) <= most:
        return [text]
    sep = next((x for x in separators if x in text), None)
    if sep is None:
        return [text[i : i + most] for i in range(0, len(text), max(1, most - overlap))]
    pieces = text.split(sep)
    pieces = [p + sep * (i < len(pieces) - 1) for i, p in enumerate(pieces) if p]
    out, held = [], ""
    for p in (y for x in pieces for y in cut_by_hand(x, most, overlap, separators[separators.index(sep) + 1 :])):
        if held and len(held) + len(p) > most:
            out.append(held)
            held = held[-overlap:] if 0 < overlap < len(held) else ""
        held += p
    return out + [held] * bool(held)


@pytest.mark.parametrize(("most", "overlap"), [(100, 0), (100, 10), (60, 7), (1800, 80)])
def test_recursive_split(spark, most, overlap):
    random.seed(2)
    words = ["word ", "end. ", "長句。", "what? ", "\n", "\n\n", "\n\n\n", "no！", "one; ", "two, ", "三，", "；", "x" * 70, "\U0001f600", ". ", " "]
    texts = ["".join(random.choice(words) for _ in range(n)) for n in (0, 1, 5, 60, 300, 900) for _ in range(4)] + ["a" * 1000, "\n" * 500, ". " * 300, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, `a text` string")
    got = {r.i: r.x for r in df.select("i", blocks.recursive_split("a text", most, overlap).alias("x")).collect()}
    assert got == {i: None if t is None else cut_by_hand(t, most, overlap) for i, t in enumerate(texts)}


def painted(rows):
    """Tables with spans by painting every cell of every row."""
    marks, grid = {}, []
    for r, cells in enumerate(rows):
        line = {c: t for (row, c), t in marks.items() if row == r}
        taken, own, at = set(line), {}, 0
        for text, across, down in cells:
            while at in taken:
                at += 1
            for c in range(at, at + across):
                own[c] = text
                marks |= {(d, c): text for d in range(r + 1, r + down)}
            at += across
        while at in taken:
            at += 1
        grid.append([(line | own)[c] for c in range(at)])
    width = max(map(len, grid), default=0)
    return [g + [""] * (width - len(g)) for g in grid if any(x.strip() for x in g)]


def test_spans_of_html_tables():
    random.seed(4)
    for _ in range(300):
        rows = [[(random.choice(["a", "b", "c d", ""]), random.choice([1, 1, 2, 3]), random.choice([1, 1, 2, 4])) for _ in range(random.randint(0, 4))] for _ in range(random.randint(0, 6))]
        html = "".join("<tr>" + "".join(f"<td colspan={a} rowspan='{d}'>{t}</td>" for t, a, d in cells) + "</tr>" for cells in rows)
        assert html_table.table_grid(f"<table>{html}</table>") == painted(rows)
    assert html_table.with_one_header([["k", "n", "n"], ["k", "x", ""], ["1", "2", "3"]]) == [["k", "n x", "n"], ["1", "2", "3"]]
    assert html_table.with_one_header([["k", "n", "m"], ["k", "x", "y"]]) == [["k", "n", "m"], ["k", "x", "y"]]


def test_heuristic_levels(spark):
    text = "# T\n# (1) a\n# Note2\n# 例子1：x\n# other\ntext\n#### 紅利"
    assert structure.heuristic_recover(docs(spark, text)).first().text == "# T\n#### (1) a\n#### Note2\n### 例子1：x\n## other\ntext\n### 紅利"


def test_levels_from_outside(spark):
    given = spark.createDataFrame([(0, 1, 3)], "doc_id long, line int, level int")
    got = structure.recover_structure(docs(spark, "# A\n# B", "# C\n# D"), given).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["### A\n# B", "# C\n## D"]


def test_broken_json_is_repaired(spark):
    answers = spark.createDataFrame([(1, 'x ```json\n{"L1": {"level": 1, "parent": null},}\n``` y'), (2, "none")], "doc_id long, response string")
    assert [(r.line, r.level) for r in structure.parse_levels(answers).collect()] == [(1, 1)]


def test_bad_answers_fall_back(spark):
    held = docs(spark, "# A\n# (1) b\n# c", "# A\n# b", "# A\n# b", "# A\n# b")
    rows = [(0, 0, '{"L1": {"level": 2}}'), (0, 1, "sorry"), (1, 0, '{"L1": {"level": 3}, "L2": {"level": 3}}'), (1, 1, '{"L2": {"level": 1}}'), (2, 0, "{}")]
    answers = spark.createDataFrame(rows, "doc_id long, batch int, response string")
    got = structure.recover_from_answers(held, answers).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["# A\n#### (1) b\n## c", "### A\n# b", "# A\n# b", "# A\n## b"]
    heads = structure.prompt_batches(structure.extract_headings(held), 2)
    report = structure.answer_report(heads, answers).orderBy("doc_id", "batch").collect()
    assert [(r.doc_id, r.batch, r.n_headings, r.n_levels, r.low_coverage, r.error) for r in report] == [
        (0, 0, 2, 1, True, None), (0, 1, 1, 0, True, "no object"), (1, 0, 2, 2, False, None), (2, 0, 2, 0, True, None), (3, 0, 2, 0, True, "no answer"),
    ]


def test_late_answers(spark, tmp_path):
    from textloom.streaming.answers import recovered_stream, settled

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.col("at") + 1000)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    asking, telling = "doc_id long, at long, n_batches int", "doc_id long, at long, batch int, response string"
    own = '{"L1": {"level": 2}, "Lx": {"level": 1}, "L2": {"level": null}}'
    streams = []
    for name, schema in (("asked", asking), ("told", telling)):
        (tmp_path / name).mkdir()
        streams.append(spark.readStream.schema(schema.replace("at long", "at timestamp")).parquet(str(tmp_path / name)))

    def run():
        q = settled(*streams, 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        q.trigger(availableNow=True).start().awaitTermination()
        return {r.doc_id: (r.outcome, r.levels) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    write("told", [(1, 5, 1, '{"L3": {"level": 4}, "L1": {"level": 3}}'), (9, 5, 0, own)], telling)  # 1's comes before its question, 9 was never asked about
    write("asked", [(1, 0, 2), (2, 0, 2), (3, 0, 1), (4, 0, 2), (5, 0, 0), (None, 0, 1), (6, 0, 1)], asking)
    first = run()
    assert first == {5: ("answered", {})}
    write("told", [(1, 50, 0, own), (2, 60, 0, own), (3, 60, 0, "sorry"), (4, 70, 1, own), (4, 70, 1, own), (None, 70, 0, own)], telling)
    second = run()
    assert second == first | {1: ("answered", {1: 3, 2: None, 3: 4}), 3: ("bad", None)}
    write("told", [(2, 101, 1, own), (1, 102, 0, "repeated"), (3, 103, 0, own), (6, 100, 0, own)], telling)  # 2's is a second late, 6's in time
    third = run()
    assert third == second | {2: ("late", None), 4: ("late", None), 6: ("answered", {1: 2, 2: None})}
    write("told", [(2, 900, 1, own), (4, 901, 0, own)], telling)
    assert run() == third and spark.read.parquet(str(tmp_path / "out")).count() == len(third)
    assert recovered_stream(docs(spark, "# A").select("doc_id", "text"), *streams).isStreaming


def test_prose_is_cut_where_its_meaning_breaks(spark):
    rng = random.Random(3)
    paragraphs = [f"p{i} " + "word " * rng.randint(5, 60) for i in range(40)]
    text = "# T\n\n" + "\n\n\n".join(paragraphs) + "\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n" + "alone. " * 100
    held = docs(spark, text, "# T\n\n" + "x " * 100 + "\n\n" + "y " * 100, "", "# U\n\nshort")
    asked = chunks.paragraphs_to_embed(held, 300)
    topic = (F.col("para") / 5).cast("int") % 2
    vectors = asked.where("doc_id = 0").withColumn("embedding", F.array((1 - topic).cast("float"), topic.cast("float")))
    assert [r.text for r in asked.where("doc_id = 0").orderBy("blk", "para").collect()][:40] == [p.strip() for p in paragraphs]
    made = chunks.chunk_documents(held, 300, 20, vectors).where("chunk_type = 'leaf'").orderBy("doc_id", "sec", "blk", "part").collect()
    groups = ["\n\n".join(p.strip() for p in paragraphs[i : i + 5]) for i in range(0, 40, 5)]
    want = [y for g in groups for y in cut_by_hand(g, 300, 20)]
    own = [r.content for r in made if r.doc_id == 0]
    assert own[: len(want)] == want
    assert own[len(want)].startswith("| a | b |") and own[len(want) + 1 :] == cut_by_hand(("alone. " * 100).strip(), 300, 20)
    plain = chunks.chunk_documents(held.where("doc_id = 1"), 300, 20).where("chunk_type = 'leaf'").orderBy("part").collect()
    assert [r.content for r in made if r.doc_id == 1] == [r.content for r in plain]


def test_names_and_text_files(spark, tmp_path):
    df = spark.createDataFrame([("/in/acme/a.md",), ("/x/Output/a.md",), ("a.md",)], "p string")
    assert [r[0] for r in df.select(files.company_of(F.col("p"))).collect()] == ["acme", "", ""]
    files.write_text(spark.createDataFrame([("one\ntwo",)], "md string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_chunk_tree(spark, sf_dir):
    made = chunks.chunk_documents(inputs.nation_docs(spark, sf_dir)).toPandas()
    assert not made.chunk_id.duplicated().any()
    by_id = made.set_index("chunk_id")
    for _, doc in made.groupby("doc_id"):
        numbers = sorted(int(x.rsplit("_", 1)[1]) for x in doc.chunk_id)
        assert numbers == list(range(1, len(doc) + 1))
    for r in made.itertuples():
        if r.chunk_type == "doc_summary":
            assert r.parent_id is None
            continue
        kind = {"section": "doc_summary", "leaf": "section", "table_row": "leaf"}[r.chunk_type]
        parent = by_id.loc[r.parent_id]
        assert parent.chunk_type == kind
        assert (r.chunk_id in list(parent.children_ids)) == (r.chunk_type != "table_row")
        if r.chunk_type == "table_row":
            assert parent.out_seq > r.out_seq
        assert list(r.sibling_ids) == [] or r.is_split_part


def test_nested_sets_and_odd_documents(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'v' * 30} |" for i in range(40))
    texts = [None, "", " \n", "no heading", "# T\n\n## A\n" + table + "\n\n" + "prose. " * 90 + "\n## B\nx\n## C", "# only", "## A\n\n## A\n\nx"]
    held = docs(spark, *texts).withColumns({c: F.lit(1) for c in ("enter", "part", "row", "content", "kind", "_s", "sec")})
    made = chunks.chunk_documents(held, 400, 20).collect()
    assert {r.doc_id for r in made if r.chunk_type == "doc_summary"} == set(range(len(texts)))
    assert {r.doc_id for r in made if r.chunk_type == "section"} == {3, 4, 6}
    by_id = {(r.doc_id, r.chunk_id): r for r in made}
    assert len(by_id) == len(made)
    for r in made:
        inside = {x.chunk_id for x in made if x.doc_id == r.doc_id and r.enter < x.enter <= r.leave}
        below, todo = set(), [r.chunk_id]
        while todo:
            more = [x.chunk_id for x in made if x.doc_id == r.doc_id and x.parent_id in todo]
            below.update(more)
            todo = more
        assert inside == below
        kinds = [x.chunk_id for x in sorted(made, key=lambda x: x.enter) if x.doc_id == r.doc_id and x.parent_id == r.chunk_id and x.chunk_type != "table_row"]
        assert r.children_ids == kinds
    assert chunks.chunk_documents(held.where("false")).count() == 0


def test_pages(spark):
    pool = [f"sentence number {i} about topic {i * 7} and more" for i in range(60)]
    texts = [" ".join(pool[i * 10 : i * 10 + 10]) for i in range(6)]
    page_rows = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)] + [(1, 7, "  ")], "doc_id long, page_no int, text string")
    held = [(1, 1, texts[2], "t"), (1, 2, texts[3] + " " + texts[4], ""), (1, 3, "nothing like it " * 4 + "zzz qqq", ""), (1, 4, "short", "")]
    rows = spark.createDataFrame(held, "doc_id long, chunk int, content string, section_title string")
    got = {r.chunk: (r.page_start, r.page_end) for r in pages.attribute_pages(rows, page_rows).collect()}
    assert got[1][0] == 3 and got[2][0] in (4, 5) and got[4] == (None, None)


def test_pages_of_a_long_text_cost_linear_time(spark):
    odd = ["", None, "x" * 1000, "y" * 1001, "續𝒳\r\n\u2028\x85 " * 500, "\n" * 2500, "𝒳" * 1500 + "é" * 700]
    got = inputs.paged(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()
    wanted = {(i, at // 1000 + 1, x and x[at : at + 1000]) for i, x in enumerate(odd) for at in range(0, max(len(x or ""), 1), 1000)}
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    for n in (1_000, 500_000):  # the first is a warm-up
        long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é line\n續 "), n).alias("text"))
        start = time.perf_counter()
        row = inputs.paged(long).agg(F.count("*"), F.sum(F.length("text")), F.bit_xor(F.xxhash64("page_no", "text"))).first()
    assert time.perf_counter() - start < 6
    assert tuple(row)[:2] == (4_500, 4_500_000)


def test_pages_of_long_documents_by_the_index(spark):
    pool = [f"sentence {i * 31 % 97} of topic {i * 7 % 23} and of number {i}" for i in range(300)]
    page_rows = [(d, i + 1, " ".join(pool[i * 5 : i * 5 + 5])) for d in (1, 2) for i in range(60)]
    page_rows += [(2, 3, "a second page of this number " + pool[20]), (1, 61, "  "), (3, 1, None), (None, 1, pool[0] * 3), (2, 70, pool[99])]
    held = [(d, i, " ".join(pool[i * 4 : i * 4 + 6]), "topic") for d in (1, 2) for i in range(50)]
    held += [(1, 7, " ".join(pool[100:130]), None), (2, None, " ".join(pool[33:36]), ""), (1, 90, "nothing like it " * 4 + "zzz qqq", ""), (1, 91, None, None)]
    held += [(1, 92, "", ""), (None, 1, pool[0] * 3, ""), (3, 1, pool[0] * 3, ""), (4, 1, pool[0] * 3, ""), (1, 93, "of topic 7 and of number 7 of topic 9 and of number", "")]
    rows = spark.createDataFrame(held, "doc_id long, chunk int, content string, section_title string")
    texts = spark.createDataFrame(page_rows, "doc_id long, page_no int, text string")
    in_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = in_rows(pages.page_ranges(rows, texts))
    assert len(whole) > 90 and any(end > start for _, _, start, end in whole)
    assert in_rows(pages.page_ranges(rows, texts, task_chars=0)) == whole  # all by the index
    assert in_rows(pages.page_ranges(rows, texts, task_chars=37_000)) == whole  # one of two
    assert pages.page_ranges(rows, texts.where("false"), task_chars=0).count() == 0
    assert pages.page_ranges(rows.where("false"), texts, task_chars=0).count() == 0


def test_long_tables_dont_overflow_the_stack(spark):
    table = "| a | b |\n| --- | --- |\n" + "".join(f"| {i} | x |\n" for i in range(30_000))
    held = docs(spark, table + "\nmiddle\n\n" + table, "| a |\nx")
    got = [r.text for r in held.select(cleaning.dedup_tables(F.col("text")).alias("text")).collect()]
    assert got == [table + "\nmiddle\n\n", "| a |\nx"]


def test_lists_of_siblings_are_not_broadcast(spark):
    table = "## A\n| a | b |\n| --- | --- |\n" + "".join(f"| {i} | some words |\n" for i in range(400))
    made = chunks.chunk_documents(docs(spark, table, table), 400, 20).select("doc_id", "chunk_id", "chunk_type", "is_split_part", "sibling_ids")
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    rows = made.collect()
    parts = {d: [r.chunk_id for r in rows if r.doc_id == d and r.is_split_part and r.chunk_type == "leaf"] for d in (0, 1)}
    assert len(parts[0]) > 20
    for r in rows:
        assert sorted(r.sibling_ids) == sorted(x for x in parts[r.doc_id] if r.chunk_id in parts[r.doc_id] and x != r.chunk_id)


def in_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pages_dealt_out_in_blocks(spark):
    """Documents cut into many blocks and parts have the pages that they have in one row, equal pages, repeated numbers and copies included."""
    random.seed(3)
    pool = [f"row {i} of {i % 7} and {i * i % 11}" for i in range(500)]
    texts = [(d, no, " ".join(random.choices(pool, k=12))) for d in (1, 2) for no in [*range(1, 60), 90, 91, 91]]
    texts += [(1, 200 + i, texts[40][2]) for i in range(3)]
    held = [(d, random.randrange(80), t[:150] + " " + random.choice(texts)[2][:100], random.choice(["row", "", None])) for d, _, t in random.choices(texts, k=150)]
    held += [(1, 5, None, texts[7][2]), (1, 5, texts[7][2], None), *held[:20]]
    rows = spark.createDataFrame(held, "doc_id long, chunk int, content string, section_title string")
    page_rows = spark.createDataFrame(texts, "doc_id long, page_no int, text string")
    whole = in_rows(pages.page_ranges(rows, page_rows))
    assert len(whole) > 100 and any(end > start + 1 for _, _, start, end in whole)
    for block_chars in (700, 5_000):
        assert in_rows(pages.page_ranges(rows, page_rows, task_chars=0, block_chars=block_chars)) == whole
    assert in_rows(pages.match_pages(rows, page_rows)) == sorted([x[:3] for x in whole], key=repr)


def test_best_page_where_grams_are_common(monkeypatch):
    """Rare grams first give the page that counting all gives."""
    random.seed(4)
    texts = ["".join(random.choice("ab 0") for _ in range(60)) + f"{i % 40:04d}|{i % 3}" for i in range(300)]
    sets = pages.gram_sets(texts, 5)
    index = pages.PageIndex(list(range(len(sets))), sets)
    asked = [pages.gram_sets([random.choice(texts)[random.randrange(30) :] + random.choice(texts)[: random.randrange(40)]], 5)[0] for _ in range(300)]
    monkeypatch.setattr(pages, "FEW", 32)
    for grams in asked:
        hits = [len(np.intersect1d(grams, x)) for x in sets]
        for need in (1, len(grams) // 2, len(grams)):
            want = (max(hits), hits.index(max(hits))) if max(hits) >= need else None
            assert index.best(grams, need) == want


def test_tables_with_spans_are_spread_over_tasks(spark, sf_dir):
    tables = inputs.spanned_tables(spark, sf_dir)
    assert tables.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.count() == inputs.table(spark, sf_dir, "customer").count()


def test_whole_preparation_round_trip(spark, tmp_path):
    folder = tmp_path / "in" / "acme"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# T\r\n\r\n# 備註\r\ntext\r\n<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>\r\n")
    (folder / "b.txt").write_text("no")
    found = files.read_documents(spark, str(tmp_path / "in"))
    assert [(r.company, r.source, r.id_prefix) for r in found.collect()] == [("acme", "a.md", "a")]
    files.write_chunks(prepare_documents(found), str(tmp_path / "out"))
    back = files.read_chunks(spark, str(tmp_path / "out")).orderBy("chunk_id").collect()
    assert [r.chunk_type for r in back] == ["doc_summary", "section"]
    assert "| a | b |" in back[1].content and back[0].children_ids == [back[1].chunk_id] and back[0].parent_id == ""


def test_incremental_runs(spark, tmp_path):
    from textloom.streaming.incremental import chunk_stream

    source, out, state = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for i, name in enumerate(("a", "b")):
        (source / f"{name}.md").write_text(f"# {name}\n\ntext\n")
        chunk_stream(spark, str(source), out, state).awaitTermination()
        assert files.read_chunks(spark, out).select("source").distinct().count() == i + 1
    (source / "acme + co 公司").mkdir()
    (source / "acme + co 公司" / "c.md").write_text("# c\n\ntext\n")
    chunk_stream(spark, str(source), out, state).awaitTermination()
    assert {r[0] for r in files.read_chunks(spark, out).where("source = 'c.md'").select("company").collect()} == {"acme + co 公司"}


def test_page_files_split_anywhere(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "in" / "a co"
    folder.mkdir(parents=True)
    pool = [f"sentence {i * 31 % 97} of topic {i * 7 % 23} and of number {i}" for i in range(400)]
    made = {}
    for name in ("long", "short one", "blank", "empty"):
        n = {"long": 300, "short one": 3, "blank": 2, "empty": 0}[name]
        texts = [" ".join(pool[i : i + rng.randrange(1, 9)]) + "\nü 續" if name != "blank" and i % 11 else " \r\n"[: i % 3] for i in range(n)]
        made[name] = [x.replace("\r\n", "\n").replace("\r", "\n") for x in texts]
        end = "" if name == "short one" else "\f"  # a last page without its end
        (folder / f"{name}.txt").write_bytes(("\f".join(texts) + end if texts else "").encode())
        (folder / f"{name}.md").write_text("\n\n".join(["# T", *(f"## S{i}\n\n{x}" for i, x in enumerate(texts[:40]))]))
    base = str(tmp_path / "in")
    ids = {r.source[:-3]: r.doc_id for r in files.read_documents(spark, base).collect()}
    wanted = {(ids[name], i + 1, x) for name, texts in made.items() for i, x in enumerate(texts)}
    whole = files.read_pages(spark, base)
    ranges = lambda: {(r.chunk_id, r.page_start, r.page_end) for r in prepare_documents(files.read_documents(spark, base), pages=files.read_pages(spark, base)).collect()}
    assert {(r.doc_id, r.page_no, r.text) for r in whole.collect()} == wanted
    before = ranges()
    assert sum(start is not None for _, start, _ in before) > 30
    settings = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert files.read_pages(spark, base).rdd.getNumPartitions() > 100
        got = files.read_pages(spark, base).collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4001")
        after = ranges()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(got) == len(wanted) and {(r.doc_id, r.page_no, r.text) for r in got} == wanted
    assert after == before


def test_page_files_are_read_once(spark, tmp_path, monkeypatch):
    """Files read whole give what lines ended by form feeds give, from one scan and without a shuffle."""
    mark, pool = b"\xef\xbb\xbf", [b"", b"\f", b"\f\f", b"a", b"a\f", b"a\fb", b"a\r\f\nb\r\n\f\r", b"\0\f\0", b" \f\n\f", b"\r\r\n\f\n\r"]
    bodies = [*pool, *pool, *(mark + x for x in pool), mark + mark + b"a", b"a\f" + mark + b"b", mark[:2], mark[:2] + b"\f" + mark[2:]]
    bad = (b"\xe4", b"\xe4\xbd", b"\xf0\x9f\x98", b"\x80", b"\xff\xfe", b"\xed\xa0\x80")
    bodies += [y for x in bad for y in (x, x + b"\f", x + b"\fz", b"q" + x + b"\f" + x)]
    bodies += [b"\f".join(b"%d of many pages" % i for i in range(k)) for k in (200, 900)]
    for i, x in enumerate(bodies):
        (tmp_path / f"file={i} +% \u00fc").mkdir()
        (tmp_path / f"file={i} +% \u00fc" / "part.txt").write_bytes(x)
        (tmp_path / f"file={i} +% \u00fc" / "part.csv").write_bytes(b"no\f")
    (tmp_path / "none").mkdir()
    read = lambda base=tmp_path: files.read_pages(spark, str(base))
    plan = lambda: read()._jdf.queryExecution().executedPlan().toString()
    whole = read().collect()
    assert plan().count("FileScan") == 1 and "Exchange" not in plan()
    of = {i: [r.text for r in sorted(whole, key=lambda r: r.page_no) if f"/file={i} +% ü/" in r.path] for i in range(len(bodies))}
    for i, x in enumerate(bodies):
        pages = x.removeprefix(mark).decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n").split("\f")
        # What replaces bad bytes is Java's, so only the pages are counted there.
        wanted = pages[: None if pages[-1] else -1]
        assert len(of[i]) == len(wanted) and ("\ufffd" in "".join(pages) or of[i] == wanted)
    assert len(whole) == len({(r.path, r.page_no) for r in whole}) == len({(r.doc_id, r.page_no) for r in whole})
    # By blocks all, then the two long ones, then one.
    for most, blocks in ((0, True), (2_000, True), (8_000, True), (1 << 20, False)):
        monkeypatch.setattr(files, "WHOLE", most)
        assert in_rows(read()) == sorted(map(tuple, whole), key=repr) and ("Exchange" in plan()) == blocks
    assert read(tmp_path / "none").count() == 0


def test_outputs_are_published_whole(spark, tmp_path):
    import os

    out = tmp_path / "out" / "batch=3"
    seen = lambda: sorted(r.md for r in spark.read.text(str(out)).toDF("md").collect())
    files.write_text(spark.createDataFrame([("one",), ("two",)], "md string"), str(out))
    assert seen() == ["one", "two"]
    # A task fails after others have written, then the run is cut off half way, its hidden folder left.
    broken = spark.range(0, 2_000, 1, 4).select(F.when(F.col("id") == 1_999, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("md"))
    with pytest.raises(Exception, match="lost"):
        files.write_text(broken, str(out))
    assert seen() == ["one", "two"] and os.listdir(out.parent) == ["batch=3"]
    left = out.parent / ".batch=3-0123"
    left.mkdir()
    (left / "part-00000.txt").write_text("half")
    assert spark.read.text(str(out.parent)).count() == 2
    for _ in range(2):
        files.write_text(spark.createDataFrame([("new",)], "md string"), str(out))
        assert seen() == ["new"]
    assert sorted(x for x in os.listdir(out.parent) if not x.startswith(".batch=3-0123")) == ["batch=3"]
