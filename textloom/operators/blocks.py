"""Blocks of a section's body, tables cut by rows, and prose cut by characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_table_separator, let, strip, strip_lf
from .sections import joined_lines

#: Fixed list: where prose may be cut, coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ", " ")


def split_blocks(sections: DataFrame) -> DataFrame:
    """(doc_id, sec, blk, kind, text): tables and the prose between them, in order.

    A table starts at the first line of a run of pipe lines whose next line is a separator, and
    ends with the run.
    """
    lines = sections.select("doc_id", "sec", F.posexplode_outer(F.split("body", "\n", -1)).alias("pos", "line"))
    section = Window.partitionBy("doc_id", "sec")
    so_far = section.orderBy("pos")
    pipe = F.col("line").contains("|") & ~is_blank(F.col("line"))
    starts = pipe & F.coalesce(is_table_separator(F.lead("line").over(so_far)), F.lit(False))
    lines = lines.withColumns({"pipe": pipe, "starts": starts})
    lines = lines.withColumn("run", F.sum((~F.col("pipe")).cast("int")).over(so_far))
    first = F.min(F.when(F.col("starts"), F.col("pos"))).over(Window.partitionBy("doc_id", "sec", "run"))
    lines = lines.withColumn("table", F.col("pipe") & F.coalesce(F.col("pos") >= first, F.lit(False)))
    lines = lines.withColumn("key", F.when(F.col("table"), F.col("run")).otherwise(-1))
    new = F.coalesce(F.lag("key").over(so_far) != F.col("key"), F.lit(True))
    lines = lines.withColumn("_b", F.sum(new.cast("int")).over(so_far))
    found = lines.groupBy("doc_id", "sec", "_b", "table").agg(joined_lines("pos", F.col("line"), F.lit(True)).alias("text"))
    kind = F.when(F.col("table"), "table").otherwise("prose")
    found = found.select("doc_id", "sec", "_b", kind.alias("kind"), F.when(F.col("table"), F.col("text")).otherwise(strip_lf(F.col("text"))).alias("text"))
    found = found.where("text <> ''")
    return found.withColumn("blk", F.row_number().over(section.orderBy("_b"))).select("doc_id", "sec", "blk", "kind", "text")


def table_rows(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: ~is_blank(x))


#: How many items a pushed list gathers before they move to its full part, so that a push copies few of them.
GATHERED = 256


def nothing_pushed(kind: str) -> list[Column]:
    return [F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("few")]


def pushed(acc: Column, when: Column, x: Column) -> list[Column]:
    """``acc`` with ``x`` at its end if ``when``; a list of n items costs n * sqrt(n) steps at most, not n * n."""
    few = F.array_append(acc["few"], x)
    moves = F.size(acc["few"]) >= GATHERED
    return [
        F.when(when & moves, F.array_append(acc["full"], few)).otherwise(acc["full"]).alias("full"),
        F.when(~when, acc["few"]).when(moves, F.slice(acc["few"], 1, 0)).otherwise(few).alias("few"),
    ]


def all_pushed(acc: Column) -> Column:
    return F.flatten(F.array_append(acc["full"], acc["few"]))


def group_starts(sizes: Column, limit: Column) -> Column:
    """Where each group starts (from 1) if items are packed into groups of at most ``limit``, one item at least."""
    start = F.struct(*nothing_pushed("int"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def step(acc: Column, size: Column) -> Column:
        new = (acc["i"] == 0) | (acc["n"] + size > limit)
        return F.struct(*pushed(acc, new, acc["i"] + 1), (acc["i"] + 1).alias("i"), F.when(new, size).otherwise(acc["n"] + size).alias("n"))

    return F.aggregate(sizes, start, step, all_pushed)


def split_table(text: Column, max_chars: int = 1800) -> Column:
    """A table as an array of tables of about ``max_chars``, each with header and separator."""

    def cut(rows: Column) -> Column:
        head = F.slice(rows, 1, 2)
        used = F.length(F.get(rows, F.lit(0))) + F.length(F.get(rows, F.lit(1))) + 2
        sizes = F.transform(F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0))), lambda x: F.length(x) + 1)
        group = lambda s, end: F.array_join(F.concat(head, F.slice(rows, s + 2, end - s)), "\n")
        made = lambda starts: F.transform(starts, lambda s, i: group(s, F.coalesce(F.get(starts, i + 1), F.size(rows) - 1)))
        return F.when(F.size(rows) < 3, F.array(text)).otherwise(let(group_starts(sizes, F.lit(max_chars) - used), made))

    return let(table_rows(text), cut)


def split_keeping(text: Column, sep: str) -> Column:
    """Pieces that keep the separator after them; empty pieces go, with their separator."""

    def kept(parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.when(p == "", F.lit(None)).when(i < F.size(parts) - 1, F.concat(p, F.lit(sep))).otherwise(p))

    return F.array_compact(let(F.split(text, rf"\Q{sep}\E", -1), kept))


def joined_sql(pieces: str, max_chars: int, overlap: int, d: int = 0) -> str:
    """SQL that joins the array ``pieces`` (a name) up to ``max_chars``, each part but the first starting with the last ``overlap`` characters of the one before.

    What is folded over the pieces holds only where parts start, as its state is copied at each step; a start is
    negative if its part has no overlap. As ``overlap`` is at most a third of ``max_chars``, two parts before one are enough to take it from.
    """
    if 3 * overlap > max_chars:
        raise ValueError("overlap must be at most a third of max_chars")
    a, p = f"a{d}", f"p{d}"
    full, moves = f"{a}.n > 0 AND {a}.n + length({p}) > {max_chars}", f"size({a}.few) >= {GATHERED}"
    tailed = f"({a}.n > {overlap} AND {overlap} > 0)"
    at = f"IF({tailed}, {a}.i, -{a}.i)"
    starts = f"""aggregate({pieces}, named_struct('full', CAST(array() AS ARRAY<ARRAY<INT>>), 'few', array(-1), 'i', 1, 'n', 0),
        ({a}, {p}) -> IF({full}, named_struct('full', IF({moves}, array_append({a}.full, {a}.few), {a}.full), 'few', IF({moves}, array({at}), array_append({a}.few, {at})),
          'i', {a}.i + 1, 'n', IF({tailed}, {overlap}, 0) + length({p})), named_struct('full', {a}.full, 'few', {a}.few, 'i', {a}.i + 1, 'n', {a}.n + length({p}))),
        {a} -> flatten(array_append({a}.full, {a}.few)))"""
    back = f"abs(get(w{d}, greatest(j{d} - 2, 0)))"
    tail = f"IF(s{d} > 0, substring(array_join(slice({pieces}, {back}, s{d} - {back}), ''), -{overlap}, {overlap}), '')"
    own = f"array_join(slice({pieces}, abs(s{d}), coalesce(abs(get(w{d}, j{d} + 1)), size({pieces}) + 1) - abs(s{d})), '')"
    made = f"get(transform(array({starts}), w{d} -> transform(w{d}, (s{d}, j{d}) -> concat({tail}, {own}))), 0)"
    return f"IF(size({pieces}) = 0, CAST(array() AS ARRAY<STRING>), {made})"


def merge_with_overlap(column: str, max_chars: int = 1800, overlap: int = 80) -> Column:
    """The pieces in the array ``column``, none of them empty, joined as by ``joined_sql``."""
    return F.expr(f"get(transform(array(`{column}`), r -> {joined_sql('r', max_chars, overlap)}), 0)")


def hard_split(text: Column, max_chars: int = 1800, overlap: int = 80) -> Column:
    """Stretches of ``max_chars`` that start every max_chars - overlap characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(max(1, max_chars - overlap)))
    return F.when(F.length(text) > 0, F.transform(at, lambda i: F.substring(text, i, F.lit(max_chars)))).otherwise(F.array().cast("array<string>"))


def recursive_split(column: str = "text", max_chars: int = 1800, overlap: int = 80) -> Column:
    """The prose of ``column`` as an array of parts of about ``max_chars``, cut at the coarsest separator that occurs.

    Pieces that are still too long are cut at finer separators, each by one level of functions inside
    the one before, and joined again as by ``merge_with_overlap``; what is left without any is cut at fixed places.
    Null gives null. It is written as SQL, which builds the thirteen levels in a fraction of the time.
    """

    def pieces(x: str, sep: str) -> str:
        if sep == "\n\n":  # may overlap itself
            kept = f"transform(w, (q, i) -> CASE WHEN q = '' THEN NULL WHEN i < size(w) - 1 THEN concat(q, '{sep}') ELSE q END)"
            return f"get(transform(array(split({x}, '{sep}', -1)), w -> filter({kept}, q -> q IS NOT NULL)), 0)"
        return rf"filter(split({x}, r'(?<=\Q{sep}\E)', -1), q -> q <> '' AND q <> '{sep}')"

    def cut(x: str, d: int) -> str:
        if d == len(SEPARATORS):
            return f"IF(length({x}) > {max_chars}, transform(sequence(1, greatest(length({x}), 1), {max(1, max_chars - overlap)}), i -> substring({x}, i, {max_chars})), array({x}))"
        has = f"contains({x}, '{SEPARATORS[d]}')"
        finer = f"flatten(transform(IF({has}, {pieces(x, SEPARATORS[d])}, array({x})), x{d + 1} -> {cut(f'x{d + 1}', d + 1)}))"
        return f"IF(length({x}) <= {max_chars}, array({x}), get(transform(array({finer}), r{d} -> IF({has}, {joined_sql(f'r{d}', max_chars, overlap, d)}, r{d})), 0))"

    return F.expr(f"IF(`{column}` IS NULL, NULL, get(transform(array(`{column}`), x0 -> {cut('x0', 0)}), 0))")


def semantic_groups(paragraphs: DataFrame, threshold: float = 0.6, window: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``grp`` to (*keys, para, embedding): it grows where a similarity falls below threshold * local mean.

    Similarities are rounded to six decimals, so that a break doesn't hang on the order of sums.
    """
    order = Window.partitionBy(*keys).orderBy("para")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    safe = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    after = F.lead("embedding").over(order)
    sims = paragraphs.withColumn("next", after)
    sim = F.round(dot(F.col("embedding"), F.col("next")) / (safe(norm(F.col("embedding"))) * safe(norm(F.col("next")))), 6)
    sims = sims.withColumn("sim", F.when(F.col("next").isNotNull(), sim)).drop("next")
    mean = F.avg("sim").over(order.rowsBetween(-window, window))
    sims = sims.withColumn("broken", (mean > 0) & (F.col("sim") < mean * threshold))
    before = F.coalesce(F.lag("broken").over(order), F.lit(False))
    return sims.withColumn("_new", before.cast("int")).withColumn("grp", F.sum("_new").over(order)).drop("_new", "broken")


BLOCK = ("doc_id", "sec", "blk")


def long_paragraphs(blocks: DataFrame, max_chars: int = 1800) -> DataFrame:
    """(doc_id, sec, blk, para, text): what of prose blocks over ``max_chars`` is to be embedded; blocks of one paragraph have none."""
    held = F.filter(F.transform(F.split("text", "\n\n", -1), strip), lambda x: x != "")
    long = blocks.where((F.col("kind") == "prose") & (F.length("text") > max_chars)).withColumn("_p", held).where(F.size("_p") > 1)
    return long.select(*BLOCK, F.posexplode("_p").alias("para", "text"))


def semantic_texts(paragraphs: DataFrame, vectors: DataFrame, threshold: float = 0.6, window: int = 3) -> DataFrame:
    """(doc_id, sec, blk, texts): the paragraphs of each block joined between breaks of meaning, in order.

    ``vectors`` has doc_id, sec, blk, para and embedding. Blocks of which a paragraph has no vector
    are left out. Repeated vectors of a paragraph would repeat it: there is to be one.
    """
    met = paragraphs.join(vectors.select(*BLOCK, "para", "embedding"), [*BLOCK, "para"], "left")
    parts = semantic_groups(met, threshold, window, BLOCK).groupBy(*BLOCK, "grp").agg(
        F.array_sort(F.collect_list(F.struct("para", "text"))).alias("p"), F.bool_and(F.col("embedding").isNotNull()).alias("whole")
    )
    own = F.struct("grp", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
    made = parts.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(own)).alias("g"), F.bool_and("whole").alias("whole"))
    return made.where("whole").select(*BLOCK, F.transform("g", lambda x: x["text"]).alias("texts"))
