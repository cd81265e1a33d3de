"""Source divergence, vector codes, span removal, and repairs of older operators, against brute force on small tables."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import divergence, mixing, span_graph, vector_codes, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"
CLASHING = {"n": "long", "p": "double", "held": "string", "terms": "string", "first": "long", "_k": "string", "key": "int", "spans": "string", "rank": "int", "start": "int"}


def clashing(df):
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in CLASHING.items()}).repartition(3)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Source divergence


def divergence_rows(rows, least, top):
    docs = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(TERM.findall(t), s) for t, x, s in docs if x == lang]
        own = [([w.translate(LOWER) for w in ws], s) for ws, s in own]
        df = Counter(w for ws, _ in own for w in set(ws))
        kept = sorted((w for w in df if df[w] >= least), key=str.encode)
        n = {s: Counter(w for ws, x in own if x == s for w in ws if df[w] >= least) for s in {s for _, s in own}}
        every = sum(n.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in n.items()}, share(every)
        for s in n:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in n if o != s]
            more = [(p[s][w] - q[w], w) for w in kept if n[s][w] and p[s][w] > q[w]]
            for part, xs in (("pair", pairs), ("term", more)):
                xs = sorted(xs, key=lambda x: (-x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(xs)]
    return sorted(out, key=repr)


def term_rows():
    random.seed(3)
    words = ["der", "Die", "DAS", "éa", "É", "x1y", "Ende.", "\U0001f600", "zz", "Ünd"]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 30))), random.choice(["de", "fr", None]), random.choice(["a", "b", "é", "", None])) for i in range(150)]
    return [*rows, (1, None, "en", "only"), (None, "   ", "es", "p"), (2, "", "es", "q"), (3, "der " * 700_000, "de", "a"), rows[0], rows[0]]


@pytest.mark.parametrize("least", [1, 30, 1000])
def test_divergence(spark, least):
    rows = term_rows()
    out = divergence.source_divergence(clashing(spark.createDataFrame(rows, DOCS)), least, top=3)
    assert got(out, "lang", "source", "part", "item", "value", "rank") == divergence_rows(rows, least, 3)


def test_divergence_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = term_rows()[:60]
    assert got(divergence.source_divergence(spark.createDataFrame(rows, DOCS).repartition(2), 3), "lang", "source", "part", "item", "value", "rank") == divergence_rows(rows, 3, 50)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_of_large_counts(spark):
    cases = [(5, 10**15), (10**15, 10**15), (123_456_789_012_345, 8 * 10**15), (1, 1)]
    out = spark.createDataFrame(cases, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("s")).collect()
    assert all(r["s"] == 1 + 10**9 * r["c"] // r["t"] for r in out)


# Vector codes


def lloyd(rows, parts, size, rounds):
    kept = [(i, label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for *_, v in kept) // parts)
    full = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    start = sorted(full, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:size]
    books = [[cut(v, p) for *_, v in start] for p in range(parts)]
    near = lambda: [[min(range(len(b)), key=lambda j: (d(cut(v, p), b[j]), j)) for p, b in enumerate(books)] for *_, v in full]
    for _ in range(rounds):
        codes = near()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for (*_, v), c in zip(full, codes, strict=True) if c[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes, h = near(), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d(cut(v, p), books[p][c]) for p, c in enumerate(cs)) for (*_, v), cs in zip(full, codes, strict=True)]
    total = defaultdict(int)
    for (_, label, _), e in zip(full, error, strict=True):
        total[label] += e
    return sorted(((i, bytes(c).hex(), e, total[label], h) for (i, label, _), c, e in zip(full, codes, error, strict=True)), key=repr)


def vectors(n, dim, levels=None):
    rng = np.random.default_rng(5)
    x = rng.integers(0, levels, (n, dim)).astype(float) / 4 if levels else rng.normal(size=(n, dim))
    rows = [(i, [float(np.float32(y)) for y in v], int(i % 3) if i % 7 else None) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [None] * dim, 1), (902, [float("nan")] * dim, None), (903, [float("inf")] + [0.0] * (dim - 1), 1), (904, [], 1), (905, [1.5], None)]
    return [*rows, *odd, (None, rows[0][1], 2), rows[3 % n], rows[3 % n], (3, rows[9 % n][1], 0)]


@pytest.mark.parametrize(("rows", "parts", "size", "rounds"), [(vectors(150, 16), 4, 8, 2), (vectors(150, 8, 2), 4, 16, 3), (vectors(40, 10), 16, 64, 2), (vectors(3, 4), 4, 1, 2)])
def test_vector_codes(spark, rows, parts, size, rounds):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    out = vector_codes.vector_codes(df, parts, size, rounds)
    assert got(out, "vec_id", "code", "error", "label_error", "codebooks_sha256") == lloyd(rows, parts, size, rounds)


def test_vector_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], schema)).columns[:2] == ["vec_id", "code"]


def test_bounds_spare_scans_and_keep_ties():
    rng = np.random.default_rng(2)
    near = rng.integers(-3000, 3000, (16, 4, 2))
    v = (near[rng.integers(0, 16, 4000)] + rng.integers(-40, 41, (4000, 4, 2))).astype(np.int64)
    books = np.ascontiguousarray(near.transpose(1, 0, 2)).astype(np.int64)
    books[:, 5] = books[:, 9]  # equal entries always tie
    state = vector_codes.assigned(v, books, None, None)
    assert state[3] == v.shape[0] * v.shape[1]
    new = books + rng.integers(-9, 10, books.shape)
    new[:, 5] = new[:, 9]
    moved = vector_codes.assigned(v, new, state[:3], vector_codes.Moves(books, new))
    assert np.array_equal(moved[0], vector_codes.assigned(v, new, None, None)[0])
    assert not (moved[0] == 9).any()
    assert moved[3] < state[3] / 2


# Span removal


def spans_left(rows, k):
    first = {}
    seqs = [(d, (t or ""), WORD.findall(t or "")) for d, t, *_ in rows]
    for d, _, w in seqs:
        if d is not None:
            for i in range(len(w) - k + 1):
                x = tuple(w[i : i + k])
                first[x] = min(first.get(x, d), d)
    out = []
    for d, _, w in seqs:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def span_rows():
    random.seed(8)
    pool = [f"w{i}" for i in range(30)] + ["é", "日本", "a\x00", "a"]
    text = lambda n: "".join(random.choice(pool) + random.choice([" ", "\n", "  ", "\t"]) for _ in range(n))
    base = [text(random.choice([3, 12, 13, 14, 60, 200])) for _ in range(40)]
    passages = [text(25) for _ in range(4)]
    rows = [(100 + i, t if i % 3 else t + passages[i % 4] + text(20) + passages[(i + 1) % 4] + text(5)) for i, t in enumerate(base)]
    long = text(4000)
    rows += [(7, long), (8, long[:9000] + " other " + long[9000:]), (9, long + long), (6, long[500:12000]), (5, "ha " * 900), (4, "ha " * 700 + base[0]), (3, "ab cd " * 300), (2, "cd ab " * 40)]
    return [*rows, (None, base[5]), (None, base[5]), (1, None), (1, ""), (1, " \n"), (105, base[5]), rows[5], rows[5], (20, base[7]), (21, base[7].upper())]


@pytest.mark.parametrize(("k", "gram", "piece"), [(13, 4, 1 << 20), (13, 4, 700), (5, 2, 300), (2, 1, 1 << 20)])
def test_spans(spark, monkeypatch, k, gram, piece):
    rows = span_rows()
    monkeypatch.setattr(span_graph, "SLICE", piece)
    kept = span_graph.dedup_spans(clashing(spark.createDataFrame(rows, "doc_id long, text string")), k, gram, with_text=True)
    assert got(kept, "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == spans_left(rows, k)


def test_spans_with_full_filters(spark):
    rows = span_rows()
    out = span_graph.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=1 << 9, with_text=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == spans_left(rows, 13)


def test_spans_of_nothing(spark):
    assert span_graph.dedup_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_paths_are_compact(spark):
    text = " ".join(f"{i}w" for i in range(3000))
    docs = spark.createDataFrame([(i, text) for i in range(5)] + [(9, text[:8000] + " but " + text[8000:])], "doc_id long, text string")
    keyed = span_graph.with_row_key(docs)
    bloom = lambda df, c: span_graph.bloom_of(df, c, df.count())
    known = bloom(span_graph.count_keys(keyed, 13, 4).where("n > 1"), "key")
    edges = span_graph.edges_of(keyed, known, 13, 4).persist()
    ends = edges.where("joins").select(F.col("id").bitwiseXOR(F.lit(span_graph.BEFORE)).alias("h")).union(edges.where("forks").select(F.col("id").bitwiseXOR(F.lit(span_graph.AFTER))))
    mixed = edges.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = span_graph.paths_of(keyed, bloom(edges, "id"), bloom(ends, "h"), bloom(mixed, "key"), 13, 4)
    assert met.count() < 6 * 60  # of 18,000 windows


# Repairs


def test_mixing_of_equal_rows(spark):
    words = " ".join(["w"] * 40)
    rows = [(7, words, "a")] * 2000 + [(i, words, "b") for i in range(2000)] + [(i % 9, words, "c") for i in range(1500)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).withColumn("over", F.col("taken") > 2 * F.col("size"))
    by = out.groupBy("target").agg(F.sum("taken").alias("taken"), F.max("over").alias("over")).collect()
    assert len(by) == 3
    assert all(abs(r["taken"] - r["target"]) <= 64 and not r["over"] for r in by)


def test_salvage_of_version_lines_is_linear():
    page = warc.record(1, "http://x/WARC/1.1", b"<p>", warc.digest(b"<p>"), None) + warc.END
    for line in (warc.VERSION, b"a:" + warc.VERSION, b"\r\n" + warc.VERSION, b"x" + warc.VERSION + b"y: 1\r\n\r\n"):
        data = page + b"X" + line * ((1 << 24) // len(line)) + page
        start = time.perf_counter()
        found = list(warc.walk_plain(data))
        assert time.perf_counter() - start < 20
        assert [f[2]["page_id"] if isinstance(f[2], dict) else "gap" for f in found] == [1, "gap", 1]
        assert [f[0] for f in found[1:]] == [f[1] for f in found[:-1]]


def test_hot_payloads_are_spread(spark):
    rows = [(i, f"u{i}", "" if i % 2 else None) for i in range(3000)] + [(5000 + i, "v", f"<p>{i % 50}") for i in range(200)]
    out = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    assert all(r["refers_to"] == 2999 for r in out if r["page_id"] < 2999)
