"""The classifier's scores and the stages of the pipeline against brute force, on a table with nulls, repeats, odd texts and planted cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import decontaminate, quality_classifier

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def statistics(text):
    """The eleven inputs of a score, counted one by one."""
    data = (text or "").encode()
    words, count = WORD.findall(data), lambda chars: sum(c in chars for c in data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeats = sum(any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(i - 2, 0), min(i, len(words) - 3) + 1)) for i in range(len(words)))
    n, chars = len(words), sum(len(w.decode()) for w in words)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    rate = lambda x, of, eps: math.log((x + eps) / (of + 1) + eps)
    return [
        math.log(n + 1) / 3, rate(count(b"#*$%&|<>"), n, 0.02), rate(upper, upper + lower + 1, 0.02), math.log((chars + 5) / (n + 1)),
        rate(repeats, n, 0.02), rate(len(lines) - len(set(lines)), len(lines), 0.05), rate(count(b"0123456789"), chars, 0.01),
        rate(count(b".!?"), n, 0.02), rate(count(b"!"), n, 0.02), rate(len(set(words)), n, 0.02), rate(sum(a == b for a, b in zip(words, words[1:], strict=False)), n, 0.02),
    ]


def densities(rows, labels):
    """Scores by the densities of two normal distributions with shrunk covariances."""
    told = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            told[i].append(q)
    x = np.array([statistics(r[1]) for r in rows])
    classes = [x[[r[0] in told and (np.mean(told[r[0]]) >= 0.5) == k for r in rows]] for k in (False, True)]
    cov = [np.cov(c.T) for c in classes]
    n = [len(c) for c in classes]
    pooled = sum((m - 1) * c for m, c in zip(n, cov, strict=True)) / (sum(n) - 2)
    z = math.log(n[1] / n[0])
    for sign, c, own in zip((-1, 1), cov, classes, strict=True):
        s = 0.9 * c + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s))
        d = x - own.mean(0)
        z = z - sign * 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    pool = ["".join(rng.choices("abcdefgéñ", k=rng.randint(1, 9))) for _ in range(3000)]
    good = lambda n: " ".join(rng.choice(pool) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY", "now!!!", "$$$", "7777", "win", "|"]) for _ in range(n))
    texts = [(i, (bad if i % 3 == 0 else good)(rng.randint(20, 200))) for i in range(150)]
    clean = [t for i, t in texts if i % 3]
    passage = "\n".join(good(30).replace("\n", " ") for _ in range(2))
    texts += [(200 + i, clean[i] + " tail") for i in range(10)]  # near copies
    texts += [(220 + i, good(60) + "\n" + passage + "\n" + good(60)) for i in range(4)]  # a passage that repeats
    item = good(40)
    texts += [(240, good(80) + "\n" + item + "\n" + good(80)), (241, None), (242, ""), (243, " \n\t"), (None, good(90)), (None, good(90)), (5, good(90)), (244, good(30_000))]
    texts += [texts[1]] * 3
    rows = [(i, t, "en" if i else None, f"s{(i or 0) % 4}" if (i or 0) % 9 else None, len(t or ""), None, "x") for i, t in texts]
    labels = [(i, int(i % 3 > 0)) for i in range(150)] + [(3, 1), (4, None), (None, 1), (999, 0), (241, 0)]
    return rows, labels, [(1, item), (2, None), (3, "x")], passage


def test_scores_are_densities(spark, corpus):
    rows, labels, _, _ = corpus
    got = quality_classifier.score_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = densities(rows, labels)
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    pairs = zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(((r[0], float(s)) for r, s in zip(rows, want, strict=True)), key=key), strict=True)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 for a, b in pairs)


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def near_classes(rows):
    """A class for each row: what a similarity of 0.8 or more links, directly or through others, or equal sets."""
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    rows, labels, bench, passage = corpus
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, held = dict(corpus_pipeline.STAGES), [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for name in list(stages)[:-1]:
        held.append(stages[name](spark, held[-1], str(tmp_path)).persist())
        assert held[-1].columns == held[0].columns
    _, judged, lines, distinct, clean = (x.collect() for x in held)

    # Quality: by the densities.
    sure = [(r, s) for r, s in zip(rows, densities(rows, labels), strict=True) if abs(s - 0.7) > 0.01]
    assert len(sure) > len(rows) - 3 and 0 < len(judged) < len(rows)
    assert {(r[0], r[1]): s >= 0.7 for r, s in sure} == {(r[0], r[1]): (r[0], r[1]) in {(j.doc_id, j.text) for j in judged} for r, _ in sure}
    # Lines: the passage stays once, other lines and documents stay, but for whole copies.
    texts = Counter(r.text for r in judged)
    left = "\n".join(r.text or "" for r in lines)
    assert left.count(passage) == 1 < sum((r.text or "").count(passage) for r in judged)
    assert {r.doc_id for r in judged} == {r.doc_id for r in lines}
    assert all(r.text in texts for r in lines if r.doc_id is not None and 6 <= r.doc_id < 150 or r.doc_id == 244)
    # Near duplicates: one of each class of all pairs.
    classes = near_classes(lines)
    place = defaultdict(set)
    for r, c in zip(lines, classes, strict=True):
        place[r.doc_id, r.text].add(c)
    assert Counter(c for r in distinct for c in place[r.doc_id, r.text]) == Counter(set(classes)) and len(distinct) < len(lines)
    # Decontamination: what holds the item's text goes.
    item = decontaminate.normal(bench[0][1].encode())
    leaks = [r for r in distinct if item in decontaminate.normal((r.text or "").encode())]
    assert [r.doc_id for r in leaks] == [240]
    assert Counter(map(tuple, clean)) == Counter(map(tuple, distinct)) - Counter(map(tuple, leaks))
    # Mixing: all of ``run``, each document within twice its size, all sizes together times 1.5 taken but for the blocks' rest.
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size = lambda t: len(WORD.findall((t or "").encode()))
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r.doc_id, size(r.text)) for r in clean)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    assert abs(sum({(r.source_size, r.target): r.target for r in out}.values()) - 1.5 * total) < 1 and abs(sum(r.taken for r in out) - 1.5 * total) < 0.02 * total


def test_stages_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, ddl in (("documents", DOCS), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
