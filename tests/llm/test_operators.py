"""The corpus operators against brute force on small tables with nulls, repeats and odd texts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import (
    common,
    decontaminate,
    line_dedup,
    lm_scoring,
    mixing,
    near_dedup,
    quality_classifier,
    rule_ledger,
    secrets,
    simhash,
    suffix_dedup,
    suffix_sort,
    warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    random.seed(11)
    pool = ["".join(random.choice("abcdefgéßñ") for _ in range(random.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(random.choice(pool) + random.choice(["", ".", "\n", ""]) for _ in range(n))
    base = [text(random.choice([3, 40, 90, 200])) for _ in range(30)]
    near = [base[5][:300] + " changed " + base[5][309:], base[6] + " tail"]
    odd = [None, "", " \n\t ", "one", "a" * 900, "ab" * 400, base[0], base[0], base[7] + "\n" + base[8] + "\n" + base[9], text(6000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(base + near + odd)]
    return [*rows, (None, base[1], None, None, None), (3, base[3], "en", "s0", 1), (3, base[3], "en", "s0", 1), (3, "other text of a repeated id", "en", "s1", 1)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = "score double, fp long, spans string, rest string, _k long, size int, key string"
    df = spark.createDataFrame(rows, DOCS)
    for c in clashing.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(frame, *columns):
    """Rows as a multiset, for results of tables with repeated ids."""
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_secrets(spark, docs, rows, empty):
    assert secrets.scan_secrets(empty).count() == 0
    assert set(pairs(secrets.scan_secrets(docs).where("spans <> ''"), "spans")) == {("hex:0:900",), ("hex:0:800",)}
    texts = [
        'é PassWord = "hunter22hunter" x', "token: abc", "AKIA" + "B2" * 8 + " AKIAB", "f" * 40 + " " + "0" * 31, None,
        "ſecret=aaaaaaaaaaaa", 'login: bob@x ... secret="' + "q" * 20 + '" https://h.example/x', "login: bob only http://a.b", "aB3" * 13 + "a",
        "AKIA" + "C" * 16 + " " + "aB3" * 13 + "a", "secret=token=abcdefghi",
    ]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].spans == "assign:2:28" and got[1].spans == "" and got[2].spans == "access:0:20" and got[3].spans == "hex:0:40"
    assert (got[4].spans, got[5].spans, got[7].spans, got[8].spans) == ("", "", "", "")
    assert [x.split(":")[0] for x in got[6].spans.split(",")] == ["weak_id", "assign", "endpoint"]
    assert [x.split(":")[0] for x in got[9].spans.split(",")] == ["access", "weak_secret"]
    assert got[0].base_sha256 == hashlib.sha256(b"assign:2:28").hexdigest() and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[10].spans == "assign:0:22"


def edits_to_stretch(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
        prev = cur
    return min(prev)


def linked_by_all_pairs(text, scope):
    """Spans of a text: every weak candidate held against every other part."""
    data = text.encode()
    found = [(m.start(), m.end(), 0) for m in secrets.ASSIGN.finditer(data) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), 1) for m in secrets.ACCESS.finditer(data) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), 2) for m in secrets.HEX.finditer(data)]
    weak = [(m.start(), m.end(), 3) for m in secrets.WEAK_ID.finditer(data)]
    weak += [(m.start(), m.end(), 4) for m in secrets.ASSIGN.finditer(data) if 4 <= len(m[2]) < 8]
    mixes = (rb"[A-Z]", rb"[a-z]", rb"[0-9]")
    weak += [(m.start(), m.end(), 4) for m in secrets.WEAK_TOKEN.finditer(data) if all(re.search(x, m[0]) for x in mixes)]
    weak += [(m.start(), m.end(), 5) for m in secrets.ENDPOINT.finditer(data)]
    weak = [w for w in weak if not any(a < w[1] and w[0] < b for a, b, _ in found)]
    place = lambda x: (len(data[: x[0]].decode()), len(data[: x[1]].decode()), x[2])
    base, weak = [place(x) for x in found], [place(x) for x in weak]
    role = lambda x: ["secret", "id", "secret", "id", "secret", "endpoint"][x[2]]

    def complete(w, p):
        if abs(w[0] - p[0]) > scope or role(w) == role(p):
            return False
        return p in base and role(p) != "endpoint" if "endpoint" in (role(w), role(p)) else True

    kept = base + [w for w in weak if any(complete(w, p) for p in base + weak)]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in sorted(kept, key=lambda x: (x[0], x[2])))


def test_secret_linking_matches_all_pairs(spark):
    random.seed(21)
    token = lambda n: "".join(random.choice("aB3dE5fG7+/") for _ in range(n))
    made = [
        lambda: f"login: user{random.randrange(99)}", lambda: f'client_id="{token(6)}"', lambda: f"token={token(5)}",
        lambda: f"secret: {token(12)}", lambda: "AKIA" + "Q7" * 8, lambda: "0f" * 17, lambda: token(40),
        lambda: "https://h.example/p?token=abcd", lambda: "10.0.0.1:80", lambda: "é" * random.randrange(90), lambda: "word " * random.randrange(60),
    ]
    texts = [" ".join(random.choice(made)() for _ in range(random.randrange(1, 14))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for scope in (400, 60):
        want = [linked_by_all_pairs(t, scope) for t in texts]
        assert {r.doc_id: r.spans for r in secrets.scan_secrets(frame, scope).collect()} == dict(enumerate(want))
        assert sum("weak" in x or "endpoint" in x for x in want) > 100


def test_alignment_matches_brute_force():
    random.seed(3)
    letters = "abcdefghijklmnop "
    draw = lambda n: "".join(random.choice(letters) for _ in range(n))
    for _ in range(60):
        item = draw(random.choice([40, 80, 120]))
        changed = list(item)
        for _ in range(random.randint(0, len(item) // 8)):
            changed[random.randrange(len(changed))] = random.choice(["", "zz", "q"])
        text = draw(random.randint(0, 150)) + "".join(changed) + draw(random.randint(0, 150))
        item, text = (decontaminate.normal(x.encode()) for x in (item, text))
        index = decontaminate.build_index([(1, item)], 0.1, 120, 24)
        found = decontaminate.matches(index, [b"", text])
        least = edits_to_stretch(item, text)
        assert (1 in found) == (least <= index.edits[0])
        if found:
            assert found[1][1][0] == least


def test_decontamination(spark, docs, rows, empty):
    long = [r for r in rows[:30] if len(r[1]) > 300]
    item, other = long[0][1], long[1][1]
    bench = spark.createDataFrame([(1, item[:100]), (2, None), (3, ""), (4, "short"), (5, "z" * 80), (None, other[:60])], "item_id long, text string")
    want = {(r[0], n) for r in rows for n, x in ((1, item[:100]), (None, other[:60])) if r[1] and decontaminate.normal(x.encode()) in decontaminate.normal(r[1].encode())}
    for size in (1 << 20, 60):
        assert set(pairs(decontaminate.find_leaks(docs, bench, block_bytes=size), "doc_id", "item_id")) == want
        kept = decontaminate.drop_leaks(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and kept.count() == len(rows) - sum(r[0] in {d for d, _ in want} for r in rows)
    none = bench.limit(0)
    assert decontaminate.find_leaks(docs, none).count() == 0 and decontaminate.drop_leaks(docs, none).count() == len(rows)
    assert decontaminate.find_leaks(empty, bench).count() == 0


def test_chunk_boundaries_follow_the_content():
    random.seed(4)
    lines = [f"line {random.random()} with enough words in it".encode() for _ in range(200)]
    chunker = line_dedup.Chunker()
    a, b = chunker.chunks(b"\n".join(lines)), chunker.chunks(b"\n".join([b"new", *lines]))
    assert b"".join(a) == b"\n".join(lines) and len(set(a) & set(b)) > 0.9 * len(a)


def test_rolling_hashes_name_runs_of_lines_wherever_they_stand():
    random.seed(5)
    lines = [random.choice([b"", b"a", b"b", b"a longer line", "é".encode()]) for _ in range(300)]
    spans = np.array([(a, b) for a in range(300) for b in range(a + 1, min(a + 6, 301))], np.int64)
    got = defaultdict(set)
    for (a, b), h in zip(spans.tolist(), line_dedup.rolling_hashes(lines, spans[:, 0], spans[:, 1]).tolist(), strict=True):
        got[h].add(tuple(lines[a:b]))
    assert all(len(x) == 1 for x in got.values()) and len(got) == len({tuple(lines[a:b]) for a, b in spans.tolist()})


def test_line_dedup(spark, docs, rows, empty):
    chunker = line_dedup.Chunker()
    distinct = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, kept = set(), {}
    keys = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").select("doc_id", "text", F.xxhash64("doc_id").alias("k"), F.xxhash64("text").alias("t"))
    order = sorted(keys.distinct().collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.k, r.t))
    assert len(order) >= len(distinct)
    for r in order:
        chunks, drop = chunker.chunks((r.text or "").encode()), set()
        for i, body in chunker.candidates((r.text or "").encode()):
            drop |= {i} if body in seen else set()
            seen.add(body)
        left = b"".join(x for i, x in enumerate(chunks) if i not in drop)
        left = left.removesuffix(b"\n") if len(chunks) - 1 in drop else left
        kept[r.doc_id, r.text] = hashlib.sha256(left).hexdigest()
    out = line_dedup.dedup_lines(docs).select(F.col("rest.doc_id").alias("d"), F.col("rest.text").alias("x"), "kept_sha256")
    assert pairs(out, "d", "x", "kept_sha256") == Counter((r[0], r[1], kept[r[0], r[1]]) for r in rows)
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_deep_shallow_order():
    random.seed(6)
    for letters in ("ab", "abcdefgh"):
        data = "".join(random.choice(letters) for _ in range(600)).encode()
        order, lcp = suffix_sort.deep_shallow_sort(data, np.arange(len(data) - 39), 40)
        sorted_ = [data[i : i + 40] for i in order]
        assert sorted_ == sorted(sorted_)
        for a, b, n in zip(sorted_, sorted_[1:], lcp[1:], strict=False):
            shared = suffix_sort.common_prefix(a, b)
            assert n == shared or (n < 32 and n <= shared)


@pytest.mark.parametrize("group_limit", [2000, 1])
def test_suffix_dedup(docs, rows, empty, group_limit):
    length = 60
    count = Counter(d[i : i + length] for d in ((r[1] or "").encode() for r in rows) for i in range(len(d) - length + 1))
    want = Counter()
    for r in rows:
        d = (r[1] or "").encode()
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[r[0], len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.suffix_dedup(docs, length, gram=12, group_limit=group_limit, bucket_bytes=4000, with_text=True)
    assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def pages(spark):
    html = ["<p>a</p>", "x" * 3000, None, "", "<p>a</p>", "WARC/1.1\r\nContent-Length: 3\r\n\r\n", "é\r\n\r\n"]
    table = [(i, f"http://h/{i}", x) for i, x in enumerate(html)] + [(None, None, "<p>a</p>"), (4, "u", "<p>a</p>"), (9, "v", "x" * 3000)]
    return table, spark.createDataFrame(table, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))


def test_warc_round_trip(spark):
    table, df = pages(spark)
    groups = defaultdict(list)
    for p, _, h in table:
        groups[h or ""].append(p)
    want = Counter()
    for p, _, h in table:
        data = (h or "").encode()
        last = max(x for x in groups[h or ""] if x is not None)
        revisit = p is not None and p < last
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None] += 1
    assert pairs(warc.warc_round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.warc_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    parts = [warc.record(i, "u", b"payload %d " % i * 50, warc.digest(b"payload %d " % i * 50), None) + warc.END for i in range(6)]
    import gzip

    stored = [gzip.compress(p) for p in parts] if packed else parts
    hurt = 60 if packed else len(stored[1]) - 100
    broken = stored[1][:hurt] + b"\xff" * 30 + stored[1][hurt + 30 :]
    data = b"junk" * packed + stored[0] + broken + stored[2] + stored[3][:-40] + stored[4] + stored[5][: len(stored[5]) // 2]
    found = list(warc.walk(data))
    assert [f["page_id"] for _, _, f in found if isinstance(f, dict)] == [0, 2, 4]
    gaps = [(a, b) for a, b, f in found if isinstance(f, str)]
    assert len(gaps) == 3 + packed and all(a < b for a, b in gaps)
    if not packed:
        assert sum(b - a for a, b, _ in found) == len(data)


def plain_fingerprint(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_classes(fps, near):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows, empty):
    fps = [plain_fingerprint(r[1], 3) for r in rows]
    classes = linked_classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {c: min((r[0] for r, k in zip(rows, classes, strict=True) if k == c and r[0] is not None), default=None) for c in classes}
    want = Counter((r[0], f if f < 1 << 63 else f - (1 << 64), low[c]) for r, f, c in zip(rows, fps, classes, strict=True))
    assert pairs(simhash.simhash_components(docs), "doc_id", "fp", "component_id") == want
    assert simhash.simhash_components(empty).count() == 0


def test_spark_hash_agrees(spark):
    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("group_limit", [4096, 3])
def test_simhash_links_chains_and_large_groups(spark, group_limit):
    random.seed(8)
    fps = {0}
    for _ in range(60):
        base = random.choice(list(fps)) if random.random() < 0.8 else random.getrandbits(64)
        for _ in range(random.randint(0, 5)):
            base ^= 1 << random.randrange(64)
        fps.add(base)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(df, 3, 6, group_limit)).collect()}
    classes = linked_classes(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for i, f in enumerate(fps):
        assert got.get(f, f) == min(x for x, c in zip(fps, classes, strict=True) if c == classes[i])


def test_near_dedup(spark, docs, rows, empty):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[random.choice(vocabulary) for _ in range(300)] for _ in range(40)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(20):
        w = list(base[i])
        for _ in range(i % 4 + 1):
            w[random.randrange(300)] = "changed"
        texts += [(100 + i, " ".join(w)), (200 + i, " ".join(base[i]))]
    for limit in (2000, 2):
        kept = near_dedup.near_dedup(spark.createDataFrame(texts, "doc_id long, text string"), group_limit=limit)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns and 30 <= out.count() < len(rows)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_takes_candidates_from_fingerprints(spark):
    """Texts within three bits that share no band key are compared too; the similarity decides."""
    random.seed(10)
    base = [f"w{random.randrange(10**6)}" for _ in range(6000)]
    texts = [(0, base), (1, [*base, "more"]), (2, [f"w{random.randrange(10**6)}" for _ in range(6000)])]
    keyed = common.with_row_key(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string"))
    nodes = near_dedup.sketches(keyed, 5, 8, 50).withColumn("keys", F.array(F.col("node")))  # no two share one
    named = {r.node: (r.doc_id, r.fp) for r in nodes.collect()}
    assert all(fp & (1 << 64) - 1 == simhash.fingerprint(" ".join(texts[d][1]).encode(), 3) for d, fp in named.values())
    groups = {named[r.node][0]: r.component for r in near_dedup.candidate_groups(nodes).collect()}
    assert set(groups) == {0, 1} and groups[0] == groups[1]


def test_lm_shards_follow_the_text(spark):
    """A corpus in one partition has as many shards as its bytes ask for; the filter doesn't depend on them."""
    random.seed(15)
    texts = [" ".join(f"w{random.randrange(2000)}" for _ in range(200)) for _ in range(60)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    few, many = lm_scoring.train_lm(train), lm_scoring.train_lm(train, shard_text=500)
    assert few.shards == 16 and many.shards >= sum(map(len, texts)) // 500
    assert few.n_bits == many.n_bits and (few.part(0, few.shards).bits == many.part(0, many.shards).bits).all()


@pytest.mark.parametrize("head", [20, 1 << 18])
def test_lm_scoring(docs, rows, empty, head):
    tokens = [[*(x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())), None] for r in rows]
    out_of = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    c = Counter(t for ts, o in zip(tokens, out_of, strict=True) if not o for t in ts)
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score_lm(docs, head=head).collect()
    want = Counter(
        (r[0], o, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6))
        for r, ts, o in zip(rows, tokens, out_of, strict=True)
    )
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    seen = [r for r in got if not r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen) and all(r.score <= 0 for r in got)
    assert lm_scoring.score_lm(empty).count() == 0


def test_log_counts_come_back_from_the_filter(spark):
    random.seed(21)
    texts = [" ".join(f"w{int(random.paretovariate(0.7))}" for _ in range(200)) for _ in range(60)]
    model = lm_scoring.train_lm(spark.createDataFrame([(t,) for t in texts], "text string"))
    part = model.part(0, model.shards)
    tokens, sizes = lm_scoring.token_hashes([t.encode() for t in texts])
    for salt, h in ((1, tokens), (2, lm_scoring.pair_hashes(tokens, sizes)[1])):
        u, n = np.unique(h, return_counts=True)
        level = part.levels(u, salt)
        assert (level >= lm_scoring.levels_of(n)).all() and (level == lm_scoring.levels_of(n)).mean() > 0.97
        assert (part.levels(u + np.uint64(1 << 20), salt) > 0).mean() < 0.03
    filled = np.unpackbits(part.bits).mean()
    assert filled < 0.3 and model.n_all == len(tokens) and model.n_distinct == len(set(tokens.tolist()))


def plain_scores(rows, mu=4.0):
    """log10 probabilities with counts read as the middle of their levels."""
    tokens = [[*(x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())), None] for r in rows]
    seen = [ts for r, ts in zip(rows, tokens, strict=True) if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    one, two = Counter(t for ts in seen for t in ts), Counter(p for ts in seen for p in zip(ts, ts[1:]))
    middle = lambda c: 0 if c == 0 else 1 if c == 1 else 1.5 * 2 ** int(math.log2(c)) - 0.5
    n, v = sum(one.values()), len(one)
    p1 = lambda t: (middle(one[t]) + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda a, t: (middle(two[a, t]) + mu * p1(t)) / (middle(one[a]) + mu)
    return [math.log10(min(p1(ts[0]), 1)) + sum(math.log10(min(p2(a, t), 1)) for a, t in zip(ts, ts[1:])) for ts in tokens]


def test_lm_scores_match_brute_force_in_any_number_of_rounds(docs, rows):
    want = Counter((r[0], round(s, 4)) for r, s in zip(rows, plain_scores(rows), strict=True))
    for table, most in ((docs, 1 << 29), (docs.repartition(7), 1 << 26)):
        got = lm_scoring.score_lm(table, max_bits=most, bits_per_entry=20000).collect()
        assert Counter((r.doc_id, round(r.score, 4)) for r in got) == want


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix_sources(docs, block_words=8, shard_words=500).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    sources = [*sorted(s for s in size if s is not None), None]
    weight = dict(zip(sources, [3, 1, 2] * len(sources), strict=False))
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        open_ = [s for s in sources if s not in capped]
        target = {s: 2.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in sources}
        over = {s for s in open_ if target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    by_target = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by_target[round(r.target, 6)] += r.taken
    assert {round(t, 6) for t in target.values()} == set(by_target)
    assert all(abs(v - k) <= 8 * 12 for k, v in by_target.items())
    assert Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows) == Counter((r.doc_id, r["size"]) for r in got)
    again = mixing.mix_sources(docs.repartition(5), block_words=8, shard_words=500)
    assert pairs(again, "doc_id", "size", "taken") == Counter((r.doc_id, r["size"], r.taken) for r in got)
    assert mixing.mix_sources(empty).count() == 0


def test_apportion_is_sainte_lague(spark):
    random.seed(2)
    shares = {k: random.randint(1, 5000) for k in range(12)}
    df = spark.createDataFrame([(0, k, v, 37) for k, v in shares.items()], "g long, key long, share long, house long")
    got = {r.key: r.seats for r in mixing.apportion(df, ["g"], "share", "house").collect()}
    want = Counter()
    for _ in range(37):
        want[max(shares, key=lambda k: (shares[k] / (2 * want[k] + 1), -k))] += 1
    assert got == {k: want[k] for k in shares}


def test_rule_ledger(docs, rows, empty):
    def measured(text):
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = list(zip(words, words[1:], words[2:], strict=False))
        n, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            covered |= {i, i + 1, i + 2} if n[w] > 1 else set()
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed

    out = rule_ledger.quality_rules(docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert pairs(out, *names) == Counter((r[0], *measured(r[1] or "")) for r in rows)
    assert out.where("base_failed and kept").count() == 0
    entries = out.collect()
    mask = rule_ledger.policy_mask("v1")
    order = list(rule_ledger.rules())
    for r in rule_ledger.ablations(out, "v1").collect():
        bit = 1 << order.index(r.rule)
        assert r.n_failed == sum(e.failures & bit > 0 for e in entries)
        assert r.n_only_this == sum(e.failures & mask == bit for e in entries)
    assert rule_ledger.quality_rules(empty).count() == 0


def test_classifier(spark, docs, rows, empty, sf_dir):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (1, 0)], "doc_id long, quality int")
    got = quality_classifier.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality_classifier.score_quality(empty, labels).count() == 0
    kept = quality_classifier.filter_quality(docs, labels)
    assert kept.columns == docs.columns
    held = {r.doc_id: r.held_out for r in got if r.doc_id is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_classifier.score_quality(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    judged = got.join(labels, "doc_id").where("held_out").toPandas()
    good, bad = judged[judged.quality == 1].score.values, judged[judged.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.98 and (judged.predicted == judged.quality).mean() > 0.95


def test_factors_are_cholesky():
    random.seed(1)
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + k for k in (0, 1)]
    n, s, q = np.array([300.0, 300.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x])
    model = quality_classifier.fit(n, s, q, 0.0, 0.0)
    from_density = []
    for a in x:
        cov, d = np.cov(a.T), np.concatenate(x) - a.mean(0)
        from_density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(from_density[0] - from_density[1]))
    assert np.allclose(model.score(np.concatenate(x)), want, atol=1e-6)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    kept, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and len(kept[-1]) > 100
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} == kept[-1]


def test_line_dedup_of_a_very_common_chunk(spark):
    """Over a thousand copies, so that the chunk is hot."""
    body = "the same license line that all of these documents carry\nand the second line of it as well"
    rows = [(i, f"{body}\nown line {i} that ends the text") for i in range(1300)]
    chunker = line_dedup.Chunker(divisor=1, max_lines=2)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), chunker)
    assert pairs(out.select("rest.doc_id", "text", "n_removed_chunks"), "doc_id", "text", "n_removed_chunks") == Counter(
        (i, t if i == 0 else t.removeprefix(body + "\n"), int(i > 0)) for i, t in rows
    )


def shingled(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_dedup_at_the_threshold(spark):
    """Pairs of similarity 0.7 to 0.95 against all pairs compared; none is missed, none below 0.8 is merged."""
    random.seed(12)
    texts, found = [], []
    for i in range(400):
        w = [f"w{random.randrange(10**6)}" for _ in range(random.choice([60, 100, 400]))]
        x = list(w)
        for _ in range(random.randint(1, max(len(w) // 25, 2))):
            x[random.randrange(len(x))] = "changed"
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x))]
        found.append(similarity(shingled(texts[-2][1]), shingled(texts[-1][1])))
    assert sum(0.8 <= s < 0.85 for s in found) > 20 and sum(0.7 <= s < 0.8 for s in found) > 40
    kept = {r.doc_id for r in near_dedup.near_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(400)} | {2 * i + 1 for i, s in enumerate(found) if s < 0.8}


def test_line_dedup_removes_planted_passages_whole(spark):
    """Runs of 50 words and more of one to seven lines, at shifting places between other lines."""
    random.seed(13)
    line = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    texts, want = [], []
    for i in range(120):
        n = i % 7 + 1
        passage = [line(50 // n + 1) for _ in range(n)]
        first, last, a, b = ([line(random.randint(1, 12)) for _ in range(random.randint(0, 5))] for _ in range(4))
        texts += [(2 * i, "\n".join([*first, *passage, *last])), (2 * i + 1, "\n".join([*a, *passage, *b]))]
        want += [texts[-2], (2 * i + 1, "\n".join(a + b))]
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.doc_id: (r.text, r.n_removed_lines, r.n_removed_chunks) for r in out.select("rest.doc_id", "text", "n_removed_lines", "n_removed_chunks").collect()}
    assert got == {i: (x, (i // 2 % 7 + 1) * (i % 2), i % 2) for i, x in want}


def test_short_and_periodic_items():
    """Short items count between word boundaries only; a long text of one letter stays cheap and is found once."""
    index = decontaminate.build_index([(1, b"to be or not"), (2, b"a" * 120), (3, b"tiny")], 0.1, 120, 24)
    texts = [b"x To be\n or not y", b"ato be or not", b"to be or notb", b"a" * 30000, b"tiny", b""]
    found = decontaminate.matches(index, texts)
    assert found == {0: {1: (0, 2, 14)}, 3: {2: (0, 0, 120)}}


def test_texts_longer_than_a_stretch_are_searched_whole(monkeypatch):
    random.seed(17)
    draw = lambda n: "".join(random.choice("abcdefghijklmnop ") for _ in range(n)).encode()
    item, text = decontaminate.normal(draw(120)), decontaminate.normal(draw(9000))
    monkeypatch.setattr(decontaminate, "SLICE", 1000)
    index = decontaminate.build_index([(1, item)], 0.1, 120, 24)
    for at in range(0, 9000, 370):
        planted = decontaminate.normal(text[:at] + b" " + item + b" " + text[at:])
        assert decontaminate.matches(index, [b"", planted])[1][1] == (0, planted.index(item), planted.index(item) + len(item))


def test_suffix_dedup_of_equal_rows_and_long_texts(spark):
    random.seed(18)
    draw = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    shared, same, long = draw(400), draw(900), draw(1_200_000)
    rows = [(1, same)] * 300 + [(2, long[:700_000] + shared + long[700_000:]), (3, shared), (4, draw(500))]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in out) == Counter({(1, 900, 900, 1): 300, (2, 1_200_400, 400, 1): 1, (3, 400, 400, 1): 1, (4, 500, 0, 0): 1})
