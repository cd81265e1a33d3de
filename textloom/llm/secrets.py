"""Secret scan with multipart credential linking.

Base findings are three patterns (assign, access, hex). Weak candidates - an account name or
key id, a short assigned value, a bare 40-character token, an endpoint - are common in harmless
text, so one is reported only if a complementary part starts within ``scope`` bytes of it in the
same text: the parts of all texts are interval-joined by text and stretch of ``scope`` bytes.
Complementary are an access identifier and a secret; an endpoint and either of them, if that
one is a base finding. A weak candidate inside a base finding is dropped.

Null or empty text: no findings and the digest of the empty string. Repeated rows have the same
findings each. A null doc_id is kept. An empty table gives an empty result. Columns other than
doc_id and text are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, map_rows, with_row_key

#: Fixed values. Bytes patterns: (?i) folds ASCII letters only.
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

WEAK_ID = re.compile(rb"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""")
WEAK_ID_WORDS = (b"key_id", b"keyid", b"client_id", b"clientid", b"account_id", b"accountid", b"user_name", b"username", b"login")
WEAK_TOKEN = re.compile(rb"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(rb"""https?://[^\s"'<>]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?(?![\d.])""")

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: Maps bytes to "h" (hex digit) or "b" (other token character) or "-".
CLASSES = bytes(
    104 if chr(i) in "0123456789abcdef" else 98 if i < 128 and (chr(i).isalnum() or chr(i) in "+/") else 45 for i in range(256)
)
HEX_RUN, TOKEN_RUN = b"h" * 32, re.compile(rb"[hb]{40,}")


def base_findings(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start, then kind: leftmost matches, those that are too short dropped."""
    found = []
    low = data.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= 16]
    if HEX_RUN in data.translate(CLASSES):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(data)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def weak_findings(data: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = []
    low = data.lower()
    if any(w in low for w in WEAK_ID_WORDS):
        found += [(m.start(), m.end(), 3) for m in WEAK_ID.finditer(data)]
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 4) for m in ASSIGN.finditer(data) if 4 <= len(m[2]) < 8]
    classes = data.translate(CLASSES)
    for run in TOKEN_RUN.finditer(classes):
        for m in WEAK_TOKEN.finditer(data, max(run.start() - 1, 0), min(run.end() + 1, len(data))):
            x = m[0]
            if re.search(rb"[A-Z]", x) and re.search(rb"[a-z]", x) and re.search(rb"[0-9]", x):
                found.append((m.start(), m.end(), 4))
    if base or found:
        found += [(m.start(), m.end(), 5) for m in ENDPOINT.finditer(data)]
    starts, reach = [b[0] for b in base], [0, *accumulate((b[1] for b in base), max)]
    return [w for w in found if reach[bisect_left(starts, w[1])] <= w[0]]


def in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not found or data.isascii():
        return found
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b]), k) for a, b, k in found]


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key, the base digest and counts, and ``parts``: every base finding and weak candidate."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "parts")}
        for data in bytes_of(batch.column("text")):
            base = base_findings(data)
            parts = in_code_points(data, base + weak_findings(data, base))
            for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                out[c].append(sum(x[2] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(written(parts[: len(base)]).encode()).hexdigest())
            out["parts"].append([{"start": a, "kind": k, "end": b} for a, b, k in parts])
        return out

    keyed = with_row_key(docs.select("doc_id", "text"))
    return map_rows(
        keyed,
        kernel,
        ["doc_id", "_k", "_t"],
        "n_assign long, n_access long, n_hex long, base_sha256 string, parts array<struct<start: long, kind: int, end: long>>",
    )


def linked(found: DataFrame, scope: int) -> DataFrame:
    """The weak candidates of each text that have a complementary part within ``scope``."""
    role = lambda kind: F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), kind + 1)
    parts = found.where(F.size("parts") > 1).dropDuplicates(["_k", "_t"]).select("_k", "_t", F.explode("parts").alias("p"))
    parts = parts.select("_k", "_t", "p", role(F.col("p.kind")).alias("role"), (F.col("p.kind") < 3).alias("strong"))
    stretch = F.floor(F.col("p.start") / scope)
    weak = parts.where("not strong").withColumn("at", stretch)
    others = parts.withColumn("at", F.explode(F.array(stretch - 1, stretch, stretch + 1))).select(
        F.col("_k").alias("k2"), F.col("_t").alias("t2"), F.col("at").alias("at2"), F.col("p").alias("p2"), F.col("role").alias("role2"), F.col("strong").alias("strong2")
    )
    no_endpoint = (F.col("role") != "endpoint") & (F.col("role2") != "endpoint")
    complement = (F.col("role") != F.col("role2")) & (no_endpoint | (F.col("strong2") & (F.col("role2") != "endpoint")))
    near = F.abs(F.col("p.start") - F.col("p2.start")) <= scope
    same = (F.col("_k") == F.col("k2")) & (F.col("_t") == F.col("t2")) & (F.col("at") == F.col("at2"))
    kept = weak.join(others, same & near & complement, "left_semi")
    return kept.groupBy("_k", "_t").agg(F.collect_set("p").alias("weak"))  # as many as one text holds


def scan_secrets(docs: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_linked, the weak candidates reported."""
    found = cut(find_parts(docs))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    out = found.join(linked(found, scope), ["_k", "_t"], "left").withColumn("weak", F.coalesce("weak", none))
    spans = F.array_sort(F.concat(F.filter("parts", lambda p: p["kind"] < 3), "weak"))
    name = F.array(*map(F.lit, KINDS))
    text = F.transform(spans, lambda p: F.concat_ws(":", F.element_at(name, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string")))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans"), F.size("weak").alias("n_linked"))
