"""WARC archives: a writer with revisit records and a salvage reader.

Writing: Spark's text writer, whose line separator is the blank line that ends a record, so each
part is a plain WARC/1.1 file on whatever file system the cluster shares. A file is one bundle of
records of bounded size, since the reader takes a file as one value. Of the records with
equal payloads (same SHA-1 and length) the one with the largest page_id is a response and the
others are revisits of it.

Reading: parts are read as binary rows and walked record by record. A record counts if its
version line, its Content-Length, its closing blank lines and, for a response, its payload
digest hold. Headers have at most 64 KB and no version line within. After a failed check the reader searches for the
next version line, or in a gzipped file for the next member that inflates, goes on from there, and logs the bytes in
between as a quarantined gap, so that each byte of a header is looked at a few times at most. The log is kept beside the archive.

Null or empty html: a payload of 0 bytes, which is revisited like any other. Null page_ids are
written, never referred to, and are always responses. Repeated rows: all rows with the largest
page_id of a payload are responses. A very long page is a file of its own and must fit in a task.
An empty table gives an empty archive and result. Columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import bloom_of
from .common import arrow_schema, cut, hot_values, map_rows, portions, scratch_folder, spread_join

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
STEP = 1 << 16
MOST_HEADER = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = (
    "file string, start long, stop long, kind string, reason string, page_id long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, own_digest: str, refers_to: int | None) -> bytes:
    """One record without its closing blank line."""
    revisit = refers_to is not None
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{n}')}>"
    body = b"" if revisit else payload
    target = "".join(c for c in url or "" if c > " ") or "about:blank"
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id if page_id is not None else own_digest)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{own_digest}",
        f"Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return VERSION + "\r\n".join(head).encode() + END + body


class Ends:
    """The first blank line at or after a place that only moves on."""

    def __init__(self, data: bytes):
        self.data, self.held = data, -1

    def after(self, at: int) -> int:
        if self.held < at:
            found = self.data.find(END, at)
            self.held = found if found >= 0 else len(self.data) + MOST_HEADER
        return self.held


def parse_record(data: bytes, at: int, ends: Ends) -> tuple[int, dict | str]:
    """The record that starts at ``at``: where it ends and its fields, or ``at`` and what is wrong."""
    if data[at : at + len(VERSION)] != VERSION:
        return at, "no version line"
    stop = ends.after(at)
    if stop - at > MOST_HEADER or stop >= len(data):
        return at, "headers do not end"
    own_line = at == 0 or data[at - 1 : at] == b"\n"
    if data.find(b"\n" + VERSION if own_line else VERSION, at + 1, stop) >= 0:
        return at, "version line within headers"
    lines = data[at + len(VERSION) : stop].split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(b":") for x in lines) if sep}
    try:
        length, full = int(fields[b"content-length"]), int(fields[b"payload-length"])
        page = int(fields[b"page-id"]) if b"page-id" in fields else None
        refers = int(fields[b"refers-to-page"]) if b"refers-to-page" in fields else None
        kind, own = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    except (KeyError, ValueError) as e:
        return at, f"bad header: {e}"
    start = stop + len(END)
    if length < 0 or start + length > len(data):
        return at, "truncated payload"
    if data[start + length : start + length + len(END)] != END:
        return at, "record does not end where its length says"
    body = data[start : start + length]
    if kind == "response" and (length != full or digest(body) != own):
        return at, "payload digest differs"
    return start + length + len(END), {
        "page_id": page, "payload_bytes": full, "payload_digest": own, "record_type": kind, "refers_to": refers, "payload": body,
    }


def walk_plain(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, stop, fields) for each record and (start, stop, reason) for each gap."""
    at, gap, reason, ends = 0, -1, "", Ends(data)
    while at < len(data):
        stop, found = parse_record(data, at, ends)
        if isinstance(found, str):
            if gap < 0:
                gap, reason = at, found
            stop = data.find(VERSION, at + 1)
            at = len(data) if stop < 0 else stop
            continue
        if gap >= 0:
            yield gap, at, reason
            gap = -1
        yield at, stop, found
        at = stop
    if gap >= 0:
        yield gap, len(data), reason


def inflate(data: bytes, at: int) -> tuple[int, bytes | str]:
    """The gzip member at ``at``: where it ends and its bytes, or ``at`` and what is wrong."""
    member, out, i = zlib.decompressobj(wbits=31), [], at
    try:
        while not member.eof and i < len(data):
            out.append(member.decompress(data[i : i + STEP]))
            i += STEP
    except zlib.error as e:
        return at, str(e)
    if not member.eof:
        return at, "truncated member"
    return min(i, len(data)) - len(member.unused_data), b"".join(out)


def walk_gzip(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """As walk_plain, with offsets of the compressed file; a member holds one record or more."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        stop, out = inflate(data, at)
        if isinstance(out, str):
            if gap < 0:
                gap, reason = at, out
            stop = data.find(GZIP, at + 1)
            at = len(data) if stop < 0 else stop
            continue
        if gap >= 0:
            yield gap, at, reason
            gap = -1
        for _, _, found in walk_plain(out):
            yield at, stop, found
        at = stop
    if gap >= 0:
        yield gap, len(data), reason


def walk(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """Gzipped if a member starts before any version line."""
    gz, plain = data.find(GZIP), data.find(VERSION)
    return walk_gzip(data) if gz >= 0 and (plain < 0 or gz < plain) else walk_plain(data)


def digested(pages: DataFrame) -> DataFrame:
    """(page_id, sha, size, h): the payload's SHA-1, its length, and eight bytes of the SHA-1 as a long."""

    def kernel(batch: pa.RecordBatch) -> dict:
        payloads = batch.column("html").cast(pa.large_binary()).to_pylist()
        sha = [hashlib.sha1(x or b"").digest() for x in payloads]
        return {"sha": sha, "size": [len(x or b"") for x in payloads], "h": np.frombuffer(b"".join(x[:8] for x in sha), np.int64)}

    return map_rows(pages.select("page_id", "html"), kernel, ["page_id"], "sha binary, size long, h long")


def archive_records(pages: DataFrame) -> DataFrame:
    """page_id, url, sha, packed (the payload deflated) and refers_to of every page.

    Payloads that occur once, as a Bloom filter of the others shows, don't move; the rest meet
    the largest page_id of their payload in a join, common ones in parts.
    """
    shared = digested(pages).groupBy("sha", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n"), F.first("h").alias("h"))
    shared = cut(shared.where("n > 1"))
    sent = pages.sparkSession.sparkContext.broadcast(bloom_of(shared, "h", shared.count()))
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *T.StructType.fromDDL("h long, sha binary, size long, packed binary").fields])
    target = arrow_schema(schema)

    def records(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in portions(batches):
                payloads = [x or b"" for x in b.column("html").cast(pa.large_binary()).to_pylist()]
                sha = [hashlib.sha1(x).digest() for x in payloads]
                h = np.frombuffer(b"".join(x[:8] for x in sha), np.int64)
                hit = sent.value.has(h.view(np.uint64)) == wanted
                at = np.flatnonzero(hit).tolist()
                own = {"h": h[hit], "sha": [sha[i] for i in at], "size": [len(payloads[i]) for i in at], "packed": [zlib.compress(payloads[i], 1) for i in at]}
                kept = [b.column(c).filter(pa.array(hit)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(own[n], target.field(n).type) for n in own], names=target.names)

        return pages.select("page_id", "url", "html").mapInArrow(run, schema)

    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    many = spread_join(records(True), shared.drop("n"), ["h", "sha", "size"], hot_values(shared, "h", least=200), ["page_id", "url"], how="left")
    often = many.select("page_id", "url", "sha", "packed", refers.alias("refers_to"))
    once = records(False).select("page_id", "url", "sha", "packed", F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"))
    return once.unionByName(often)


def write_archive(pages: DataFrame, path: str, bytes_per_file: int = 1 << 24, spoil: Callable[[int | None, bytes], bytes] | None = None) -> None:
    """Write one record per page as WARC files of about ``bytes_per_file`` under ``path``; a larger record has a file of its own.

    Records are bundled in the tasks, and each bundle is written as one file. ``spoil`` may change
    a page's stored record, to try the reader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in portions(batches):
            for p, u, x, s, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "packed", "sha", "refers_to")), strict=True):
                made = record(p, u, zlib.decompress(x), base64.b32encode(s).decode(), r)
                made = spoil(p, made) if spoil else made
                if held and size + len(made) > bytes_per_file:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([END.join(held)], pa.binary())})
                    held, size = [], 0
                held.append(made)
                size += len(made) + len(END)
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([END.join(held)], pa.binary())})

    bundles = archive_records(pages).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    bundles.write.mode("overwrite").option("lineSep", END.decode()).option("maxRecordsPerFile", 1).text(path)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind 'record' and, for quarantined bytes, of kind 'gap'; ``payload`` is null if it isn't asked for."""
    schema = arrow_schema(T.StructType.fromDDL(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows, held = [], 0
                for start, stop, found in walk(data):
                    row = {"file": file, "start": start, "stop": stop, "kind": "gap", "reason": found}
                    if isinstance(found, dict):
                        row |= {"kind": "record", "reason": None} | found | ({} if payloads else {"payload": None})
                    rows.append(row)
                    held += stop - start
                    if held > 4_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in schema.names}, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def salvaged(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, without payloads; its quarantined gaps are logged as Parquet in ``path``-gaps."""
    found = cut(read_archive(spark, path, payloads=False).drop("payload"))
    found.where("kind = 'gap'").select("file", "start", "stop", "reason").write.mode("overwrite").parquet(f"{path}-gaps")
    return found.where("kind = 'record'")


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to an archive, read it back, and return one row per record read; an archive that lost a page is an error."""
    spark = pages.sparkSession
    own = path or f"{scratch_folder(spark, 'warc')}/archive"
    write_archive(pages, own)
    back = salvaged(spark, own)
    if (read := back.count()) != (written := pages.count()):
        raise RuntimeError(f"{read} records read of {written} written, see {own}-gaps")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def spoiled(page_id: int | None, stored: bytes) -> bytes:
    """Every seventh page loses its version line, every eleventh the end of its record, every thirteenth has a header that lies."""
    if page_id is None:
        return stored
    if page_id % 7 == 3:
        return b"X" + stored[1:]
    if page_id % 11 == 5:
        return stored[:-10] if stored.endswith(END) else stored[: len(stored) // 2]
    if page_id % 13 == 2:
        return stored.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    return stored


def salvage_trial(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, record_type) of what the reader recovers from an archive that ``spoiled`` has damaged."""
    own = f"{scratch_folder(pages.sparkSession, 'warc')}/archive"
    write_archive(pages, own, spoil=spoiled)
    return salvaged(pages.sparkSession, own).select("page_id", "payload_bytes", "record_type")
