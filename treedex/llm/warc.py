"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

Reader: each task takes a byte range of a file, scans it for the gzip magic, and takes a candidate for a member only if it
decodes to a WARC version line. It owns the records that start inside its range, reading past the range's end to finish the last
one. After a record that it owns it goes on at that member's end, so that bytes inside a member are not looked at again.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, storage

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Bytes of a reader task's range; bytes read at once.
SPLIT, CHUNK = 8 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: The longest member head that is decoded to look for the version line.
HEAD = 4096
_URN = "urn:treedex:page:"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without the payload. refers_to: the page whose payload it is, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"), ("WARC-Target-URI", safe), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_URN}{refers_to}>")]
    return member([*headers, ("Content-Type", "application/http; msgtype=response")], http if refers_to is not None else http + payload)


def write_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to archives in path; returns (file, bytes) of each archive.

    Null html is an empty payload. Of equal payloads of LEAST_REVISIT bytes or more, rows with the largest page_id are
    responses (all of them, if a row is repeated; a null page_id comes before any other) and the rest revisit it.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn("digest", F.sha1("html"))
    repeated = p.filter(F.length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    # the hash, not the page, meets the groups of copies; a group of any size is split by adaptive execution as the join needs no group together
    joined = p.join(repeated.select("digest", "last"), "digest", "left")

    def run(batches):
        from pyspark import TaskContext

        n = 0

        def members():
            nonlocal n
            for batch in batches:
                for page_id, url, html, digest, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    n += 1
                    yield page_record(page_id, url, html, digest, last if last is not None and page_id != last else None)

        name = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        size = storage.put(name, members())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["file", "bytes"])

    files = joined.select("page_id", "url", "html", "digest", "last").mapInArrow(run, "file string, bytes bigint")
    return common.written(files, "warc-files")


def _records(read, start: int, end: int, size: int):
    """Decoded records that start in [start, end): (place, bytes). read(place, length) gives a file's bytes.

    From start on the first place counts whose bytes are gzip magic, inflate to what begins with `WARC/1.` and go on to a whole member; from there on records follow
    one another. So a range that begins inside a member could only be misled by a member stored in it unchanged, that is by a payload that is itself an
    archive and that deflate kept as it is; write_pages() deflates payloads, which are texts, and no text holds the magic's bytes in UTF-8.
    """
    buf, base, at = b"", start, start
    while at < end:
        if at < base or at >= base + len(buf) - len(MAGIC) - HEAD and base + len(buf) < size:
            base, buf = at, read(at, min(CHUNK + HEAD, size - at))
        k = buf.find(MAGIC, at - base)
        if k < 0:
            if base + len(buf) >= size:
                return
            at = max(at + 1, base + len(buf) - len(MAGIC) + 1)
            continue
        at = base + k
        if at >= end:
            return
        if len(buf) - k < HEAD and base + len(buf) < size:
            base, buf = at, read(at, min(CHUNK + HEAD, size - at))
            k = 0
        try:
            if not zlib.decompressobj(31).decompress(buf[k : k + HEAD], 64).startswith(b"WARC/1."):
                raise zlib.error
            z, out, pos = zlib.decompressobj(31), [], at
            while not z.eof:
                piece = buf[pos - base :] if base <= pos < base + len(buf) else read(pos, CHUNK)
                if not piece:
                    raise zlib.error("cut short")
                out.append(z.decompress(piece))
                pos += len(piece) - len(z.unused_data)
        except zlib.error:
            at += 1
            continue
        yield at, b"".join(out)
        at = pos


def parse(record: bytes) -> dict:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return {"headers": headers, "block": rest[: int(headers.get("content-length", 0))]}


def read(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of archives, by byte ranges: file, offset, record_type, record_id, refers_to, url, http (its headers), payload.

    files: file, bytes. Unreadable members are passed over; an empty file has no record.
    """
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start")).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "start")

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                rows, held = [], 0
                for at, raw in _records(lambda a, n, f=x["file"]: storage.get(f, a, n), x["start"], min(x["start"] + split, x["bytes"]), x["bytes"]):
                    r = parse(raw)
                    http, _, payload = r["block"].partition(b"\r\n\r\n")
                    h = r["headers"]
                    rows.append((x["file"], at, h.get("warc-type"), h.get("warc-record-id", "").strip("<>"), h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-target-uri"), h.get("warc-payload-digest"), http.decode("utf-8", "replace"), payload))
                    held += len(payload)
                    if held > CHUNK:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.select("file", "bytes", "start").mapInArrow(run, "file string, offset bigint, record_type string, record_id string, refers_to string, url string, digest string, http string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "offset", "record_type", "record_id", "refers_to", "url", "digest", "http", "payload"])


def page_digests(records: DataFrame) -> DataFrame:
    """The pages that read() found: a response's size and digest from its payload, a revisit's from its headers."""
    number = lambda c: F.regexp_extract(c, "([0-9-]+)$", 1).try_cast("long")
    own = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"), F.when(own, F.length("payload")).otherwise(F.regexp_extract("http", r"(?i)content-length:\s*(\d+)", 1).cast("long")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"), "record_type", number(F.coalesce("refers_to", F.lit(""))).alias("refers_to"),
    )


