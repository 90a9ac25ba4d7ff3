"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a skippable frame that holds the seek
table (compressed and decompressed size of each frame), and an index maps each record to its bundle, frame and offset
within the frame. A payload that an earlier record of the archive holds is written as a revisit.

Files go to the shared folder under a name of their own for each task attempt; the index names only those of attempts
that ended well, so a lost executor or a second attempt leaves at most a file that nothing refers to.

Nulls and oddities: a null payload is an empty payload, a null URL a record without a target URI; control characters in
a URL are percent-encoded in its header; a very long payload is one record of one frame; rows without an id are responses; of rows that repeat one id and payload all
are responses if the id is the largest; an empty table gives no bundle and an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Of the seekable format: magic of the skippable frame and of the footer; fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Decompressed bytes after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Frames, each of about FRAME_BYTES, that one task reads back.
FRAMES_A_TASK = 64
INDEX = "page_id long, path string, frame int, offset long, length long"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers alone, which keep the payload's size and digest."""
    body = HTTP + payload if kind == "response" else HTTP
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    body = raw[end + 4 : end + 4 + int(head["content-length"])]
    return head, body[body.index(b"\r\n\r\n") + 4 :]


class Bundle:
    """Writes frames to a binary file and, at its end, their seek table."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.now, self.size = bytearray(), 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and length of the record."""
        at = (len(self.frames), len(self.now), len(raw))
        self.now += raw
        if len(self.now) >= FRAME_BYTES:
            self._end_frame()
        return at

    def _end_frame(self) -> None:
        if self.now:
            packed = self.pack.compress(bytes(self.now))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.now)))
            self.size += len(packed)
            self.now = bytearray()

    def close(self) -> None:
        self._end_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class Reader:
    """Frames of a bundle by number, found through the seek table alone."""

    def __init__(self, f):
        import zstandard

        self.f, self.open = f, zstandard.ZstdDecompressor()
        end = f.seek(0, io.SEEK_END)
        f.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        f.seek(end - 9 - 8 * count)
        table = f.read(8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.f.seek(at)
        return self.open.decompress(self.f.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bundles(marked: DataFrame, folder: str) -> DataFrame:
    """Writes rows (page_id, url, payload, digest, record_type, refers_to) as bundles; the index as a DataFrame that is cut."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _fs(folder)
        files.create_dir(root, recursive=True)
        bundle = name = None
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, kind, refers in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if bundle is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(files.open_output_stream(f"{root}/{name}", compression=None))
                ids = [None if pd.isna(x) else int(x) for x in (page_id, refers)]
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                at = bundle.add(record(ids[0], url, payload.encode(), b32, kind, ids[1]))
                rows.append((ids[0], f"{folder}/{name}", *at))
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            out = pd.DataFrame(rows, columns=["page_id", "path", "frame", "offset", "length"])
            yield out.assign(page_id=out["page_id"].astype("Int64"))
        if bundle is not None:
            bundle.close()

    return shared.cut(marked.mapInPandas(write, INDEX), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record the index names, from the files.

    A response's digest and size are those of the payload that was read; a revisit's are those in its headers.
    """
    got = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(urn: str | None):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = reader = handle = held = None
        frame = b""
        for batch in batches:
            rows = []
            for at, i, offset, length in zip(batch["path"], batch["frame"], batch["offset"], batch["length"], strict=True):
                if at != path:
                    if handle is not None:
                        handle.close()
                    files, own = _fs(at)
                    handle = files.open_input_file(own)
                    reader, path, held = Reader(handle), at, None
                if held != i:
                    frame, held = reader.frame(i), i
                head, payload = parse(frame[offset : offset + length])
                kind = head["warc-type"]
                if kind == "response":
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:
                    size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                rows.append((number(head["warc-record-id"]), size, digest, kind, number(head.get("warc-refers-to"))))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    # one row a frame travels; records are unfolded where the frame is read, in order; FRAMES_A_TASK frames are a task's
    frames = index.groupBy("path", "frame").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("at"))
    number_of = index.select("path", "frame").distinct().count()
    tasks = max(1, min(number_of, max(index.sparkSession.sparkContext.defaultParallelism, -(-number_of // FRAMES_A_TASK))))
    dealt = frames.repartition(tasks, "path", "frame").sortWithinPartitions("path", "frame")
    return dealt.select("path", "frame", F.inline("at")).mapInPandas(read, got)


def mark(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, html) with payload, digest, record_type and refers_to: the largest id of equal payloads is kept."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    # who revisits whom is found on ids and digests alone, so that copies of a common page don't meet with their payloads
    ids = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    keepers = ids.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper")
    revisits = ids.join(keepers, "digest").where("page_id <> keeper").distinct()
    joined = rows.join(revisits.hint("merge"), ["page_id", "digest"], "left")
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("keeper").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("keeper").alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every page written to bundles and read back."""
    folder = shared.new_path(spark, "warc")
    return read_bundles(write_bundles(mark(shared.table(spark, sf_dir, "pages")), folder))


#: Base32 of a SHA-1: each five hex digits are four letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
b AS (
  SELECT page_id, h, d, max(page_id) OVER (PARTITION BY d) AS keeper,
         list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((CAST('0x' || substr(d, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), 'string_agg', '') AS b32
  FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b
"""
