"""Operator 6: WARC archives as seekable Zstandard bundles.

Records are gathered into independent frames; a footer in a skippable frame lists the size of
every frame (the public seekable format), so a reader can seek to any frame, and an index
maps each record to (bundle, frame, offset in the frame). Equal payloads are stored once:
one record is the response, the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C
from stratafuse.llm import files

FRAME, BUNDLE, LEAST = 1 << 18, 128 << 20, 1000
#: Fixed values of the seekable format: magic of the skippable frame that holds the table, and of its end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", packed, raw) for _, packed, raw in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, packed size, raw size) of each frame of an open bundle."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("bundle: no seek table that can be read")
    f.seek(size - 9 - 8 * n)
    sizes = list(struct.iter_unpack("<II", f.read(8 * n)))
    out, at = [], 0
    for packed, raw in sizes:
        out.append((at, packed, raw))
        at += packed
    return out


def _uri(page: int | None) -> str:
    return f"urn:page:{'null' if page is None else page}"


def record(page: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, its headers keep length and digest of the full payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_uri(page)}>", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_uri(refers_to)}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of one frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"record: no WARC header at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


INDEX = "page_id long, bundle string, frame long, in_frame long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, number, rows = None, "", 0, []

        def done() -> pa.RecordBatch:
            writer.flush()
            writer.close(seek_table(writer.frames))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["page_id", "bundle", "frame", "in_frame"])

        for b in batches:
            for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if writer is None:
                    name, number, rows = files.task_name("bundle", number) + ".warc.zst", number + 1, []
                    writer = files.FrameWriter(f"{folder}/{name}", FRAME, 3)
                payload = (html or "").encode()
                rows.append((page, name, *writer.add(record(page, url, payload, hashlib.sha1(payload).digest(), refers))))
                if writer.total >= BUNDLE:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame long, in_frame long"


def _page(uri: str) -> int | None:
    x = uri.strip("<>").rpartition(":")[2]
    return None if x == "null" else int(x)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for name in b.column("bundle").to_pylist():
                fs, path = files.open_fs(f"{folder}/{name}")
                with fs.open_input_file(path) as f:
                    for k, (at, packed, raw) in enumerate(read_seek_table(f, f.size())):
                        f.seek(at)
                        out = []
                        for pos, head, block in parse_records(unpack.decompress(f.read(packed), raw)):
                            told = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
                            kind = head["WARC-Type"]
                            if kind == "response" and (hashlib.sha1(block).hexdigest() != told or len(block) != int(head["X-Payload-Length"])):
                                raise ValueError(f"record: {head['WARC-Record-ID']} does not match its digest")
                            out.append((_page(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), told, kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None, name, k, pos))
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i in (2, 3, 5) else pa.int64()) for i in range(8)], [x.split()[0] for x in READ.split(", ")])

    return run


def read_record(folder: str, bundle: str, frame: int, in_frame: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one indexed record: one seek, one frame."""
    fs, path = files.open_fs(f"{folder}/bundles/{bundle}")
    with fs.open_input_file(path) as f:
        at, packed, raw = read_seek_table(f, f.size())[frame]
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), raw)
    return next((h, block) for pos, h, block in parse_records(data) if pos == in_frame)


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html, ...) into bundles below ``folder``
    and return the index (page_id, bundle, frame, in_frame), stored in ``folder``/index.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of LEAST bytes or more the
    largest page_id is the response and the others are revisits of it; rows that share this
    page_id and payload are all responses, rows of a null page_id always are. Smaller payloads
    are responses. Other columns are ignored; an empty table writes no bundle.
    """
    C.bounded_batches(spark, 500, 4)
    stage = C.work_dir(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.when(F.octet_length(payload) >= LEAST, F.sha1(payload)).alias("digest"))
    shared = rows.where("digest is not null and page_id is not null").groupBy("digest").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low < top")
    # only the pages that become revisits travel with the decision: few columns, no payloads
    named = rows.where("digest is not null and page_id is not null").select("page_id", "digest")
    revisits = named.join(shared.select("digest", "top"), "digest").where("page_id < top")
    revisits = C.saved(spark, revisits.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), F.col("top").alias("refers_to")).distinct(), stage, "revisits")
    small = revisits.count() <= C.BROADCAST_IDS // 10
    decided = rows.join(F.broadcast(revisits) if small else revisits.hint("merge"), (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("of")), "left")
    index = decided.select("page_id", "url", "html", "refers_to").mapInArrow(_write(f"{folder}/bundles"), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives, read through the bundles' seek tables and checked against
    its digest: page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, in_frame.
    A task a bundle, and no row for a folder whose index is empty."""
    bundles = spark.read.schema(INDEX).parquet(f"{folder}/index").select("bundle").distinct()
    # names are small, what they stand for isn't: a number of partitions is asked for, which isn't coalesced
    return bundles.repartitionByRange(max(1, bundles.count()), "bundle").mapInArrow(_read(f"{folder}/bundles"), READ)


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.work_dir(spark) + "/warc"
    write_archives(spark, C.documents(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.top IS NULL OR d.page_id IS NULL OR d.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id < m.top THEN m.top END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""
