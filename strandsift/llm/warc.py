"""WARC archives compressed with Zstandard (operator 6): writer and reader.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame
for each record. The reader loads that dictionary, walks frame by frame (block headers give each
frame's end, so nothing is guessed), decodes one record from each and validates its version line,
its mandatory headers, its Content-Length, the blank lines that close it and its SHA-1 digests.

Archives are rows of a Parquet table (name, part number, bytes) below the shared folder, written by
tasks and bounded by ``roll_bytes``; so any store that Spark reaches will do, and a lost executor
only redoes its task. ``read_files`` reads real ``.warc.zst`` files through Spark's binaryFile source.

Of records whose payloads are equal and at least ``min_revisit`` bytes long, the one with the largest
page_id is the response and the others are revisits that carry no payload, only its digest and the
response they refer to. Defined cases: null html is an empty payload; a null url is written as
``urn:page:<id>``; if rows share the largest page_id, each of them is a response; a null page_id
comes after every number (it is a response only if no equal payload has an id); an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SKIPPABLE = 0x184D2A5D  # the skippable frame that carries a dictionary
FRAME = 0xFD2FB528
BROADCAST_ROWS = 500_000  # so many digests of repeated pages are sent to all tasks; more are joined
PROFILE_URI = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record or frame that breaks the format."""


def digest32(payload_sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(payload_sha1).decode()


# ---------------------------------------------------------------- frames
def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and block headers."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise WarcError(f"no frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size_bytes = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + size_bytes
    while True:
        if at + 3 > len(data):
            raise WarcError("frame is cut off")
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise WarcError("frame is cut off")
    return at


def write_archive(records: list[bytes], dictionary: bytes | None, level: int = 3) -> bytes:
    """Dictionary frame first, then a frame for each record."""
    out = []
    if dictionary:
        out.append(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
    zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=zdict, write_checksum=True, write_content_size=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def read_frames(data: bytes, max_record: int = 1 << 30):
    """The decoded contents of each frame, in order."""
    at, zdict = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise WarcError("dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        zdict, at = zstandard.ZstdCompressionDict(raw), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=zdict) if zdict else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) >= at + 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise WarcError("skippable frame is cut off")
            continue
        end = frame_end(data, at)
        try:
            yield opener.decompress(data[at:end], max_output_size=max_record)
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        at = end


# ---------------------------------------------------------------- records
def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one record; raises WarcError where it is not valid."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("headers do not end")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version {first!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"content-length {size} against {len(rest) - 4} bytes")
    block = rest[:size]
    if (want := headers.get("warc-block-digest")) and want != digest32(hashlib.sha1(block).digest()):
        raise WarcError("block digest differs")
    return headers, block


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, kind: str, refers: int | None) -> bytes:
    """The WARC record of one page: an HTTP response, or a revisit without its payload."""
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    headers = {
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{uri}')}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": uri,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest32(sha1), "WARC-Block-Digest": digest32(hashlib.sha1(block).digest()), "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if kind == "revisit":
        headers |= {"WARC-Profile": PROFILE_URI, "WARC-Refers-To-Page": str(refers)}
    return record(kind, headers, block)


def read_page(raw: bytes) -> dict:
    """What a page record says; the payload's digest and length are checked against the payload where it is there."""
    headers, block = parse(raw)
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP headers")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind, want = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind == "response" and (size != len(payload) or want != digest32(hashlib.sha1(payload).digest())):
        raise WarcError("payload differs from its length or digest")
    if kind == "revisit" and (headers.get("warc-profile") != PROFILE_URI or payload):
        raise WarcError("not an identical-payload revisit")
    number = headers.get("x-page-id") or None
    return {
        "page_id": number and int(number), "url": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": base64.b32decode(want.removeprefix("sha1:")).hex(),
        "record_type": kind, "refers_to": int(headers["warc-refers-to-page"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


# ---------------------------------------------------------------- Spark
def record_types(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """page_id, url, html, sha1, record_type, refers_to. Digests that several large pages share are
    sent to all tasks up to BROADCAST_ROWS of them, so no html is shuffled; more are joined."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    shared = p.where(F.col("size") >= min_revisit).groupBy("sha1", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL")
    s = C.materialize(shared.select(F.col("sha1").alias("s_sha1"), F.col("size").alias("s_size"), "keeper"), "shared-digests")
    s = F.broadcast(s) if s.count() <= BROADCAST_ROWS else s
    out = p.join(s, (F.col("sha1") == F.col("s_sha1")) & (F.col("size") == F.col("s_size")), "left")
    visits = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return out.select("page_id", "url", "html", "sha1", F.when(visits, "revisit").otherwise("response").alias("record_type"), F.when(visits, F.col("keeper")).alias("refers_to"))


def write_warc(pages: DataFrame, roll_bytes: int = 8 << 20, dict_bytes: int = 16 << 10, min_revisit: int = 1000) -> DataFrame:
    """Write all pages into archives; returns the table of archives (name, archive)."""

    def run(batches):
        name, pending, held = uuid.uuid4().hex, [], 0
        count = 0

        def roll():
            dictionary = None
            samples = pending[:: max(1, len(pending) // 64)]  # the dictionary is a hint for compression, never for content
            if len(samples) >= 16:
                try:
                    dictionary = zstandard.train_dictionary(dict_bytes, [s[:4096] for s in samples]).as_bytes()
                except zstandard.ZstdError:
                    dictionary = None
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{count:05d}.warc.zst"]), pa.array([write_archive(pending, dictionary)], pa.binary())], names=["name", "archive"])

        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("html"))
            meta = batch.drop_columns(["html"]).to_pylist()
            for k, m in enumerate(meta):
                payload = buf[offsets[k] : offsets[k + 1]].tobytes()
                raw = page_record(m["page_id"], m["url"], payload, bytes.fromhex(m["sha1"]), m["record_type"], m["refers_to"])
                pending.append(raw)
                held += len(raw)
                if held >= roll_bytes:
                    yield roll()
                    pending, held, count = [], 0, count + 1
        if pending:
            yield roll()

    return C.materialize(record_types(pages, min_revisit).mapInArrow(run, "name string, archive binary"), "warc")


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of a table (name, archive): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to") + (("payload",) if payloads else ())
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for batch in batches:
            for data in batch.column("archive"):
                rows: list[dict] = []
                for raw in read_frames(data.as_buffer().to_pybytes()):
                    rows.append(read_page(raw))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in names], names=list(names))
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in names], names=list(names))

    sql = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}
    return archives.select("archive").mapInArrow(run, ", ".join(f"{c} {sql.get(c, 'string')}" for c in names))


def read_files(spark, path: str, payloads: bool = True) -> DataFrame:
    """Read ``.warc.zst`` files (each below 2 GB) from any file system that Spark reaches."""
    return read_warc(spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("archive")), payloads)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page into archives, read them back, and report each record."""
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keeper, count(*) AS n FROM p GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n > 1 AND strlen(html) >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND strlen(html) >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN k USING (html)
"""
