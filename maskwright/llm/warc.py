"""WARC archives of pages: written by tasks, one gzip member for each record, and read back sequentially.

Records with equal payloads of at least `min_revisit` bytes: the one with the smallest page_id is the response, the
others are revisits without payload that refer to it. Only (digest, page_id) is shuffled to find that, with the smallest
id of a digest combined before the shuffle and digests found once left out of the join.

The reader inflates a file in small steps, a member at a time, frames each record by its Content-Length and checks the
block's digest and, for responses, the payload's. It never holds more than one record.

Defined cases: null html is an empty payload; a null url is `urn:none`, white space and control characters in a url are
percent-encoded; a null page_id is written without an id, comes after all others and is a revisit of any record with an
id; rows with the same smallest page_id are all responses; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import shared_folder, ship, staged
from .files import opened, task_file

#: Bytes read, and inflated, at a time.
STEP = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, revisit: bool,
) -> bytes:
    """One record as its own gzip member."""
    digest = hashlib.sha256(payload).hexdigest()
    block = HTTP % len(payload) + (b"" if revisit else payload)
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    head += [f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Payload-Length: {len(payload)}",
             f"WARC-Block-Digest: sha256:{base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip('=')}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipped.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + zipped.flush()


class BadArchive(ValueError):
    """What was read is no whole, undamaged archive."""


def _members(source: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member; each must be used up before the next."""
    left = b""

    def pieces() -> Iterator[bytes]:
        nonlocal left
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            data = inflate.unconsumed_tail or left or source.read(STEP)
            if not inflate.unconsumed_tail:
                left = b""
            if not data:
                raise BadArchive("the file ends within a member")
            try:
                out = inflate.decompress(data, STEP)
            except zlib.error as e:
                raise BadArchive(f"damaged member: {e}") from None
            if out:
                yield out
        left = inflate.unused_data

    while True:
        left = left or source.read(STEP)
        if not left:
            return
        yield pieces()


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, in order, verified."""
    for pieces in _members(source):
        held = b""
        while b"\r\n\r\n" not in held:
            more = next(pieces, None)
            if more is None:
                raise BadArchive("a record without a whole header")
            held += more
        head, _, held = held.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise BadArchive(f"not a record: {first[:20]}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(fields["content-length"])
        block = bytearray(held)
        for more in pieces:
            block += more
            if len(block) > length + 4:
                raise BadArchive("a record longer than its Content-Length")
        if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
            raise BadArchive("a record that does not end at its Content-Length")
        del block[length:]
        want = fields["warc-block-digest"].removeprefix("sha256:")
        if base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("=") != want:
            raise BadArchive("wrong block digest")
        if fields["warc-type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4:]
            if hashlib.sha256(payload).hexdigest() != fields["warc-payload-digest"].removeprefix("sha256:"):
                raise BadArchive("wrong payload digest")
        yield fields, bytes(block)


def write_archives(
    pages: DataFrame, folder: str | None = None, min_revisit: int = 100, date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write the pages as archives in `folder` (a new one in the shared folder if not given); (uri, records, bytes) of
    each file that counts."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark) + "-warc"
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    found = staged(
        rows.where(F.octet_length("payload") >= min_revisit).select("page_id", "digest"), "digests")
    repeated = found.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = found.join(repeated.select("digest", "refers_to"), "digest").where(
        "refers_to is not null and not (page_id <=> refers_to)").select(
        F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to").distinct()
    both = rows.join(revisits.hint("shuffle_hash"), rows.page_id.eqNullSafe(F.col("r_page")) & (
        rows.digest == F.col("r_digest")), "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        uri = task_file(folder, "warc.gz")
        fs, path = opened(uri)
        n = 0
        with fs.open_output_stream(path) as out:
            while batch is not None:
                for page, url, payload, refers in zip(*(batch.column(c) for c in range(4)), strict=True):
                    refers = refers.as_py()
                    out.write(record(page.as_py(), url.as_py(), payload.as_py(), refers, date, refers is not None))
                    n += 1
                batch = next(batches, None)
            size = out.tell()
        yield pa.RecordBatch.from_arrays(
            [pa.array([uri]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["uri", "records", "bytes"])

    return staged(both.mapInArrow(run, "uri string, records long, bytes long"), "archives")


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record of the files in column `uri`: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits)."""
    spark = archives.sparkSession
    ship(spark)

    def page(value: str | None) -> int | None:
        found = _PAGE.fullmatch(value or "")
        return int(found[1]) if found else None

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                fs, path = opened(uri)
                with fs.open_input_stream(path) as source:
                    for fields, block in read_records(source):
                        kind = fields["warc-type"]
                        payload = block[block.index(b"\r\n\r\n") + 4:] if kind == "response" else None
                        rows.append((
                            page(fields.get("warc-record-id")), fields["warc-target-uri"],
                            int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), kind,
                            page(fields.get("warc-refers-to")), payload))
                        held += len(block)
                        if held > 4_000_000 or len(rows) >= 4096:
                            yield pack(rows)
                            rows, held = [], 0
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # One file is one task's sequential work; few small manifest rows are spread over all of them.
    spread = archives.select("uri").repartition(max(1, archives.count()))
    return spread.mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "payload binary")
