"""WARC files: one gzip member per record, written in parallel and read by a sequential reader.

The reader decompresses a file piece by piece with zlib, frames records by their Content-Length and
verifies block digests. It holds one record at a time, never a file. A file is one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.storage import cut, scratch_path

PIECE = 1 << 20
#: A block is one value of a row, and Spark holds no longer one.
MOST_BYTES = 2**31 - 1 - 64
_DATE = "2024-01-01T00:00:00Z"
_VERSION = b"WARC/1.1"
_CONTROL = re.compile(r"[\x00-\x20\x7f%]")
_SCHEMA = "file string, record_no bigint, type string, record_id string, uri string, page_id bigint, block string, block_is_null boolean, content_length bigint, digest_ok boolean, error string"
_ARROW = pa.schema([(c, t) for c, t in zip(_SCHEMA.replace(",", "").split()[::2], (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()))])


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _escaped(uri: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", uri)


def _plain(uri: str) -> str:
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), uri)


def record(page_id: int | None, uri: str | None, block: str | None) -> bytes:
    """A record as a gzip member. What is null is left out, or marked where the block is."""
    body = (block or "").encode("utf-8", "surrogatepass")
    headers = [("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("Content-Type", "text/html"), ("Content-Length", str(len(body))), ("WARC-Block-Digest", digest(body))]
    headers += [("WARC-Target-URI", _escaped(uri))] if uri is not None else []
    headers += [("X-Page-ID", str(page_id))] if page_id is not None else []
    headers += [("X-Null-Block", "true")] if block is None else []
    head = b"\r\n".join([_VERSION, *(f"{k}: {v}".encode() for k, v in headers)]) + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + body + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(file, n_records): the files written under path, one for each partition with rows.

    A task that runs again writes a file of another name; only the files of the attempts that counted are
    named in the result, which is kept in the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, name = None, 0, f"{path}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, at = pa.fs.FileSystem.from_uri(name)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(at, compression=None)
                out.write(record(page_id, url, html))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n_records"])

    return cut(pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "file string, n_records bigint"))


class Corrupt(ValueError):
    """What follows can't be framed any more."""


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The decompressed pieces of each gzip member in turn; plain files are one member."""
    left = stream.read(max(2, PIECE))
    if left[:2] != b"\x1f\x8b":

        def plain(piece: bytes) -> Iterator[bytes]:
            while piece:
                yield piece
                piece = stream.read(PIECE)

        if left:
            yield plain(left)
        return
    while left:
        state: dict[str, bytes] = {}

        def member(piece: bytes, state: dict = state) -> Iterator[bytes]:
            inflater = zlib.decompressobj(31)
            while piece:
                while True:
                    try:
                        out = inflater.decompress(piece, PIECE)
                    except zlib.error as e:
                        raise Corrupt(str(e)) from e
                    if out:
                        yield out
                    piece = inflater.unconsumed_tail
                    if inflater.eof or not out and not piece:
                        break
                if inflater.eof:
                    state["rest"] = inflater.unused_data
                    return
                piece = stream.read(PIECE)
            raise Corrupt("the file ends within a member")

        pieces = member(left)
        yield pieces
        for _ in pieces:  # what the caller left
            pass
        left = state.get("rest", b"") or stream.read(PIECE)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; Corrupt where the framing ends."""
    for pieces in members(stream):
        buffer = bytearray()

        def need(n: int, buffer: bytearray = buffer, pieces: Iterator[bytes] = pieces) -> bool:
            while len(buffer) < n:
                piece = next(pieces, None)
                if piece is None:
                    return False
                buffer += piece
            return True

        while need(1):
            at = 0
            while (end := buffer.find(b"\r\n\r\n", max(0, at - 3))) < 0:
                at = len(buffer)
                if not need(at + 1):
                    if buffer.strip():
                        raise Corrupt("the headers have no end")
                    break
            if end < 0:
                break
            lines = bytes(buffer[:end]).split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise Corrupt("no version line where a record begins")
            headers: dict[str, str] = {}
            for line in lines[1:]:
                name, _, value = line.partition(b":")
                headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            if not re.fullmatch(r"[0-9]{1,19}", headers.get("content-length", "")):
                raise Corrupt("no content length")
            size = int(headers["content-length"])
            if size > MOST_BYTES:
                raise Corrupt("the content length is more than a row can hold")
            del buffer[: end + 4]
            if not need(size + 4):
                raise Corrupt("the block is shorter than its content length")
            block = bytes(buffer[:size])
            if buffer[size : size + 4] != b"\r\n\r\n":
                raise Corrupt("no record end where the content length puts it")
            del buffer[: size + 4]
            yield headers, block


def _row(file: str, n: int, headers: dict[str, str], block: bytes) -> dict:
    given, page = headers.get("warc-block-digest"), headers.get("x-page-id", "")
    text = None if headers.get("x-null-block") == "true" else block.decode("utf-8", "replace")
    return {"file": file, "record_no": n, "type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "uri": _plain(headers["warc-target-uri"]) if "warc-target-uri" in headers else None, "page_id": int(page) if re.fullmatch(r"-?[0-9]{1,19}", page) and -(2**63) <= int(page) < 2**63 else None, "block": text, "block_is_null": text is None, "content_length": len(block), "digest_ok": None if given is None else given == digest(block), "error": None}


def read_warc(files: DataFrame, file_col: str = "file") -> DataFrame:
    """A row for each record of the files named in a column: its headers' main values and its block.

    digest_ok is null for a record without a digest, false for one whose block has another. A file that
    is damaged or cut off gives its records up to there and one more row with the error alone; a file of
    no bytes gives no rows; null names are left out, and a name given twice is read twice. A file that
    can't be opened fails the job. Blocks are decoded as UTF-8, bytes that aren't replaced. A length that
    isn't a number, or is over 2 GiB, counts as damage; a page id that isn't a bigint is null.
    """
    n = max(1, files.count())
    named = files.select(F.col(file_col).alias("file")).where("file IS NOT NULL").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, at = pa.fs.FileSystem.from_uri(file)
                rows, size, number = [], 0, 0
                with system.open_input_stream(at, compression=None, buffer_size=0) as stream:
                    try:
                        for headers, block in records(stream):
                            rows.append(_row(file, number, headers, block))
                            number += 1
                            size += len(block)
                            if size > 1 << 23 or len(rows) >= 10_000:
                                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                                rows, size = [], 0
                    except Corrupt as e:
                        rows.append({"file": file, "record_no": number, "error": str(e)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return named.mapInArrow(run, _SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, html, content_length, digest_ok) of every page, written to WARC files and read back.

    Null ids, urls and texts come back as nulls, empty texts as empty; rows that repeat come back as often.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    read = read_warc(write_warc(pages, scratch_path(spark, "warc")))
    return read.select("page_id", F.col("uri").alias("url"), F.col("block").alias("html"), "content_length", "digest_ok")


ORACLE = "SELECT page_id, url, html, coalesce(octet_length(encode(html)), 0)::BIGINT AS content_length, true AS digest_ok FROM pages"
