"""Web archives: metadata and plain-text conversion records derived from responses, with reader and writer."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|article|section|nav|header|footer|main|aside|blockquote|pre|figure|form|title|head|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[A-Za-z/!?][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
EPOCH = "1970-01-01T00:00:00Z"
FIELDS = [("source_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("source_digest", pa.string()), ("block_digest", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("header", pa.string()), ("block", pa.string())]
DDL = "source_id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_type string, content_length long, header string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """The same urn for the same parts, so that a repeated task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """Visible text of a whole page: no comments, scripts or styles; a line per block element; entities resolved once;
    runs of blanks are one blank, empty lines go."""
    body = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def _one_line(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value)).strip()


def _record(kind: str, fields: list[tuple[str, object]], content_type: str, block: str) -> tuple[str, str, int]:
    data = block.encode()
    block_digest = digest(data)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {_one_line(v)}" for k, v in fields if v is not None), f"WARC-Block-Digest: {block_digest}", f"Content-Type: {content_type}", f"Content-Length: {len(data)}"]
    return "\r\n".join(lines), block_digest, len(data)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(FIELDS)], names=[n for n, _ in FIELDS])

        size = 0
        for at in range(batch.num_rows):
            source, given, uri, date, http, payload, given_digest = (batch.column(i)[at].as_py() for i in range(7))
            page, uri = payload or "", uri or ""
            refers = given or record_id("response", source, uri, hashlib.sha256(page.encode()).hexdigest())
            source_digest = given_digest or digest(page.encode())
            linked = [("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", uri or None), ("WARC-Refers-To-Date", date or EPOCH)]
            common = [("WARC-Date", date or EPOCH), ("WARC-Target-URI", uri or None), *linked]
            text = plain_text(page)
            title, lang, links = _TITLE.search(page), _LANG.search(page), [html.unescape(a or b) for a, b in _LINK.findall(page)]
            conversion, meta = record_id("conversion", refers), record_id("metadata", refers)
            about = [("source-payload-digest", source_digest), ("source-length", len(page.encode())), ("conversion-id", conversion), ("title", " ".join(html.unescape(title[1]).split()) if title else None), ("language", lang[1] if lang else None)]
            about += [(f"source-http-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in (http or "").replace("\r\n", "\n").split("\n")) if v.strip()]
            about += [("outlink", x) for x in links]
            made = [
                ("metadata", meta, "application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in about if v is not None)),
                ("conversion", conversion, "text/plain; charset=utf-8", text),
            ]
            for kind, rid, content_type, block in made:
                also = [("WARC-Concurrent-To", conversion)] if kind == "metadata" else [("WARC-Source-Payload-Digest", source_digest)]
                header, block_digest, length = _record(kind, [("WARC-Record-ID", rid), *common, *also], content_type, block)
                rows.append((source, kind, rid, refers, uri, source_digest, block_digest, content_type, length, header, block))
                size += len(block)
            if size > 1 << 22:
                yield flush(rows)
                rows, size = [], 0
        if rows:
            yield flush(rows)


def derive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", record_id_col: str | None = None, date_col: str | None = None, http_col: str | None = None, digest_col: str | None = None) -> DataFrame:
    """Two rows per response, a metadata and a conversion record that refer to it: source_id, record_type, record_id,
    refers_to, target_uri, source_digest, block_digest, content_type, content_length, header, block.

    The response's own record id, date, HTTP headers and payload digest are preserved where columns for them are
    given; else the id is a urn of url, id and payload, the digest is computed, and the date is the epoch. The metadata
    block lists the source's digest, length, HTTP headers, title, language, links and the conversion's id.
    A null or empty payload gives an empty conversion, a null url no target, a null id a null source_id. Repeated rows
    give repeated records. Other columns are left out; an empty table gives an empty result.
    """
    some = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long"), some(record_id_col), F.col(url_col).cast("string"), some(date_col), some(http_col), F.col(payload_col).cast("string"), some(digest_col))
    return rows.toDF("source_id", "record_id", "uri", "date", "http", "payload", "digest").mapInArrow(_derive, DDL)


def write_records(records: DataFrame, path: str) -> int:
    """Writes records as .warc.gz files under `path`, each record a gzip member of its own, as readers seek by them; a
    file for each partition. Returns the number of records.

    `path` is a folder that the executors share, in any file system that pyarrow opens by a URI (a plain path is a
    local one). A file has its partition's number and is moved to its name once it is whole, so a repeated task leaves
    the same file, and a failed one no part of it. Existing files of the same names are replaced.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, folder = _file_system(path)
        where.create_dir(folder, recursive=True)
        name = f"{folder}/part-{task.partitionId():05d}"
        part, count = f"{name}.{task.taskAttemptId()}.tmp", 0
        with where.open_output_stream(part) as out:
            for batch in batches:
                for header, block in zip(batch.column(0), batch.column(1), strict=True):
                    out.write(gzip.compress(f"{header.as_py()}\r\n\r\n{block.as_py()}\r\n\r\n".encode(), mtime=0))
                    count += 1
        if count:
            where.move(part, f"{name}.warc.gz")
        else:
            where.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["n"])

    return records.select("header", "block").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    scheme, rest = re.fullmatch(r"(?:([a-z][a-z0-9]*):)?(.*)", path, re.S).groups()
    where, name = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}" if scheme else f"file://{quote(os.path.abspath(path))}")
    return where, name.rstrip("/")


def _members(stream: BinaryIO, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, piece by piece, expanded if they are gzip members."""
    expand = None
    data = stream.read(step)
    zipped = data[:2] == b"\x1f\x8b"
    while data:
        if not zipped:
            yield data
        while zipped and data:
            expand = expand or zlib.decompressobj(31)
            yield expand.decompress(data)
            data, expand = (expand.unused_data, None) if expand.eof else (b"", expand)
        data = stream.read(step)


def _records(stream: BinaryIO, path: str) -> Iterator[tuple[str, str]]:
    """(header, block) of each record of a file. What is held is a record and a piece of the file."""
    held, at = bytearray(), 0
    pieces = _members(stream)

    def reach(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while reach(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not reach(len(held) + 1):
                raise ValueError(f"no end of a header from byte {at} of {path}")
        head = held[:end].decode(errors="replace")
        size = re.search(r"(?im)^content-length:\s*(\d+)\s*$", head)
        if not head.startswith("WARC/") or not size:
            raise ValueError(f"no record at byte {at} of {path}")
        stop = end + 4 + int(size[1])
        if not reach(stop):
            raise ValueError(f"the record at byte {at} of {path} is cut off")
        yield head, held[end + 4 : stop].decode(errors="replace")
        reach(stop + 4)
        del held[: stop + 4]
        at += stop + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*rows, strict=True)], names=["header", "block"])

    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, name = _file_system(path)
            rows, size = [], 0
            with where.open_input_stream(name, compression=None) as stream:
                for head, block in _records(stream, path):
                    rows.append((head, block))
                    size += len(head) + len(block)
                    if size > 1 << 22:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)


def read_records(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(header, block) of every record in .warc or .warc.gz files, by content length. Spark lists the files, dealt over
    `tasks` (by default as many as there are cores); a task streams its files, so memory is bounded by a record."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(tasks or spark.sparkContext.defaultParallelism).mapInArrow(_parse, "header string, block string")
