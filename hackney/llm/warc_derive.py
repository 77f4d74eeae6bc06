"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records. The conversion record holds the page's text; the
metadata record holds the title, character set, links and the response's own headers,
each as a line ``source-header: Name: value``. Both carry ``WARC-Refers-To`` with the
response's record id, its target URI and date, and ``WARC-Payload-Digest`` of the
payload they derive from beside the ``WARC-Block-Digest`` of their own block; the
metadata record names the conversion record as ``WARC-Concurrent-To``. Record ids follow
from the contents, so a task that runs again writes the same records.

Responses come from a table of pages (``write_derivatives``) or from the response records
of WARC files (``derive_files``), whose own ids, headers and digests are kept.

Files have one gzip member a record, so records can be read alone. Tasks write under
a name of their own attempt; the manifest, written by Spark, names the committed ones.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import html as entities
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_dir, small_batches

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
NAMESPACE = uuid.NAMESPACE_URL
#: The date of responses whose table has none.
DATE = "1970-01-01T00:00:00Z"

#: Elements whose text is no text of the page, and those that end a line (fixed).
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe")
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
_NAME = re.compile(r"[a-z][a-z0-9]*")
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)
_SPACES = re.compile(r"[^\S\n]+")


@dataclass
class Response:
    """A response record: named headers, and its block of HTTP headers and payload."""

    headers: dict[str, str]
    http: list[tuple[str, str]]
    payload: bytes


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def to_bytes(self) -> bytes:
        lines = [VERSION] + [f"{k}: {_line(v)}".encode() for k, v in self.headers.items()]
        return b"\r\n".join(lines) + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value; control characters would end the line and are escaped."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join((kind, *parts)))}>"


def response_of(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> Response:
    """The response that a row of ``pages`` stands for; nulls are empty."""
    payload = (html or "").encode()
    headers = {"WARC-Type": "response"}
    headers["WARC-Record-ID"] = record_id("response", str(page_id), url or "", digest(payload))
    if url is not None:
        headers["WARC-Target-URI"] = url
    headers["WARC-Date"] = date
    headers["WARC-Payload-Digest"] = digest(payload)
    headers["Content-Type"] = "application/http; msgtype=response"
    http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return Response(headers, http, payload)


_ASCII_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def parse_page(html: str) -> tuple[str, dict[str, list[str]]]:
    """The page's text, and its title, charset and links; one pass, any length.

    Broken markup is read as far as it goes: a tag, comment or hidden element
    without an end goes to the end of the page.
    """
    low, out, at, n = html.lower(), [], 0, len(html)
    if len(low) != n:  # a dotted capital I becomes two; places must stay those of the page
        low = html.translate(_ASCII_LOWER)
    meta: dict[str, list[str]] = {"title": [], "charset": [], "link": []}
    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            out.append(html[at:])
            break
        out.append(html[at:tag])
        if low.startswith("<!--", tag):
            end = html.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        close = low.startswith("</", tag)
        name = _NAME.match(low, tag + 1 + close)
        if not name and html[tag + 1 : tag + 2] not in ("!", "?", "/"):
            out.append("<")
            at = tag + 1
            continue
        end = html.find(">", tag)
        end = n if end < 0 else end
        what = name[0] if name else ""
        at = end + 1
        if what in BLOCKS:
            out.append("\n")
        if close:
            continue
        if what in HIDDEN:
            stop = low.find(f"</{what}", at)
            at = n if stop < 0 else stop
        elif what == "a" and (m := _HREF.search(html, tag, end)):
            meta["link"].append(entities.unescape(next(g for g in m.groups() if g is not None)))
        elif what == "meta" and (m := _CHARSET.search(html, tag, end)):
            meta["charset"].append(m[1])
        elif what == "title" and not meta["title"]:
            stop = low.find("</title", at)
            meta["title"].append(" ".join(entities.unescape(html[at : n if stop < 0 else stop]).split()))
    text = _SPACES.sub(" ", entities.unescape("".join(out)))
    lines = (x.strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x), meta


def header_of(http: list[tuple[str, str]], name: str) -> str:
    """The first value of an HTTP header, whatever its case; empty for none."""
    return next((v for k, v in http if k.lower() == name), "")


def charset_of(response: Response) -> str:
    """The charset the HTTP header names, else one named in the page, else UTF-8."""
    head = response.payload[:1024].decode("ascii", "replace")
    for place in (header_of(response.http, "content-type"), head):
        if m := _CHARSET.search(place):
            try:
                if codecs.lookup(m[1])._is_text_encoding:
                    return m[1]
            except LookupError:
                continue
    return "utf-8"


def is_text(response: Response) -> bool:
    """Does the payload have a text to convert? So also where no type is named."""
    kind = header_of(response.http, "content-type").partition(";")[0].strip().lower()
    return not kind or kind.startswith("text/") or kind == "application/xhtml+xml"


def derivatives(response: Response) -> list[Record]:
    """The records of a response: of a payload that is no text the metadata alone."""
    if is_text(response):
        return list(derive(response))
    metadata, _ = derive(Response(response.headers, response.http, b""), response.payload)
    del metadata.headers["WARC-Concurrent-To"]
    return [metadata]


def derive(response: Response, payload: bytes | None = None) -> tuple[Record, Record]:
    """(metadata, conversion) records of a response, linked to it and to each other.

    ``payload`` is what the digest is of where the response names none, else its own.
    """
    source = response.headers
    refers = source["WARC-Record-ID"]
    payload_digest = digest(response.payload if payload is None else payload)
    text, found = parse_page(response.payload.decode(charset_of(response), errors="replace"))
    shared = {"WARC-Refers-To": refers}
    shared |= {k: source[k] for k in ("WARC-Target-URI", "WARC-Date") if k in source}
    shared["WARC-Payload-Digest"] = source.get("WARC-Payload-Digest", payload_digest)

    def record(kind: str, content: str, block: bytes, more: dict[str, str]) -> Record:
        own = {"WARC-Type": kind, "WARC-Record-ID": record_id(kind, refers), **shared, **more}
        own |= {"WARC-Block-Digest": digest(block), "Content-Type": content, "Content-Length": str(len(block))}
        return Record(own, block)

    conversion = record("conversion", "text/plain; charset=utf-8", text.encode(), {})
    fields = [(k, v) for k in ("title", "charset", "link") for v in found[k]]
    fields += [("source-header", f"{k}: {v}") for k, v in [*source.items(), *response.http]]
    block = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode()
    link = {"WARC-Concurrent-To": conversion.headers["WARC-Record-ID"]}
    return record("metadata", "application/warc-fields", block, link), conversion


#: Names of headers that are read here; files may spell them in any case.
_SPELT = {
    name.lower(): name
    for name in "WARC-Type WARC-Record-ID WARC-Target-URI WARC-Date WARC-Payload-Digest Content-Type Content-Length".split()
}


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Named fields; a line that begins with a space goes on with the one before."""
    found: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode(errors="replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            found.append((name.strip(), value.strip()))
    return found


def stored_records(stream: io.BufferedIOBase) -> Iterator[Record]:
    """The records of a WARC file of version 1.0 or 1.1, one at a time.

    Fields that repeat are joined by commas. A file that breaks off is a ValueError.
    """
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/1."):
            raise ValueError("a record does not begin with its version")
        lines: list[bytes] = []
        while (line := stream.readline()).strip():
            lines.append(line)
        headers: dict[str, str] = {}
        for name, value in _fields(lines):
            name = _SPELT.get(name.lower(), name)
            headers[name] = f"{headers[name]}, {value}" if name in headers else value
        if not line or not headers.get("Content-Length", "").isdigit():
            raise ValueError("a record has no end of its headers or no length")
        block = stream.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]):
            raise ValueError(f"{headers.get('WARC-Record-ID')} breaks off")
        yield Record(headers, block)


def _joined(chunks: bytes) -> bytes:
    """The body of a chunked transfer; one that breaks off, as far as it goes."""
    out, at = [], 0
    while (end := chunks.find(b"\r\n", at)) >= 0:
        try:
            size = int(chunks[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(chunks[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def _unpacked(body: bytes, coding: str) -> bytes:
    """The body without its content coding; as it is where that cannot be read."""
    bits = {"gzip": [31], "x-gzip": [31], "deflate": [15, -15]}.get(coding.strip().lower(), [])
    for window in bits:
        try:
            unzip = zlib.decompressobj(window)
            return unzip.decompress(body) + unzip.flush()
        except zlib.error:
            continue
    return body


def response_in(record: Record) -> Response | None:
    """The HTTP response a record holds, its body decoded; None for other records."""
    if record.headers.get("WARC-Type", "").lower() != "response" or not record.block.startswith(b"HTTP/"):
        return None
    if "WARC-Record-ID" not in record.headers:
        raise ValueError("a response without a record id")
    head = io.BytesIO(record.block)
    head.readline()
    lines = []
    while (line := head.readline()).strip():
        lines.append(line)
    http, body = _fields(lines), head.read()
    if "chunked" in header_of(http, "transfer-encoding").lower():
        body = _joined(body)
    return Response(record.headers, http, _unpacked(body, header_of(http, "content-encoding")))


def read_records(data: bytes) -> Iterator[Record]:
    """The records of one or more gzip members; digests and lengths are verified."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data)
        data = member.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if first != VERSION:
            raise ValueError("a record does not begin with its version")
        headers = dict(x.decode().split(": ", 1) for x in lines)
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or digest(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"{headers['WARC-Record-ID']} does not match its digest")
        yield Record(headers, block)


def member_of(record: Record) -> bytes:
    zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipper.compress(record.to_bytes()) + zipper.flush()


#: Of a record in a file: where it lies, and what links and checks it.
INDEX = """page_id long, warc_type string, record_id string, refers_to string, concurrent_to string,
    target_uri string, payload_digest string, block_digest string, n_bytes long, path string,
    offset long, length long"""


def _writer(files: str, responses: Callable) -> Callable:
    """Writes the derivatives of what ``responses`` makes of a task's batches; the index of them.

    ``responses`` takes the batches and yields (page_id, response).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task, out, offset, rows, schema = TaskContext.get(), None, 0, [], index_schema()
        store, inner = fs.FileSystem.from_uri(files)
        store.create_dir(inner, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"

        def index() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for page, response in responses(batches):
            if out is None:
                out = store.open_output_stream(posixpath.join(inner, name), compression=None)
            for record in derivatives(response):
                member, h = member_of(record), record.headers
                out.write(member)
                rows.append(
                    (
                        page,
                        h["WARC-Type"],
                        h["WARC-Record-ID"],
                        h["WARC-Refers-To"],
                        h.get("WARC-Concurrent-To"),
                        h.get("WARC-Target-URI"),
                        h["WARC-Payload-Digest"],
                        h["WARC-Block-Digest"],
                        len(record.block),
                        f"{files}/{name}",
                        offset,
                        len(member),
                    )
                )
                offset += len(member)
            if len(rows) >= 1000:
                yield index()
        if rows:
            yield index()
        if out is not None:
            out.close()

    return write


def write_derivatives(pages: DataFrame, path: str, date: str = DATE) -> DataFrame:
    """Writes the derivatives of ``pages`` (page_id, url, html) below ``path``.

    Returns the index, one row a record, written by Spark beside the files. Null urls
    give records without target, null html an empty text. Repeated rows give equal
    records, each. An empty table gives no files. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Response]]:
        for batch in batches:
            for page, url, html in zip(*(batch[k] for k in range(3)), strict=True):
                page = page.as_py()
                yield page, response_of(page, url.as_py(), html.as_py(), date)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    slim.mapInArrow(_writer(f"{path}/warc", responses), INDEX).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def derive_files(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Writes the derivatives of the WARC files at ``source`` below ``path``; their index.

    Files are plain or gzip, of any member layout; each is read by one task, which holds
    one record. Ids, target, date and payload digest are those of the response record,
    and its headers and the HTTP headers are ``source-header`` lines. Other
    records, and responses that are not HTTP, give none. A payload of another type than
    text gives a metadata record only. ``page_id`` is null. Repeated records give equal
    ones, each. An empty file gives none; a broken one fails the job, by its name.
    """

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Response]]:
        from pyarrow import fs

        for name in (n for batch in batches for n in batch[0].to_pylist()):
            if name.startswith("file:/"):
                store, inner = fs.LocalFileSystem(), "/" + name[5:].lstrip("/")
            else:
                store, inner = fs.FileSystem.from_uri(quote(name, safe=":/@"))
            with store.open_input_stream(inner, compression=None, buffer_size=1 << 20) as raw:
                stream = io.BufferedReader(raw)
                packed = stream.peek(2)[:2] == b"\x1f\x8b"
                try:
                    for record in stored_records(gzip.GzipFile(fileobj=stream) if packed else stream):
                        if response := response_in(record):
                            yield None, response
                except (ValueError, EOFError, OSError, zlib.error) as e:
                    raise ValueError(f"{name}: {e}") from e

    files = spark.read.format("binaryFile").load(source).select("path")
    files = files.repartition(max(1, files.count()))
    files.mapInArrow(_writer(f"{path}/warc", responses), INDEX).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def index_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in INDEX.replace("\n", " ").split(","))])


def read_derivatives(index: DataFrame) -> DataFrame:
    """A row for each record, read from its file by place; all digests are verified.

    Records of a file are read in runs by the tasks that hold their index rows; the
    index names the page, everything else comes from the record itself.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        path, file = None, None
        names = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "payload_digest"]
        names += ["block_digest", "n_bytes", "block_sha256"]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    path = row["path"]
                    store, inner = fs.FileSystem.from_uri(path)
                    file = store.open_input_file(inner)
                file.seek(row["offset"])
                (record,) = read_records(file.read(row["length"]))
                h = record.headers
                rows.append(
                    (
                        row["page_id"],
                        h["WARC-Type"],
                        h["WARC-Record-ID"],
                        h["WARC-Refers-To"],
                        h.get("WARC-Target-URI"),
                        h["WARC-Payload-Digest"],
                        h["WARC-Block-Digest"],
                        len(record.block),
                        hashlib.sha256(record.block).hexdigest(),
                    )
                )
            if rows:
                kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string()]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return index.select("page_id", "path", "offset", "length").mapInArrow(
        read,
        "page_id long, warc_type string, record_id string, refers_to string, target_uri string,"
        " payload_digest string, block_digest string, n_bytes long, block_sha256 string",
    )


def op9(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The records of all pages as read back from the written files."""
    return read_derivatives(write_derivatives(pages, shared_dir(spark)))
