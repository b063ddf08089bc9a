"""WARC derivatives: responses to linked metadata and plain-text conversion records.

Each response record gives a `metadata` record (title, language, charset, links, and what the server said) and a
`conversion` record (its plain text). Both keep the link to their response in WARC-Refers-To and all its other headers, repeated
ones too; what is true of the response alone (digests, and what the standard bars from a conversion) is kept under the name WARC-Source-...
Both carry digests of their own. Record ids come from the response's id, so a task that runs again makes the same records. They are
written to .warc.gz files, a gzip member each, and read back from them.

`derive_files` takes response files of any crawl, gzip or plain, with a member a record or not; other records in them are passed over.
`write_responses` makes such files of a table of pages.

A payload is freed of its transfer encoding (chunked) and content encoding (gzip, deflate, zstd), and decoded by its byte order mark,
else the charset of its Content-Type, else that of its markup, else as UTF-8; labels of Latin-1 mean windows-1252, as in browsers.
An encoding that is declared but isn't there leaves the bytes as they are; one that isn't known here (br) gives no text, and the metadata say so.
HTML and XML are freed of markup, other text and JSON stay as they are, and other types give an empty conversion.

Edge cases: a null page is an empty one; a null url has no WARC-Target-URI; repeated pages give repeated
records with the same ids; broken markup, cut gzip and chunked data are read as far as they go; bytes that aren't of the charset are
replaced, an unknown charset is passed over; very long pages are converted whole; a file that ends within a record is an error;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rippleline.llm.common import bounded_batches, materialize, opened, released, table_path

VERSION = "WARC/1.1"
ROW_ID = "X-Row-ID"  # an extension header: the row that a response was made of
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard name space of URLs

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul|head|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, chr(0).join(parts))}>"


def clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


Fields = list[tuple[str, str]]

_END = re.compile(rb"\r?\n\r?\n")
_FOLD = re.compile(rb"\r?\n[ \t]+")


def _text(raw: bytes) -> str:
    """Headers are UTF-8, or else what HTTP once was."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def head_of(block: bytes) -> tuple[str, Fields, bytes]:
    """(first line, fields, what follows) of a WARC or HTTP block; folded lines are joined, repeated fields stay."""
    end = _END.search(block)
    lines = _FOLD.sub(b" ", block[: end.start()] if end else block).splitlines()
    fields = [(_text(k).strip(), _text(v).strip()) for k, colon, v in (x.partition(b":") for x in lines[1:]) if colon]
    return _text(lines[0]) if lines else "", fields, block[end.end() :] if end else b""


def value(fields: Fields, name: str) -> str | None:
    """The first field of a name, in whatever case."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def read_record(record: bytes) -> tuple[Fields, bytes]:
    """(headers, block)."""
    first, fields, rest = head_of(record)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return fields, rest[: int(value(fields, "Content-Length") or "")]


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, the first of each, and the block."""
    fields, block = read_record(record)
    return {k.lower(): v for k, v in reversed(fields)}, block


def response(page_id: int | None, url: str | None, page: str | None) -> bytes:
    payload = (page or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    uri = ([("WARC-Target-URI", url)] if url is not None else []) + ([(ROW_ID, str(page_id))] if page_id is not None else [])
    return serialize(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))), ("WARC-Date", DATE), *uri,
         ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http + payload)), ("Content-Type", "application/http; msgtype=response")],
        http + payload,
    )


def plain_text(page: str) -> str:
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def unchunked(body: bytes) -> bytes:
    """The data of a chunked body; as it is if it isn't one."""
    parts, at = [], 0
    while size := re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n").match(body, at):
        n = int(size[1], 16)
        parts.append(body[size.end() : size.end() + n])
        at = size.end() + n
        if not n:
            break
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(parts) if parts else body


def _inflate(body: bytes, wbits: int) -> bytes:
    """As far as it goes; all members of gzip data."""
    out = []
    while body:
        pack = zlib.decompressobj(wbits)
        try:
            for at in range(0, len(body), 1 << 16):
                out.append(pack.decompress(body[at : at + (1 << 16)]))
                if pack.eof:
                    break
        except zlib.error:
            return b"".join(out)
        if not pack.eof or wbits != 31:
            return b"".join(out)
        body = pack.unused_data + body[at + (1 << 16) :]
    return b"".join(out)


def decoded(body: bytes, coding: str) -> bytes | None:
    """Without a content encoding; None for one that isn't known here."""
    if coding in ("gzip", "x-gzip"):
        return _inflate(body, 31) if body[:2] == b"\x1f\x8b" else body
    if coding == "deflate":  # with the header that it should have, or without
        return _inflate(body, 15) or _inflate(body, -15) or body
    if coding == "zstd":
        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError:
            return body
    return body if coding in ("identity", "none", "") else None


# Labels that browsers take for windows-1252.
_LATIN = "ascii us-ascii ansi_x3.4-1968 latin1 l1 iso-8859-1 iso8859-1 iso88591 iso_8859-1 cp1252 x-cp1252".split()
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s\"';>]+)", re.I)
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?([^\s\"'/;>]+)|<\?xml\b[^>]*?encoding\s*=\s*[\"']([^\"']+)", re.I)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def text_of(data: bytes, content_type: str) -> tuple[str, str]:
    """(text, charset) of a payload."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    said, meta = _CHARSET.search(content_type), _META.search(data[:4096])
    inside = (meta[1] or meta[2]).decode("latin-1").lower() if meta else ""
    # Markup that could be read to this point isn't in UTF-16, whatever it says.
    for name in ((said[1].lower() if said else ""), "" if inside.startswith("utf-16") else inside):
        name = "windows-1252" if name in _LATIN else name
        try:
            if name:
                return data.decode(name, "replace"), name
        except (LookupError, ValueError):
            continue
    return data.decode("utf-8", "replace"), "utf-8"


# Fields that are a record's own, and those that the standard bars from a conversion or that hold for the response alone.
_OWN = "warc-type warc-record-id warc-refers-to warc-segment-number warc-segment-origin-id warc-segment-total-length content-length content-type".split()
_SOURCE = "warc-payload-digest warc-block-digest warc-identified-payload-type warc-truncated".split()
_BARRED = {"metadata": _SOURCE, "conversion": [*_SOURCE, "warc-ip-address", "warc-concurrent-to"]}


def carried(fields: Fields, kind: str) -> Fields:
    """The fields of a response that a record made of it keeps."""
    return [(f"WARC-Source-{k[5:]}" if k.lower() in _BARRED[kind] else k, v) for k, v in fields if k.lower() not in _OWN]


def derive(record: bytes) -> tuple[bytes, bytes]:
    """A response record to its metadata and conversion records."""
    head, block = read_record(record)
    of = value(head, "WARC-Record-ID") or record_id("response", digest(block))
    status, http, body = head_of(block) if (value(head, "Content-Type") or "application/http").lower().startswith("application/http") else ("", head, block)
    content = value(http, "Content-Type") or "text/html"
    codings = [x.strip().lower() for k, v in http if k.lower() == "content-encoding" for x in v.split(",")]
    data: bytes | None = unchunked(body) if "chunked" in (value(http, "Transfer-Encoding") or "").lower() else body
    for coding in reversed(codings):
        data = data if data is None else decoded(data, coding)
    kind = content.partition(";")[0].strip().lower()
    markup = "html" in kind or "xml" in kind
    readable = data is not None and (markup or kind.startswith("text/") or "json" in kind)
    page, charset = text_of(data, content) if readable else ("", "")
    title, lang = (_TITLE.search(page), _LANG.search(page)) if markup else (None, None)
    facts = [("title", " ".join(html.unescape(title[1]).split()) if title else ""), ("language", lang[1].lower() if lang else ""), ("charset", charset), ("http-status", status)]
    facts += [("undecoded", ", ".join(codings))] if data is None else []
    facts += [("http-header", f"{k}: {v}") for k, v in http] if status else []
    facts += [("outlink", clean(html.unescape(a or b))) for a, b in _LINK.findall(_DROP.sub(" ", page))] if markup else []
    about = "".join(f"{k}: {v}\r\n" for k, v in facts).encode("utf-8", "replace")
    text = (plain_text(page) if markup else page).encode("utf-8", "replace")
    if value(head, "WARC-Payload-Digest") is None:
        head = [*head, ("WARC-Payload-Digest", digest(body))]
    made = []
    for kind, content, own in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, of)), ("WARC-Refers-To", of), *carried(head, kind), ("WARC-Block-Digest", digest(own)), ("Content-Type", content)]
        made.append(serialize(fields, own))
    return made[0], made[1]


_MANIFEST = "path string, records long, bytes long"
_SCHEMA = "page_id long, kind string, record_id string, refers_to string, target_uri string, date string, source_digest string, block_digest string, content_length long, record binary"
SHARD_BYTES = 256 << 20


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own, without a time, so that the same record is the same bytes."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


_LENGTH = re.compile(rb"\ncontent-length[ \t]*:[ \t]*([0-9]+)", re.I)
_RESPONSE = re.compile(rb"\nwarc-type[ \t]*:[ \t]*response[ \t]*\r?\n", re.I)


def inflated(read: Callable[[int], bytes], size: int = 1 << 16) -> Iterator[bytes]:
    """A file in pieces, without its compression if it has one. What is left of a piece is copied at the end of each gzip member, so pieces are short."""
    chunk = read(size)
    if chunk[:2] != b"\x1f\x8b":
        while chunk:
            yield chunk
            chunk = read(size)
        return
    unpack = zlib.decompressobj(31)
    while chunk:
        yield unpack.decompress(chunk)
        chunk = unpack.unused_data
        if unpack.eof:
            chunk = chunk or read(size)
            unpack = zlib.decompressobj(31) if chunk else unpack
        chunk = chunk or read(size)
    if not unpack.eof:
        raise ValueError("a record is cut off")


def records(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The records of a file, one at a time, by their lengths: however they are spread over gzip members."""
    held, pieces = bytearray(), inflated(read)
    while True:
        while held[:1] in (b"\r", b"\n"):  # what ends the record before
            del held[:1]
        if (end := _END.search(held)) is None:
            if (piece := next(pieces, None)) is not None:
                held += piece
                continue
            if held:
                raise ValueError("a record is cut off")
            return
        size = _LENGTH.search(held, 0, end.end())
        if size is None or not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        stop = end.end() + int(size[1])
        while len(held) < stop:
            if (piece := next(pieces, None)) is None:
                raise ValueError("a record is cut off")
            held += piece
        yield bytes(held[:stop])
        del held[:stop]


def _to_files(made: Iterator[bytes], folder: str, name: str, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records of a task to files of about a size; a row of the manifest for each. Names have the attempt of a task, so a lost one
    leaves files that nothing reads."""
    task = TaskContext.get()
    record = next(made, None)
    for k in itertools.count():
        if record is None:
            return
        path, n, size = f"{folder}/{name}-{task.partitionId():06d}-{k:06d}-{task.taskAttemptId()}.warc.gz", 0, 0
        with opened(path, "wb") as f:
            while record is not None and size < shard_bytes:
                size += f.write(member(record))
                n += 1
                record = next(made, None)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])


def _dealt(files: DataFrame) -> DataFrame:
    """The list of files is small and the files aren't: they are dealt out by number."""
    return files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def files_below(spark: SparkSession, folder: str, glob: str = "*.warc*") -> DataFrame:
    """(path, bytes) of the files of a crawl; none is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", found["length"].alias("bytes"))


def write_responses(pages: DataFrame, out: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(page_id, url, html) -> .warc.gz files of a response a page below `out` (by default a new folder in the shared one); the manifest
    (path, records, bytes), which Spark commits."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = out or table_path(spark, "warc-responses")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _to_files((response(*row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), folder, "responses", shard_bytes)

    return materialize(pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(released(shards), _MANIFEST), "warc-manifest")


def derive_files(files: DataFrame, out: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(path) of files with response records -> .warc.gz files of two records a response below `out`; their manifest."""
    folder = out or table_path(files.sparkSession, "warc")

    def derived(paths: Iterator[str]) -> Iterator[bytes]:
        for path in paths:
            with opened(path, "rb") as f:
                for record in records(f.read):
                    if _RESPONSE.search(record, 0, _END.search(record).start() + 2):
                        yield from derive(record)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _to_files(derived(path for batch in batches for path in batch.column(0).to_pylist()), folder, "derived", shard_bytes)

    return materialize(_dealt(files).mapInArrow(released(shards), _MANIFEST), "warc-manifest")


def read(files: DataFrame) -> DataFrame:
    """The records of files (path), with what their headers say."""
    named = {"kind": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "date": "warc-date", "source_digest": "warc-source-payload-digest", "block_digest": "warc-block-digest"}

    def made(rows: list[tuple[dict[str, str], bytes, bytes]]) -> pa.RecordBatch:
        ids = [h.get(ROW_ID.lower(), "") for h, _, _ in rows]
        texts = [pa.array([h.get(x) for h, _, _ in rows], pa.string()) for x in named.values()]
        numbers = pa.array([int(x) if re.fullmatch(r"-?[0-9]{1,18}", x) else None for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([numbers, *texts, pa.array([len(b) for _, b, _ in rows], pa.int64()), pa.array([r for _, _, r in rows], pa.binary())], ["page_id", *named, "content_length", "record"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (path for batch in batches for path in batch.column(0).to_pylist()):
            with opened(path, "rb") as f:
                rows, held = [], 0
                for record in records(f.read):
                    rows.append((*parse(record), record))
                    held += len(record)
                    if held > 1 << 22 or len(rows) >= 1000:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return _dealt(files).mapInArrow(released(found), _SCHEMA)


def write(pages: DataFrame, out: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(page_id, url, html) -> files of responses, and of those the files of their derivatives below `out`; the manifest of the latter."""
    return derive_files(write_responses(pages), out, shard_bytes)


def derivatives(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> two records a page, read back from the files that were made."""
    return read(write(pages))
