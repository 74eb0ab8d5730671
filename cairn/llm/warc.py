"""WARC derivatives: linked metadata and plain-text conversion records of response records.

For every response record two records are derived: ``metadata`` (JSON of the response's WARC and HTTP headers and of
what the page says of itself: title, meta fields, links) and ``conversion`` (the page's text lines). Both name the
response in WARC-Refers-To and keep its target, date, payload digest and HTTP headers (in files as WARC-Source-*); each has
a digest of its own block. Record
ids are derived from the response's id, so reruns give the same files.

``read`` takes WARC files (plain or gzip, one member for each record or one for all) from any store Spark reads;
``write`` makes valid WARC files with Spark's text sink (every record ends with CR LF CR LF). Work is row by row in
the scan's tasks, without a shuffle.

Nulls: a null html is an empty payload, a null url an empty target; null ids are carried. Repeated pages give records
of the same ids. Responses that are not HTTP messages have their whole block as payload. Extra columns are ignored.
Empty tables and files give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._html import lines

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_END = "\r\n\r\n"
RESPONSE = "page_id long, record_id string, target_uri string, date string, http_head string, payload binary"
DERIVED = (
    "page_id long, url string, warc_type string, record_id string, refers_to string, date string, content_type string, "
    "payload_digest string, block_digest string, content_length long, source_headers string, block string"
)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(parts))}>"


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of fetched pages, with the HTTP head that they must have had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
                rows.append((page_id, record_id("response", str(page_id), url or "", digest(payload)), url or "", date, head, payload))
            yield _table(rows, ("page_id", "record_id", "target_uri", "date", "http_head", "payload"), (pa.int64(), *[pa.string()] * 4, pa.binary()))

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, RESPONSE)


def _table(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_META = re.compile(r"<meta\s[^>]*>", re.I)
_LINK = re.compile(r"<(a|link|img|script|iframe|form)\s[^>]*?\b(href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_FIELD = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def _charset(head: str) -> str:
    m = re.search(r"(?im)^content-type:.*?charset=[\"']?([\w.:-]+)", head)
    try:
        return m[1] if m and "".encode(m[1]) == b"" else "utf-8"
    except LookupError:
        return "utf-8"


def _headers(head: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:]) if k.strip()}


def _derive(page_id, response: str, uri: str, date: str, head: str, payload: bytes) -> list[tuple]:
    html = payload.decode(_charset(head), "replace")
    payload_digest = digest(payload)
    title, source = _TITLE.search(html), _headers(head)
    about = {
        "Envelope": {
            "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": response, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": payload_digest},
            "HTTP-Response-Metadata": {
                "Response-Line": head.split("\r\n")[0],
                "Headers": source,
                "Head": {
                    "Title": " ".join(unescape(title[1]).split()) if title else None,
                    "Metas": [{m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _FIELD.finditer(x)} for x in _META.findall(html)],
                },
                "Links": [{"path": f"{m[1].upper()}@/{m[2].lower()}", "url": unescape(m[3] or m[4] or m[5] or "")} for m in _LINK.finditer(html)],
            },
        }
    }
    blocks = (("metadata", "application/json", json.dumps(about, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", "\n".join(x.text for x in lines(html))))
    out, listed = [], "\r\n".join(f"{k}: {v}" for k, v in source.items())
    for kind, content_type, block in blocks:
        raw = block.encode("utf-8", "replace")
        out.append((page_id, uri, kind, record_id(kind, response), response, date, content_type, payload_digest, digest(raw), len(raw), listed, raw.decode()))
    return out


def derive(responses_: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = tuple(x.split()[0] for x in DERIVED.split(", "))
        kinds = (pa.int64(), *[pa.string()] * 8, pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = [r for x in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns)) for r in _derive(*x)]
                yield _table(rows, names, kinds)

    return responses_.select(*(x.split()[0] for x in RESPONSE.split(", "))).mapInArrow(run, DERIVED)


def write(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of derived records."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("warc_type")), field("WARC-Record-ID", F.col("record_id")), field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Target-URI", F.col("url")), field("WARC-Date", F.col("date")), field("WARC-Payload-Digest", F.col("payload_digest")),
        field("WARC-Block-Digest", F.col("block_digest")), field("Content-Type", F.col("content_type")), field("Content-Length", F.col("content_length").cast("string")),
        F.when(F.col("source_headers") != "", F.concat(F.regexp_replace("source_headers", "(^|\r\n)", "$1WARC-Source-"), F.lit("\r\n"))).otherwise(""), F.lit("\r\n"), F.col("block"),
    )
    derived.select(record.alias("value")).write.option("lineSep", _END).option("compression", compression).text(path)


def _inflate(content: bytes) -> bytes:
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out) if out else content


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC headers, block) of every whole record of a file; what a cut-off end leaves is no record."""
    data, at = _inflate(content), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = _headers(data[at:end].decode("utf-8", "replace"))
        size = next((v for k, v in head.items() if k.lower() == "content-length"), "")
        if not size.isdigit():
            at = end + 4
            continue
        begin, at = end + 4, end + 4 + int(size)
        if at > len(data):
            return
        yield head, data[begin:at]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers map<string,string>, block binary) of all records below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                for head, block in records(content):
                    yield _table([(file, list(head.items()), block)], ("file", "headers", "block"), kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "file string, headers map<string,string>, block binary")


def responses_of(found: DataFrame) -> DataFrame:
    """The response records of ``read`` in the form that ``derive`` takes; page_id is null."""
    head_end = F.instr(F.decode("block", "ISO-8859-1"), "\r\n\r\n")
    split = (head_end > 0) & F.startswith(F.decode(F.substring("block", 1, 5), "ISO-8859-1"), F.lit("HTTP/"))
    return found.where(F.col("headers")["WARC-Type"] == "response").select(
        F.lit(None).cast("long").alias("page_id"), F.col("headers")["WARC-Record-ID"].alias("record_id"), F.coalesce(F.col("headers")["WARC-Target-URI"], F.lit("")).alias("target_uri"),
        F.coalesce(F.col("headers")["WARC-Date"], F.lit("")).alias("date"),
        F.when(split, F.decode(F.expr("substring(block, 1, instr(decode(block, 'ISO-8859-1'), '\\r\\n\\r\\n') - 1)"), "ISO-8859-1")).otherwise("").alias("http_head"),
        F.when(split, F.expr("substring(block, instr(decode(block, 'ISO-8859-1'), '\\r\\n\\r\\n') + 4)")).otherwise(F.col("block")).alias("payload"),
    )
