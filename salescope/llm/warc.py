"""WARC derivatives: metadata and plain-text conversion records made from response records.

``responses`` writes pages as WARC/1.1 response records. ``derive`` reads response records (named
fields, HTTP status and headers, payload) and makes for each a ``conversion`` record with the page's
plain text and a ``metadata`` record about it. Both refer to the response (``WARC-Refers-To``), keep
its target, date and payload digest, and the metadata record keeps the HTTP headers and names the
conversion. Record ids are UUIDs of a record's content, so a repeated run gives the same ids.
``write`` writes records as WARC files through Spark's text writer.

Plain text: comments, scripts and styles go; block elements and line breaks start a line; other tags
go; character references are resolved; blanks are folded and empty lines dropped.

Defined results: null html is an empty payload, a null url an empty target; a record that is no
well-formed response (unknown version, missing id, payload shorter than announced) gives no
derivatives and stands in ``failure``; a payload that differs from its digest is converted, and its
metadata says so (digests in base 32 or base 16, of any algorithm hashlib always has; others never match);
a text key may hold line ends; repeated rows give records with equal ids. Extra columns pass through ``derive``.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import with_columns

VERSION = "WARC/1.1"
BREAK = "\r\n"
DATE = "1970-01-01T00:00:00Z"

_BLOCKS = ("address article aside blockquote br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
           "body li main nav ol p pre section table tbody td th thead title tr ul option select").split()
_MARKUP = re.compile(
    rb"<!--.*?(?:-->|\Z)"
    rb"|<(script|style|noscript|template)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    rb"|</?([a-z][a-z0-9]*+)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    rb"|</?([a-z][a-z0-9]*+)[^>]*+>"
    rb"|<[!?][^>]*+>", re.I | re.S)
_BLANKS = re.compile(r"[^\S\n]+")
_TITLE = re.compile(rb"<title\b[^>]*+>(.*?)</title", re.I | re.S)
_LINK = re.compile(rb"<a\s[^>]*?href\s*=", re.I)
_LANG = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_BLOCK_NAMES = frozenset(b.encode() for b in _BLOCKS)


def _tag(m: re.Match) -> bytes:
    name = m[2] or m[3]
    return b"\n" if name and name.lower() in _BLOCK_NAMES else b" " if m[1] else b""


def plain_text(page: bytes) -> str:
    text = html.unescape(_MARKUP.sub(_tag, page.replace(b"\r", b" ").replace(b"\n", b" ")).decode("utf-8", "replace"))
    return "\n".join(t for line in text.split("\n") if (t := _BLANKS.sub(" ", line.replace("\xa0", " ")).strip()))


def digest(block: bytes) -> str:
    return "sha1:" + hashlib.sha1(block).hexdigest()


def same_digest(given: str, block: bytes) -> bool:
    """Whether ``given`` (algorithm, colon, value in base 32 or base 16) is the digest of ``block``."""
    name, _, value = given.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return False
    own = hashlib.new(name, block, usedforsecurity=False).digest()
    return value.strip().rstrip("=").upper() in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())


def _id(kind: str, *parts: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + ':' + hashlib.sha1(b'|'.join(parts)).hexdigest())}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that follow it in a file."""
    head = [VERSION, *(f"{k}: {re.sub('[\r\n]+', ' ', v)}" for k, v in fields), f"Content-Length: {len(block)}"]
    return BREAK.join(head).encode() + b"\r\n\r\n" + block


def parse(source: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (by lower-case name) and block of a record."""
    head, gap, rest = source.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(BREAK)
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size) or "warc-record-id" not in fields:
        raise ValueError("no id, or a block shorter than announced")
    return fields, rest[:int(size)]


def response(url: str, payload: bytes, key: str, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record([("WARC-Type", "response"), ("WARC-Record-ID", _id("response", key.encode(), url.encode(), payload)), ("WARC-Date", date), ("WARC-Target-URI", url),
                   ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http + payload)), ("Content-Type", "application/http; msgtype=response")], http + payload)


def derivatives(source: bytes) -> list[dict]:
    """The conversion and the metadata record of a response."""
    fields, block = parse(source)
    if fields.get("warc-type") != "response":
        raise ValueError("not a response")
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("utf-8", "replace").split(BREAK)
    origin, own = fields["warc-record-id"], digest(payload)
    given = fields.get("warc-payload-digest", own)
    shared = [("WARC-Refers-To", origin), ("WARC-Target-URI", fields.get("warc-target-uri", "")), ("WARC-Date", fields.get("warc-date", DATE))]

    def made(kind: str, content_type: str, body: bytes) -> dict:
        key = _id(kind, origin.encode(), body)
        named = [("WARC-Type", kind), ("WARC-Record-ID", key), *shared, ("WARC-Source-Payload-Digest", given), ("WARC-Block-Digest", digest(body)), ("Content-Type", content_type)]
        return {"record_type": kind, "record_id": key, "refers_to": origin, "content_length": len(body), "block_digest": digest(body), "record": record(named, body).decode("utf-8", "replace")}

    text = plain_text(payload)
    conversion = made("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))
    title = _TITLE.search(payload)
    language = _LANG.search(payload)
    about = [("title", plain_text(title[1]).replace("\n", " ") if title else ""), ("language", language[1].decode().lower() if language else ""), ("links", str(len(_LINK.findall(payload)))),
             ("conversion", conversion["record_id"]), ("conversion-digest", conversion["block_digest"]), ("conversion-chars", str(len(text))),
             ("source-status", status), *((f"source-header-{k.strip().lower()}", v.strip()) for k, _, v in (h.partition(":") for h in headers)),
             ("source-payload-digest", given), ("source-payload-length", str(len(payload))), ("source-digest-matches", str(same_digest(given, payload)).lower())]
    return [conversion, made("metadata", "application/warc-fields", "".join(f"{k}: {v}{BREAK}" for k, v in about).encode("utf-8", "replace"))]


def responses(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """The key and ``record``: a response record for each page."""
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    packed = pages.select(F.col(key), F.concat_ws("\n", F.octet_length(named), F.concat(named, F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]+", " ")),
                                                  F.coalesce(page, F.lit(""))).alias("__page"))

    def made(packed: bytes) -> str:
        size, rest = packed.split(b"\n", 1)
        named, rest = rest[:int(size)], rest[int(size):]  # a key may hold line ends
        address, payload = rest.split(b"\n", 1)
        return response(address.decode("utf-8", "replace"), payload, named.decode("utf-8", "replace"), date).decode("utf-8", "replace")

    def rows(batch):
        return ([made(p) for p in batch],)

    return with_columns(packed, "__page", [("record", "string")], lambda: rows).drop("__page")


_KIND = "array<struct<record_type:string,record_id:string,refers_to:string,content_length:long,block_digest:string,record:string>>"


def derive(df: DataFrame, *, source: str = "record") -> DataFrame:
    """All rows with ``derived``, the conversion and metadata records of the response in ``source``, and ``failure``."""

    def rows(batch):
        made, failed = [], []
        for r in batch:
            try:
                made.append(derivatives(r))
                failed.append(None)
            except ValueError as e:
                made.append([])
                failed.append(str(e))
        return made, failed

    return with_columns(df, source, [("derived", _KIND), ("failure", "string")], lambda: rows)


def write(records: DataFrame, path: str, *, column: str = "record") -> None:
    """WARC files, one for each partition: every record is followed by two line ends."""
    records.where(F.col(column).isNotNull()).select(column).write.option("lineSep", BREAK * 2).text(path)
