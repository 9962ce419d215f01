"""Text and document information of PDF bytes, for files with simple text encodings.

Content streams, plain or deflated, are scanned for text operators; composite fonts with glyph
numbers of their own are beyond this reader and give no text. Nothing here raises on a bad file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import naive_word_count, pdf_markdown

_STREAM = re.compile(rb"<<(.{0,4000}?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_TEXT = re.compile(rb"BT\b(.*?)\bET\b", re.S)
_STEP = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|-?\d+\.?\d*|\bT[dDmJj*]|['\"\[\]]|[A-Za-z*]+", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPE.get(m[1], b"" if m[1][-1:] == b"\n" else m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _shown(body: bytes) -> str:
    """Text of one text object; a move to another line is a line break, a wide gap a space."""
    out: list[str] = []
    numbers: list[float] = []
    for m in _STEP.finditer(body):
        t = m[0]
        if t[:1] in (b"(", b"<"):
            out.append(_string(t))
        elif t in (b"T*", b"'", b'"'):
            out.append("\n")
        elif t in (b"Td", b"TD"):
            if len(numbers) > 1 and numbers[-1]:
                out.append("\n")
        elif t[:1].isdigit() or t[:1] == b"-":
            numbers.append(float(t))
            if numbers[-1] < -200 and out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
            continue
        numbers = []
    return "".join(out).strip("\n")


def extract(data: bytes | None) -> dict[str, str | None]:
    """text, title, author and created (ISO) of a file."""
    data = data or b""
    parts = []
    for m in _STREAM.finditer(data):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        text = "\n".join(x for x in map(_shown, _TEXT.findall(body)) if x)
        if text:
            parts.append(text)
    info = {}
    for name in ("Title", "Author", "CreationDate"):
        m = re.search(rb"/" + name.encode() + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", data, re.S)
        info[name] = (_string(m[1]).strip() or None) if m else None
    return {"text": "\n\n".join(parts), "title": info["Title"], "author": info["Author"], "created": iso_date(info["CreationDate"])}


def iso_date(date: str | None) -> str | None:
    """`D:20240131120000+02'00'` as ISO text; missing parts are the first."""
    m = re.match(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([+-])(\d\d)'?(\d\d)?|Z)?", date or "")
    if not m:
        return None
    zone = f"{m[7]}{m[8]}:{m[9] or '00'}" if m[7] else "Z"
    return f"{m[1]}-{m[2] or '01'}-{m[3] or '01'}T{m[4] or '00'}:{m[5] or '00'}:{m[6] or '00'}{zone}"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            got = extract(batch.column("content")[i].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("path").slice(i, 1), *(pa.array([got[k]], pa.string()) for k in ("title", "author", "created", "text"))], names=["path", "title", "byline", "published_time", "text"])


def articles(files: DataFrame) -> DataFrame:
    """A record for each file of (path, content) that holds text, with its Markdown and words."""
    rows = files.select("path", "content").mapInArrow(_rows, "path string, title string, byline string, published_time string, text string").filter(F.length("text") > 0)
    return rows.withColumn("markdown", pdf_markdown(F.col("text"), F.col("title"))).withColumn("word_count", naive_word_count(F.col("text"))).withColumn("method", F.lit("pdf-parse"))
