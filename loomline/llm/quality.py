"""Quality rules by compression bands.

A document is compressed by zstandard as a whole and in fixed chunks. Its ratio, compressed over
raw bytes, must lie inside the band of its length: below it the text repeats itself, above it
there is no language in it. Short texts compress badly, hence the limits fall with the length, in
straight lines between the points of LIMITS over the logarithm of the bytes. The lower limits lie
just under what labelled good documents have; much of labelled junk lies below them.

The chunk rule looks for a passage inside a longer document: fixed chunks, and one more that ends
with the text where its last bytes fill no chunk, so every byte of a text over CHUNK is in a chunk.
Too large a share of chunks outside the chunk band rejects the document. A text of CHUNK bytes or
less is its only chunk, which the whole ratio judges.

A null text has no words, as an empty one: both fail the base rule. Every row is judged by itself,
whatever its length; equal rows alike. Of other columns only doc_id is read, so none clashes. An
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import pieces

LEVEL = 3
CHUNK = 4096
#: (bytes, least whole ratio, greatest whole ratio). The least are about 0.006 under the lowest of
#: 21,785 labelled documents that pass the base rule; the greatest leave room for other scripts.
LIMITS = (
    (256, 0.490, 0.90), (512, 0.490, 0.82), (724, 0.487, 0.78), (1024, 0.478, 0.74), (1448, 0.458, 0.72), (2048, 0.448, 0.70),
    (2896, 0.442, 0.69), (4096, 0.430, 0.68), (5792, 0.420, 0.67), (8192, 0.410, 0.66), (11585, 0.406, 0.65), (16384, 0.401, 0.64),
    (23170, 0.395, 0.63), (32768, 0.388, 0.62), (65536, 0.382, 0.62), (131072, 0.372, 0.62), (1 << 20, 0.300, 0.62), (1 << 26, 0.250, 0.62),
)
#: Least and greatest ratio of a chunk, and the share of a document's chunks that may lie outside.
#: No chunk of a labelled good document was under 0.439 or over 0.514.
CHUNK_BAND, CHUNKS_OUTSIDE = (0.43, 0.70), 0.25

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, chunks_outside long"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def band(n: int) -> tuple[float, float]:
    """Least and greatest whole ratio of a text of n bytes."""
    sizes, low, high = zip(*LIMITS, strict=True)
    at = np.log2(max(n, 1))
    return float(np.interp(at, np.log2(sizes), low)), float(np.interp(at, np.log2(sizes), high))


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, back, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[back] > 1
    marked = np.zeros(len(words), bool)
    marked[:-2] |= hit
    marked[1:-1] |= hit
    marked[2:] |= hit
    return int(marked.sum())


def duplicate_lines(text: str) -> int:
    lines = Counter(line for line in text.split("\n") if _has_word(line))
    return sum(lines.values()) - len(lines)


def _has_word(line: str) -> bool:
    return bool(line.strip("\x20\t\n\x0b\x0c\r"))


class Compression:
    """Ratios of one text, and the verdict on them."""

    def __init__(self, level: int = LEVEL) -> None:
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

    def ratio(self, raw: bytes) -> float:
        return len(self.zstd.compress(raw)) / len(raw) if raw else 1.0

    def judge(self, raw: bytes) -> tuple[float, int, int, bool]:
        """Whole ratio, chunks, those outside the band, verdict."""
        ratio = self.ratio(raw)
        starts = [*range(0, len(raw) - CHUNK + 1, CHUNK)] if len(raw) > CHUNK else []
        if len(raw) > CHUNK and len(raw) % CHUNK:
            starts.append(len(raw) - CHUNK)
        outside = sum(not CHUNK_BAND[0] <= self.ratio(raw[i : i + CHUNK]) <= CHUNK_BAND[1] for i in starts)
        low, high = band(len(raw))
        return ratio, len(starts), outside, bool(raw) and low <= ratio <= high and outside <= CHUNKS_OUTSIDE * len(starts)


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compression = Compression()
    for batch in pieces(batches, "text"):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            raw = text.encode()
            words = raw.split()  # bytes split at exactly \t \n \v \f \r and space
            n, repeated = len(words), repeat_words(words)
            failed = n < 50 or 100 * repeated > 50 * n
            ratio, chunks, outside, good = compression.judge(raw)
            rows.append((doc_id, n, len(text) - len(_SPACE.findall(text)), len(_SYMBOL.findall(text)), duplicate_lines(text), repeated, failed, not failed and good, len(raw), ratio, chunks, outside))
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        names, types = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def quality(docs: DataFrame) -> DataFrame:
    """The base counts, the verdict and the method's own figures for every row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(judged, SCHEMA)
