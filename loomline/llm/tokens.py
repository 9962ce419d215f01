"""Token ids as Parquet lists.

Documents are dealt by ranges of doc_id and sorted, so that the files in the order of their part
numbers, read from first to last row, hold the documents in ascending doc_id. A file has, beside
the list of ids, the document's columns: doc_id, start_in_part and n_tokens (delta encoded: the
writer is version 2 and their dictionary is off) and the ids (dictionary encoded: the vocabulary
has under 65,536 ids, so pages hold 16-bit codes). Row groups and pages are small and the writer
keeps column and offset indexes, so a reader of a few documents reads a few pages, and a reader of
the metadata never touches a token page.

Null text encodes as empty: the end id alone. Null doc_id sorts first. Rows with equal doc_id are
ordered by text and encoded each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lasting, pieces, shared_dir
from .words import WordBook, buffer_of

END = 1
#: Parquet writer: bytes of a row group and of a page, encodings.
FORMAT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"
#: Ends of words that are remembered, and characters of one.
TAILS, TAIL = 65_536, 64
#: The longest word, in bytes, that is merged in numpy.
MERGED = 48
#: Marks that end a word as one piece for the pre-tokenizer (an apostrophe may begin another).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
NONE = np.int32(2**31 - 1)


class Merges:
    """Byte-pair merges of many words at once.

    The words of one length are a matrix of symbols. In every step each word merges its pair of the
    lowest rank, the leftmost of equal ones, as the tokenizer's model does; a word without a pair
    left is done.
    """

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import pre_tokenizers

        model = json.loads(tokenizer)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.fit = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Symbols of a byte inside a word and at its end; -1 where a byte cannot stand alone.
        self.inner, self.last = np.full(256, -1, np.int32), np.full(256, -1, np.int32)
        for c in map(chr, range(0x250)):
            for byte, shown in zip(c.encode(), mapped.pre_tokenize_str(c)[0][0] if c.strip() else "", strict=False):
                self.inner[byte], self.last[byte] = vocab.get(shown, -1), vocab.get(shown + suffix, -1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.wide = len(vocab) + 1
        keys = np.array([vocab[x] * self.wide + vocab[y] for x, y in pairs], np.int64).reshape(-1)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32).reshape(-1)
        # an open-addressed table of the pairs, a fifth of it filled at most
        self.bits = max(8, (5 * len(keys)).bit_length())
        self.keys, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        open_, at = np.arange(len(keys)), self.place(keys)
        while len(open_):
            free = open_[self.keys[at[open_]] < 0]
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.rank[at[first]] = keys[first], first
            open_ = open_[self.keys[at[open_]] != keys[open_]]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        symbols = np.r_[self.inner, self.last]
        self.first = self.ranks(np.repeat(self.inner, 512), np.tile(symbols, 256)).reshape(256, 512)

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.wide + right
        at = self.place(key)
        held = self.keys[at]
        out = np.where(held == key, self.rank[at], NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def merged(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (a matrix of bytes), left-aligned, and how many each word has."""
        n, width = words.shape
        symbols = self.inner[words]
        symbols[:, -1] = self.last[words[:, -1]]
        out, counts, open_ = symbols.copy(), np.full(n, width), np.arange(n)
        second = words[:, 1:].astype(np.int64)
        second[:, -1:] += 256
        rank = self.first[words[:, :-1], second]
        cols = np.arange(width)
        for used in range(width, 1, -1):
            at = rank[:, : used - 1].argmin(1)
            best = rank[np.arange(len(at)), at]
            done = best == NONE
            if done.any():
                out[open_[done], :used] = symbols[done, :used]
                counts[open_[done]] = used
                go = ~done
                open_, symbols, rank, at, best = open_[go], symbols[go], rank[go], at[go], best[go]
            if not len(open_):
                return out, counts
            rows, after = np.arange(len(open_)), cols[: used - 1] > at[:, None]
            symbols = np.where(after, symbols[:, 1:used], symbols[:, : used - 1])
            symbols[rows, at] = self.made[best]
            if used == 2:
                break
            rank = np.where(after[:, :-1], rank[:, 1 : used - 1], rank[:, : used - 2])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(symbols[left, at[left] - 1], symbols[left, at[left]])
            right = np.flatnonzero(at < used - 2)
            rank[right, at[right]] = self.ranks(symbols[right, at[right]], symbols[right, at[right] + 1])
        out[open_, 0], counts[open_] = symbols[:, 0], 1
        return out, counts


class WordEncoder:
    """Ids of whole texts, one word at a time.

    No token crosses white space: the pre-tokenizer drops it and special tokens hold none. Hence
    ids of a text are those of its words in a row, and a book of words (WordBook) spares repeated
    ones. A word of Latin letters alone is one piece for the pre-tokenizer and, in lower case, what
    the normaliser makes of it, so its bytes are merged here (Merges); the marks after it are a piece
    of their own. Every other word takes the tokenizer's whole way. Whether the short way holds for a
    tokenizer is tried on some words first.
    Words end at what both Python and the tokenizer take as white space; the four separators U+001C
    to U+001F are none for the tokenizer, so a text with one of them is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.book = Tokenizer.from_file(path), WordBook(self.learn)
        self.merges = Merges(self.tokenizer.to_str())
        letters = np.array([chr(c).isalpha() and c != 0x130 for c in range(0x250)])
        self.letter = np.r_[letters, False]
        self.tails = {"": b""}
        tried = [w + t for w in ("A", "the", "Straße", "ÉTÉ", "ñandú", "Wordlike", "Ǆ", "x") for t in ("", ".", ",", "###", ".%%%", "-")]
        self.short = self.merges.fit and self.quick(tried)[0] == dict(zip(tried, self.slow(tried), strict=True))

    def slow(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def quick(self, words: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of words of letters below U+0250 other than U+0130 before a tail of MARKS or none;
        the words that are no such ones."""
        cores = [w.rstrip(MARKS) for w in words]
        ends = [w[len(c) :] for w, c in zip(words, cores, strict=True)]
        if fresh := list({t for t in ends if t not in self.tails and len(t) <= TAIL}):
            if len(self.tails) > TAILS:
                self.tails = {"": b""}
                fresh = list({t for t in ends if t and len(t) <= TAIL})
            self.tails.update(zip(fresh, self.slow(fresh), strict=True))
        text = "\n".join(cores) + "\n"
        points = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x250)
        starts = np.r_[0, np.flatnonzero(points == 10)[:-1] + 1]
        good = np.add.reduceat(~self.letter[points], starts) == 1  # the line's end alone
        good &= np.fromiter(map(self.tails.__contains__, ends), bool, len(ends))
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        stop = np.flatnonzero(raw == 10)
        begin = np.r_[0, stop[:-1] + 1]
        size = np.where(good, stop - begin, 0)
        good &= (size > 0) & (size <= MERGED)
        out: dict[str, bytes] = {}
        order = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[order], np.arange(1, MERGED + 2))
        for n, a, b in zip(range(1, MERGED + 1), bounds[:-1], bounds[1:], strict=True):
            some = order[a:b]
            if not len(some):
                continue
            bytes_ = raw[begin[some, None] + np.arange(n)]
            known = (self.merges.inner[bytes_[:, :-1]] >= 0).all(1) & (self.merges.last[bytes_[:, -1]] >= 0)
            if not known.all():
                good[some[~known]] = False
                some, bytes_ = some[known], bytes_[known]
                if not len(some):
                    continue
            ids, counts = self.merges.merged(bytes_)
            flat = ids[np.arange(n) < counts[:, None]].astype("<i4", copy=False).tobytes()
            cut = (np.cumsum(counts) * 4).tolist()
            where = some.tolist()
            out.update(zip(map(words.__getitem__, where), [flat[x:y] + self.tails[ends[i]] for x, y, i in zip([0, *cut], cut, where, strict=False)], strict=True))
        return out, [words[i] for i in np.flatnonzero(~good).tolist()]

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new, rest = self.quick(words) if self.short and words else ({}, words)
        for i in range(0, len(rest), 4096):
            new.update(zip(rest[i : i + 4096], self.slow(rest[i : i + 4096]), strict=True))
        parts = list(map(new.__getitem__, words))
        return np.frombuffer(b"".join(parts), "<i4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4, np.zeros((0, len(parts)))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each has."""
        raw, at = buffer_of(texts)
        starts, sizes, odd = spans_of(raw, at)
        of = np.searchsorted(at, starts, side="right") - 1
        if len(odd):
            keep = ~np.isin(of, odd)
            starts, sizes, of = starts[keep], sizes[keep], of[keep]
        ids, counts, _ = self.book.read(raw, starts, sizes)
        sums = np.bincount(of, counts, minlength=len(texts)).astype(np.int64)
        if len(odd):
            own = dict(zip(odd.tolist(), self.slow([raw[at[i] : at[i + 1]].tobytes().decode() for i in odd]), strict=True))
            parts = np.split(ids, np.cumsum(sums)[:-1])
            parts = [np.frombuffer(own[i], "<i4") if i in own else p for i, p in enumerate(parts)]
            ids, sums = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sums

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian 32 bits each."""
        ids, sums = self.encode_column(pa.array(texts, pa.string()))
        return [x.astype("<i4").tobytes() for x in np.split(ids, np.cumsum(sums)[:-1])]


#: Kinds of bytes: 1 white space, 2 the separators U+001C to U+001F, 3 what may begin longer white space.
KINDS = np.zeros(256, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 1
KINDS[0x1C:0x20] = 2
KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] = 3


def spans_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and sizes of the words of texts that stand in a row, and the texts with a separator."""
    kind = KINDS[raw]
    word = kind != 1
    lead = np.flatnonzero(kind == 3)
    a, b, c = (np.r_[raw, np.zeros(2, np.uint8)][lead + i] for i in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    dashes = (c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & ((b == 0x80) & dashes | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    for i, which in enumerate((two | three, two | three, three)):
        word[lead[which] + i] = False
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.r_[False, word[:-1]] & ~edge[:-1]
    after = np.r_[word[1:], False] & ~edge[1:]
    starts = np.flatnonzero(word & ~before)
    odd = np.unique(np.searchsorted(at, np.flatnonzero(kind == 2), side="right") - 1)
    return starts, np.flatnonzero(word & ~after) + 1 - starts, odd


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker: tasks share its memo, which is bounded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return lasting(("tokens", path), lambda: WordEncoder(path))


def encoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = encoder_of(path), TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", 2 << 20):
            ids, sums = encoder.encode_column(batch.column("text"))
            flat, sizes = np.insert(ids, np.cumsum(sums), END), sums + 1
            ends = np.cumsum(sizes)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part), pa.int32()), batch.column("doc_id"), pa.array(start + ends - sizes), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["part", "doc_id", "start_in_part", "n_tokens", "ids"])
            start += int(ends[-1]) if len(ends) else 0

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the token files to `path`."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(encoding(tokenizer), SCHEMA).write.options(**FORMAT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, start_in_part, n_tokens; the token pages are not read."""
    return spark.read.schema(SCHEMA).parquet(path).drop("ids")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part and the ids before it, one row a file."""
    from pyspark.sql.window import Window

    sums = read_metadata(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("part").alias("base_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].data) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("start_in_part"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    read = spark.read.schema(SCHEMA).parquet(path).select("part", "doc_id", "start_in_part", "ids")
    sums = read.mapInArrow(summed, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    joined = sums.join(starts(spark, path), F.col("part") == F.col("base_part"))
    return joined.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents: the filter reaches the page index."""
    return spark.read.schema(SCHEMA).parquet(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return digest(spark, path)
