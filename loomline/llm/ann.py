"""Approximate nearest neighbours by additive quantisation.

A vector is encoded as one code word from each of BOOKS full-dimensional codebooks whose sum is
near it. The books are fitted to residuals on a bounded sample, book after book; a vector is
encoded by beam search over the books, and the squared norm of its code sum is stored with the
codes. A query's inner products with all code words are a lookup table; with the stored norm they
score a candidate in BOOKS additions. In each block of candidates the best SHARE of a query's
scores (SHORT at least, and all that equal the last of them) are scored again exactly, in double
precision, on the original vectors, and the best `k` of all blocks are the answer.

Of vectors that are equal in all components only the k + 1 smallest vec_ids can be among the k
nearest of any query, so only those are candidates: a vector that fills a third of the table is a
few rows of the index, and ties go to the smaller vec_id exactly. Exact scores are sums in one
order for all rows, so equal vectors score equally.

Queries and candidates meet in blocks: each block of queries is sent to each block of candidates,
so no task holds more than a block of either. Vectors that are null, empty, zero or hold null or
non-finite components take no part, and neither do those of another length than most. Rows with
equal vec_id are one vector (the first in order of components); a null vec_id takes no part. Other
columns are not read, so none clashes. Without queries or candidates there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast, written

BOOKS, WORDS, BEAM = 12, 256, 4
SAMPLE, PASSES = 8192, 6
BLOCK, QUERIES = 4096, 1024
SHORT, SHARE = 128, 0.04


class Quantiser:
    """Codebooks of shape (BOOKS, WORDS, d), float32."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books
        self.squares = (books * books).sum(2)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 11) -> Quantiser:
        rng = np.random.default_rng(seed)
        words = max(1, min(WORDS, len(x)))
        rest, books = x.astype(np.float32).copy(), []
        for _ in range(BOOKS):
            book = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(PASSES):
                near = nearest(rest, book)
                counts = np.bincount(near, minlength=words)
                sums = np.zeros_like(book)
                order = np.argsort(near, kind="stable")
                some = np.flatnonzero(counts)
                sums[some] = np.add.reduceat(rest[order], np.r_[0, np.cumsum(counts[some])[:-1]])
                book[some] = sums[some] / counts[some, None]
                empty = np.flatnonzero(counts == 0)
                if len(empty):
                    book[empty] = rest[rng.choice(len(rest), len(empty))]
            rest -= book[nearest(rest, book)]
            books.append(book)
        return cls(np.stack(books))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, BOOKS) and squared norms of the code sums."""
        codes, norms = [], []
        for i in range(0, len(x), 1024):
            c, n = self._encode(x[i : i + 1024].astype(np.float32), beam)
            codes.append(c)
            norms.append(n)
        return np.concatenate(codes), np.concatenate(norms)

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, d = x.shape
        rest = x[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for book, squares in zip(self.books, self.squares, strict=True):
            width = rest.shape[1]
            cost = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, -1) + squares
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            from_beam, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, from_beam[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, from_beam[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        at = (rest * rest).sum(2).argmin(1)
        rows = np.arange(n)
        total = x - rest[rows, at]
        return codes[rows, at], (total * total).sum(1)

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Cosines of queries (unit length) with the code sums, shape (candidates, queries)."""
        out = np.zeros((len(codes), len(queries)), np.float32)
        for m, book in enumerate(self.books):
            out += (book @ queries.T)[codes[:, m]]
        return out / np.sqrt(np.maximum(norms, 1e-12))[:, None].astype(np.float32)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    squares = (book * book).sum(1)
    return np.concatenate([(squares - 2 * (x[i : i + 4096] @ book.T)).argmin(1) for i in range(0, len(x), 4096)])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part, one row a vec_id."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    good = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.filter(good)
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def candidates_of(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal embeddings the k + 1 smallest vec_ids; each task keeps that many at most
    before the shuffle."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")


def directions(lists: pd.Series) -> np.ndarray:
    x = np.stack(lists.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest candidates found for each vec_id
    divisible by `every`."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "ann-vectors")
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0]["d"]
    asking = rows.filter((F.size("embedding") == d) & (F.col("vec_id") % every == 0))
    rows = written(candidates_of(rows.filter(F.size("embedding") == d), k), "ann-candidates")
    n, asked = rows.count(), asking.count()
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()
    quantiser = broadcast(spark, Quantiser.fit(directions(sample.embedding)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = directions(batch.column("embedding").to_pandas())
            codes, norms = quantiser.value.encode(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float64))], names=["vec_id", "embedding", "codes", "norm"])

    index = written(rows.mapInArrow(encode, "vec_id long, embedding array<double>, codes binary, norm double"), "ann-index")
    parts, asks = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    ask = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asks))
    blocks = index.withColumn("block", block).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long"))))
    queries = asking.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), ask.alias("ask")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def meet(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q, ids = directions(own.embedding), directions(asked["query"]), own.vec_id.to_numpy()
        codes = np.frombuffer(b"".join(own.codes), np.uint8).reshape(len(own), -1)
        short = min(len(own), max(SHORT, int(SHARE * len(own))))
        out = []
        for i in range(0, len(q), 256):
            part = quantiser.value.scores(q[i : i + 256].astype(np.float32), codes, own.norm.to_numpy()).T
            cut = np.partition(part, len(own) - short, axis=1)[:, len(own) - short]
            for query, query_id, scores, least in zip(q[i : i + 256], asked.query_id.to_numpy()[i : i + 256], part, cut, strict=True):
                some = np.flatnonzero((scores >= least) & (ids != query_id))
                exact = (x[some] * query).sum(1)
                order = np.lexsort((ids[some], -exact))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[some][order], "score": exact[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = blocks.groupBy("ask", "block").cogroup(queries.groupBy("ask", "block")).applyInPandas(meet, "query_id long, vec_id long, score double")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return top.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
