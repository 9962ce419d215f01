"""Toxicity by a subsequence string-kernel support vector machine.

The units of a text are its lower-cased words without punctuation; runs of single letters count as
words as well ("i d i o t"). Two units are as near as the 3-letter subsequences
they share, each weighing DECAY to the power of the stretch it spans, so inserted characters and
gaps lower the similarity but do not end it. The normalised kernel counts from FLOOR on. A unit's
values against the landmarks (units as well), whitened by the landmarks' own kernel matrix
(Nyström), are its features, and a linear SVM with squared hinge loss separates them. A sentence is
as bad as its worst unit.

Where labelled toxic documents hold no telling word, pairs of words are units too: each word of a
sentence with the next one and with the one after that, so that an insult of ordinary words is seen
and one word put between them does not hide it.

Labels belong to documents, so the telling units of each toxic document, those that hardly ever
stand in clean ones, are its positives, and the worst-looking units of each clean document, found
anew in every round, are negatives. Frequent positives are also shown with a letter put in, which
teaches the weights what gaps do to the kernel. A document scores as its worst sentence, through a fitted sigmoid.

Training takes at most TRAIN_TOXIC and TRAIN_CLEAN labelled documents of up to TRAIN_CHARS
characters, lowest hashes first, and never those held out; scoring takes every whole text. Null
and empty texts score as a text without units. Without both labels in the training rows the
score is the share of toxic ones. Repeated rows are scored each; of repeated labels the highest
counts, of texts that share a labelled doc_id the first in order. Units that are equally telling
follow each other by name. An empty table gives no rows. Columns beside doc_id and text are not
read; a column with the name of the score gives way to it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast, lasting, pieces

TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 2500, 20_000
LANDMARKS, BACKGROUND, UNLIKE = 40, 8, 0.6
DECAY, SPAN, FLOOR = 0.75, 6, 0.45
LONGEST, STEP = 24, 12
ROUNDS, RIDGE, HARD = 4, 1e-3, 5
TELLING, ODDS, GAPPED = 3, 2.5, 20
SIZE = 64
#: Bytes that the memo of tokens may hold, the longest token in it, bytes of an entry beside it.
MEMO_BYTES, MEMO_TOKEN, ENTRY = 24 << 20, 64, 180
SINGLE = -1e9
#: Toxic training documents without a telling word from which on pairs are units.
UNTOLD = 3

_MARKS = re.compile(r"[^\w\s]+|_+")
_ENDS = re.compile(r"[.!?]+(?=\s|$)|\n+")


def unit(token: str) -> str:
    """A token in lower case without punctuation."""
    return _MARKS.sub("", token.lower())


def spaced(tokens: list[str], single: list[bool]) -> list[str]:
    """Words written letter by letter: runs of three and more single letters."""
    out, run = [], []
    for t, one in zip([*tokens, ""], [*single, False], strict=True):
        if one:
            run.append(unit(t))
        else:
            if len(run) > 2:
                out.append("".join(run))
            run = []
    return out


def units_of(text: str, pairs: bool = False) -> list[str]:
    """The units of a text: its tokens, its words written letter by letter, and pairs if asked for."""
    tokens = text.split()
    own = [unit(t) for t in tokens]
    return [x for w in [*own, *spaced(tokens, [len(w) == 1 for w in own])] if w for x in cut(w)] + (pairs_of(text) if pairs else [])


def pairs_of(text: str) -> list[str]:
    """Each word of a sentence with the next one, and with the one after that; of words longer than
    LONGEST the windows that face each other (the words themselves are units as a whole)."""
    out = []
    for s in sentences_of(text):
        own = [cut(w) for t in s.split() if (w := unit(t))]
        out += [f"{a[-1]} {b[0]}" for step in (1, 2) for a, b in zip(own, own[step:], strict=False)]
    return out


def sentences_of(text: str) -> list[str]:
    return [s for s in _ENDS.split(text) if s and s.strip()]


def cut(word: str) -> list[str]:
    """Overlapping windows of a word longer than LONGEST: nothing of it is lost."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - STEP, STEP)]


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a string of n characters that span SPAN at most; their weights."""
    at = np.array([t for i in range(n - 2) for t in ((i, i + a, i + b) for a, b in combinations(range(1, min(SPAN, n - i)), 2))], np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def letter(c: str) -> int:
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + o % 37 if c != "^" else 0


class Letters(dict):
    def __missing__(self, c: str) -> int:
        self[c] = letter(c)
        return self[c]


_LETTERS = Letters()


def codes_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices into words, their triple codes, weights), by length; each word begins with ^."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) > 1:
            by.setdefault(len(w) + 1, []).append(i)
    for n, where in by.items():
        at, weight = triples(n)
        for k in range(0, len(where), 4096):
            some = where[k : k + 4096]
            chars = np.zeros((len(some), n), np.int32)
            chars[:, 1:] = np.array([_LETTERS[c] for i in some for c in words[i]], np.int32).reshape(len(some), n - 1)
            yield np.array(some), (chars[:, at[:, 0]] * SIZE + chars[:, at[:, 1]]) * SIZE + chars[:, at[:, 2]], weight


def self_kernel(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    order = np.argsort(codes, axis=1, kind="stable")
    sorted_codes, w = np.take_along_axis(codes, order, 1), weight[order]
    new = np.ones(codes.shape, bool)
    new[:, 1:] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    return np.add.reduceat(sums * sums, np.concatenate([[0], np.cumsum(new.sum(1))[:-1]]))


class Landmarks:
    """Kernel values of units against fixed units."""

    def __init__(self, units: list[str]) -> None:
        self.units = units
        rows: dict[int, np.ndarray] = {}
        for where, codes, weight in codes_of(units):
            norm = np.sqrt(self_kernel(codes, weight))
            for i, own, n in zip(where, codes, norm, strict=True):
                for code, w in zip(own.tolist(), weight.tolist(), strict=True):
                    rows.setdefault(code, np.zeros(len(units), np.float32))[i] += w / n
        self.row = np.zeros(SIZE**3, np.int32)
        self.row[list(rows)] = np.arange(1, len(rows) + 1)
        self.table = np.vstack([np.zeros((1, len(units)), np.float32), *rows.values()])
        self.most = self.table.max(1)[self.row]

    def kernel(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words with any value over FLOOR, and their values less FLOOR, else 0.

        The sum of the largest table entries over the square root of the summed squared weights is
        an upper bound of a word's values, so words below FLOOR by it are left out exactly.
        """
        kept, values = [], []
        for where, codes, weight in codes_of(words):
            bound = self.most[codes] @ weight
            may = bound > FLOOR * np.sqrt((weight * weight).sum())
            if not may.any():
                continue
            where, codes = where[may], codes[may]
            rows = self.row[codes]
            k = np.zeros((len(where), len(self.units)), np.float32)
            for t in range(rows.shape[1]):
                hit = np.flatnonzero(rows[:, t])
                k[hit] += self.table[rows[hit, t]] * weight[t]
            k /= np.sqrt(self_kernel(codes, weight))[:, None]
            k = np.maximum(k - FLOOR, 0)
            some = k.any(1)
            kept.append(where[some])
            values.append(k[some])
        if not kept:
            return np.zeros(0, np.int64), np.zeros((0, len(self.units)), np.float32)
        return np.concatenate(kept), np.vstack(values)


def document_units(texts: list[str], pairs: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units; the unit and the document of every place."""
    known: dict[str, int] = {}
    ids: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        before = len(ids)
        ids += [known.setdefault(w, len(known)) for w in units_of(text, pairs)]
        counts[d] = len(ids) - before
    return list(known), np.array(ids, np.int64), np.repeat(np.arange(len(texts)), counts)


def unit_features(marks: Landmarks, texts: list[str], pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Document index and landmark values of each unit of a document that has any."""
    units, ids, of = document_units(texts, pairs)
    which, values = marks.kernel(units)
    place = np.full(len(units) + 1, -1, np.int64)
    place[which] = np.arange(len(which))
    own = place[ids]
    pairs = np.unique(np.stack([of[own >= 0], own[own >= 0]]), axis=1)
    return pairs[0], values[pairs[1]]


def svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> tuple[np.ndarray, float]:
    """Primal Newton for the squared hinge loss; `share` weighs rows within their class."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    c = share * np.where(y > 0, 0.5 / max(1e-9, share[y > 0].sum()), 0.5 / max(1e-9, share[y < 0].sum()))
    w, penalty = np.zeros(x1.shape[1]), ridge * np.eye(x1.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (x1 @ w) < 1
        a, ca = x1[active], c[active]
        new = np.linalg.solve(penalty + (a * ca[:, None]).T @ a, (a * (ca * y[active])[:, None]).sum(0))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def sigmoid_fit(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a f + b))), targets smoothed by class counts."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t, a, b = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2)), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g, h = np.array([((p - t) * f).sum(), (p - t).sum()]), p * (1 - p) + 1e-9
        step = np.linalg.solve(np.array([[(h * f * f).sum() + 1e-6, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-6]]), g)
        scale = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
    return max(float(a), 1e-3), float(b)


class Model:
    """Landmarks, weights on their values, bias and sigmoid, and whether pairs are units; or a
    constant score."""

    def __init__(self, marks: Landmarks | None, weights: np.ndarray | None, bias: float, sigmoid: tuple[float, float], constant: float | None = None, pairs: bool = False) -> None:
        self.marks, self.weights, self.bias, self.sigmoid, self.constant, self.pairs = marks, weights, bias, sigmoid, constant, pairs
        self.memo, self.held = {}, 0

    def unit_margins(self, units: list[str]) -> list[float]:
        margin = np.full(len(units), self.bias)
        which, values = self.marks.kernel(units)
        margin[which] = values @ self.weights + self.bias
        return margin.tolist()

    def learn(self, tokens: list[str]) -> None:
        """Puts tokens into the memo: the worst of a token's units, or SINGLE for a lone letter."""
        own = [unit(t) for t in tokens]
        parts = [cut(w) for w in own]
        flat = iter(self.unit_margins([x for p in parts for x in p]))
        for t, w, p in zip(tokens, own, parts, strict=True):
            worst = max(next(flat) for _ in p)
            self.memo[t] = SINGLE if len(w) == 1 else worst
        self.held += sum(map(len, tokens)) + ENTRY * len(tokens)

    def margins(self, texts: list[str]) -> np.ndarray:
        """The worst unit of each text; the bias where no unit is near a landmark. A bounded memo
        spares tokens seen before."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        memo, out = self.memo, np.full(len(texts), self.bias)
        docs = [t.split() for t in texts]
        new = list(set().union(*docs).difference(memo))
        if new:
            self.learn(new)
        for i, tokens in enumerate(docs):
            if not tokens:
                continue
            values = np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
            single = values == SINGLE
            out[i] = max(self.bias, values.max())
            if (single[2:] & single[1:-1] & single[:-2]).any():
                out[i] = max(out[i], *self.unit_margins([x for w in spaced(tokens, single.tolist()) for x in cut(w)]))
        for w in new:
            if len(w) > MEMO_TOKEN:
                del memo[w]
                self.held -= len(w) + ENTRY
        if self.pairs:
            for i, text in enumerate(texts):
                own = list(dict.fromkeys(pairs_of(text)))
                for k in range(0, len(own), 16_384):
                    out[i] = max(out[i], *self.unit_margins(own[k : k + 16_384]))
        return out

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """Every sentence of a text with its score."""
        own = sentences_of(text)
        return list(zip(own, self.scores(own).tolist(), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.sigmoid
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts) + b, -30, 30)))


def telling(bad: list[str], good: list[str], units: Callable[[str], list[str]] = units_of) -> tuple[list[list[str]], list[str]]:
    """The TELLING units of each toxic document with the highest log odds of standing in toxic
    documents (over ODDS only); and the most frequent units of clean ones."""
    sets = [[{w for w in units(t) if len(w) > 2} for t in texts] for texts in (bad, good)]
    count = [Counter(w for own in some for w in own) for some in sets]

    def odds(w: str) -> float:
        return float(np.log((count[0][w] + 0.5) / (len(bad) + 1)) - np.log((count[1][w] + 0.5) / (len(good) + 1)))

    best = [sorted((w for w in own if odds(w) > ODDS), key=lambda w: (-odds(w), w))[:TELLING] for own in sets[0]]
    return best, sorted((w for w in count[1] if odds(w) < 0.5), key=lambda w: (-count[1][w], w))[:200]


def telling_pairs(bad: list[str], good: list[str], best: list[list[str]]) -> list[list[str]]:
    """`best` with telling pairs for the documents that have no telling word that another one shares;
    a pair counts only if it tells UNTOLD of them."""
    count = Counter(w for own in best for w in own)
    untold = [i for i, own in enumerate(best) if all(count[w] < 2 for w in own)]
    if len(untold) < UNTOLD:
        return best
    pairs, _ = telling([bad[i] for i in untold], good, pairs_of)
    often = Counter(w for own in pairs for w in own)
    out = list(best)
    for i, own in zip(untold, pairs, strict=True):
        out[i] = [w for w in own if often[w] >= UNTOLD] or best[i]
    return out


def choose_landmarks(best: list[list[str]], common: list[str]) -> Landmarks:
    """Telling units, most frequent first and unlike each other, and frequent clean ones."""
    count = Counter(w for own in best for w in own)
    ranked = sorted(count, key=lambda w: (-count[w], w))[:2000]
    picked: list[str] = []
    for pool, most in ((ranked, LANDMARKS), (common, LANDMARKS + BACKGROUND)):
        if not pool:
            continue
        which, values = Landmarks(pool).kernel(pool)
        near = np.zeros((len(pool), len(pool)), np.float32)
        near[which] = values + FLOOR * (values > 0)
        taken: list[int] = []
        for i, w in enumerate(pool):
            if len(picked) >= most:
                break
            if w not in picked and (not taken or near[i, taken].max() < UNLIKE):
                taken.append(i)
                picked.append(w)
    return Landmarks(picked)


def shown(marks: Landmarks, words: list[str]) -> np.ndarray:
    """Landmark values of each of the words."""
    out = np.zeros((len(words), len(marks.units)), np.float32)
    which, values = marks.kernel(words)
    out[which] = values
    return out


def train(bad: list[str], good: list[str]) -> Model:
    best, common = telling(bad, good) if bad and good else ([], [])
    best = telling_pairs(bad, good, best)
    pairs = any(" " in w for own in best for w in own)
    if not any(best):
        return Model(None, None, 0.0, (1.0, 0.0), len(bad) / max(1, len(bad) + len(good)))
    marks = choose_landmarks(best, common)
    gram = shown(marks, marks.units)
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(gram)))
    whiten = vector / np.sqrt(np.maximum(value, 1e-2))
    insults = sorted(Counter(w for own in best for w in own).items())
    often = [(w, n) for w, n in insults if n >= GAPPED and len(w) > 4]
    gapped = [(w[:i] + c + w[i:], n / (4 * len(w))) for w, n in often for i in range(2, len(w)) for c in ("x", w[i - 1])]
    up = shown(marks, [w for w, _ in insults + gapped]) @ whiten
    share = np.sqrt([n for _, n in insults + gapped])
    of_bad, x_bad = unit_features(marks, bad, pairs)
    of_good, x_good = unit_features(marks, good, pairs)
    z_good = x_good @ whiten
    score = x_good.sum(1)
    for _ in range(ROUNDS):
        worst = top(of_good, score, HARD)
        down = np.vstack([z_good[worst], np.zeros((1, whiten.shape[1]))])
        w, b = svm(np.vstack([up, down]), np.r_[np.ones(len(up)), -np.ones(len(down))], np.r_[share, np.ones(len(down))])
        score = z_good @ w
    model = Model(marks, whiten @ w, b, (1.0, 0.0), None, pairs)
    f = []
    for n, of, values in ((len(bad), of_bad, x_bad), (len(good), of_good, x_good)):
        margin = np.full(n, b)
        np.maximum.at(margin, of, values @ model.weights + b)
        f.append(margin)
    model.sigmoid = sigmoid_fit(np.concatenate(f), np.r_[np.ones(len(bad)), -np.ones(len(good))])
    return model


def top(of: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The n best rows of each document."""
    order = np.lexsort((-score, of))
    first = np.r_[True, of[order][1:] != of[order][:-1]] if len(of) else np.zeros(0, bool)
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0)) if len(of) else np.zeros(0, int)
    return order[rank < n]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on the bounded sample of labelled documents; only its doc_ids, TRAIN_TOXIC and
    TRAIN_CLEAN at most, are broadcast."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit("train"))
    short = docs.select("doc_id", "text").filter(F.length("text") <= TRAIN_CHARS)
    there = known.join(short.select("doc_id").distinct(), "doc_id")
    sample = there.filter("toxic = 1").orderBy(order).limit(TRAIN_TOXIC).unionByName(there.filter("toxic <> 1").orderBy(order).limit(TRAIN_CLEAN))
    rows = short.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return train(rows.text[rows.toxic == 1].tolist(), rows.text[rows.toxic != 1].tolist())


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score in a column `name`, which takes the place of one that has it already."""
    sent, key = broadcast(docs.sparkSession, model), uuid.uuid4().hex
    keep = [n for n in docs.columns if n != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lasting(("toxicity", key), lambda: sent.value)
        for batch in pieces(batches, "text", 2 << 20):
            scores = held.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(scores, pa.float64())], names=[*keep, name])

    schema = T.StructType([*(docs.schema[n] for n in keep), T.StructField(name, T.DoubleType())])
    return docs.select(*keep).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
