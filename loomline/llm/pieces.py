"""SentencePiece encoding by N-best segmentation, and decoding.

The pieces that fit a text form a lattice; a segmentation scores the sum of its pieces' scores as
the model file has them, and a character without a piece costs UNKNOWN below the lowest score and
is written as byte pieces. Forward Viterbi gives the best score from the start to every place;
those scores are the exact distance still to go for an A-star search from the end, which therefore
yields segmentations best first.

No piece reaches from a word into the space before the next one, so a text is a row of words, and
its N best segmentations differ from the best one only in the N - 1 words whose second best
segmentation loses least. Viterbi keeps the two best scores of a word and runs over all new words
of one length at once; A-star runs for those few words, and the lists are combined two at a time,
keeping the n best. A book of words (WordBook) spares repeated ones.

Null texts encode as empty: no ids, score 0. A text has fewer than N results if it has fewer
segmentations. Among equal scores the longer last piece comes first. Each row is encoded by itself,
repeated rows alike; of the other columns of a table only doc_id is read, so none clashes. An empty
table gives no rows. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .words import WordBook, buffer_of

UNKNOWN = 10.0
LOW = float("-inf")
#: Bytes that the book of words and the lists may hold, characters of the longest word in them, bytes of an entry.
BOOK_BYTES, LISTS_BYTES, LISTS_WORD, ENTRY = 32 << 20, 12 << 20, 64, 240
#: The longest words that numpy takes, by lengths that share a matrix, and cells of a matrix.
BATCHED, CELLS = (8, 12, 20, 40), 1 << 17
MULTIPLIER, STEP = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
SPACE = "▁"


class Pieces:
    """Numbers of the pieces that stand at all places of many words, by a hash of their characters.

    The table holds every piece, and every beginning of one as number ALIVE. The hash is of 64 bits;
    what it finds is compared with the pieces once more (Lattice.learn_many).
    """

    ALIVE, NOTHING = -2, -1

    def __init__(self, pieces: list[str], scores: list[float], unknown: float) -> None:
        self.longest = max(map(len, pieces))
        #: score by number; a character that is no piece is number len(pieces); -1 and -2 are none.
        self.score = np.array([*scores, unknown, LOW, LOW])
        held: dict[int, int] = {}
        for i, p in enumerate(pieces):
            h = 0
            for c in p[:-1]:
                h = (h * STEP + ord(c) + 1) & 2**64 - 1
                held.setdefault(h, self.ALIVE)
            held[(h * STEP + ord(p[-1]) + 1) & 2**64 - 1] = i
        keys, numbers = np.array(list(held), np.uint64), np.array(list(held.values()), np.int32)
        self.bits = max(8, (3 * len(keys)).bit_length())
        self.keys, self.number = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, self.NOTHING, np.int32)
        open_, at = np.arange(len(keys)), self.place(keys)
        while len(open_):
            free = open_[self.number[at[open_]] == self.NOTHING]
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.number[at[first]] = keys[first], numbers[first]
            open_ = open_[self.keys[at[open_]] != keys[open_]]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key * MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, key: np.ndarray) -> np.ndarray:
        """The number for each hash: of a piece, ALIVE or NOTHING."""
        at = self.place(key)
        found = self.number[at]
        same = self.keys[at] == key
        out = np.where(same, found, self.NOTHING)
        open_ = np.flatnonzero(~same & (found != self.NOTHING))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.number[at[open_]]
            hit = self.keys[at[open_]] == key[open_]
            out[open_[hit]] = found[hit]
            open_ = open_[~hit & (found != self.NOTHING)]
        return out

    def at_places(self, points: np.ndarray) -> list[np.ndarray]:
        """By length less one, the pieces that begin at each cell of `points` (characters down, words
        across; 0 beyond a word's end)."""
        flat = points.astype(np.uint64).ravel()
        open_ = np.flatnonzero(flat)
        key = flat[open_] + np.uint64(1)
        out, across = [], points.shape[1]
        for k in range(1, min(points.shape[0], self.longest) + 1):
            number = self.numbers(key)
            found = np.full(len(flat), self.NOTHING, np.int32)
            found[open_] = number
            if k == 1:
                found[open_[number < 0]] = len(self.score) - 3
                number = np.where(number == self.NOTHING, self.NOTHING, self.ALIVE)
            out.append(found.reshape(points.shape))
            after = open_ + k * across
            go = (number != self.NOTHING) & (after < len(flat))
            go[go] = flat[after[go]] > 0
            if not go.any():
                break
            open_, key = open_[go], key[go] * np.uint64(STEP) + flat[after[go]] + np.uint64(1)
        return out


class Lattice:
    """Pieces of a model file, and segmentations of normalised text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        own = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        self.ids = {m.id_to_piece(i): i for i in own}
        self.unknown = min((m.get_score(i) for i in own), default=0.0) - UNKNOWN
        #: score of each piece; LOW for what only begins one.
        self.score: dict[str, float] = {}
        for p in self.ids:
            for n in range(1, len(p)):
                self.score.setdefault(p[:n], LOW)
        self.score |= {p: m.get_score(i) for p, i in self.ids.items()}
        self.names, self.numbers = list(self.ids), np.array(list(self.ids.values()), "<i4")
        self.table = Pieces(self.names, [self.score[p] for p in self.names], self.unknown)
        self.lengths = np.array([*map(len, self.names), 1])
        #: no piece reaches from one word into the next; else a text is one word.
        self.parted = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.spelled = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else None for i in range(size)]
        for p, i in self.ids.items():
            self.spelled[i] = p.replace(SPACE, " ").encode()
        self.bytes = {bytes([c]): m.piece_to_id(f"<0x{c:02X}>") for c in range(256)}
        self.plain = all(self._spell(m.encode(t)) == m.decode(m.encode(t)) for t in ("a b", " a  b", "   x ", "", "  ", "日本 \x01 é"))
        self.book = WordBook(self.learn, 2, BOOK_BYTES)
        self.lists: dict[tuple[bytes, int], list[tuple[float, np.ndarray]]] = {}
        self.lists_held = 0

    def normalised(self, text: str) -> str:
        return self.model.normalize(text) if text else ""

    def forward(self, s: str) -> tuple[list[float], list[float], list[int]]:
        """Best and second best scores up to each place, and where the best last piece begins."""
        n, score, unknown = len(s), self.score, self.unknown
        best, second, back = [LOW] * (n + 1), [LOW] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        get, ids = score.get, self.ids
        for i in range(n):
            b, c = best[i], second[i]
            for j in range(i + 1, n + 1):
                x = get(s[i:j])
                if x is None:
                    break
                new = b + x
                if new > best[j]:
                    second[j] = best[j] if best[j] > c + x else c + x
                    best[j], back[j] = new, i
                elif new > second[j]:
                    second[j] = new
            if s[i] not in ids:
                new, j = b + unknown, i + 1
                if new > best[j]:
                    second[j] = max(best[j], c + unknown)
                    best[j], back[j] = new, i
                elif new > second[j]:
                    second[j] = new
        return best, second, back

    def coded(self, s: str, places: list[int]) -> bytes:
        """Ids of the segmentation that ends pieces at places."""
        out, a = [], 0
        for b in places:
            piece = s[a:b]
            i = self.ids.get(piece)
            out += [i] if i is not None else [self.bytes[bytes([c])] for c in piece.encode()]
            a = b
        return np.array(out, "<i4").tobytes()

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words in a row, how many each has; scores, and what the second best loses."""
        parts: list[bytes] = [b""] * len(words)
        figures = np.zeros((2, len(words)))
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        bounds = np.searchsorted(-size[order], [-n for n in BATCHED], side="left")
        rest = order[: bounds[-1]].tolist()
        for n, a, b in zip(BATCHED, bounds, [len(order), *bounds[:-1]], strict=True):
            for k in range(a, b, CELLS // n):
                some = order[k : min(b, k + CELLS // n)].tolist()
                learned = self.learn_many([words[i] for i in some])
                if learned is None:
                    rest += some
                    continue
                figures[:, some] = learned[1]
                for i, own in zip(some, learned[0], strict=True):
                    parts[i] = own
        for i in rest:
            best, second, back = self.forward(words[i])
            places, j = [], len(words[i])
            while j > 0:
                places.append(j)
                j = back[j]
            parts[i] = self.coded(words[i], places[::-1])
            figures[:, i] = best[-1], best[-1] - second[-1]
        return np.frombuffer(b"".join(parts), "<i4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4, figures

    def learn_many(self, words: list[str]) -> tuple[list[bytes], np.ndarray] | None:
        """Ids and figures of words at once, longest first; None if they must be learned one by one."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, many, longest = len(words), len(self.names), int(size[0])
        points = np.zeros((n, longest), np.uint32)
        points[np.arange(longest) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        pieces = self.table.at_places(np.ascontiguousarray(points.T))
        best, second = np.full((longest + 1, n), LOW), np.full((longest + 1, n), LOW)
        best[0] = 0
        last = np.zeros((longest + 1, n), np.int32)
        some = [(p >= 0).any(1) for p in pieces]
        for j in range(1, longest + 1):
            m = int(np.searchsorted(-size, -j, side="right"))
            b, c, piece = best[j, :m], second[j, :m], last[j, :m]
            for k in range(min(j, len(pieces)), 0, -1):
                if not some[k - 1][j - k]:
                    continue
                number = pieces[k - 1][j - k, :m]
                x = self.table.score[number]
                new = best[j - k, :m] + x
                better = new > b
                c[:] = np.maximum(np.where(better, b, c), np.where(better, second[j - k, :m] + x, new))
                np.copyto(b, new, where=better)
                np.copyto(piece, number, where=better)
        ids, ends, across = np.full((n, longest), -1, np.int32), size.copy(), np.arange(n)
        for k in range(longest - 1, -1, -1):
            ids[across, k] = number = last[ends[across], across]
            ends[across] -= self.lengths[number]
            across = across[ends[across] > 0]
            if not len(across):
                break
        held = ids >= 0
        odd = (ids == many).any(1)
        numbers = ids[held & ~odd[:, None]]
        if "".join(map(self.names.__getitem__, numbers.tolist())) != "".join(w for w, o in zip(words, odd.tolist(), strict=True) if not o):
            return None  # a hash led astray
        flat = self.numbers[numbers].tobytes()
        even = np.flatnonzero(~odd)
        cut = (np.cumsum(held[even].sum(1)) * 4).tolist()
        parts = [b""] * n
        for i, a, b in zip(even.tolist(), [0, *cut], cut, strict=False):
            parts[i] = flat[a:b]
        rest = np.flatnonzero(odd)
        ends_ = np.cumsum(np.where(held[rest], self.lengths[ids[rest]], 0), 1)
        for i, own in zip(rest.tolist(), ends_.tolist(), strict=True):
            parts[i] = self.coded(words[i], list(dict.fromkeys(e for e in own if e)))
        score = best[size, np.arange(n)]
        return parts, np.stack([score, score - second[size, np.arange(n)]])

    def search(self, s: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a chunk, best first: (score, ids)."""
        if not s:
            return [(0.0, b"")]
        best = self.forward(s)[0]
        ending: dict[int, list[tuple[int, float]]] = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                x = self.score.get(s[i:j])
                if x is None:
                    break
                if x > LOW:
                    ending.setdefault(j, []).append((i, x))
            if s[i] not in self.ids:
                ending.setdefault(i + 1, []).append((i, self.unknown))
        agenda: list = [(-best[-1], len(s), 0, 0.0, None)]
        out, count = [], 0
        while agenda and len(out) < n:
            _, at, _, done, path = heapq.heappop(agenda)
            if at == 0:
                places = []
                while path:
                    places.append(path[0])
                    path = path[1]
                out.append((done, self.coded(s, places)))
                continue
            for i, x in ending[at]:
                if best[i] > LOW:
                    count += 1
                    heapq.heappush(agenda, (-(best[i] + x + done), i, count, done + x, (at, path)))
        return out

    def encode(self, text: str, n: int = 1) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text, best first: (score, little-endian ids)."""
        return [(score, ids.astype("<i4").tobytes()) for score, ids in next(self.encode_all([text], n))]

    def encode_all(self, texts: list[str], n: int = 1) -> Iterator[list[tuple[float, np.ndarray]]]:
        """The n best segmentations of each text, best first: (score, ids)."""
        if self.lists_held > LISTS_BYTES:
            self.lists.clear()
            self.lists_held = 0
        raw, at = buffer_of(pa.array(list(map(self.normalised, texts)), pa.string()))
        starts = words_of(raw, at) if self.parted else at[:-1][at[1:] > at[:-1]]
        sizes = np.diff(np.r_[starts, len(raw)])
        ids, counts, (best, loss) = self.book.read(raw, starts, sizes)
        first = np.searchsorted(starts, at)
        edge = np.r_[0, np.cumsum(counts)]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = ids[edge[a] : edge[b]]
            out = [(float(best[a:b].sum()), own)]
            if n > 1 and b > a:
                out += self.further(raw, starts[a:b], sizes[a:b], own, edge[a : b + 1] - edge[a], out[0][0], loss[a:b], n)
            yield out

    def further(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, edge: np.ndarray, score: float, loss: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
        """The second to n-th best segmentations of a text, given the best one of each word."""
        few = min(n - 1, len(loss))
        most = np.partition(loss, few - 1)[few - 1]
        near = np.concatenate([np.flatnonzero(loss < most), np.flatnonzero(loss == most)])[:few].tolist()
        lists = [self.alternatives(raw[starts[i] : starts[i] + sizes[i]].tobytes(), n) for i in near]
        order = sorted(range(len(near)), key=near.__getitem__)
        out = []
        for gain, choice in best_sums([[x[0] - own[0][0] for x in own] for own in lists], n)[1:]:
            parts, done = [], 0
            for k in order:
                if choice[k]:
                    parts += [ids[done : edge[near[k]]], lists[k][choice[k]][1]]
                    done = edge[near[k] + 1]
            out.append((score + gain, np.concatenate([*parts, ids[done:]])))
        return out

    def alternatives(self, word: bytes, n: int) -> list[tuple[float, np.ndarray]]:
        own = self.lists.get((word, n))
        if own is None:
            own = [(score, np.frombuffer(ids, "<i4")) for score, ids in self.search(word.decode(), n)]
            if len(word) <= LISTS_WORD:
                self.lists[word, n] = own
                self.lists_held += len(word) + sum(ENTRY + x[1].nbytes for x in own)
        return own

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids, by the pieces' spelling; what is not spelled so goes to the library."""
        numbers = (np.frombuffer(ids, "<i4") if isinstance(ids, bytes) else ids).tolist()
        text = self._spell(numbers) if self.plain else None
        return self.model.decode(numbers) if text is None else text

    def _spell(self, ids: list[int]) -> str | None:
        try:
            text = b"".join(map(self.spelled.__getitem__, ids)).decode()
        except (TypeError, UnicodeDecodeError):
            return None
        return text[1:] if text[:1] == " " else text


def words_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the words of normalised texts begin: at a text's begin, and at a space after no space."""
    padded = np.r_[raw, np.zeros(2, np.uint8)]
    a, b, c = SPACE.encode()
    space = np.flatnonzero((raw == a) & (padded[1:-1] == b) & (padded[2:] == c))
    run, begins = np.zeros(len(raw) + 4, bool), np.zeros(len(raw) + 1, bool)
    run[space + 3] = True
    begins[space[~run[space]]] = True
    begins[at] = True
    return np.flatnonzero(begins[:-1])


def best_sums(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n largest sums of one entry from each of the lists (each falls), largest first and equal
    ones in order of the places chosen. Lists join one after another, n sums being kept: what is
    not among them cannot be part of the n largest."""
    sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for own in lists:
        joined = ((s + x, (*places, k)) for s, places in sums for k, x in enumerate(own[:n]))
        sums = heapq.nsmallest(n, joined, key=lambda c: (-c[0], c[1]))
    return sums


def lattice_of(path: str) -> Lattice:
    """The lattice of this Python worker: tasks share it; its memos are bounded."""
    return common.lasting(("pieces", path), lambda: Lattice(path))


SCHEMA = "doc_id long, rank int, score double, n_tokens long, ids_crc32 long, decoded boolean"


def encoding(path: str, n: int, ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in common.pieces(batches, "text", 1 << 20):
            cols: list[list] = [[] for _ in range(6)]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, text, ranked in zip(batch.column("doc_id").to_pylist(), texts, lattice.encode_all(texts, n), strict=True):
                for rank, (score, coded) in enumerate(ranked, 1):
                    whole = lattice.decode(coded) == text if rank == 1 else None
                    for c, v in zip(cols, (doc_id, rank, score, len(coded), coded if ids else zlib.crc32(np.ascontiguousarray(coded, "<i4")), whole), strict=True):
                        c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols[:4], (pa.int64(), pa.int32(), pa.float64(), pa.int64()), strict=True)]
            if ids:
                offsets = np.cumsum([0, *cols[3]])
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *cols[4]]))))
            else:
                arrays.append(pa.array(cols[4], pa.int64()))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cols[5], pa.bool_())], names=["doc_id", "rank", "score", "n_tokens", "ids" if ids else "ids_crc32", "decoded"])

    return run


LISTED = "doc_id long, score double, n_tokens long, ids array<int>, decoded boolean, further array<struct<score: double, ids: array<int>>>"


def lists(own: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, own)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *own])))


def listing(path: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in common.pieces(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ranked = list(lattice.encode_all(texts, n))
            ids = lists([own[0][1] for own in ranked])
            rest = [x for own in ranked for x in own[1:]]
            rest_ = pa.StructArray.from_arrays([pa.array([x[0] for x in rest], pa.float64()), lists([x[1] for x in rest])], names=["score", "ids"])
            further = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(own) - 1 for own in ranked)]), pa.int32()), rest_)
            decoded = [lattice.decode(own[0][1]) == text for own, text in zip(ranked, texts, strict=True)]
            score, count = pa.array([own[0][0] for own in ranked], pa.float64()), pa.array([len(own[0][1]) for own in ranked], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score, count, ids, pa.array(decoded, pa.bool_()), further], names=["doc_id", "score", "n_tokens", "ids", "decoded", "further"])

    return run


def nbest_lists(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """One row for every row of docs: its best segmentation, whether that decodes to the text, and
    in `further` the second to n-th best with their scores, best first."""
    return docs.select("doc_id", "text").mapInArrow(listing(model, n), LISTED)


def nbest_digests(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """doc_id, rank, score, n_tokens and ids_crc32 of the n best segmentations of every row of
    docs, and for the best whether it decodes to the text."""
    return docs.select("doc_id", "text").mapInArrow(encoding(model, n, False), SCHEMA)


def nbest(docs: DataFrame, model: str, n: int = 1) -> DataFrame:
    """As nbest_digests, with the ids themselves."""
    return docs.select("doc_id", "text").mapInArrow(encoding(model, n, True), SCHEMA.replace("ids_crc32 long", "ids array<int>"))


def decoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in batches:
            texts = [lattice.decode(np.array(x or [], "<i4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    return rows.select("doc_id", "ids").mapInArrow(decoding(model), "doc_id long, text string")
