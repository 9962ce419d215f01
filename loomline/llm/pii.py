"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

Seeds are e-mail addresses, IP addresses, card and phone numbers. Every seed, and every other token
that looks like an identifier (three digits in it, or an @), is an instance; the words beside it are
lexical patterns: the two words before it, and the word before with the word after. Strings in the
form of a credential (SECRET) are seeds of a further kind, `secret`, but as they may be mere digests
they are spans only where an accepted pattern says so. Spark holds the
graph of patterns and instances and scores it in rounds: a pattern of a kind scores the confidence
of its instances of that kind over the number of its distinct instances, and needs SUPPORT distinct
ones, so copies of a text count once; an instance is as sure as its best accepted pattern. Patterns
of TRUST and more discover what no fixed pattern finds, such as a number behind words that elsewhere
stand before phone numbers, and those discoveries support further patterns in the next round.

Spans are code points, end exclusive; base spans stay, discovered ones never overlap them and bear
the kind of their pattern. Null texts are empty. Every row is answered, repeated rows alike; only
texts decide, of whatever length, and other columns may bear any name. Of patterns that are equally
sure of a span the kind that is last by name counts. An empty table gives no rows. Words and
instances of more than LONG characters stand for themselves by their digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, pieces, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
LONG = 64
ROUNDS, SUPPORT, TRUST = 3, 4, 0.75

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_EDGE = "\"'`([{<>}]).,;:!?"

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, one @ at a time: the local part is the run of its characters
    before the @, no further back than the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if not _MARK.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (EVERY.index(s[0]), s[1])))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Identifier-like tokens, with three digits or an @ in them, that touch no base span."""
    out = []
    cover = sorted((a, b) for _, a, b in taken)
    at, i = 0, 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\v\f\r":
            start -= 1
        end = _TOKEN.match(text, start).end()
        at = end
        word = text[start:end]
        a = start + len(word) - len(word.lstrip(_EDGE))
        b = end - (len(word) - len(word.rstrip(_EDGE)))
        while i < len(cover) and cover[i][1] <= a:
            i += 1
        if a >= b or i < len(cover) and cover[i][0] < b:
            continue
        word = text[a:b]
        if "@" in word or sum(map(str.isdigit, word)) >= 3:
            out.append((a, b))
    return out


def named(word: str) -> str:
    """A word or instance as it stands in the graph."""
    return word if len(word) <= LONG else "#" + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def beside(text: str, at: int, step: int) -> Iterator[str]:
    """The words before (step -1) or after (1) a place, nearest first, whole however long; marks at
    their ends do not count, and a word of marks alone is none."""
    reach = 80
    while True:
        part = text[max(0, at - reach) : at] if step < 0 else text[at : at + reach]
        whole = reach >= (at if step < 0 else len(text) - at)
        words = part.split()[::step]
        if not whole and words and (part[0] if step < 0 else part[-1]) not in " \t\n\v\f\r":
            words.pop()  # it may go on
        words = [w for x in words if (w := x.lower().strip(_EDGE))]
        if whole or len(words) > 1:
            yield from words
            return
        reach *= 4


def context(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns around a span; none without a word before it."""
    before = [named(w) for w, _ in zip(beside(text, a, -1), range(2), strict=False)][::-1]
    after = named(next(beside(text, b, 1), ""))
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before:
        out.append(f"{before[-1]} _ {after}" if after else f"{before[-1]} _")
    return out


FOUND = pa.struct([("kind", pa.string()), ("own", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
SCHEMA = "doc_id long, h1 long, h2 long, base string, n_email long, n_ip long, n_card long, n_phone long, found array<struct<kind:string,own:boolean,a:long,b:long,instance:string,patterns:array<string>>>"


def finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        bases, counts, found = [], {k: [] for k in KINDS}, []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            bases.append(told(spans))
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in spans))
            every = [*((k, True, a, b) for k, a, b in spans), *(("secret" if SECRET.fullmatch(text, a, b) else None, False, a, b) for a, b in candidates(text, spans))]
            found.append([{"kind": k, "own": own, "a": a, "b": b, "instance": named(text[a:b].lower()), "patterns": context(text, a, b)} for k, own, a, b in every])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(bases, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(found, pa.list_(FOUND))], names=["doc_id", "h1", "h2", "base", *(f"n_{k}" for k in KINDS), "found"])


def hashed(docs: DataFrame, h1: str = "h1", h2: str = "h2") -> DataFrame:
    """docs with two 64-bit hashes of the text, which stand for it in joins."""
    t = text_or_empty()
    return docs.withColumn(h1, F.xxhash64(t)).withColumn(h2, F.xxhash64(F.lit(1), F.length(t), t))


def trusted_patterns(found: DataFrame) -> DataFrame:
    """pattern, kind and confidence of the patterns accepted; found: kind, instance, pattern."""
    edges = written(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-graph")
    known = edges.filter("kind is not null").select("instance", F.col("kind").alias("as"), F.lit(1.0).alias("sure")).distinct()
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("all")).filter(F.col("all") >= SUPPORT)
    accepted = None
    for _ in range(ROUNDS):
        held = edges.join(known, "instance").groupBy("pattern", "as").agg(F.sum("sure").alias("mass"), F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
        scored = held.join(sizes, "pattern").select("pattern", F.col("as").alias("kind"), (F.col("mass") / F.col("all")).alias("confidence")).filter(F.col("confidence") >= TRUST)
        accepted = written(scored, "pii-patterns")
        new = edges.filter("kind is null").drop("kind").join(accepted, "pattern").groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("x"))
        known = known.filter("sure = 1.0").unionByName(new.select("instance", F.col("x.kind").alias("as"), F.least(F.col("x.confidence"), F.lit(0.99)).alias("sure")))
        known = written(known, "pii-known")
    return accepted


def discovered(spans: DataFrame) -> DataFrame:
    """h1, h2 and extra (kind:a:b) of every text with discovered spans."""
    each = spans.select("h1", "h2", F.explode("found").alias("x")).select("h1", "h2", "x.*")
    rows = each.select("h1", "h2", "kind", "a", "b", "instance", F.explode("patterns").alias("pattern"), "own")
    accepted = trusted_patterns(rows)
    hits = rows.filter("not own").drop("kind").join(accepted, "pattern").groupBy("h1", "h2", "a", "b").agg(F.max(F.struct("confidence", "kind")).alias("x"))
    span = F.concat_ws(":", "x.kind", F.col("a").cast("string"), F.col("b").cast("string"))
    return written(hits.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(span)).alias("extra")), "pii-extra")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """base_sha256 and all spans in order."""
    for batch in batches:
        sums, every, counts = [], [], []
        for base, extra in zip(batch.column("base").to_pylist(), batch.column("extra").to_pylist(), strict=True):
            sums.append(hashlib.sha256(base.encode()).hexdigest())
            spans = parsed(base, extra)
            every.append(told(spans))
            counts.append((len(spans), len(extra or [])))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")), pa.array(sums, pa.string()), pa.array(every, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_found"])


def parsed(base: str, extra: list[str] | None) -> list[Span]:
    every = [s.split(":") for s in [*base.split(","), *(extra or [])] if s]
    return [(k, int(a), int(b)) for k, a, b in every]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, their number n_spans and that of
    those the method found, n_found, of every row of docs."""
    rows = hashed(docs.select("doc_id", text_or_empty().alias("text")))
    spans = written(rows.mapInArrow(finding, SCHEMA), "pii-spans")
    out = spans.drop("found").join(discovered(spans), ["h1", "h2"], "left")
    return out.mapInArrow(joined, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_found long")


def redacted(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the earlier, longer."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; n_chars, where there, follows the text."""
    rows = hashed(docs.select("doc_id", text_or_empty().alias("text")))
    extra = discovered(written(rows.mapInArrow(finding, SCHEMA), "pii-spans"))
    names = docs.columns
    h1, h2, more = fresh(names, "h1", "h2", "extra")
    keys = extra.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("extra").alias(more))
    with_extra = hashed(docs, h1, h2).join(keys, [h1, h2], "left").select(*names, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [None if t is None else redacted(t, base_spans(t) + parsed("", e)) for t, e in zip(batch.column("text").to_pylist(), batch.column(more).to_pylist(), strict=True)]
            new = {"text": pa.array(texts, batch.column("text").type)}
            if "n_chars" in names:
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return with_extra.mapInArrow(run, docs.schema)
