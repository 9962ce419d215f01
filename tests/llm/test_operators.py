"""Each operator against a plain version of itself, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from loomline.llm import ann, chat, common, dedup, extraction, graph, mixing, pii, quality, registry, tokens, toxicity, words
from loomline.llm import pieces as sentence_pieces

SF = "/root/testdata/sf0.001"
WORDS = re.compile(common.WORD)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, rank int, h1 string"


def frame(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", 0, 9, 1.5, 3, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", "   \n\t ", "one", "one two", "a" * 300_000, "x y " * 40_000, "same text here", "same text here", "\x00\x1c odd  \U0001f600", "Größe ÉTÉ İstanbul ñandú. It's 12,5!"]


def test_shared_folder_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_names_that_clash_with_none():
    assert common.fresh(["a", "B", "b_"], "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]


def test_scratch_tables_go(spark):
    import os

    with common.scratch(spark):
        held = common.written(spark.range(3), "scratch")
        path = held.inputFiles()[0].removeprefix("file:").removeprefix("//").rpartition("/")[0]
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


# --- 1 ----------------------------------------------------------------------------------------


def plain_tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens_round_trip(spark, tmp_path):
    import public_tokenizers

    real = [r.text for r in common.table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    texts = AWKWARD + real + ["<|endoftext|> <|startoftext|>x", "can't I'll", "ﬁ é ǅ"]
    docs = frame(spark, texts).repartition(3)
    path = f"file://{tmp_path}/t"
    got = {r.doc_id: r for r in tokens.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), path).collect()}
    start = 0
    for i, ids in enumerate(plain_tokens(texts)):
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)), repr(texts[i])[:60]
        assert got[i].ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert tokens.read_tokens(spark, path, [3]).first().ids[-1] == 1


def test_merges_are_the_tokenizer_s():
    import public_tokenizers

    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = ["".join(rng.choice(letters if rng.random() < 0.3 else "etaoinshrdluABCé") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words = [rng.choice(["", "", "'", "("]) + w + "".join(rng.choice(tokens.MARKS + "'’") for _ in range(rng.randint(0, 3))) for w in words] + ["#" * 130, "x" * 47, "x" * 49, "z" * 3000]
    assert encoder.short
    assert encoder.encode(words) == encoder.slow(words)


def test_token_file_format(spark, tmp_path):
    import public_tokenizers
    import pyarrow.parquet as pq

    path = tmp_path / "t"
    tokens.write_tokens(common.table(spark, SF, "documents"), f"file://{path}", public_tokenizers.path("word_bpe_49k.json"), 2)
    meta = pq.ParquetFile(sorted(path.glob("part-*"))[0]).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert columns["doc_id"].has_offset_index
    plan = tokens.read_metadata(spark, f"file://{path}")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_tokens_empty_table_and_null_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.token_files(frame(spark, []), path).count() == 0
    rows = tokens.token_files(frame(spark, ["b", "a"], [None, 1]), path).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (1, 2)]


# --- 2 ----------------------------------------------------------------------------------------


def test_extraction_of_plain_pages(spark):
    import html as entities

    pages = common.table(spark, SF, "pages")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", "\n")))).strip() for b in re.split(r"</?(?:p|h1)>", body))
        want = " ".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


FURNISHED = """<html><body><header><h1>Site</h1><nav>menu</nav></header><div id="cookie-banner">We use cookies</div><div class="wrap">
<div class="post-content"><h1>Title</h1><p>Hello, this is, a first paragraph of the article with enough, length &amp; more.</p>
<ul><li>point one is here</li><li>two</li></ul><div class="ad">Buy</div><form>Sign up</form><p>Short one.</p><script>var x="</p>"</script>
<div class="comments"><p>Nice, post, really, I like it, a lot, thanks, thanks, thanks</p></div></div>
<div class="sidebar"><p>About me, I write, every day, and more</p></div></div><footer>foot</footer></body></html>"""


def test_extraction_drops_furniture():
    assert extraction.main_text(FURNISHED)[0] == "Title Hello, this is, a first paragraph of the article with enough, length & more. point one is here two Short one."


STORY = "<h1>Title</h1>" + "".join(f"<p>Paragraph {i} of the story, long enough, with commas, to be read as text.</p>" for i in range(5))
TOLD = " ".join(["Title", *(f"Paragraph {i} of the story, long enough, with commas, to be read as text." for i in range(5))])
ASIDE = '<div class="sidebar"><p>About me, I write, every day, and more</p></div>'


@pytest.mark.parametrize("names", ["content has-sidebar", "page no-sidebar", "layout-sidebar-right", "main has-sidebar", "withSidebar", "search-page", "share-wrap", "legal", "related-layout", "widget", "warning", "page comments-open", "no-comments"])
@pytest.mark.parametrize("inner", [f"<article>{STORY}</article>", f"<main>{STORY}</main>"])
def test_extraction_keeps_wrappers(names, inner):
    assert extraction.main_text(f'<body><nav>menu</nav><div class="{names}">{inner}{ASIDE}</div><footer>foot</footer></body>')[0] == TOLD


def test_extraction_keeps_wrappers_without_article():
    for names in ("search-page", "legal", "page widget"):
        assert extraction.main_text(f'<body><p>Skip</p><div id="{names}"><div class="col">{STORY}</div>{ASIDE}</div></body>')[0] == TOLD


def test_extraction_keeps_pages_in_a_form():
    for inner in (f"<article>{STORY}</article>", f"<div>{STORY}</div>"):
        page = f'<body><form method="post"><input type="hidden" name="__VIEWSTATE"><div class="search"><label>Find</label><button>Go</button></div>{inner}<select><option>no</option></select>{ASIDE}</form></body>'
        assert extraction.main_text(page)[0] == TOLD


def test_extraction_still_drops_long_furniture():
    long = "<p>A remark, that goes on, and on, and on, for a long while, as they do.</p>" * 30
    for names in ("comments", "comment-list", "sidebar"):
        for inner in (long, long.replace("p>", "article>")):
            if names != "sidebar" or inner is long:
                assert extraction.main_text(f'<body><article>{STORY * 2}</article><div class="{names}">{inner if names != "sidebar" else long[:600]}</div></body>')[0] == f"{TOLD} {TOLD}"
    cards = "<article><h2>Other</h2><p>Another story, in short.</p></article>" * 3
    assert extraction.main_text(f'<body><div class="post">{STORY}</div><div class="related">{cards}</div></body>')[0] == TOLD


def test_extraction_keeps_reference_lists():
    links = '<ol><li><a href="/1">A history of the mills of the valley</a></li><li><a href="/2">On water wheels</a></li></ol>'
    assert extraction.main_text(f"<body><article>{STORY}{links}</article></body>")[0] == f"{TOLD} A history of the mills of the valley On water wheels"
    assert extraction.main_text(f'<body><div class="post">{STORY}{links}<p>See also <a href="/x">this</a></p></div></body>')[0] == f"{TOLD} A history of the mills of the valley On water wheels See also this"
    menu = '<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul>'
    assert extraction.main_text(f"<body><div>{menu}{STORY}</div></body>")[0] == TOLD


def plain_best(tree):
    """The container of most points, scored element by element with the rules of the docstring."""
    every = [tree, *tree.elements()]

    def inside(node, test):
        return sum(len(" ".join(c.split())) if isinstance(c, str) else inside(c, test) for c in node.children) if test(node) else 0

    def chars(node):
        return inside(node, lambda n: True)

    def linked(node):
        return chars(node) if node.tag == "a" else sum(linked(c) for c in node.children if not isinstance(c, str))

    def start(node):
        named = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", f"{node.get('class') or ''} {node.get('id') or ''}")}
        return extraction.START.get(node.tag, 0.0) + (10.0 if named & extraction.CONTENT else 0.0)

    points = {}
    for p in every:
        if p.tag == "p" and chars(p):
            gives = (1 + p.text().count(",") + min(chars(p) / 100, 3.0)) * (1 - linked(p) / chars(p)) * (1 if chars(p) >= 25 else 0.3)
            above, share = p.parent, [1.0, 0.5, 1 / 6, 1 / 9, 1 / 12]
            for s in share:
                if above is None or above.tag in ("html", "#document"):
                    break
                points[id(above)] = points.get(id(above), start(above)) + gives * s
                above = above.parent
    score = {id(n): points[id(n)] * (1 - linked(n) / max(1, chars(n))) for n in every if id(n) in points}
    return next(n for n in every if score.get(id(n)) == max(score.values()))


def test_extraction_scores_as_a_plain_scorer():
    rng = random.Random(6)
    for _ in range(60):
        boxes = []
        for b in range(rng.randint(2, 4)):
            texts = []
            for _ in range(rng.randint(1, 6)):
                words = [rng.choice(["the", "mill,", "of", "valley", "water,", "stone", "and"]) for _ in range(rng.randint(2, 40))]
                if rng.random() < 0.3:
                    words.insert(0, '<a href="/x">some link text here</a>')
                texts.append(f"<p>{' '.join(words)}</p>")
            name = rng.choice(["", ' class="story"', ' id="entry"'])
            boxes.append(f"<div{name}>{''.join(texts)}</div>")
        tree = extraction.parse(f"<html><body><div><section>{''.join(boxes)}</section></div></body></html>")
        kept, _ = extraction.best_container(tree)
        assert plain_best(tree) in kept


def test_extraction_of_awkward_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>only"), (4, "u", "<div>" * 3000 + "deep"), (4, "u", "<p>again</p>"), (5, "u", "<nav>menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = sorted((r.page_id, r.text, r.n_chars) for r in extraction.extract(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "only", 4), (4, "again", 5), (4, "deep", 4), (5, "", 0)]
    assert extraction.extract(pages.limit(0)).count() == 0


# --- 3 ----------------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    w = WORDS.findall(text)
    seen, marked = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if seen[x] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def test_quality_counts(spark):
    texts = AWKWARD + ["a b c a b c d\na b c a b c d\n\nx", "a a a a a", "a a a", "# $ <b>\n \n# $ <b>"] + [r.text for r in common.table(spark, SF, "documents").collect()]
    for r in quality.quality(frame(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def plain_bands(text):
    """Whole ratio, chunks, those outside, verdict, each chunk cut out and looked up by hand."""
    raw = (text or "").encode()

    def ratio(part):
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(part)) / len(part)

    if not raw:
        return 1.0, 0, 0, False
    chunks = []
    if len(raw) > 4096:
        chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
        if len(chunks[-1]) < 4096:
            chunks[-1] = raw[-4096:]
    outside = sum(not quality.CHUNK_BAND[0] <= ratio(c) <= quality.CHUNK_BAND[1] for c in chunks)
    points = quality.LIMITS
    if len(raw) <= points[0][0]:
        low, high = points[0][1:]
    elif len(raw) >= points[-1][0]:
        low, high = points[-1][1:]
    else:
        (x, lo, hi), (y, lo2, hi2) = next((p, q) for p, q in itertools.pairwise(points) if p[0] <= len(raw) < q[0])
        t = (math.log2(len(raw)) - math.log2(x)) / (math.log2(y) - math.log2(x))
        low, high = lo + t * (lo2 - lo), hi + t * (hi2 - hi)
    whole = ratio(raw)
    return whole, len(chunks), outside, low <= whole <= high and outside <= 0.25 * len(chunks)


def test_quality_verdict_is_the_bands(spark):
    texts = AWKWARD + [r.text for r in common.table(spark, SF, "documents").collect()]
    for r in quality.quality(frame(spark, texts)).collect():
        ratio, chunks, outside, good = plain_bands(texts[r.doc_id])
        assert (r.ratio, r.n_chunks, r.chunks_outside, r.kept) == (ratio, chunks, outside, good and not r.base_failed)


def prose_of(rng, n):
    """Made-up prose without repetition or noise."""
    parts = [a + b for a in "b d f g h l m n p r s t v w st tr gr pl".split() for b in "a e i o u ai ou en er".split()]
    out = ""
    while len(out) < n:
        out += " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(6, 14))).capitalize() + ". "
    return out[:n]


def test_quality_bands(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rng.choices(letters, k=20)) for _ in range(900))
    loop = " ".join(f"w{i % 7}{'ab'[i % 2]}" for i in range(4000))
    judged = quality.Compression()
    assert not judged.judge(noise.encode())[3]
    assert not judged.judge(loop.encode())[3]
    for n in (600, 2000, 4096, 5000, 8100, 20_000):
        prose = prose_of(rng, n)
        assert judged.judge(prose.encode())[3], n
        assert not judged.judge((prose[: n // 3] + loop[: n - n // 3]).encode())[3]
    # junk in the last bytes, which fill no chunk
    prose = prose_of(rng, 4096)
    assert judged.judge((prose + loop[:4000]).encode())[1:3] == (2, 1)
    assert not judged.judge((prose + loop[:4000]).encode())[3]


def test_quality_on_labels(spark):
    docs, labels = (common.table(spark, SF.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    rows = quality.quality(docs).filter("not base_failed").join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").collect()
    good, junk = [r.kept for r in rows if r.good], [r.kept for r in rows if not r.good]
    assert sum(good) >= 0.99 * len(good)
    assert sum(junk) <= 0.6 * len(junk)


def test_quality_of_no_rows_and_clashing_columns(spark):
    assert quality.quality(frame(spark, [])).count() == 0
    docs = frame(spark, ["same text", "same text"]).withColumns({"ratio": F.lit("r"), "kept": F.lit(1), "n_words": F.lit(2.0)})
    assert [(r.n_words, r.kept) for r in quality.quality(docs).collect()] == [(2, False)] * 2


# --- 4 ----------------------------------------------------------------------------------------


def plain_kernel(s, t):
    """The normalised subsequence kernel by enumeration."""

    def weights(x):
        x, out = "^" + x, Counter()
        for i, j, k in itertools.combinations(range(len(x)), 3):
            if k - i < toxicity.SPAN:
                out[x[i] + x[j] + x[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = weights(s), weights(t)
    dot = lambda p, q: sum(v * q[c] for c, v in p.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_string_kernel_values():
    words = ["idiot", "idioot", "idxiot", "theory", "at", "banana", "ananas", "mississippi"]
    marks = toxicity.Landmarks(["idiot", "banana", "missing"])
    got = np.zeros((len(words), 3))
    which, values = marks.kernel(words)
    got[which] = values
    for i, w in enumerate(words):
        for j, m in enumerate(marks.units):
            assert got[i, j] == pytest.approx(max(0, plain_kernel(w, m) - toxicity.FLOOR), abs=1e-5)


def toxic_corpus(n=600):
    rng = random.Random(7)
    syllables = ["the", "on", "er", "an", "tion", "re", "ha", "ou", "st", "nd"]
    clean = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(60))
    rows = []
    for i in range(n):
        words = clean().split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "worthless", "scum", "pathetic"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("predicted", F.lit(9))
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, _, bad in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1
        assert got[i].predicted == int(got[i].score >= 0.5)
    assert sum(got[i].predicted == bad for i, _, bad in rows) > 0.98 * len(rows)


def test_toxicity_gaps():
    rows = toxic_corpus()
    model = toxicity.train([t for _, t, b in rows if b], [t for _, t, b in rows if not b])
    clean = next(t for _, t, b in rows if not b)
    assert model.scores([clean, ""]).max() < 0.5
    assert model.scores([f"{clean} {x}" for x in ("i d i o t", "i-d-i-o-t", "Wort_hless!", "WORTHLESSS", "IDIOT", "patthetic")]).min() >= 0.5


def test_toxicity_of_phrases():
    """Toxic documents marked by a pair of ordinary words only, also with a word put between."""
    rng = random.Random(9)
    words = ["".join(rng.choices(["the", "on", "er", "an", "tion", "re", "ha", "ou", "st", "nd", "li", "mo"], k=rng.randint(1, 3))) for _ in range(80)]
    words += ["kick", "rocks", "drop", "dead"]
    spoken = lambda n: " ".join(" ".join(rng.choices(words, k=9)) + "." for _ in range(n))
    good = [t for t in (spoken(6) for _ in range(300)) if "kick rocks" not in t and "drop dead" not in t]
    bad = [f"{spoken(3)} {rng.choice(words)} {p} {rng.choice(words)}. {spoken(2)}" for p in ("kick rocks", "drop dead") for _ in range(60)]
    model = toxicity.train(bad[10:60] + bad[70:], good[50:])
    assert model.pairs
    assert (model.scores(bad[:10] + bad[60:70]) >= 0.5).mean() >= 0.9
    assert (model.scores(good[:50]) >= 0.5).mean() <= 0.1
    gapped = [t.replace("kick rocks", "kick some rocks").replace("drop dead", "drop so dead") for t in bad[:10] + bad[60:70]]
    assert (model.scores(gapped) >= 0.5).mean() >= 0.9
    worst = max(model.sentences(bad[0]), key=lambda x: x[1])[0]
    assert "kick rocks" in worst


def test_toxicity_awkward(spark):
    docs, labels = frame(spark, AWKWARD, [None, *range(10)]), spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(AWKWARD)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


# --- 5 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattice():
    import public_tokenizers

    return sentence_pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def plain_segmentations(lattice, s):
    out = []

    def go(i, score, n):
        if i == len(s):
            out.append((score, n))
            return
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in lattice.ids:
                go(j, score + lattice.score[s[i:j]], n + 1)
        if s[i] not in lattice.ids:
            go(i + 1, score + lattice.unknown, n + len(s[i].encode()))

    go(0, 0.0, 0)
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "naïve, x", "aaaa a", "日本 語", "a.b,c", "\n\t x", "Zu und", "", "  two", "banana ananas"])
def test_nbest_is_exact(lattice, text):
    want = plain_segmentations(lattice, lattice.normalised(text))[:5]
    got = lattice.encode(text, 5)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert lattice.decode(got[0][1]) == text
    assert len({x[1] for x in got}) == len(got)


def k_best(lattice, s, n):
    """Scores of the n best segmentations, place by place."""
    best = [[0.0]] + [[] for _ in s]
    for j in range(1, len(s) + 1):
        every = [x + lattice.score[s[i:j]] for i in range(max(0, j - 40), j) if s[i:j] in lattice.ids for x in best[i]]
        if s[j - 1] not in lattice.ids:
            every += [x + lattice.unknown for x in best[j - 1]]
        best[j] = sorted(every, reverse=True)[:n]
    return best[-1]


@pytest.mark.parametrize("n", [1, 2, 8, 40])
def test_nbest_of_sentences(lattice, n):
    texts = ["The quick brown fox jumps over the lazy dog, again and again.", "Çà et là — naïve façade 日本語 x", "aaaa " * 12, "b" * 200, "Un mot" + "o" * 90 + " und noch eines"]
    for text, got in zip(texts, lattice.encode_all(texts, n), strict=True):
        assert [x[0] for x in got] == k_best(lattice, lattice.normalised(text), n)
        assert len({x[1].tobytes() for x in got}) == len(got)
        assert all(lattice.decode(x[1]) == text for x in got)


def test_word_book():
    """Ids of words are those learned, whatever the book forgets, and long words too."""
    rng = random.Random(8)
    learned = []

    def learn(own):
        learned.extend(own)
        return np.array([ord(c) for w in own for c in w], np.int32), np.array([*map(len, own)], np.int64), np.array([[float(len(w)) for w in own]])

    book = words.WordBook(learn, 1, most=20_000)
    for _ in range(40):
        own = ["".join(rng.choice("abcé日") for _ in range(rng.choice([1, 2, 3, 9, 70, 200]))) for _ in range(rng.randint(0, 300))]
        raw = " ".join(own).encode()
        ends = np.flatnonzero(np.frombuffer(raw + b" ", np.uint8) == 32)
        starts = np.r_[0, ends[:-1] + 1] if own else np.zeros(0, np.int64)
        ids, counts, figures = book.read(np.frombuffer(raw, np.uint8), starts, (ends - starts) if own else starts)
        assert "".join(map(chr, ids)) == "".join(own)
        assert counts.tolist() == [len(w) for w in own] == figures[0].tolist()
    assert len(learned) > len(set(learned))
    assert book.held < 400_000


def test_spans_are_python_s_words():
    rng = random.Random(11)
    marks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\u2010", "a", "é", "日", "\xc2", "\u00e2", "🙂", "ა", "᠎"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 12))) for _ in range(3000)]
    raw, at = words.buffer_of(pa.array(texts, pa.string()))
    starts, sizes, odd = tokens.spans_of(raw, at)
    assert [raw[a : a + n].tobytes().decode() for a, n in zip(starts, sizes, strict=True)] == [w for t in texts for w in t.split()]
    assert tokens.spans_of(*words.buffer_of(pa.array(["a", "b\x1dc", None, "\x1c"])))[2].tolist() == [1, 3]
    assert not len(odd)


def test_best_sums():
    rng = random.Random(3)
    lists = [sorted((-float(rng.randint(0, 5)) for _ in range(4)), reverse=True) for _ in range(5)]
    every = sorted(((sum(x[k] for x, k in zip(lists, c, strict=True)), c) for c in itertools.product(range(4), repeat=5)), key=lambda t: (-t[0], t[1]))
    assert sentence_pieces.best_sums(lists, 50) == every[:50]


def test_words_learned_at_once(lattice):
    """Viterbi over many words gives what it gives for one."""
    rng = random.Random(4)
    words = {"".join(rng.choice("▁abcdeéèçñtionß%#ê日") for _ in range(rng.randint(1, 45))) for _ in range(800)}
    words = sorted(words)
    ids, counts, figures = lattice.learn(words)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for i, w in enumerate(words):
        best, second, back = lattice.forward(w)
        assert tuple(figures[:, i]) == (best[-1], best[-1] - second[-1])
        places, j = [], len(w)
        while j > 0:
            places.append(j)
            j = back[j]
        assert parts[i].tobytes() == lattice.coded(w, places[::-1])


def test_words_begin_at_spaces():
    for texts in (["▁a▁▁b", "", "x▁", "▁", "▁▁"], [""], [], ["é▁日▁▁▁本x"]):
        raw, at = words.buffer_of(pa.array(texts, pa.string()))
        begins = sentence_pieces.words_of(raw, at).tolist()
        want = [len("".join(texts[:i]).encode()) + len(t[: m.start()].encode()) for i, t in enumerate(texts) for m in re.finditer("▁*[^▁]+|▁+", t)]
        assert begins == want


def test_nbest_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = frame(spark, AWKWARD)
    rows = sentence_pieces.nbest_digests(docs, path, 3).collect()
    assert {r.doc_id for r in rows} == set(range(len(AWKWARD)))
    assert all(r.decoded for r in rows if r["rank"] == 1 and "\x00" not in (AWKWARD[r.doc_id] or ""))
    assert next(r for r in rows if r.doc_id == 0).n_tokens == 0
    texts = {r.doc_id: r.text for r in sentence_pieces.decode(sentence_pieces.nbest(docs, path), path).collect()}
    assert texts[10] == AWKWARD[10]
    assert sentence_pieces.nbest(docs.limit(0), path).count() == 0


# --- 6 ----------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mix(spark):
    rng = random.Random(3)
    sources = [rng.choice(["hot"] * 12 + ["a", "b", "é", None, "tiny"]) for _ in range(3000)]
    texts = [None if i % 101 == 0 else "w " * rng.randint(1, 60) for i in range(3000)]
    docs = frame(spark, texts, sources=sources)
    rows = mixing.mix(docs, block_rows=64).collect()
    again = mixing.mix(docs.repartition(7), block_rows=64).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").split())
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == 0 or r.taken % r["size"] == 0
        sizes[sources[r.doc_id]] += r["size"]
        taken[sources[r.doc_id]] += r.taken
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[sources[r.doc_id]]
        assert r.target == pytest.approx(want[sources[r.doc_id]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.05 * t + 60


def test_pivot_keeps_means():
    p = [0.2, 0.7, 0.5, 0.9, 0.4, 0.3]
    sums, totals = np.zeros(len(p)), set()
    for seed in range(4000):
        part, held = mixing.pivot(p, random.Random(seed))
        assert held < 0 or 0 < part[held] < 1
        totals.add(round(sum(part), 6))
        sums += part
    assert totals == {3.0}
    assert np.abs(sums / 4000 - p).max() < 0.03


def test_mix_awkward(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(frame(spark, [None, "", " "])).collect()} == {0}
    rows = mixing.mix(frame(spark, ["a b", "a b", "c"], [7, 7, None])).collect()
    assert len(rows) == 3
    assert sum(r.taken for r in rows) == sum(r["size"] for r in rows)
    kept = mixing.mixed_documents(frame(spark, ["a b", "a b", "c", None], [7, 7, None, 2]))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.text for r in kept.collect()) == ["a b", "a b", "c"]


def test_mixed_documents_leave_clashing_columns(spark):
    texts = ["one two three"] * 40 + ["four five"] * 40 + [None, "", "long " * 30_000]
    docs = frame(spark, texts, sources=["a"] * 40 + ["b"] * 40 + [None, "a", "b"])
    clash = {n: F.lit(n) for n in ("copies", "mix_words", "mix_nth", "mix_id", "mix_size", "mix_copies", "taken", "ratio")}
    got = mixing.mixed_documents(docs.withColumns(clash))
    plain = mixing.mixed_documents(docs)
    assert got.columns == [*docs.columns, *clash]
    assert all(r[n] == n for r in got.collect() for n in clash)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in plain.collect())


# --- 7 ----------------------------------------------------------------------------------------


def test_search_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([rng.normal(size=(1500, 32)), centres[rng.integers(0, 40, 1500)] + 0.1 * rng.normal(size=(1500, 32))]).astype(np.float32)
    v = spark.createDataFrame([(i, [float(c) for c in r], "x") for i, r in enumerate(x)], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.search(v).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hit = 0
    for q in range(0, 3000, 50):
        s = y @ y[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        hit += len({int(b) for b in best} & {r.vec_id for r in got[q].values()})
        assert [got[q][k].score for k in range(1, 6)] == sorted((got[q][k].score for k in range(1, 6)), reverse=True)
        assert all(got[q][k].score == pytest.approx(float(s[got[q][k].vec_id]), abs=1e-12) for k in range(1, 6))
    assert hit >= 0.9 * 5 * 60


def test_search_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0]), (10, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(v).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 10, -1.0)]
    assert ann.search(v.limit(0)).count() == 0
    assert ann.search(v.filter("vec_id = 0")).count() == 0


def test_search_with_many_equal_vectors(spark):
    """Two thirds of the rows are one vector: more ties than a shortlist holds."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    same = rng.random(3000) < 0.66
    x[same] = x[7]
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    got = {}
    for r in ann.search(v).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    assert len(got) == 60
    for q in got:
        s = (y * y[q]).sum(1)
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5].tolist()
        if same[q]:
            assert got[q] == best
        else:
            assert len(set(got[q]) & set(best)) >= 4


def test_encoding_beats_a_single_book():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 48))
    q = ann.Quantiser.fit(rng.normal(size=(3000, 48)))
    codes, norms = q.encode(x)
    sums = sum(q.books[m][codes[:, m]] for m in range(ann.BOOKS))
    assert np.allclose((sums * sums).sum(1), norms, rtol=1e-3)
    wide, narrow = ((x - sum(q.books[m][q.encode(x, b)[0][:, m]] for m in range(ann.BOOKS))) ** 2 for b in (4, 1))
    assert wide.mean() < narrow.mean() < 0.6


# --- 8 ----------------------------------------------------------------------------------------


def test_perspectives_match_sql(spark, duck):
    from conftest import same_rows

    same_rows(chat.perspectives(common.table(spark, SF, "conversations")).toPandas(), duck(SF).sql(chat.ORACLE).df())


def plain_perspectives(rows):
    """(conv_id, participant) -> (text, mask), turn by turn."""
    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv if conv is not None else ("lone", turn, role, text), []).append((turn is None, turn or 0, role or "unknown", text or ""))
    for conv, turns in convs.items():
        for who in {t[2] for t in turns} - {"system"}:
            text, mask = "", []
            for _, _, role, body in sorted(turns):
                name, body = role.replace("<|", "< |"), body.replace("<|", "< |")
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={name}|>\n"
                if role == who:
                    mask.append(f"{len(text)}-{len(text) + len(body) + len('<|end|>')}")
                text += body + "<|end|>\n"
            out[conv if not isinstance(conv, tuple) else (None, *conv[1:]), who] = text, ",".join(mask)
    return out


def joined_perspectives(frame_):
    """The same from the operator's rows, pieces put in a row."""
    out = {}
    for r in sorted(frame_.collect(), key=lambda r: r.piece):
        text, mask, n = out.get((r.conv_id, r.participant), ("", [], 0))
        assert (r.start, r.piece, r.n_chars) == (len(text), n, len(r.text))
        out[r.conv_id, r.participant] = text + r.text, mask + ([r["mask"]] if r["mask"] else []), n + 1
    return {k: (text, ",".join(mask)) for k, (text, mask, _) in out.items()}, max((v[2] for v in out.values()), default=0)


def test_perspectives_rotate(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, None, None, "late"), (1, 3, "ann", "bye"), (2, 0, "system", "alone")]
    turns = spark.createDataFrame([*rows, (None, 1, "x", "a"), (None, 1, "y", "b")], "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1)).withColumn("piece", F.lit(1)).withColumn("part", F.lit(1))
    assert {(r.conv_id, r.participant) for r in chat.perspectives(turns).collect()} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "x"), (None, "y")}
    for piece, most in ((chat.PIECE, 1), (2, 9)):
        got, pieces = joined_perspectives(chat.perspectives(turns.filter("conv_id is not null"), piece))
        assert got == plain_perspectives(rows)
        assert pieces <= most
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_perspectives_of_long_conversations(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["ann", "bob", "system"]), f"turn {i}") for i in range(1100)]
    rows += [(2, 7, "ann", "the same turn")] * 1500 + [(2, 7, "bob", f"t{i}") for i in range(300)]
    rows += [(3, 1000 * i, "ann" if i % 2 else "bob", "x" * i) for i in range(9)] + [(4, 0, "ann", "long " * 60_000), (4, 1, "bob", "so")]
    rows += [(5, None, f"p{i % 3}", f"n{i}") for i in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got, pieces = joined_perspectives(chat.perspectives(turns, wide=100_000))
    assert got == plain_perspectives(rows)
    assert pieces >= 4
    single = chat.perspectives(turns.filter("conv_id in (3, 5)"))
    assert single.filter("piece > 0").count() == 0


def test_perspectives_are_native(spark):
    plan = chat.perspectives(common.table(spark, SF, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 9 ----------------------------------------------------------------------------------------


def shingle_set(text, k):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    w = WORDS.findall((text or "").translate(lower))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(texts, k):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def copied_corpus(seed, groups, size, common_words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(common_words)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(6, 120))
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    texts = [*copied_corpus(k, 60, 8), "A b", "a B", "solo", "Solo", "İ x", "i x", None, "", " \n"]
    want, sizes = plain_components(texts, k)
    got = {r.doc_id: r for r in dedup.near_duplicates(frame(spark, texts), k).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    for name, value in (("LEAF", 4), ("BLOCK", 8), ("DEPTH", 2)):
        monkeypatch.setattr(dedup, name, value)
    texts = copied_corpus(11, 6, 40, 12) + copied_corpus(12, 40, 2, 12)
    want, _ = plain_components(texts, 2)
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(frame(spark, texts), 2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_branching_keeps_pairs_at_full_depth():
    lost = 0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        a, b = rng.integers(0, 2**32, (2, 250, dedup.SLOTS), dtype=np.uint32)
        slots = np.concatenate([a, np.where(rng.random(a.shape) < 0.8, a, b)])
        held = [pa.RecordBatch.from_pydict({"vertex": np.arange(500), "slots": [x.tobytes() for x in slots]})]
        held = list(dedup.rooted(held))
        for level in range(dedup.DEPTH + 1):
            rows = pa.Table.from_batches(held)
            v, tree, node = (rows.column(c).to_numpy() for c in ("vertex", "tree", "node"))
            _, at, n = np.unique(np.stack([v % 250, tree, node]), axis=1, return_inverse=True, return_counts=True)
            rows = rows.filter(pa.array(n[at.ravel()] == 2))
            if level < dedup.DEPTH:
                batch = rows.append_column("slots", pa.array([slots[i].tobytes() for i in rows.column("vertex").to_pylist()])).combine_chunks().to_batches()
                step = dedup.branching if "path" in rows.column_names else dedup.branching(level + 1)
                held = list(step(batch))
        lost += 250 - len(set((rows.column("vertex").to_numpy() % 250).tolist()))
    assert lost == 0


def test_nodes_choose_slots_off_their_path():
    node = np.arange(2000, dtype=np.uint64)
    tree = np.repeat(np.arange(4, dtype=np.int32), 500)
    path = np.full(2000, 1 << 3 | 1 << 20 | 1 << 63, np.uint64)
    first, second = dedup.chosen(tree, node, path)
    assert (first != second).all()
    assert set(first) | set(second) == set(range(dedup.ROOTS * dedup.TREES, dedup.SLOTS)) - {20, 63}
    assert len(set(zip(first[:500], second[:500], strict=True))) > 300
    other = dedup.chosen(tree + 1, node, path)
    assert (next(other) != first).mean() > 0.9


def test_near_duplicates_at_full_depth(spark, monkeypatch):
    for name, value in (("LEAF", 1), ("BLOCK", 64)):
        monkeypatch.setattr(dedup, name, value)
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        # 36 common words and 36 own ones, of which a copy keeps 28: similarity 64 / 80 to 66 / 78
        own = [f"v{rng.randrange(10**9)}" for _ in range(36)]
        common_words = [f"c{i}" for i in range(36)]
        cut = rng.choice([6, 7, 8])
        texts += [" ".join(common_words + own), " ".join(common_words + own[cut:] + [f"v{rng.randrange(10**9)}" for _ in range(cut)])]
    want, _ = plain_components(texts, 1)
    assert [w == i for i, w in enumerate(want)] == [True, False] * 12
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(frame(spark, texts), 1).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_of_a_passage_in_common(spark, monkeypatch):
    """Large nodes of documents that are alike but not linked do not multiply their rows."""
    for name, value in (("LEAF", 32), ("BLOCK", 16)):
        monkeypatch.setattr(dedup, name, value)
    compare, made = dedup.Join.compare, []

    def counted(self, members, *rest):
        made.append(members.count())
        return compare(self, members, *rest)

    monkeypatch.setattr(dedup.Join, "compare", counted)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"d{i}x{j}" for j in range(20 + 77 * i % 300)) for i in range(600)]
    texts += [f"{t} more" for t in texts[::10]]
    want, _ = plain_components(texts, 1)
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(frame(spark, texts), 1).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(made) < 4 * made[0], made


def test_near_duplicates_awkward(spark):
    assert dedup.near_duplicates(frame(spark, []), 5).count() == 0
    rows = dedup.near_duplicates(frame(spark, ["a b c", "a b c", "x y z", "a b c", None], [3, None, 3, 9, None]), 2).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("3", "3", True), ("3", "3", True), ("9", "3", False), ("None", "None", False), ("None", "None", False)]


def test_near_duplicates_of_repeated_ids(spark):
    rows = dedup.near_duplicates(frame(spark, ["a b c", "a b c", "x y z", "x y z", "p q r", "p q r", ""], [3, 5, 5, 8, 7, 7, 5]), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == [(3, 2, 3, True), (5, 0, 5, True), (5, 2, 3, False), (5, 2, 3, False), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 3, False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 70), (70, 80), (5, 5), (None, 4)]
    got = {r.vertex: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {70: 70, 80: 70, 100: 70}


# --- 10 ---------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            double = [d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(c) for c in reversed(digits))]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and sum(double) % 10 == 0) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


ODD = ["a@b.c_d@e.f", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111 1111 1111-5", "4111-1111 1111-1111", "+1 234 567 8.", "@@a@b.co", "..a@b.co", "a@b", "+12", "1.2.3.4@x.y", "٣٤@a.b 1٣", "001.002.003.004", "+1 (456) 555-2186 4111111111111111"]


def test_base_spans():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("aZ9@.-+ ()1", k=60)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_spans_are_fast_on_long_runs():
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(t)
        pii.candidates(t, [])


def test_personal_data(spark):
    texts = AWKWARD + ODD + [r.text for r in common.table(spark, SF, "documents").collect()]
    for r in pii.personal_data(frame(spark, texts)).collect():
        base = plain_spans(texts[r.doc_id])
        told = ",".join("{}:{}:{}".format(*s) for s in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_patterns_discover_unseen(spark):
    seeds = [f"please call us at +1 (555) 010-{i:04d} today or write" for i in range(12)]
    noise = [f"chapter number {i}00{i} of the book" for i in range(12)]
    texts = [*seeds, *noise, "please call us at 0049-555-7788 today or write", "please call us at 0049-555-7788 today or write"]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, texts)).collect()}
    assert got[24] == got[25] == "phone:18:31"
    assert all(got[i] == "" for i in range(12, 24))
    clean = pii.redact(frame(spark, texts))
    assert clean.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.text for r in clean.filter("doc_id in (0, 24)").collect()} == {"please call us at [PHONE] today or write"}


def test_secrets_are_found_by_their_patterns(spark):
    rng = random.Random(3)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    own = [f'word{i} token = "{key()}" word{i + 1} and more' for i in range(10)]
    odd = 'here token = "zz-77-81-pass-long" there'
    alone = f"commit {key()} fixes it"
    rows = {r.doc_id: r for r in pii.personal_data(frame(spark, [*own, odd, alone])).collect()}
    assert all(rows[i].spans == f"secret:{own[i].index(chr(34)) + 1}:{own[i].index(chr(34)) + 41}" and rows[i].n_found == rows[i].n_spans == 1 for i in range(10))
    assert rows[10].spans.startswith("secret:14:")
    assert (rows[11].spans, rows[11].n_found) == ("", 0)


def test_yield_on_a_planted_corpus(spark):
    """Unseen identifiers in the contexts of seeds are found, with precision and recall of 0.9."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeghilmnoprstu", k=rng.randint(3, 8)))
    leads = [("phone", "reach me on", lambda: f"+44 20 {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}", lambda: f"020-{rng.randint(1000, 9999)}-{rng.randint(100, 999)}"),
             ("ip", "connected from host", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"fe80::{rng.randint(100, 999)}:{rng.randint(1000, 9999)}"),
             ("email", "write to address", lambda: f"{word()}@{word()}.org", lambda: f"{word()}@{word()}")]
    texts, want = [], {}
    for i in range(400):
        kind, lead, seed, unseen = leads[i % 3]
        hidden, body = i % 5 == 0, f"{word()} {word()} {lead} "
        value = unseen() if hidden else seed()
        texts.append(f"{body}{value} {word()} {word()} room {rng.randint(1000, 99999)} {word()}")
        if hidden:
            want[i] = f"{kind}:{len(body)}:{len(body) + len(value)}"
    found = {(r.doc_id, s) for r in pii.personal_data(frame(spark, texts)).collect() for s in r.spans.split(",") if s}
    extra = {(i, s) for i, s in found if not any(s == "{}:{}:{}".format(*b) for b in plain_spans(texts[i]))}
    assert len(extra & set(want.items())) >= 0.9 * max(len(extra), len(want))


def test_contexts_take_whole_words():
    long = "a" * 500
    assert pii.context(f"{long} call +1", 506, 508)[0] == f"{pii.named(long)} call _"
    assert pii.context(f"x {long}1 call +1", 508, 510)[0] == f"{pii.named(long + '1')} call _"
    assert pii.context(f"call now 12345 {long}", 9, 14) == ["call now _", f"now _ {pii.named(long)}"]
    assert pii.candidates("id " + "9" * 70 + " x a@ 123", []) == [(3, 73), (76, 78), (79, 82)]


def test_redaction_leaves_clashing_columns(spark):
    docs = frame(spark, ["mail a@b.co now", None]).withColumns({n: F.lit(n) for n in ("h2", "extra", "extra_", "__h1", "found")})
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert [(r.text, r.h1, r.extra, r.found) for r in got.orderBy("doc_id").collect()] == [("mail [EMAIL] now", "x", "extra", "found"), (None, "x", "extra", "found")]


def test_personal_data_empty(spark):
    assert pii.personal_data(frame(spark, [])).count() == 0
    assert pii.redact(frame(spark, [None])).first().text is None


def test_one_query_each():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 11))


def test_pairs_of_one_node_are_visited_by_size():
    rng = np.random.default_rng(7)
    n = 900
    run, size, label = np.repeat([0, 1, 4], n // 3), np.exp(rng.uniform(0, 9, n)).astype(np.int64) + 1, rng.integers(0, n // 2, n)
    low = rng.integers(0, 256, (n, dedup.SLOTS), dtype=np.uint8)
    twins = rng.permutation(n // 2) * 2
    low[twins + 1, 20:], size[twins + 1] = low[twins, 20:], size[twins]
    i, j = np.triu_indices(n, 1)
    may = (run[i] == run[j]) & (5 * size[i] >= 4 * size[j]) & (5 * size[j] >= 4 * size[i])
    linked = may & (label[i] != label[j]) & ((low[i] == low[j]).sum(1) >= dedup.LEAST)
    got = {tuple(sorted(p)) for xs, ys in dedup.neighbours(run, label, size, low) for p in zip(xs.tolist(), ys.tolist(), strict=True)}
    assert got == set(zip(i[linked].tolist(), j[linked].tolist(), strict=True))
    order, end = dedup.windows(run, size)
    assert sorted(order) == list(range(n))
    assert (end - np.arange(n) - 1).sum() == may.sum() < n * n // 60  # in place of every pair of a node
