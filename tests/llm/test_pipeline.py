"""The pipeline's stages, each held against what it must do to its own input."""

from collections import Counter

from pyspark.sql import functions as F
from test_operators import plain_components, plain_spans

import corpus_pipeline as P
from loomline.llm import common, mixing, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    rows = docs
    for name, stage in P.STAGES[:-1]:
        before = rows.collect()
        rows = common.written(stage(spark, rows, SF), f"test-{name}")
        assert rows.columns == columns
        kept[name] = before, rows.collect()
    before, after = kept["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, common.table(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] < 0.5}
    before, after = kept["near_dedup"]
    order = sorted(before, key=lambda r: r.doc_id)
    want, _ = plain_components([r.text for r in order], 5)
    assert sorted(r.doc_id for r in after) == [r.doc_id for i, r in enumerate(order) if want[i] == i]
    before, after = kept["pii"]
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in before:
        assert plain_spans(r.text) == [] or texts[r.doc_id] == pii.redacted(r.text, plain_spans(r.text)) or "[" in texts[r.doc_id]
        assert not plain_spans(texts[r.doc_id])
    before, after = kept["mixing"]
    copies = Counter(r.doc_id for r in after)
    source = spark.createDataFrame(before, docs.schema)
    assert copies == Counter({r.doc_id: r.taken // r["size"] for r in mixing.mix(source).collect() if r.taken})
    encoded = P.STAGES[-1][1](spark, rows, SF).collect()
    assert Counter(r.doc_id for r in encoded) == copies
    assert all(r.decoded and r.n_tokens == len(r.ids) for r in encoded)


def test_near_copies_of_repeated_ids(spark):
    a, b, t, u = (" ".join(f"{c}{i}" for i in range(40)) for c in "abtu")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, t, "y"), (7, t, "x"), (9, f"{t} more", "x"), (2, u, "x"), (2, u, "x"), (None, a, "x"), (None, a, "x"), (6, None, "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(3, a, "x"), (5, b, "x"), (7, t, "x"), (2, u, "x"), (None, a, "x"), (None, a, "x"), (6, None, "x"), (6, "", "x")]
    assert Counter(map(tuple, got.collect())) == Counter(want)


CLASH = ["toxic_score", "score", "copies", "mix_words", "mix_nth", "h1", "h2", "extra", "found", "vertex", "rank", "ids", "__row"]


def test_awkward_rows_and_clashing_columns(spark):
    """Null, empty, long and repeated rows with columns of names that the stages use themselves."""
    plain = " ".join(f"word{i} und" for i in range(30))
    texts = [None, "", "  ", plain, plain, "x y " * 40_000, "a" * 200_000, f"mail to a@b.co {plain[:90]}", "one", "one"]
    rows = [(i if i else None, t, "en", "s" if i % 3 else None, 7) for i, t in enumerate(texts)]
    rows += [rows[8], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASH:
        docs = docs.withColumn(name, F.lit(name))
    frames = {}
    for name, stage in P.STAGES[:-1]:
        out = common.written(stage(spark, docs, SF), f"test-awkward-{name}")
        assert out.columns == docs.columns
        frames[name] = out.collect()
        assert all(r[c] == c for r in frames[name] for c in CLASH)
    assert Counter(r.text for r in frames["toxicity"]) == Counter(r[1] for r in rows)
    assert sorted((r.doc_id or -1) for r in frames["near_dedup"]) == [-1, 1, 2, 3, 5, 6, 7, 8]
    assert Counter(r.doc_id for r in frames["pii"]) == Counter(r[0] for r in rows)
    assert [r.text[:16] for r in frames["pii"] if r.doc_id == 7] == ["mail to [EMAIL] "]
    assert all(r.text.split() for r in frames["mixing"])
    encoded = P.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in encoded) == Counter(r[0] for r in rows)
    assert all(r.n_tokens == 0 for r in encoded if r.doc_id in (None, 1))


def test_encoding_searches_further_segmentations(spark):
    import public_tokenizers

    from loomline.llm import pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the cat sat on banana bread", "naïve, 日本 語 x", "a", "", None, "word und " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.encode(spark, docs, SF).collect()}
    assert len(got) == len(texts)
    lattice = pieces.Lattice(model)
    for i, text in enumerate(texts):
        want = [(score, list(map(int, memoryview(ids).cast("i")))) for score, ids in lattice.encode(text or "", 4)]
        assert [(got[i].score, got[i].ids), *((x.score, x.ids) for x in got[i].further)] == want
    for i in (0, 1):
        exact = lattice.search(lattice.normalised(texts[i]), 4)
        assert [round(x.score, 3) for x in got[i].further] == [round(score, 3) for score, _ in exact[1:]] and len(got[i].further) == 3
    assert [len(got[i].further) for i in (3, 4)] == [0, 0]


def test_run_leaves_its_result_alone(spark):
    import os

    shared = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    assert P.run(spark, SF).count() > 0
    assert [x.split("-")[1] for x in set(os.listdir(shared)) - before] == ["sentencepiece"]


def test_empty_documents(spark):
    rows = common.table(spark, SF, "documents").limit(0)
    for name, stage in P.STAGES:
        rows = common.written(stage(spark, rows, SF), f"test-empty-{name}")
    assert rows.count() == 0
