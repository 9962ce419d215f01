"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what it keeps.

All stages but the last return the columns of documents, and any further ones that docs has, under
whatever names. A stage's result is written as Parquet and read again as the next one's docs; tables
of a stage are deleted when the next one has read them. Every stage takes whole texts of any length,
and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import common, dedup, mixing, pii, toxicity
from loomline.llm import pieces as sentence_pieces

#: Toxicity and near-duplicate decisions cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5.

    Null and empty texts score as texts without words, so they stay with the clean ones; repeated
    rows are judged each and alike; a null doc_id has no label and is judged as any row.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    (score,) = common.fresh(docs.columns, "toxic_score")
    return toxicity.scored(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: the smallest doc_id.

    Documents without doc_id stay. Where doc_ids repeat, rows of one doc_id with different texts are
    documents of their own: of a group the smallest (doc_id, SHA-256 of the text) stays, and of rows
    equal in doc_id and text the one that is smallest in its other columns.
    """
    named = docs.filter("doc_id is not null")
    if not named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        gone = dedup.near_duplicates(docs, 5).filter("not kept and doc_id is not null").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    single = named.groupBy("doc_id", F.sha2("text", 256).alias("__digest")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    single = common.written(single.withColumn("__vertex", F.monotonically_increasing_id()), "pipeline-single")
    groups = dedup.near_duplicates(single.select(F.col("__vertex").alias("doc_id"), "__row.text"), 5).select(F.col("doc_id").alias("__vertex"), "component_id")
    first = single.select("doc_id", "__digest", "__vertex").join(groups, "__vertex").groupBy("component_id").agg(F.min(F.struct("doc_id", "__digest", "__vertex")).alias("x"))
    stay = single.join(first.select("x.__vertex"), "__vertex", "left_semi").select("__row.*")
    return stay.unionByName(docs.filter("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind in brackets.

    No row goes. A null text stays null, an empty one empty; equal texts are redacted alike; n_chars,
    where docs has it, follows the text.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words (null, empty) are taken never; a null source is a source; rows with
    equal doc_id and size share their copies, most to the first in order of text and source; reruns
    agree.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the four best segmentations: doc_id, score, n_tokens, ids and decoded of the
    best, and in `further` scores and ids of the next ones that there are, best first.

    The forward Viterbi pass gives the best, the backward search the others. A null or empty text
    has no ids, score 0 and none further; among equal scores the longer last piece counts; repeated
    rows are encoded each; other columns are not read.
    """
    import public_tokenizers

    return sentence_pieces.nbest_lists(docs, public_tokenizers.path("piece_bpe_32k.model"), 4)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with common.scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if last:
            common.deleted(spark, last)
        docs, last = spark.read.schema(kept.schema).parquet(path), path
    return docs
