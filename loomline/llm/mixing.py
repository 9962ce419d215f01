"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be copied target / source_size times. The whole part of that
number is taken at once; the fractional parts are rounded by the pivotal method: two fractional
units meet, mass moves from one to the other at random (means kept) until one of them is 0 or 1,
and the other goes on to the next meeting. Inside a block of a source documents meet in order of
size, so the words moved nearly balance, and the nearest of a few draws counts; what is left of each block, one unit at most, climbs a
reduction tree of blocks, `FANOUT` at a time, until one unit a source is left, which is drawn.

A source is split into blocks by a hash of the document, so a source with a third of all rows is
as many tasks as its rows need. Draws depend on seed, source rank and block only: reruns agree.

Rows: null text has size 0; a null source is a source, last in order; rows with equal doc_id are
documents of their own; a source without words takes nothing; an empty table gives no rows. Very
long texts are counted whole; equal sizes meet in order of doc_id. Columns beside doc_id, source and
text may bear any name: names needed on the way are made to differ.

Draws: a block is drawn up to DRAWS times and the draw nearest to its expected words counts, so a
source of few documents comes near its target; the chance of a document is then that of its pivotal
rounding only on average over documents of like size.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, written

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_ROWS = 4096
FANOUT = 16
DRAWS, NEAR = 32, 0.002
SEED = 20_260


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """rank, source, source_size, rows, target of each source of `sized` (source, size).

    Resharing the excess of capped sources again and again ends at a water level: with sources
    ordered by cap / weight, those before the level are full and the rest share what remains by
    weight. One row a source; the windows run over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*map(F.lit, weights))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    s = s.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(given, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("most", cap * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")), ignorenulls=True).over(whole))
    return s.select("rank", "source", "source_size", "rows", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def pivot(p: list[float], rng: random.Random) -> tuple[list[float], int]:
    """`p` with every entry but one at most rounded to 0 or 1 by meetings in order; where the
    unrounded entry stands, or -1. Sums keep their value up to float error."""
    out, held = list(p), -1
    for i, q in enumerate(out):
        if q <= 1e-9 or q >= 1 - 1e-9:
            out[i] = float(round(q))
            continue
        if held < 0:
            held = i
            continue
        a, both = out[held], out[held] + q
        if both < 1:
            stays = rng.random() * both < a
            out[held], out[i] = (both, 0.0) if stays else (0.0, both)
            held = held if stays else i
        else:
            first = rng.random() * (2 - both) < 1 - q
            out[held], out[i] = (1.0, both - 1) if first else (both - 1, 1.0)
            held = i if first else held
        if held >= 0 and (out[held] <= 1e-9 or out[held] >= 1 - 1e-9):
            out[held], held = float(round(out[held])), -1
    return out, held


def rounded(sizes: list[int], p: float, seed: str) -> tuple[list[float], int]:
    """pivot() for equal p, drawn anew up to DRAWS times until the words taken are within NEAR of
    those expected; the nearest draw counts. A few long documents can otherwise miss by a lot."""
    expected, best = p * sum(sizes), None
    for draw in range(DRAWS):
        part, held = pivot([p] * len(sizes), random.Random(f"{seed}:{draw}"))
        off = abs(sum(a * b for a, b in zip(part, sizes, strict=True)) - expected) + (min(part[held], 1 - part[held]) * sizes[held] if held >= 0 else 0)
        if best is None or off < best[0]:
            best = off, part, held
        if off <= NEAR * expected:
            break
    return best[1:]


def mixed(docs: DataFrame, keys: list[str], seed: int = SEED, block_rows: int = BLOCK_ROWS, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """`keys` of docs with size, source_size, target and copies; needs columns source and text."""
    base = written(docs.select(*keys, "source", words_of(F.col("text")).alias("size")), "mix-sizes")
    targets = written(source_targets(base, weights, cap), "mix-targets")
    levels = targets.agg(F.max(F.ceil(F.col("rows") / block_rows)).alias("n")).first()["n"] or 1
    t = targets.withColumnRenamed("source", "t_source")
    rows = base.join(t, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*keys, "size"), F.ceil(F.col("rows") / block_rows)).cast("long"))
    schema = base.schema
    head = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)

    def in_block(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["size", *keys], ascending=False, kind="stable", na_position="last").reset_index(drop=True)
        ratio = float(got["ratio"].iat[0]) if len(got) else 0.0
        whole = math.floor(ratio + 1e-12)
        part, held = rounded(got["size"].tolist(), max(0.0, ratio - whole), f"{seed}:{key[0]}:{key[1]}")
        got["copies"] = [whole + (0 if i == held else round(x)) for i, x in enumerate(part)]
        got["at"] = range(len(got))
        got["left"] = [x if i == held else None for i, x in enumerate(part)]
        return got[[*keys, "rank", "block", "at", "size", "source_size", "target", "copies", "left"]]

    done = written(rows.select(*keys, "rank", "block", "size", "source_size", "target", "ratio").groupBy("rank", "block").applyInPandas(in_block, f"{head}, rank int, block long, at long, size long, source_size long, target double, copies long, left double"), "mix-blocks")

    def meet(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("node").reset_index(drop=True)
        rng = random.Random(f"{seed}:{key[0]}:{key[1]}:{len(got)}:up")
        part, held = pivot(got["left"].tolist(), rng)
        if held >= 0 and key[2]:
            part[held], held = float(rng.random() < part[held]), -1
        got["left"] = part
        got["open"] = [i == held for i in range(len(got))]
        got["node"] = key[1]
        return got[["rank", "block", "at", "node", "left", "open"]]

    shape = "rank int, block long, at long, node long, left double, open boolean"
    units = done.filter(F.col("left").isNotNull()).select("rank", "block", "at", F.col("block").alias("node"), "left")
    settled = None
    while True:
        top = levels <= FANOUT
        level = units.withColumn("up", F.floor(F.col("node") / FANOUT)).withColumn("top", F.lit(top)).groupBy("rank", "up", "top").applyInPandas(meet, shape)
        level = written(level, "mix-units")
        closed = level.filter(~F.col("open")).select("rank", "block", "at", F.col("left").cast("long").alias("more"))
        settled = closed if settled is None else settled.unionByName(closed)
        if top:
            break
        units, levels = level.filter("open").select("rank", "block", "at", "node", "left"), math.ceil(levels / FANOUT)
    return done.join(settled, ["rank", "block", "at"], "left").select(*keys, "size", "source_size", "target", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of every row of docs."""
    return mixed(docs, ["doc_id"], **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (documents without words: never).

    Rows that share a doc_id share its copies, most to the first in order of text.
    """
    words, nth, most, at, n, held = fresh(docs.columns, "mix_words", "mix_nth", "mix_copies", "mix_id", "mix_size", "mix_list")
    plan = mixed(docs.select("doc_id", "source", "text"), ["doc_id"], **options).filter("copies > 0 and size > 0")
    plan = plan.groupBy(F.col("doc_id").alias(at), F.col("size").alias(n)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(held))
    sized = docs.withColumn(words, words_of(F.col("text")))
    in_order = F.row_number().over(Window.partitionBy("doc_id", words).orderBy("text", "source"))
    joined = sized.withColumn(nth, in_order).join(plan, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(words) == F.col(n)))
    joined = joined.withColumn(most, F.try_element_at(held, F.col(nth))).filter(F.col(most) > 0)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(most).cast("int")))).select(*docs.columns)
