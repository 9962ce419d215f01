"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once more with that speaker as
the assistant, all others as named users and system turns as the system. Each rendering comes with
its mask: the character spans (code points, end exclusive) that the model learns, which are the
speaker's own turns with their end mark.

A conversation of up to PIECE turns and WIDE characters is one row a participant. Of a longer one no
task gathers the whole: its turns are sorted across tasks by range and a rendering comes in several
rows, `piece` 0, 1, ... of about PIECE turns each, which put in a row are the whole rendering;
`start` is where a piece begins in it, and masks count from the rendering's begin. Equal rows are
counted before they are gathered and rendered as often as they occur.

Rows without conv_id belong to no conversation: each distinct one is a dialogue of its own. Turns
without a number come last, turns with equal numbers are ordered by role and text. A null role is
the participant `unknown`, a null text is empty; "<|" in a text or name is written "< |". A
conversation with system turns only is rendered for no one. Other columns are not read, so none
clashes; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

PIECE, WIDE = 512, 8 << 20
SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, piece: int = PIECE, wide: int = WIDE) -> DataFrame:
    """conv_id, participant, piece, start, text, mask ("start-end,..."), n_turns, n_chars, n_trained."""
    role, text = F.coalesce("role", F.lit(UNKNOWN)), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    lone = F.when(F.col("conv_id").isNull(), F.md5(F.to_json(F.struct("turn", "role", "text"))))
    rows = rows.withColumn("lone", lone).groupBy("conv_id", "lone", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("late", F.col("turn").isNull())
    roles = rows.filter(F.col("role") != SYSTEM).groupBy(F.col("conv_id").alias("c"), F.col("lone").alias("l")).agg(F.array_sort(F.collect_set("role")).alias("roles"))
    size = rows.groupBy(F.col("conv_id").alias("c"), F.col("lone").alias("l")).agg(F.sum("n").alias("turns"), F.sum(F.col("n") * (F.length("text") + F.length("role") + 32)).alias("chars"))
    large = size.filter((F.col("turns") > piece) | (F.col("chars") > wide)).select("c", "l")
    own = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("lone").eqNullSafe(F.col("l"))
    if not large.limit(1).count():
        return _told(_rendered(_gathered(rows, F.lit(0), F.lit(0).cast("long")), roles).withColumns({"piece": F.lit(0).cast("long"), "start": F.lit(0).cast("long")}))
    large = written(large, "chat-large")
    small = _rendered(_gathered(rows.join(large, own, "left_anti"), F.lit(0), F.lit(0).cast("long")), roles)
    small = small.withColumns({"piece": F.lit(0).cast("long"), "start": F.lit(0).cast("long")})
    return _told(small.unionByName(_placed(_rendered(_cut(rows.join(large, own, "left_semi"), piece), roles))))


def _gathered(rows: DataFrame, part: Column, cut: Column) -> DataFrame:
    turn = F.struct("late", "turn", "role", "text", "n")
    return rows.groupBy("conv_id", "lone", part.alias("part"), cut.alias("cut")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _cut(rows: DataFrame, piece: int) -> DataFrame:
    """Turns of long conversations in pieces: `part` is a range of the sorted turns of all of them,
    `cut` counts on within a conversation's share of it. Written, as parts depend on the ranges."""
    order = ["late", "turn", "role", "text"]
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece))))
    copies = copies.withColumn("n", F.least(F.lit(piece).cast("long"), F.col("n") - F.col("copy") * piece))
    ranged = copies.repartitionByRange("conv_id", "lone", *order, "copy").withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("conv_id", "lone", "part").orderBy(*order, "copy").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumn("cut", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / piece))
    return written(_gathered(numbered, F.col("part"), F.col("cut")), "chat-pieces")


def _placed(rendered: DataFrame) -> DataFrame:
    """Pieces with their number and where they begin; only their lengths meet by participant."""
    rendered = written(rendered, "chat-rendered")
    key = ["conv_id", "lone", "participant", "part", "cut"]
    inside = Window.partitionBy("conv_id", "lone", "participant").orderBy("part", "cut")
    start = F.coalesce(F.sum("n_chars").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = rendered.select(*key, (F.row_number().over(inside) - 1).cast("long").alias("piece"), start.alias("start"))
    x, y = rendered.alias("x"), places.alias("y")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return x.join(y, same).select("x.*", "y.piece", "y.start")


def _rendered(gathered: DataFrame, roles: DataFrame) -> DataFrame:
    """Each gathered row for each participant; spans count from the row's own begin."""
    each = gathered.join(roles, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("lone").eqNullSafe(F.col("l")))
    each = each.select("conv_id", "lone", "part", "cut", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["n"].cast("int")))).alias("turns"), F.explode("roles").alias("participant"))

    def head(t: Column) -> Column:
        return F.when(t["role"] == SYSTEM, F.lit("<|system|>\n")).when(t["role"] == F.col("participant"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), _safe(t["role"]), F.lit("|>\n")))

    parts = each.withColumn("parts", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_safe(t["text"]), F.lit(END)).alias("body"), (t["role"] == F.col("participant")).alias("own"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:long,b:long>>").alias("spans"), F.lit(0).cast("long").alias("trained"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        end = a + F.length(p["body"])
        span = F.struct(a.alias("a"), (end - 1).alias("b"))
        return F.struct(end.alias("at"), F.when(p["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"), (acc["trained"] + F.when(p["own"], end - 1 - a).otherwise(0)).alias("trained"))

    folded = parts.withColumn("fold", F.aggregate("parts", begin, step))
    return folded.select(
        "conv_id", "lone", "part", "cut", "participant",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), F.col("fold.spans").alias("spans"),
        F.size("parts").cast("long").alias("n_turns"), F.col("fold.at").alias("n_chars"), F.col("fold.trained").alias("n_trained"),
    )


def _told(rendered: DataFrame) -> DataFrame:
    span = F.transform("spans", lambda x: F.concat_ws("-", (x["a"] + F.col("start")).cast("string"), (x["b"] + F.col("start")).cast("string")))
    return rendered.select("conv_id", "participant", "piece", "start", "text", F.array_join(span, ",").alias("mask"), "n_turns", "n_chars", "n_trained")


#: The same rows in DuckDB for tables without null conv_id or turn and without longer conversations.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> '{SYSTEM}'),
p AS (
  SELECT t.conv_id, r.participant, t.turn, t.role, t.text, t.role = r.participant AS own,
    CASE WHEN t.role = '{SYSTEM}' THEN '<|system|>' || chr(10) WHEN t.role = r.participant THEN '<|assistant|>' || chr(10)
      ELSE '<|user name=' || replace(t.role, '<|', '< |') || '|>' || chr(10) END AS head,
    replace(t.text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM t JOIN r USING (conv_id)),
o AS (
  SELECT *, row_number() OVER w AS rn, sum(length(head) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) - length(body) AS start FROM p
  WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn, role, text))
SELECT conv_id, participant, CAST(0 AS BIGINT) AS piece, CAST(0 AS BIGINT) AS start, string_agg(head || body, '' ORDER BY rn) AS text,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(body) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE own), '') AS mask,
  CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars,
  CAST(coalesce(sum(length(body) - 1) FILTER (WHERE own), 0) AS BIGINT) AS n_trained
FROM o GROUP BY conv_id, participant
"""
