"""Preference formatting: the longest common turn prefix of a chosen and a rejected
conversation is rendered once as the prompt, and what follows in each is a completion whose
assistant turns, and only they, carry the loss.

A side of a pair is made of stretches of conversations, so a pair may be two whole
conversations or one conversation with two replies. Turns are compared by their place: order
of turn number, ties by role and text. Two turns are the same if role and text are, nulls
equal to nulls. The result has one row for each rendered segment, so a conversation of any
number of turns is never one value: ``pair_id``, ``part`` (``prompt``, ``chosen``,
``rejected``), ``place``, ``role``, ``rendered`` and ``trained`` (1 for assistant turns of the
completions).

Null texts and roles are rendered as empty ones. Repeated turns are turns of their own. A
pair whose conversations are equal has a prompt and no completions; without a common turn
it has no prompt. A conversation without turns gives no rows. Where ``rejected`` is null,
all turns of the chosen conversation are its completion. Without an assistant turn nothing
of a conversation is trained; it is rendered as any other. Turns without a conversation are
left out, turns without a number come first. A text is one row, rendered whole. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>\n"


def places(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``conv``, ``place`` (from 0), ``role``, ``text``: turns in their order.

    Places come from two sums, of turns by stretch of 1024 turn numbers and within one, so
    that a conversation with very many turns is not one task.
    """
    rows = turns.select(F.col(key).alias("conv"), F.col("turn").cast("long").alias("turn"),
                        "role", "text").filter("conv is not null")
    rows = rows.withColumn("stretch", F.coalesce(F.shiftright("turn", 10), F.lit(-(1 << 62))))
    before = (
        rows.groupBy("conv", "stretch").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(
            Window.partitionBy("conv").orderBy("stretch")) - F.col("n")).drop("n")
    )
    inside = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text")
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(before, ["conv", "stretch"])
        .select("conv", (F.col("before") + F.col("inside")).alias("place"), "role", "text")
    )


def neighbours(turns: DataFrame, key: str = "conv_id", alone: bool = False) -> DataFrame:
    """Pairs of the conversations ``2 n`` and ``2 n + 1`` that both exist, the one with more
    assistant text being the chosen one (ties: the smaller id). With ``alone``, also pairs of
    one conversation whose neighbour does not exist: it is chosen, and rejected is null."""
    size = F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0))
    each = turns.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("conv")).agg(
        F.coalesce(size, F.lit(0)).alias("size"))
    better = F.struct(F.col("size"), (-F.col("conv")).alias("least"))
    pairs = each.groupBy(F.shiftright("conv", 1).alias("pair_id")).agg(
        F.max_by("conv", better).alias("chosen"), F.min_by("conv", better).alias("rejected"))
    if alone:
        return pairs.withColumn("rejected", F.nullif("rejected", "chosen"))
    return pairs.filter("chosen <> rejected")


WHOLE, OWN, OTHER = "whole", "replies_to_chosen", "replies_to_rejected"


def _stretch(conv: str, first, last, moved) -> Column:
    """Turns of a conversation from one place to another (null: its end), and by how much
    their places move."""
    kinds = (("conv", F.col(conv), "long"), ("first", first, "long"), ("last", last, "long"),
             ("moved", moved, "long"))
    return F.struct(*[F.lit(v).cast(k).alias(n) for n, v, k in kinds])


def whole_sides(pairs: DataFrame) -> DataFrame:
    """The stretches of pairs of whole conversations (``pair_id``, ``chosen``, ``rejected``)."""
    return _sides(pairs, {(WHOLE, part): [_stretch(part, 0, None, 0)] for part in ("chosen", "rejected")})


def reply_sides(pairs: DataFrame) -> DataFrame:
    """The stretches of pairs that share their context: either conversation up to its last
    assistant turn, and the same with that turn taken from the other one. ``pairs`` also has
    these places, ``chosen_last`` and ``rejected_last``; pairs without both have none."""
    both = pairs.filter("chosen_last is not null and rejected_last is not null")
    sides = {}
    for kind, own, other in ((OWN, "chosen", "rejected"), (OTHER, "rejected", "chosen")):
        last, reply = F.col(f"{own}_last"), F.col(f"{other}_last")
        context = _stretch(own, 0, last - 1, 0)
        sides[kind, own] = [context, _stretch(own, last, last, 0)]
        sides[kind, other] = [context, _stretch(other, reply, reply, last - reply)]
    return _sides(both, sides)


def _sides(pairs: DataFrame, sides: dict[tuple[str, str], list[Column]]) -> DataFrame:
    """``kind``, ``pair_id``, ``part`` and a row for each stretch."""
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(part).alias("part"), stretch.alias("of"))
            for (kind, part), own in sides.items() for stretch in own]
    return pairs.select("pair_id", F.inline(F.array(*rows))).select(
        "kind", "pair_id", "part", "of.*").filter("conv is not null")


def rendered(placed: DataFrame, sides: DataFrame) -> DataFrame:
    """The rendered segments of pairs: ``placed`` as of ``places``, ``sides`` as of
    ``whole_sides``. The prefixes are found by digests; texts are read only to be rendered."""
    # As JSON, a missing text is not an empty one.
    digest = F.unhex(F.sha2(F.to_json(F.struct("role", "text")), 256))
    inside = F.col("place").between(F.col("first"), F.coalesce("last", F.lit(1 << 62)))

    def turns_of(turns: DataFrame, stretches: DataFrame) -> DataFrame:
        met = turns.join(stretches, "conv").filter(inside)
        return met.withColumn("place", F.col("place") + F.col("moved"))

    segments = turns_of(placed.select("conv", "place", digest.alias("digest")), sides)
    # Both sides of a place, met in one row; the first that differs ends the prefix.
    same = (F.min("digest") == F.max("digest")) & (F.count("*") == 2)
    ends = (
        segments.groupBy("kind", "pair_id", "place").agg(same.alias("same"))
        .groupBy("kind", "pair_id").agg(
            F.min(F.when(~F.col("same"), F.col("place"))).alias("prefix"),
            F.max("place").alias("end"))
        .select("kind", "pair_id", F.coalesce("prefix", F.col("end") + 1).alias("prefix"))
    )
    common = F.col("place") < F.col("prefix")
    return (
        turns_of(placed, sides.join(ends, ["kind", "pair_id"]))
        .filter(~common | (F.col("part") == "chosen"))
        .select(
            "kind", "pair_id", F.when(common, "prompt").otherwise(F.col("part")).alias("part"), "place",
            F.coalesce("role", F.lit("")).alias("role"),
            F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"),
                     F.coalesce("text", F.lit("")), F.lit(END)).alias("rendered"),
            (~common & F.coalesce(F.col("role") == "assistant", F.lit(False))).cast("int").alias("trained"))
    )


def paired(turns: DataFrame, pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """The rendered segments of pairs of whole conversations."""
    return rendered(places(turns, key), whole_sides(pairs)).drop("kind")


def all_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every turn of the conversations ``2 n`` and ``2 n + 1`` (``kind`` ``whole``; a conversation
    without a neighbour is chosen and has no rejected one), and beside it both ways to
    exchange their last assistant turns. Turns are numbered once and written."""
    placed = written(places(turns, key), "turns")
    last = placed.filter("role = 'assistant'").groupBy("conv").agg(F.max("place").alias("last"))
    pairs = neighbours(placed, "conv", alone=True)
    pairs = written(
        pairs.join(last.toDF("chosen", "chosen_last"), "chosen", "left")
        .join(last.toDF("rejected", "rejected_last"), "rejected", "left"), "pairs")
    return rendered(placed, whole_sides(pairs).union(reply_sides(pairs)))


ORACLE = f"""
WITH r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS n,
        max(CASE WHEN role = 'assistant' THEN place END) AS final FROM r GROUP BY conv_id),
k AS (SELECT *, conv_id // 2 AS pair_id,
        row_number() OVER (PARTITION BY conv_id // 2 ORDER BY n DESC, conv_id) AS k FROM c),
p AS (SELECT a.pair_id, a.conv_id AS c, a.final AS fc, b.conv_id AS r, b.final AS fr
      FROM k a LEFT JOIN k b ON a.pair_id = b.pair_id AND b.k = 2 WHERE a.k = 1),
q AS (SELECT * FROM p WHERE fc IS NOT NULL AND fr IS NOT NULL),
m AS (
  SELECT 'whole' AS kind, pair_id, 'chosen' AS part, place, role, text FROM p JOIN r x ON x.conv_id = c
  UNION ALL SELECT 'whole', pair_id, 'rejected', place, role, text FROM p JOIN r x ON x.conv_id = p.r
  UNION ALL SELECT 'replies_to_chosen', pair_id, 'chosen', place, role, text FROM q
    JOIN r x ON x.conv_id = c AND place <= fc
  UNION ALL SELECT 'replies_to_chosen', pair_id, 'rejected', place, role, text FROM q
    JOIN r x ON x.conv_id = c AND place < fc
  UNION ALL SELECT 'replies_to_chosen', pair_id, 'rejected', fc, role, text FROM q
    JOIN r x ON x.conv_id = q.r AND place = fr
  UNION ALL SELECT 'replies_to_rejected', pair_id, 'rejected', place, role, text FROM q
    JOIN r x ON x.conv_id = q.r AND place <= fr
  UNION ALL SELECT 'replies_to_rejected', pair_id, 'chosen', place, role, text FROM q
    JOIN r x ON x.conv_id = q.r AND place < fr
  UNION ALL SELECT 'replies_to_rejected', pair_id, 'chosen', fr, role, text FROM q
    JOIN r x ON x.conv_id = c AND place = fc),
e AS (SELECT kind, pair_id, place,
             count(*) = 2 AND count(DISTINCT struct_pack(r := coalesce(role, chr(1)),
                                                         x := coalesce(text, chr(1)))) = 1 AS same
      FROM m GROUP BY kind, pair_id, place),
f AS (SELECT kind, pair_id,
             coalesce(min(CASE WHEN NOT same THEN place END), max(place) + 1) AS prefix
      FROM e GROUP BY kind, pair_id)
SELECT kind, pair_id, CASE WHEN place < prefix THEN 'prompt' ELSE part END AS part, place,
       coalesce(role, '') AS role,
       '{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)
         AS rendered,
       CASE WHEN place >= prefix AND role = 'assistant' THEN 1 ELSE 0 END AS trained
FROM m JOIN f USING (kind, pair_id) WHERE place >= prefix OR part = 'chosen'
"""
