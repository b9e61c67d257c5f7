"""Chat formatting by perspective rotation, in DataFrame expressions only.

For every participant of a conversation the dialogue is rendered once: that participant's turns as ``assistant``, all
others' as ``user`` with their name, ``system`` turns as ``system``; the mask lists the places that are trained on, which
are the participant's own contents with their end marker.

Conversations of at most ``turns_per_part`` turns are gathered in one shuffle. The turns of longer ones are put in order by a
range exchange on conversation, turn, role and text, so a conversation, or a turn number, that holds many rows is spread over
tasks; a turn's number in its conversation is its place in its range plus the sizes of the ranges before. Such a
dialogue is rendered in parts of ``turns_per_part`` turns by that number, each a row: the rendering of the whole dialogue is
the texts of its parts in order, and ``offset`` is where a part starts in it. Participants are found by a partial aggregate
and joined back, not broadcast.

Defined results: a null text is empty; a null role is a participant of its own (null), shown as ``unknown``; null turns come
last; a null conv_id is a conversation of its own; turns with the same number are ordered by role, then text, and
repeated rows are rendered each. Markers inside a text or a role are broken by a space, and line breaks in a role are
spaces, so that neither can forge a turn. A conversation with system turns only has no participant and no row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import let, materialize, running, text_of

START, END = "<|im_start|>", "<|im_end|>"
TURNS_PER_PART = 1024


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))


def _segments(perspective: Column) -> Column:
    """The turns of a part as (head, body) pairs with whether they are trained on."""
    own = lambda t: t["role"].eqNullSafe(perspective)
    named = lambda t: F.when(t["role"] == "system", F.lit("system")).when(own(t), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["name"]))
    return F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), named(t), F.lit("\n")).alias("head"),
            F.concat(t["text"], F.lit(END)).alias("body"),
            own(t).alias("own"),
        ),
    )


def _mask(segments: Column) -> Column:
    """start:end of each trained place, comma-joined, in code points of the part."""
    ends = running(F.transform(segments, lambda s: (F.length(s["head"]) + F.length(s["body"]) + 1).cast("long")), lambda p, q: p + q)
    places = lambda e: F.transform(segments, lambda s, i: F.when(s["own"], F.concat_ws(":", F.get(e, i) - 1 - F.length(s["body"]), F.get(e, i) - 1)))
    return let(ends, lambda e: F.array_join(places(e), ","))


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their number in their conversation (``at``, from 0)."""
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc(), F.col("draw").asc()]
    drawn = turns.withColumn("draw", F.monotonically_increasing_id())  # repeated rows can be parted too
    dealt = materialize(drawn.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("draw"), "turns")
    part = F.shiftright("place", 33)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy(F.col("conv_id").alias("c"), part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first")).withColumn("before", before)
    own = dealt.withColumn("part", part).join(ranges.withColumnRenamed("part", "p"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return own.withColumn("at", F.col("before") + F.col("place") - F.col("first")).drop("c", "p", "part", "place", "first", "before", "n")


def perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part, offset, n_turns, n_own, text, mask (places in the part)."""
    read = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), _safe(text_of(text_col)).alias("text"))
    shown = read.withColumn("name", F.translate(_safe(F.coalesce("role", F.lit("unknown"))), "\n\r", "  "))
    people = read.filter(F.col("role").isNull() | (F.col("role") != "system")).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    many = materialize(read.groupBy(F.col("conv_id").alias("m")).agg(F.count("*").alias("n")).filter(F.col("n") > turns_per_part).select("m"), "long")
    own = F.col("conv_id").eqNullSafe(F.col("m"))
    place = F.struct(F.col("turn").isNull().alias("last"), "turn", F.col("role").isNull().alias("end"), "role", "text", "name")

    def rendered(parts: DataFrame) -> DataFrame:
        rows = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("segments", _segments(F.col("perspective")))
        return rows.select(
            "conv_id",
            "perspective",
            "part",
            F.size("turns").cast("long").alias("n_turns"),
            F.size(F.filter("segments", lambda s: s["own"])).cast("long").alias("n_own"),
            F.concat(F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "\n"), F.lit("\n")).alias("text"),
            _mask(F.col("segments")).alias("mask"),
        )

    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = shown.join(many, own, "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("turns")).withColumn("part", F.lit(0).cast("long"))
    numbered = _numbered(shown.join(many, own, "left_semi")).groupBy("conv_id", F.floor(F.col("at") / turns_per_part).alias("part"))
    parts = numbered.agg(F.array_sort(F.collect_list(F.struct("at", "role", "name", "text"))).alias("turns"))
    offset = F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0))
    return rendered(whole).withColumn("offset", F.lit(0).cast("long")).unionByName(rendered(parts).withColumn("offset", offset))


SQL = """
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, translate(replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>'), chr(10) || chr(13), '  ') AS name,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS text
  FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text) - 1 AS k FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS DISTINCT FROM 'system'),
s AS (
  SELECT n.conv_id, perspective, k // 1024 AS part, role IS NOT DISTINCT FROM perspective AS own, k,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b
  FROM s),
g AS (
  SELECT conv_id, perspective, part, CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_own,
         string_agg(head || body || chr(10), '' ORDER BY k) AS text,
         coalesce(string_agg(CAST(CAST(b AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(b + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
  FROM o GROUP BY conv_id, perspective, part)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, n_turns, n_own, text, mask,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM g
"""
