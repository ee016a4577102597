"""Chat formatting by perspective rotation, in DataFrame functions only.

Every participant of a conversation gets a rendering of the whole dialogue in which that speaker is the assistant,
everybody else a named user, and only the assistant's turns are trained on. A rendering is a run of segments, one row per
turn, with its exact place in the dialogue's text: ``start`` counts code points from the dialogue's beginning, and
``mask_start``/``mask_end`` bound what is trained (the text and its end mark, neither header nor line end; empty
for other speakers).

Places are running sums in two steps, so no task needs a whole conversation: windows over blocks of
``BLOCK_TURNS`` turn numbers, then a window over the blocks' totals, joined back. They are computed on lengths: a turn is multiplied by
the participants as a few numbers and meets its text once, when it is shown. Exact repeats of a turn (same number,
speaker and text) are combined on the map side and rendered once; ``copies`` tells how many there were.

Defined results: a null text is empty, a null or blank role is the speaker ``unknown``; system turns are shown as system
turns in every rendering and have no perspective of their own (a conversation of system turns only has no
rendering); turns with equal numbers are ordered by speaker and text, turns without number come last; rows without a
conversation id form one conversation; markers inside texts and names are defused; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docyard.llm.common import cut, table

BLOCK_TURNS = 64
SYSTEM = "system"
UNKNOWN = "unknown"
#: A segment: header with role and name, the text, an end mark.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns: conv_id, turn, block, speaker, text, copies."""
    role = F.trim(F.coalesce(F.col("role"), F.lit("")))
    return (conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(role == "", F.lit(UNKNOWN)).otherwise(role).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)))


def _defused(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def _header(role: Column, name: Column) -> Column:
    shown = F.translate(name, "<|>\n\r\t ", "_______")
    return F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), shown)).otherwise(F.lit("")),
                    F.lit(CLOSE + "\n"))


def numbered(conversations: DataFrame) -> DataFrame:
    """The distinct turns with their order in the block (``at``, from 0) and the length of the shown text; kept once."""
    block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    return cut(turns_of(conversations).withColumn("at", F.row_number().over(block) - 1)
               .withColumn("text", _defused(F.col("text"))).withColumn("chars", F.length("text").cast("long")))


def rotate(conversations: DataFrame) -> DataFrame:
    """One row per conversation, perspective and turn, with its place and mask."""
    turns = numbered(conversations)
    # places come from lengths alone: nothing that is multiplied by the participants, sorted or summed holds a text
    narrow = turns.select("conv_id", "block", "at", "speaker", "chars")
    views = (narrow.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective"))
             .distinct())
    role = (F.when(F.col("speaker") == F.col("perspective"), F.lit("assistant"))
            .when(F.col("speaker") == SYSTEM, F.lit("system")).otherwise(F.lit("user")))
    shown = (narrow.join(views, narrow["conv_id"].eqNullSafe(views["of"])).drop("of")
             .withColumn("role", role).withColumn("head", F.length(_header(F.col("role"), F.col("speaker"))).cast("long"))
             .withColumn("size", F.col("head") + F.col("chars") + len(END + "\n")))
    before = (Window.partitionBy("conv_id", "perspective", "block").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = cut(shown.select("conv_id", "block", "at", "perspective", "role", "head", "size",
                              F.coalesce(F.sum("size").over(before), F.lit(0)).alias("inner_start")))
    totals = placed.groupBy("conv_id", "perspective", "block").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    blocks = (Window.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    ahead = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
                          F.coalesce(F.sum("size").over(blocks), F.lit(0)).alias("block_start"),
                          F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("block_position"))
    places = placed.join(ahead, placed["conv_id"].eqNullSafe(ahead["c"]) & (placed["perspective"] == ahead["p"])
                         & placed["block"].eqNullSafe(ahead["b"])).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("at").alias("a"), "perspective", "role", "head", "size",
        (F.col("inner_start") + F.col("block_start")).alias("begin"),
        (F.col("at") + F.col("block_position")).alias("position"))
    start, trained = F.col("begin"), F.col("role") == "assistant"
    # the text is met once, to be shown
    return (turns.join(places, turns["conv_id"].eqNullSafe(places["c"]) & turns["block"].eqNullSafe(places["b"])
                       & (turns["at"] == places["a"]))
            .select("conv_id", "perspective", F.col("position").cast("long").alias("position"),
                    "turn", "role", F.col("speaker").alias("name"),
                    F.concat(_header(F.col("role"), F.col("speaker")), "text", F.lit(END + "\n")).alias("segment"),
                    start.cast("long").alias("start"),
                    F.when(trained, start + F.col("head")).otherwise(start).cast("long").alias("mask_start"),
                    F.when(trained, start + F.col("size") - 1).otherwise(start).cast("long").alias("mask_end"),
                    "copies"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, ''), ' ') = '' THEN '{UNKNOWN}' ELSE trim(role, ' ') END AS speaker,
         coalesce(text, '') AS text, count(*) AS copies
  FROM conversations GROUP BY ALL),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> '{SYSTEM}'),
shown AS (
  SELECT t.*, v.perspective,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN 'system' ELSE 'user' END AS role
  FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
headed AS (
  SELECT *, '{OPEN}' || role || CASE WHEN role = 'user'
              THEN ' name=' || translate(speaker, '<|>' || chr(10) || chr(13) || chr(9) || ' ', '_______') ELSE '' END
            || '{CLOSE}' || chr(10) AS header FROM shown),
built AS (SELECT *, header || replace(text, '{OPEN}', '< |') || '{END}' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER before, 0)::BIGINT AS start,
         row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text) - 1 AS position
  FROM built
  WINDOW before AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, position, turn, role, speaker AS name, segment, start,
       CASE WHEN role = 'assistant' THEN start + length(header) ELSE start END AS mask_start,
       CASE WHEN role = 'assistant' THEN start + length(segment) - 1 ELSE start END AS mask_end, copies
FROM placed
"""
