"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, all others
as named users, and system turns as they are.  The result has one row per turn and perspective: the rendered segment,
its place in the perspective's text (the segments in order are the text) and the span that is trained on, which is the
assistant's words with their end marker.  A rendered dialogue is thus never one row's or one task's burden.

Places are running sums in two levels: within ``SPAN`` turn numbers, and over the totals of the spans before, so a
conversation that holds a large share of all turns is numbered by many tasks.

Defined results: a null role is the speaker "unknown", a null text is empty, a null turn comes first, rows without a
conv_id form one conversation.  Turns with one number are ordered by speaker and text; repeated rows are turns of
their own.  Conversations of system turns only have no participant and give no rows.  Markers inside a text or a
shown name are broken by a space and line ends in a name are spaces, so neither can end its own segment or open another.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SPAN = 1024
START, END = "<|im_start|>", "<|im_end|>"


def rotated(turns: DataFrame, system: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, seg, turn, chat_role, name, segment, start, end, mask_start, mask_end."""
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"<\|im_", "<| im_").alias("body"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ck"), F.col("conv_id").isNull().alias("cn"))
    people = rows.where(~F.col("speaker").isin(*system)).select("ck", "cn", F.col("speaker").alias("perspective")).distinct()
    chat_role = (F.when(F.col("speaker").isin(*system), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user"))
    # a name is one line of a header and cannot end it
    shown = F.regexp_replace(F.translate("speaker", "\r\n", "  "), r"<\|im_", "<| im_")
    head = F.concat(F.lit(START), F.col("chat_role"), F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), shown)).otherwise(""),
                    F.lit("\n"))
    seen = (rows.join(people, ["ck", "cn"]).withColumn("chat_role", chat_role).withColumn("head", head)
            .withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
            .withColumn("long", F.length("segment").cast("long"))
            .withColumn("span", F.floor(F.col("turn") / SPAN)))
    view = ["ck", "cn", "perspective"]
    before = Window.partitionBy(*view).orderBy(F.col("span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = (seen.groupBy(*view, "span").agg(F.sum("long").alias("chars"), F.count(F.lit(1)).alias("segs"))
              .select(*view, "span", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
                      F.coalesce(F.sum("segs").over(before), F.lit(0)).alias("segs_before"))
              .withColumn("sk", F.coalesce("span", F.lit(-(1 << 62)))).drop("span"))
    own = Window.partitionBy(*view, "sk").orderBy(F.col("turn").asc_nulls_first(), "speaker", "body")
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    placed = (seen.withColumn("sk", F.coalesce("span", F.lit(-(1 << 62))))
              .withColumn("no", F.row_number().over(own)).withColumn("to", F.sum("long").over(running))
              .join(totals, [*view, "sk"])
              .withColumn("end", F.col("to") + F.col("chars_before")).withColumn("start", F.col("end") - F.col("long")))
    trained = F.col("chat_role") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("no") - 1 + F.col("segs_before")).cast("long").alias("seg"), "turn", "chat_role",
        F.when(F.col("chat_role") == "user", F.col("speaker")).alias("name"), "segment", "start", "end",
        F.when(trained, F.col("start") + F.length("head")).alias("mask_start"), F.when(trained, F.col("end") - 1).alias("mask_end"))


def dialogues(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks: whole dialogues, for conversations that fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("seg", "segment", "mask_start", "mask_end")))
    return (segments.groupBy("conv_id", "perspective").agg(ordered.alias("s"))
            .select("conv_id", "perspective", F.array_join(F.col("s.segment"), "").alias("text"),
                    F.transform(F.filter("s", lambda x: x["mask_start"].isNotNull()),
                                lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks")))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` from every participant's view, a row per turn and view."""
    return rotated(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (SELECT t.*, p.perspective,
             CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || replace(translate(speaker, chr(13) || chr(10), '  '), '<|im_', '<| im_') ELSE '' END || chr(10) AS head FROM v),
s AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM h),
n AS (SELECT *, row_number() OVER w - 1 AS seg,
             sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
      FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, CAST(seg AS BIGINT) AS seg, turn, chat_role, CASE WHEN chat_role = 'user' THEN speaker END AS name, segment,
       CAST(e - length(segment) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end",
       CASE WHEN chat_role = 'assistant' THEN CAST(e - length(segment) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN CAST(e - 1 AS BIGINT) END AS mask_end
FROM n
"""
