"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as
``assistant`` and all others as named users; loss masks cover the assistant's own words and end
marks.  ``system`` turns stay system turns in every rendering and are no participant.

The result holds one row per (conversation, perspective, turn): the rendered segment, where it
stands in the rendered dialogue, and the span to train on.  Concatenating the segments by
``pos`` gives the dialogue (``dialogues``).

Scale: only built-in functions.  What stands before a chunk of ``CHUNK`` turns follows from the
number and length of each speaker's turns, so those prefix sums are made without the texts.  The texts
go through two shuffles: identical turns are counted, and the counted turns meet the sums of their
chunk; offsets inside a chunk and all perspectives are made where they lie.  A conversation that holds
a third of all turns is spread by its chunks; a turn repeated any number of times is one row.

Defined cases: turns are ordered by (turn, speaker, text), nulls first, and repeated rows follow
each other; many texts of one (conversation, turn) are ordered within one task, which spills; a null
role speaks as ``unknown``; a null text is empty; a very long text is one segment; rows of a null
``conv_id`` form one conversation; a conversation of system turns only has no perspective and so no
rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CHUNK = 64
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def rotate(conversations: DataFrame, context_role: str = "system", chunk: int = CHUNK) -> DataFrame:
    """``conv_id, perspective, pos, role, name, segment, seg_start, seg_end, train_start,
    train_end`` (character offsets in the dialogue; the train span is null where masked)."""
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    frame = len(BEGIN) + 1 + len(END)
    named = F.when(F.col("speaker") == context_role, len("system")).otherwise(F.length("speaker") + len("user name="))
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.floor(F.col("turn").cast("long") / chunk), F.lit(-(1 << 62))).alias("chunk"),
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    # Prefix sums over chunks, from counts and lengths alone; "n" and "s" as if all were named.
    spoken = turns.groupBy("key", "chunk", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("text") + frame + named).alias("s"))
    people = spoken.where(F.col("speaker") != context_role).select("key", F.col("speaker").alias("perspective")).distinct()
    own = spoken.select("key", "chunk", F.col("speaker").alias("perspective"), F.col("n").alias("own"))
    sums = spoken.groupBy("key", "chunk").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(people, "key").join(own, ["key", "chunk", "perspective"], "left")
    shorter = F.length("perspective") + len("user name=") - len("assistant")
    sums = sums.withColumn("s", F.col("s") - F.coalesce("own", F.lit(0)) * shorter)
    whole = before("key", "perspective").orderBy("chunk")
    sums = sums.select("key", "chunk", "perspective", F.coalesce(F.sum("s").over(whole), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("n0"))
    # Texts: counted, then joined by sort, so that the chunk's windows need no further shuffle.
    rows = turns.groupBy("key", "chunk", "conv_id", "turn", "speaker", "text").agg(F.count("*").alias("copies")).join(sums.hint("merge"), ["key", "chunk"])
    mine, context = F.col("speaker") == F.col("perspective"), F.col("speaker") == context_role
    rows = rows.withColumn("role", F.when(context, "system").when(mine, "assistant").otherwise("user")).withColumn("name", F.when(~mine & ~context, F.col("speaker")))
    head_len = F.when(mine & ~context, len("assistant")).otherwise(named) + len(BEGIN) + 1
    rows = rows.withColumn("size", (F.length("text") + frame - len(BEGIN) - 1 + head_len).cast("long")).withColumn("head_len", head_len)
    inside = before("key", "chunk", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    rows = rows.withColumn("s1", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))).withColumn("n1", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    head = F.concat(F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")))
    segment = F.concat(F.lit(BEGIN), head, F.lit("\n"), F.col("text"), F.lit(END))
    start = F.col("s0") + F.col("s1") + F.col("copy") * F.col("size")
    train = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "perspective", (F.col("n0") + F.col("n1") + F.col("copy")).alias("pos"), "role", "name", segment.alias("segment"), start.alias("seg_start"), (start + F.col("size")).alias("seg_end"),
        F.when(train, start + F.col("head_len")).alias("train_start"), F.when(train, start + F.col("size") - 1).alias("train_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole rendered dialogues, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "segment", "train_start", "train_end")))
    rows = segments.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    spans = F.transform(F.filter("parts", lambda x: x.train_start.isNotNull()), lambda x: F.struct(x.train_start, x.train_end))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda x: x.segment), "").alias("dialogue"), spans.alias("train_spans"))


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.select("conv_id", "perspective", "pos", "role", "name", F.sha2("segment", 256).alias("segment_sha256"), "seg_start", "seg_end", "train_start", "train_end")


SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS c2, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT conv_id, perspective, turn, speaker, text,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
      FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c2),
s AS (SELECT *, '<|im_start|>' || role || CASE WHEN name IS NOT NULL THEN ' name=' || name ELSE '' END || chr(10) || text || '<|im_end|>' || chr(10) AS segment,
        length(role) + CASE WHEN name IS NOT NULL THEN 6 + length(name) ELSE 0 END + 13 AS head_len FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
      FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, CAST(pos AS BIGINT) AS pos, role, name, sha256(segment) AS segment_sha256, CAST(st AS BIGINT) AS seg_start, CAST(st + length(segment) AS BIGINT) AS seg_end,
  CASE WHEN role = 'assistant' THEN CAST(st + head_len AS BIGINT) END AS train_start, CASE WHEN role = 'assistant' THEN CAST(st + length(segment) - 1 AS BIGINT) END AS train_end
FROM o
"""
