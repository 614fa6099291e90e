"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once
more: that speaker's turns as the assistant's, all others' as named users',
system turns as they are.  The training mask is on for the assistant's content
and end mark and off elsewhere.

The result has one row per (conversation, perspective, turn): the rendered
segment, and the half-open character range of it that the mask covers (equal
ends: none).  The dialogue of a perspective is its segments in order of
``turn`` (ties: ``role``, then ``segment``); leaving them as rows keeps a
conversation of any length out of a single cell or task.  The join on the
conversation is salted: participants are copied to each salt, turns go to one,
so a conversation that holds a third of all turns spreads over ``SALTS`` tasks.

Marks cannot be forged: in content and names each ``<|`` is spelled ``<||``
(undone by the reverse), and white-space control characters of a name become blanks in the header.

Defined results: a null role is the participant ``unknown``; null text is
empty; a null conv_id is one conversation; repeated rows are repeated turns; a
conversation with system turns only has no participant and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Marks of the rendered form.
OPEN, CLOSE = "<|turn|>", "<|end|>"


def escaped(text: Column) -> Column:
    """Text in which no mark can begin."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def rotate(conversations: DataFrame) -> DataFrame:
    """``conv_id, perspective, turn, role, name, segment, mask_start, mask_end``."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    speakers = turns.where("name <> 'system'").select(F.col("conv_id").alias("conv"), F.col("name").alias("perspective")).distinct()
    speakers = speakers.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = turns.withColumn("salt", F.pmod(F.xxhash64("turn", "name", "content"), F.lit(SALTS)).cast("int"))
    seen = salted.join(speakers, salted.conv_id.eqNullSafe(speakers.conv) & (salted.salt == speakers.place))
    role = F.when(F.col("name") == "system", "system").when(F.col("name") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.translate(escaped(F.col("name")), "\t\n\x0b\x0c\r", "     "))).otherwise(""), F.lit("\n"))
    return (
        seen.withColumn("role", role)
        .withColumn("head", head)
        .withColumn("segment", F.concat(F.col("head"), escaped(F.col("content")), F.lit(CLOSE)))
        .select(
            "conv_id", "perspective", "turn", "role", "name", "segment",
            F.length("head").cast("long").alias("mask_start"),
            F.when(F.col("role") == "assistant", F.length("segment")).otherwise(F.length("head")).cast("long").alias("mask_end"),
        )
    )


def op9_perspectives(spark, sf_dir: str) -> DataFrame:
    """``rotate`` over the whole ``conversations`` table."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn, name, content,
    CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT * REPLACE (replace(content, '<|', '<||') AS content), '<|turn|>' || role || CASE WHEN role = 'user' THEN ' name=' || translate(replace(name, '<|', '<||'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') ELSE '' END || chr(10) AS head FROM r)
SELECT conv_id, perspective, turn, role, name, head || content || '<|end|>' AS segment,
  length(head)::BIGINT AS mask_start,
  (CASE WHEN role = 'assistant' THEN length(head || content || '<|end|>') ELSE length(head) END)::BIGINT AS mask_end
FROM h
"""
