"""Conversations logged once for each turn, collapsed to the longest, and rendered.

A log that stores a conversation anew after every turn holds each of its prefixes. A hash of each prefix rolls along a
conversation's turns; one whose whole hash is a proper prefix of another goes, by an anti-join on hashes. What is left
is rendered with role marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at (from 1), turn, role, text, in order of turn, role and text; null roles and texts are empty, rows without a conversation go, and exact repeats of a row count once."""
    t = conversations.select(
        F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).where("conv IS NOT NULL")
    t = t.withColumns({"h": F.xxhash64(F.lit(1), "role", "text"), "g": F.xxhash64(F.lit(2), "role", "text")})
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    return t.withColumn("same", F.coalesce(same, F.lit(False))).where("NOT same").withColumn("at", F.row_number().over(order)).drop("same")


def prefixes(t: DataFrame) -> DataFrame:
    """t with the two 64-bit hashes p, q of the conversation up to each turn, and whether it is the last.

    A turn's hash takes its place in, so that the exclusive or over the turns so far depends on their order; the window
    runs through a conversation of any length without holding it.
    """
    order = Window.partitionBy("conv").orderBy("at")
    rolled = {"p": F.expr("bit_xor(xxhash64(at, h, g))").over(order), "q": F.expr("bit_xor(xxhash64(g, at, h))").over(order)}
    return t.withColumns({**rolled, "last": F.lead("at").over(order).isNull()})


def maximal(t: DataFrame) -> DataFrame:
    """conv, n_turns, n_same of the conversations that are no proper prefix of another; of equal ones the least conv, n_same counting them."""
    p = prefixes(t).select("conv", "at", "p", "q", "last")
    whole = p.where("last").groupBy("at", "p", "q").agg(F.min("conv").alias("conv"), F.count("*").alias("n_same"))
    inner = p.where("NOT last").select("at", "p", "q").distinct()
    return whole.join(inner, ["at", "p", "q"], "left_anti").select("conv", F.col("at").alias("n_turns"), "n_same")


def render(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_same, rendered.

    Turns are ordered by turn, null first, then role, then text, both by their bytes. Each is rendered
    ``<|im_start|>role\\ntext<|im_end|>\\n`` with null as empty. No rows give no rows; columns other than the four named
    are ignored.
    """
    t = turns(conversations, conv_id, turn, role, text)
    kept = maximal(t)
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    joined = t.join(kept.select("conv", "n_turns", "n_same"), "conv")
    rendered = joined.groupBy("conv").agg(F.max("n_turns").alias("n_turns"), F.max("n_same").alias("n_same"), F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    return rendered.select(F.col("conv").alias(conv_id), F.col("n_turns").cast("long").alias("n_turns"), "n_same", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


SQL = """
WITH one AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered FROM one GROUP BY conv_id
), part AS (
  SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS prefix, lead(1) OVER w AS more FROM one
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), dropped AS (SELECT DISTINCT md5(prefix) AS m FROM part WHERE more IS NOT NULL)
SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_same, rendered FROM conv
WHERE md5(rendered) NOT IN (SELECT m FROM dropped) GROUP BY n_turns, rendered
"""
