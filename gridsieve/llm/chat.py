"""Chat formatting after collapsing cumulative snapshots of conversations.

A logged conversation that is a prefix of a longer one, turn by turn, is a snapshot of it. Each turn is
hashed with its position, role and text under two seeds; the running exclusive-or of these hashes is the
rolling hash of every prefix. A conversation whose full hash is a proper prefix hash of another one is
removed by an anti-join, and of equal conversations the smallest id stays. What stays is rendered.

DataFrame functions only. Hot first turns and copies are grouped with partial sums before they are
shuffled, and the prefix table is distinct before the anti-join.

Defined cases: turns follow each other by turn, then role, then text, nulls first, and count from 1; a null
role is rendered as ``user`` and a null text as nothing, and both compare as such; rows that are equal in
all columns are one turn; a null conv_id is one conversation; an empty table gives no rows. Control marks
inside texts and roles are broken by a space after ``<``. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsieve.llm.common import staged

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ROLE = "user"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position, role, text and the rolling hashes h1, h2 of the prefix that ends here."""
    rows = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(ROLE)).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    within = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("position", F.row_number().over(within))
    running = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    content = ("position", "role", "text")
    return rows.select(
        "conv_id",
        *content,
        F.bit_xor(F.xxhash64(*content, F.lit(1))).over(running).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), *content)).over(running).alias("h2"),
    )


def maximal(rows: DataFrame) -> DataFrame:
    """One row for each conversation that stays: keep_id, n_turns, n_copies; ``rows`` as turns() gives them."""
    whole = rows.groupBy("conv_id").agg(F.max_by(F.struct("position", "h1", "h2"), "position").alias("e"))
    distinct = whole.groupBy(F.col("e.position").alias("n_turns"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2")).agg(
        F.min("conv_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")
    )
    last = Window.partitionBy("conv_id")
    proper = rows.withColumn("n", F.max("position").over(last)).where(F.col("position") < F.col("n"))
    prefixes = proper.select(F.col("position").alias("n_turns"), "h1", "h2").distinct()
    return distinct.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("keep_id", "n_turns", "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, this one included) and the rendered text."""
    rows = staged(turns(conversations), "turns")
    kept = maximal(rows)
    line = F.concat(F.lit(OPEN), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit(CLOSE + "\n"))
    lines = rows.join(kept, rows["conv_id"].eqNullSafe(kept["keep_id"])).select(
        "conv_id", "n_turns", "n_copies", "position", line.alias("line")
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", "line")))
    texts = lines.groupBy("conv_id", "n_turns", "n_copies").agg(ordered.alias("t"))
    return texts.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("t", lambda x: x["line"]), "").alias("text")
    )


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '{ROLE}') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position FROM t),
c AS (
  SELECT conv_id, count(*) AS n, list({{'r': role, 't': text}} ORDER BY position) AS turns,
         string_agg('{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10), ''
                    ORDER BY position) AS text
  FROM p GROUP BY conv_id),
d AS (
  SELECT min(conv_id) AS conv_id, n, turns, any_value(text) AS text, count(*) AS n_copies FROM c GROUP BY n, turns)
SELECT conv_id, n AS n_turns, n_copies, text FROM d
WHERE NOT EXISTS (SELECT 1 FROM d AS o WHERE o.n > d.n AND o.turns[1] = d.turns[1] AND o.turns[1:d.n] = d.turns)
"""
