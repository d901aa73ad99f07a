"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

A logged conversation whose turns begin a longer one is a snapshot of it. Every turn gets
the rolling hash of its prefix (the exclusive-or of hashes that include the position); a
conversation whose whole hash is another's proper prefix hash is dropped by an anti-join,
and of conversations with equal turns the smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of a bucket, and turns of a part of a rendered conversation.
BUCKET = 1024
#: Different rows of one turn number beyond which its bucket is split, by turn and by the leading bits of the hash.
CROWD = 4096
_NONE = -(1 << 63)


def _scan_base(rows: DataFrame, unit: str, parts: dict[str, Column]) -> DataFrame:
    """Combined ``parts`` of all earlier units of a conversation, by unit: a small table."""
    before = Window.partitionBy("conv").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", unit).agg(*[part.alias(name) for name, part in parts.items()])
    again = {"n": F.sum, "x1": F.bit_xor, "x2": F.bit_xor}
    return sums.select("conv", unit, *[F.coalesce(again[name](name).over(before), F.lit(0)).alias(f"base_{name}") for name in parts])


def _turns(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, h1, h2: every row without nulls, with its hashes."""
    number = F.coalesce(F.col("turn").cast("bigint"), F.lit(-1).cast("bigint"))
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(_NONE)).alias("conv"), number.alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64("text", "role", F.lit(1)))


def _placed(turns: DataFrame, bucket: int, crowd: int) -> DataFrame:
    """conv, turn, h1, h2, pos, last: first and last position (from 1) of each turn's copies in the order of turn, h1, h2.

    Copies of a turn are one row with their count. One task orders a unit: a bucket of turn numbers, or,
    where over ``crowd`` different rows share a number, one number's rows with the same ten leading bits of h1.
    """
    rows = _turns(turns).groupBy("conv", "turn", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("bucket", F.floor(F.when(F.col("turn") == -1, F.lit(0)).otherwise(F.col("turn")) / bucket))
    # At most one row for each ``crowd`` rows of the table, its list at most a bucket's turn numbers.
    crowds = rows.groupBy("conv", "bucket", "turn").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > crowd).groupBy("conv", "bucket").agg(F.collect_list("turn").alias("crowds"))
    apart = F.when(F.col("crowds").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("turn"))
    leading = F.when(F.array_contains("crowds", F.col("turn")), F.shiftright("h1", 54)).otherwise(F.lit(0).cast("bigint"))
    rows = rows.join(crowds, ["conv", "bucket"], "left").withColumn("unit", F.struct("bucket", apart.alias("turn"), leading.alias("leading"))).drop("crowds", "bucket")
    inside = Window.partitionBy("conv", "unit").orderBy("turn", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.join(_scan_base(rows.select("conv", "unit", "n"), "unit", {"n": F.sum("n")}), ["conv", "unit"]).withColumn("last", F.col("base_n") + F.sum("n").over(inside))
    return counted.select("conv", "turn", "h1", "h2", (F.col("last") - F.col("n") + 1).alias("pos"), "last")


def prefixes(turns: DataFrame, bucket: int = BUCKET, crowd: int = CROWD) -> DataFrame:
    """conv, pos, x1, x2: each turn's position (from 1) and the rolling hash of all up to it."""
    spans = _placed(turns, bucket, crowd).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("pos") / bucket), F.floor(F.col("last") / bucket))))
    # Copies spread over tasks by their chunk before they become a row each.
    within = F.sequence(F.greatest("pos", F.col("chunk") * bucket), F.least("last", F.col("chunk") * bucket + (bucket - 1)))
    placed = spans.repartition("conv", "chunk").select("conv", "chunk", "h1", "h2", F.explode(within).alias("pos"))
    placed = placed.select("conv", "pos", "chunk", F.xxhash64("pos", "h1").alias("g1"), F.xxhash64("h2", "pos", F.lit(7)).alias("g2"))
    base = _scan_base(placed, "chunk", {"x1": F.bit_xor("g1"), "x2": F.bit_xor("g2")})
    run = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(base, ["conv", "chunk"]).select("conv", "pos", *[F.bit_xor(f"g{k}").over(run).bitwiseXOR(F.col(f"base_x{k}")).alias(f"x{k}") for k in (1, 2)])


def maximal(turns: DataFrame, bucket: int = BUCKET, crowd: int = CROWD) -> DataFrame:
    """conv, n_turns: the conversations that no other one begins with or repeats under a smaller id."""
    seen = prefixes(turns, bucket, crowd)
    length = seen.groupBy("conv").agg(F.max(F.struct("pos", "x1", "x2")).alias("whole"))
    classes = length.groupBy("whole").agg(F.min("conv").alias("conv")).select("conv", "whole.*")
    proper = seen.join(length.select("conv", F.col("whole.pos").alias("n")), "conv").filter("pos < n").select("pos", "x1", "x2").distinct()
    return classes.join(proper, ["pos", "x1", "x2"], "left_anti").select("conv", F.col("pos").cast("bigint").alias("n_turns"))


def format_chats(turns: DataFrame, bucket: int = BUCKET, crowd: int = CROWD, opening: str = "<|{role}|>\n", closing: str = "\n<|end|>\n") -> DataFrame:
    """conv_id, part, n_turns, text: maximal conversations, rendered in the order of their turns.

    A part holds up to ``bucket`` turns by position, so no task holds an unbounded
    conversation. Turns that share a number go by a hash of role and text; repeated rows are
    turns of their own, carried as a count until they are rendered. A null role is "unknown", null text empty, a null turn number counts
    as -1, just before 0, and rows without a conversation form one, whose id is null. Other
    columns are ignored; an empty table gives no rows.
    """
    before, after = opening.split("{role}")
    one = F.concat(F.lit(before), F.col("role"), F.lit(after), F.col("text"), F.lit(closing))
    places = _placed(turns, bucket, crowd).join(maximal(turns, bucket, crowd), "conv")
    texts = _turns(turns).groupBy("conv", "turn", "h1", "h2", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = texts.join(places, ["conv", "turn", "h1", "h2"]).select("conv", "n_turns", "pos", "last", one.alias("line"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.floor((F.col("pos") - 1) / bucket), F.floor((F.col("last") - 1) / bucket))))
    copies = F.least("last", (F.col("part") + 1) * bucket) - F.greatest(F.col("pos") - 1, F.col("part") * bucket)
    rows = rows.select("conv", "n_turns", "part", F.struct("pos", copies.cast("int").alias("copies"), "line").alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: F.repeat(x["line"], x["copies"])), "")
    parts = rows.groupBy("conv", "part").agg(lines.alias("text"), F.max("n_turns").alias("n_turns"))
    return parts.select(F.nullif(F.col("conv"), F.lit(_NONE)).alias("conv_id"), "part", "n_turns", "text")


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS r, coalesce(text, '') AS x,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 1024 AS part
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, list(r || chr(1) || x ORDER BY turn, r, x) AS l FROM t GROUP BY conv_id
), p AS (
  SELECT DISTINCT array_to_string(list_slice(l, 1, k), chr(2)) AS body FROM (SELECT l, unnest(range(1, n)) AS k FROM c)
), w AS (
  SELECT min(conv_id) AS conv_id, n, array_to_string(l, chr(2)) AS body FROM c GROUP BY n, l
)
SELECT w.conv_id, t.part, CAST(w.n AS BIGINT) AS n_turns,
       string_agg('<|' || t.r || '|>' || chr(10) || t.x || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.turn, t.r, t.x) AS text
FROM w JOIN t ON t.conv_id = w.conv_id
WHERE w.body NOT IN (SELECT body FROM p)
GROUP BY w.conv_id, t.part, w.n
"""
