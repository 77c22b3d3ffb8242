"""Chat formatting after collapsing cumulative snapshots.

A logger that writes a conversation again after every turn leaves prefixes of the final one. Each turn is hashed with its
position; the rolling hash of a prefix is the exclusive or of its turns' hashes, in two independent 64-bit lanes. A
conversation whose hash at its full length is the hash of a longer one's prefix is dropped by an anti-join, and of equal
conversations the smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wardline.llm.common import prepare

#: Turns this many numbers apart may be hashed in different tasks, so a conversation of any length is spread.
BLOCK = 1024


def positioned(turns: DataFrame) -> DataFrame:
    """``(conv, block, pos, role, text, h1, h2, n)``: turns numbered from 1, rolling hashes, turns of the conversation."""
    once = turns.distinct().withColumn("block", F.floor(F.col("turn") / BLOCK).cast("bigint"))
    in_block = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = in_block.rowsBetween(W.unboundedPreceding, 0)
    blocks = W.partitionBy("conv").orderBy(F.col("block").asc_nulls_first())
    earlier = blocks.rowsBetween(W.unboundedPreceding, -1)

    def carried(df: DataFrame, total: DataFrame) -> DataFrame:
        right = total.withColumnsRenamed({"conv": "_c", "block": "_b"})
        return df.join(right, F.col("conv").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))).drop("_c", "_b")

    counts = (
        once.groupBy("conv", "block")
        .agg(F.count(F.lit(1)).alias("here"))
        .withColumn("skip", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
        .withColumn("n", F.sum("here").over(W.partitionBy("conv")))
        .drop("here")
    )
    numbered = (
        carried(once.withColumn("rn", F.row_number().over(in_block)), counts)
        .withColumn("pos", F.col("skip") + F.col("rn"))
        .withColumn("x1", F.xxhash64("pos", "role", "text"))
        .withColumn("x2", F.xxhash64("text", "role", "pos", F.lit(1)))
    )
    lanes = (
        numbered.groupBy("conv", "block")
        .agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
        .withColumn("p1", F.coalesce(F.bit_xor("b1").over(earlier), F.lit(0)))
        .withColumn("p2", F.coalesce(F.bit_xor("b2").over(earlier), F.lit(0)))
        .drop("b1", "b2")
    )
    return carried(
        numbered.withColumn("l1", F.bit_xor("x1").over(so_far)).withColumn("l2", F.bit_xor("x2").over(so_far)), lanes
    ).select(
        "conv", "block", "pos", "role", "text", "n",
        F.col("l1").bitwiseXOR(F.col("p1")).alias("h1"),
        F.col("l2").bitwiseXOR(F.col("p2")).alias("h2"),
    )


def maximal(positions: DataFrame) -> DataFrame:
    """``(conv, n, n_copies)`` of the conversations that are no strict prefix of another, one of equal ones."""
    ends = (
        positions.filter("pos = n")
        .groupBy("n", "h1", "h2")
        .agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    )
    prefixes = positions.filter("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv", "n", "n_copies")


def chatml(role: Column, text: Column) -> Column:
    """One turn in ChatML; markers within a text are broken up so that they can't end the turn."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    who = F.replace(F.coalesce(role, F.lit("unknown")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), who, F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def format_chats(
    turns: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    part_turns: int = 256,
) -> DataFrame:
    """``(conv_id, part, n_turns, n_copies, text)``: the maximal conversations, rendered.

    A conversation of more than ``part_turns`` turns is rendered in that many turns a part, so that no row grows without
    bound; ``n_turns`` counts the turns of the part, ``n_copies`` the equal conversations it stands for. Turns go by
    number (null first), then role, then text. Rows that repeat are one turn. A null id names one more conversation, and
    stays only if no equal one has an id. A null text is rendered as empty, a null role as ``unknown``, but for comparison
    null and empty differ. An empty table gives no rows. Only the four named columns are read.
    """
    prepare(turns.sparkSession)
    named = turns.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    positions = positioned(named)
    stay = maximal(positions).select(F.col("conv").alias("_c"), "n_copies")
    return (
        positions.join(stay, F.col("conv").eqNullSafe(F.col("_c")))
        .withColumn("part", F.floor((F.col("pos") - 1) / part_turns).cast("bigint"))
        .groupBy(F.col("conv").alias("conv_id"), "part", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct("pos", chatml(F.col("role"), F.col("text")).alias("said")))).alias("turns"))
        .select("conv_id", "part", F.size("turns").cast("bigint").alias("n_turns"), "n_copies", F.concat_ws("", "turns.said").alias("text"))
    )


ORACLE = """
WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
    SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
           list(struct_pack(r := role, t := text)) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far
    FROM once WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
ends AS (SELECT so_far, min(conv_id) AS conv_id, count(*) AS n_copies FROM placed WHERE pos = n GROUP BY so_far),
stay AS (SELECT * FROM ends WHERE so_far NOT IN (SELECT so_far FROM placed WHERE pos < n))
SELECT p.conv_id, (p.pos - 1) // 256 AS part, count(*) AS n_turns, any_value(s.n_copies) AS n_copies,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                  || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM placed p JOIN stay s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
GROUP BY p.conv_id, part
"""
