"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The documents of a source lie end to end on a tape in a seeded order. The tape is cut into blocks of ``block_tokens``
words. All blocks the mix holds are allotted to the sources by the highest quotients target / (2n + 1), and the blocks
of a source in the same way to its shards (the hash buckets of its documents, by the blocks that start in them). A
shard whose quota is q out of n blocks takes every block q div n times, and q mod n of them, picked by a seeded
permutation, once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wardline.llm.common import WORD, prepare

#: Prime, so that steps of this length visit every block of a shard (its block count stays far below).
STRIDE = 2147483647


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``(source, source_size)`` plus ``target``: shares of the total by weight, none above ``cap`` times its size.

    Weights go to the sources by code point, null last, and repeat. Filling all sources to one level per unit of weight,
    with the excess of the full ones reshared, ends where the first source in order of size per weight isn't full.
    One row per source goes through one task, never the documents.
    """
    by_name, by_room = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("room", "nth")
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        by_source.withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum("most").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    )
    level = F.max(F.when(F.col("level") < F.col("room"), F.col("level"))).over(everything)
    return (
        ranked.withColumn("fill", level)
        .withColumn(
            "target",
            F.when(F.col("fill").isNull() | (F.col("room") <= F.col("fill")), F.col("most").cast("double")).otherwise(
                F.col("weight") * F.col("fill")
            ),
        )
        .select("source", "nth", "source_size", "total", "target")
    )


def sainte_lague(df: DataFrame, votes: str, seats: str, within: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the share of ``seats`` (equal in all rows of a ``within`` group) that each row gets by its ``votes``.

    Only quotients near the proportional share can decide: with S rows in a group, a row's seats differ from its share
    q by at most 1 + q * S / seats, so all seats below that are given at once and the rest go to the highest quotients.
    Ties go to the first in ``order``. A group without votes gets nothing.
    """
    group = W.partitionBy(*within)
    whole = df.withColumn("_sum", F.sum(votes).over(group)).withColumn("_rows", F.count(F.lit(1)).over(group))
    share = F.col(votes) * F.col(seats) / F.col("_sum")
    slack = 1 + F.col(votes) * F.col("_rows") / F.col("_sum")
    bounds = (
        whole.withColumn("_sure", F.when(F.col("_sum") > 0, F.greatest(F.lit(0), F.floor(share - slack))).otherwise(0).cast("bigint"))
        .withColumn("_most", F.when((F.col("_sum") > 0) & (F.col(votes) > 0), F.ceil(share + slack)).otherwise(0).cast("bigint"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    )
    offers = bounds.filter("_most > _sure").select(
        *within, *order, "_open", votes, F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_n")
    )
    best = W.partitionBy(*within).orderBy((F.col(votes) / (2 * F.col("_n") + 1)).desc(), *order)
    won = (
        offers.withColumn("_place", F.row_number().over(best))
        .filter("_place <= _open")
        .groupBy(*within, *order)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        bounds.join(won, [*within, *order], "left")
        .withColumn(out, F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0)))
        .drop("_sum", "_rows", "_sure", "_most", "_open", "_won")
    )


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    block_tokens: int = 32,
    seed: str = "mix-1",
    buckets_log16: int = 3,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``size`` is the number of words, ``taken`` how many of them the mix holds, repeats counted. A null text has size 0;
    null sources form one source, the last. Rows that repeat are documents of their own; which of several rows with the
    same id and size comes first on the tape doesn't show. An empty table gives no rows. Only the four named columns are
    read, so others may have any name.

    Sizes, never texts, are shuffled, by source and 16^``buckets_log16`` hash buckets, so a source with a third of all
    rows is spread over all tasks. ``taken`` of a source misses its target by a few blocks at most.
    """
    prepare(docs.sparkSession)
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words_of(F.col(text)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string")).cast("binary")).alias("place"),
    ).withColumn("bucket", F.conv(F.substring("place", 1, buckets_log16), 16, 10).cast("int"))
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    block = F.lit(block_tokens).cast("bigint")
    blocks_in = F.floor((F.col("source_size") + block - 1) / block).cast("bigint")
    plan = plan.withColumn("seats", F.floor(F.col("total") / block + F.lit(0.5)).cast("bigint")).withColumn("all", F.lit(0))
    plan = sainte_lague(plan, "target", "seats", ["all"], ["nth"], "quota").withColumn("quota", F.least("quota", cap * blocks_in))

    along = W.partitionBy("nth").orderBy("bucket")
    first_block = lambda c: F.floor((c + block - 1) / block).cast("bigint")
    shards = (
        by_bucket.withColumnRenamed("source", "_s")
        .join(plan.select("source", "nth", "source_size", "target", "quota"), F.col("_s").eqNullSafe(F.col("source")))
        .drop("_s")
        .withColumn("start", F.coalesce(F.sum("bucket_size").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("j0", first_block(F.col("start")))
        .withColumn("n", first_block(F.col("start") + F.col("bucket_size")) - F.col("j0"))
    )
    shards = sainte_lague(shards, "n", "quota", ["nth"], ["bucket"], "q")
    shift = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "nth", "bucket").cast("binary")), 1, 7), 16, 10).cast("bigint")
    own = F.struct(F.col("j0"), F.col("n"), F.col("q"), shift.alias("shift"))
    shards = (
        shards.withColumn("own", own)
        .withColumn("before", F.last(F.when(F.col("n") > 0, F.col("own")), True).over(along.rowsBetween(W.unboundedPreceding, -1)))
        .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "source_size", "target", "start", "own", "before")
    )

    here = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        sized.withColumn("before_here", F.coalesce(F.sum("size").over(here), F.lit(0)))
        .join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .withColumn("from", F.col("start") + F.col("before_here"))
        .withColumn("to", F.col("from") + F.col("size"))
    )

    def copies(j: Column) -> Column:
        s = F.when(j < F.col("own.j0"), F.col("before")).otherwise(F.col("own"))
        extra = (F.lit(STRIDE) * (j - s["j0"]) + s["shift"]) % s["n"] < s["q"] % s["n"]
        return F.floor(s["q"] / s["n"]).cast("bigint") + extra.cast("bigint")

    def held(total: Column, j: Column) -> Column:
        width = F.least(F.col("to"), (j + 1) * block) - F.greatest(F.col("from"), j * block)
        return total + width * copies(j)

    touched = F.sequence(F.floor(F.col("from") / block).cast("bigint"), F.floor((F.col("to") - 1) / block).cast("bigint"))
    taken = F.when(F.col("size") > 0, F.aggregate(touched, F.lit(0).cast("bigint"), held)).otherwise(F.lit(0).cast("bigint"))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


ORACLE = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR))) AS place FROM documents),
docs AS (SELECT *, CAST('0x' || substr(place, 1, 3) AS INTEGER) AS bucket FROM sized),
by_bucket AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS bucket_size FROM docs GROUP BY ALL),
by_source AS (
    SELECT source, CAST(sum(bucket_size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
    FROM by_bucket GROUP BY source),
rooms AS (SELECT *, nth % 3 + 1 AS weight, 3 * source_size AS most, 3 * source_size / (nth % 3 + 1) AS room FROM by_source),
levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY room, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY room, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
           CAST(sum(source_size) OVER () AS BIGINT) AS total FROM rooms),
filled AS (SELECT *, max(CASE WHEN level < room THEN level END) OVER () AS fill FROM levels),
targets AS (
    SELECT source, nth, source_size, CAST(floor(total / 32 + 0.5) AS BIGINT) AS seats,
           CASE WHEN fill IS NULL OR room <= fill THEN CAST(most AS DOUBLE) ELSE weight * fill END AS target FROM filled),
offers AS (SELECT nth, seats, target / (2 * n + 1) AS quotient FROM (SELECT *, unnest(range(seats)) AS n FROM targets) WHERE target > 0),
quotas AS (
    SELECT nth, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, nth) AS rn FROM offers) WHERE rn <= seats
    GROUP BY nth),
plan AS (
    SELECT source, t.nth, source_size, target, least(coalesce(won, 0), 3 * ((source_size + 31) // 32)) AS quota
    FROM targets t LEFT JOIN quotas q USING (nth)),
starts AS (
    SELECT b.source, bucket, nth, source_size, target, quota, bucket_size,
           CAST(coalesce(sum(bucket_size) OVER (PARTITION BY nth ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM by_bucket b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source),
shards AS (SELECT *, (start + 31) // 32 AS j0, (start + bucket_size + 31) // 32 - (start + 31) // 32 AS n FROM starts),
shard_offers AS (SELECT nth, bucket, quota, n / (2 * k + 1) AS quotient FROM (SELECT *, unnest(range(3 * n + 1)) AS k FROM shards WHERE n > 0)),
shard_quotas AS (
    SELECT nth, bucket, count(*) AS q
    FROM (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY quotient DESC, bucket) AS rn FROM shard_offers) WHERE rn <= quota
    GROUP BY nth, bucket),
owned AS (
    SELECT s.*, CASE WHEN n > 0 THEN struct_pack(j0 := j0, n := n, q := coalesce(q, 0),
               shift := CAST('0x' || substr(md5(concat_ws(':', 'mix-1', CAST(nth AS VARCHAR), CAST(bucket AS VARCHAR))), 1, 7) AS BIGINT)) END AS own
    FROM shards s LEFT JOIN shard_quotas USING (nth, bucket)),
ready AS (
    SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY nth ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM owned),
placed AS (
    SELECT d.doc_id, d.size, d.place, r.*, r.start + CAST(coalesce(sum(d.size) OVER (
               PARTITION BY r.nth, d.bucket ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
    FROM docs d JOIN ready r ON d.source IS NOT DISTINCT FROM r.source AND d.bucket = r.bucket),
pieces AS (SELECT *, unnest(range(first // 32, (first + size + 31) // 32)) AS j FROM placed WHERE size > 0),
held AS (
    SELECT *, least(first + size, (j + 1) * 32) - greatest(first, j * 32) AS width, CASE WHEN own IS NULL OR j < own.j0 THEN before ELSE own END AS s
    FROM pieces),
taken AS (
    SELECT nth, bucket, place, doc_id, first,
           sum(width * (s.q // s.n + CAST((2147483647 * (j - s.j0) + s.shift) % s.n < s.q % s.n AS BIGINT))) AS taken
    FROM held GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN taken t ON p.size > 0 AND p.nth = t.nth AND p.bucket = t.bucket AND p.place = t.place AND p.first = t.first
"""
