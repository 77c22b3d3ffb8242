"""Exact top-k by Hamming distance over binary codes, by incremental multi-index hashing.

A code is cut into m segments, each with an index by its value. A code within m * (r + 1) - 1 bits of a query differs from
it by at most r bits in some segment. So the radius r of the probes into each segment grows from 0 until the k-th distance
verified on whole codes is at most that; only the queries not yet done go on.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed, prepare, written


#: Codes of one length up to which queries are compared with all of them.
FEW = 64


def sign_code(vector: Column, segment_bits: int = 16) -> Column:
    """The signs of a vector (1 from zero up and for NaN; a null element 0) as an array of segments; the last may be shorter."""
    segment = lambda i: F.aggregate(
        F.slice(vector, i * segment_bits + 1, segment_bits), F.lit(0), lambda acc, x: acc * 2 + F.coalesce(x >= 0, F.lit(False)).cast("int")
    )
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / segment_bits).cast("int")), segment)


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    *,
    row_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    segment_bits: int = 16,
) -> DataFrame:
    """``(query_id, rank, neighbour_id, distance)``: the ``k`` nearest of ``rows`` for each of ``queries``, exact.

    Ties go to the smaller id. A query isn't its own neighbour: rows with its id are left out. Rows and queries with a null
    id, a null vector or an empty one take no part; vectors of different length are never neighbours. Rows that repeat count
    once. Fewer than k rows give fewer neighbours. Only the two named columns are read.

    Equal codes are one entry of the index, which keeps the k + 1 smallest ids: no more can be among k neighbours, so this
    bound loses nothing. Queries with equal codes are searched once.
    """
    spark = prepare(rows.sparkSession)

    def coded(df: DataFrame) -> DataFrame:
        return (
            df.select(F.col(row_id).alias("id"), F.col(vector).alias("v"))
            .filter("id IS NOT NULL AND size(v) > 0")
            .select("id", F.size("v").alias("bits"), sign_code(F.col("v"), segment_bits).alias("code"))
            .distinct()
        )

    smallest = W.partitionBy("bits", "code").orderBy("id")
    index = written(
        coded(rows)
        .withColumn("nth", F.row_number().over(smallest))
        .filter(F.col("nth") <= k + 1)
        .groupBy("bits", "code")
        .agg(F.collect_list("id").alias("ids")),
        "codes",
    )
    asked = checkpointed(coded(queries))
    entries = index.select("bits", "code", "ids", F.posexplode("code").alias("seg", "value"))
    open_ = asked.select("bits", F.col("code").alias("q")).distinct()
    nearest = W.partitionBy("bits", "q").orderBy("distance", "id")

    def kept(found: DataFrame) -> DataFrame:
        return (
            found.groupBy("bits", "q", "id")  # an id may have several vectors
            .agg(F.min("distance").alias("distance"))
            .withColumn("nth", F.row_number().over(nearest))
            .filter(F.col("nth") <= k + 1)
            .drop("nth")
        )

    # Where a length has few codes, no radius may ever prove the k-th; its queries are compared with all of them.
    few = checkpointed(index.groupBy("bits").agg(F.count(F.lit(1)).alias("codes")).filter(F.col("codes") <= FEW).select("bits"))
    direct = open_.join(few, "bits", "left_semi").join(index.select("bits", "ids", "code"), "bits")
    done = checkpointed(
        kept(direct.select("bits", "q", distance(F.col("q"), F.col("code")).alias("distance"), F.explode("ids").alias("id")))
    )
    open_ = checkpointed(open_.join(few, "bits", "left_anti"))
    best, r = None, 0
    while not open_.isEmpty():
        masks = F.array(*[F.lit(sum(1 << b for b in bits)) for bits in combinations(range(segment_bits), r)])
        probes = (
            open_.select("bits", "q", F.posexplode("q").alias("seg", "mine"))
            .withColumn("mask", F.explode(masks))
            .select("bits", "q", "seg", F.col("mine").bitwiseXOR(F.col("mask")).alias("value"))
        )
        found = (
            probes.join(entries, ["bits", "seg", "value"])
            .select("bits", "q", "ids", distance(F.col("q"), F.col("code")).alias("distance"), F.explode("ids").alias("id"))
            .select("bits", "q", "id", "distance")
        )
        if best is not None:
            found = found.union(best.join(open_, ["bits", "q"], "left_semi"))
        best = checkpointed(kept(found))
        segments = F.size("q")
        proven = best.groupBy("bits", "q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).filter(
            (F.col("n") == k + 1) & (F.col("far") <= segments * (r + 1) - 1)
        )
        finished = best if r == segment_bits else best.join(proven, ["bits", "q"], "left_semi")
        done = done.union(finished)
        if r == segment_bits:
            break
        open_ = checkpointed(open_.join(proven, ["bits", "q"], "left_anti"))
        r += 1
    place = W.partitionBy("query_id").orderBy("distance", "id")
    return (
        asked.withColumnsRenamed({"id": "query_id", "code": "q"})
        .join(done, ["bits", "q"])
        .filter("id <> query_id")
        .groupBy("query_id", "id")  # an id that has several vectors counts by its nearest
        .agg(F.min("distance").alias("distance"))
        .withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")
    )


ORACLE = """
WITH codes AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: coalesce(x >= 0, false)) AS code FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id,
           min(list_sum(list_transform(list_zip(q.code, c.code), lambda z: CAST(z[1] <> z[2] AS INTEGER)))) AS distance
    FROM codes q JOIN codes c ON len(q.code) = len(c.code) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
"""
