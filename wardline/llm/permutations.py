"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots, the first ``prefix`` of them. The index is dealt to shards; in
a shard every pivot has an inverted file, the vectors that hold it in their prefix with its place there. A query adds up,
over the files of its own prefix, what each common pivot takes off the footrule distance of the two orders; the vectors
with the smallest footrule are then ranked by their exact distance.

With l for the prefix's length and l as the place of all pivots outside, the footrule is l * (l + 1) less twice the sum of
l - max(place in the query, place in the vector) over the common pivots. So only common pivots are ever looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wardline.llm.common import prepare, written


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all of it finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()


def fit(entries: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Up to ``pivots`` of the distinct vectors of each length, those with the smallest hashes, as rows of a matrix."""
    first = W.partitionBy("size").orderBy("h", "v")
    chosen = (
        entries.select("v", F.size("v").alias("size"), F.xxhash64("v").alias("h"))
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= pivots)
        .orderBy("size", "nth")
        .select("size", "v")
        .collect()
    )
    return {n: np.array([r.v for r in chosen if r.size == n]) for n in {r.size for r in chosen}}


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row of ``x``, nearest first, of equal ones the first in the matrix."""
    with np.errstate(all="ignore"):  # squares of huge components
        far = (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    return np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def with_orders(df: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """``df`` with ``near``: the order of the pivots nearest to its vector ``v``. The pivots' number bounds what is sent."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)
    at = df.columns.index("v")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near: list[np.ndarray] = [np.empty(0, np.int16)] * batch.num_rows
            for size, places, x in by_size(batch.column(at)):
                if size in sent.value:  # else no vector has this length
                    for i, order in zip(places.tolist(), orders(x, sent.value[size], prefix)):
                        near[i] = order
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int16()))], [*batch.schema.names, "near"])

    return df.mapInArrow(ordered, f"{kinds}, near array<smallint>")


def by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, places, matrix)`` of the vectors of each length in a column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        yield size, places, flat[starts[places][:, None] + np.arange(size)]


class InvertedFiles:
    """The inverted files of the pivots over the prefixes ``near`` of the vectors of a shard."""

    def __init__(self, near: np.ndarray) -> None:
        self.rows, self.length = near.shape
        flat = near.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(flat))]) if self.rows else np.zeros(1, np.int64)
        self.row = (by_pivot // self.length).astype(np.int32)
        self.left = (self.length - by_pivot % self.length).astype(np.int32)  # the length less the place

    def nearest(self, order: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` rows with the smallest footrule to ``order``, of equal ones the first."""
        taken = np.zeros(self.rows, np.int64)
        for place, pivot in enumerate(order.tolist()):
            if pivot + 1 < len(self.starts):
                file = slice(self.starts[pivot], self.starts[pivot + 1])
                taken[self.row[file]] += np.minimum(self.left[file], self.length - place)
        if count >= self.rows:
            return np.arange(self.rows)
        key = taken * self.rows - np.arange(self.rows)
        return np.argpartition(-key, count)[:count]


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    *,
    row_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    pivots: int = 512,
    prefix: int = 256,
    candidates: int = 256,
    shard_rows: int = 8192,
    block_rows: int = 4096,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest of ``rows`` found for each of ``queries`` by Euclidean distance.

    Ties go to the smaller id. Rows with a query's own id are left out for it. Vectors that are null, empty or zero or hold
    null, NaN or infinite components take no part, nor do rows without an id; ids are integers. Vectors of different length are
    never neighbours, each length has pivots of its own. Rows that repeat count once; an id with several vectors counts by
    its nearest one. Fewer than k candidates give fewer rows. Only the two named columns are read.

    The pivots are fitted on a bounded sample (``pivots`` vectors), every row is in the index. Equal vectors are one entry,
    which keeps the k + 1 smallest ids: no more can be among k neighbours. In each shard of about ``shard_rows`` entries the
    ``candidates`` entries (more than k) with the smallest footrule are ranked exactly, so recall doesn't sink as shards are
    added, and a query with less than ``candidates`` entries to a shard has exact results.
    """
    spark = prepare(rows.sparkSession)
    candidates = max(candidates, k + 1)
    smallest = W.partitionBy("v").orderBy("id")
    entries = written(
        vectors(rows, row_id, vector)
        .withColumn("nth", F.row_number().over(smallest))
        .filter(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("id")).alias("ids")),
        "vectors",
    )
    chosen = fit(entries, pivots)
    index = written(with_orders(entries, chosen, prefix), "permutations")
    asked = written(with_orders(vectors(queries, row_id, vector).select(F.array("id").alias("ids"), "v"), chosen, prefix), "queries")
    shards, blocks = -(-index.count() // shard_rows) or 1, -(-asked.count() // block_rows) or 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("v", "ids"), F.lit(n)).cast("int")
    meeting = index.select(own(shards).alias("shard"), numbers(blocks).alias("block"), F.lit(False).alias("asks"), "ids", "v", "near").union(
        asked.select(numbers(shards).alias("shard"), own(blocks).alias("block"), F.lit(True).alias("asks"), "ids", "v", "near")
    )

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        known, sought = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        out_q, out_id, out_score = [], [], []
        questions = {size: (places, x) for size, places, x in by_size(sought.column("v"))}
        ids_of, asked_ids = known.column("ids").to_pylist(), [i for (i,) in sought.column("ids").to_pylist()]
        nears = {False: known.column("near").combine_chunks(), True: sought.column("near").combine_chunks()}
        for size, places, x in by_size(known.column("v")):
            if size not in questions:
                continue
            rank = np.argsort([ids_of[p][0] for p in places], kind="stable")  # equal footrules by id, whatever the arrival
            places, x = places[rank], x[rank]
            files = InvertedFiles(np.stack([nears[False][p].values.to_numpy() for p in places.tolist()]))
            for p, q in zip(*questions[size]):
                found = files.nearest(nears[True][int(p)].values.to_numpy(), candidates)
                with np.errstate(all="ignore"):
                    far = np.sqrt(((x[found] - q) ** 2).sum(axis=1))
                best = np.argsort(far, kind="stable")
                limit = far[best[min(k, len(best) - 1)]]  # k + 1 entries hold k ids beside the query's own
                me = asked_ids[p]
                hits = sorted((float(far[i]), v) for i in np.flatnonzero(far <= limit).tolist() for v in ids_of[places[found[i]]] if v != me)
                out_q += [me] * len(hits[:k])
                out_id += [v for _, v in hits[:k]]
                out_score += [d for d, _ in hits[:k]]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_score, pa.float64())})

    found = meeting.repartition(shards * blocks, "shard", "block").groupBy("shard", "block").applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    place = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
