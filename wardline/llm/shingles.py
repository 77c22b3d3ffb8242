"""Near-dedup at an exact Jaccard similarity of word shingles, by SimHash and BK-trees.

Two texts are near-copies if their sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more. The SimHash
bits of such a pair differ in a share of at most about arccos(2 least / (1 + least)) / pi, 0.15 at 0.8, which is too much for
the few segments of ``simhash``. So a text has 256 bits, and many tables of some of these bits each; the texts that agree in
a table's bits form a shard, whose BK-tree finds those within ``radius`` bits. What is found is compared by
the full sets, unless the two texts are linked already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import prepare, written
from wardline.llm.components import components
from wardline.llm.simhash import differing, keep_best, met_in_shards, shingle_hashes


#: Words of 64 bits in a fingerprint.
WORDS = 4


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text or b"", width), np.uint64))


_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 64, WORDS, np.uint64)


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """``WORDS`` words of SimHash: each bit is set if it is in over half the hashes, ``WORDS`` of every shingle."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(s), 255):  # counts of 255 rows fit a byte
        h = s[i : i + 255, None] * _FACTORS + _MASKS
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(s)).view(np.uint64)


class Tables:
    """Shards by SimHash bits, for ``rows`` sets. Two that differ in a share ``apart`` of the bits agree in the bits of a table
    but for ``missed``. Bits grow with the rows, so that shards stay short, and tables with the bits."""

    def __init__(self, rows: int, apart: float, missed: float, seed: int = 5) -> None:
        self.bits = max(4, math.ceil(2 / 3 * math.log2(max(rows, 2))))
        self.count = math.ceil(math.log(missed) / math.log1p(-((1 - apart) ** self.bits)))
        chosen = np.random.default_rng(seed).permuted(np.tile(np.arange(64 * WORDS), (self.count, 1)), axis=1)[:, : self.bits]
        self.weights = np.zeros((64 * WORDS, self.count))
        for t, bits in enumerate(chosen):
            self.weights[bits, t] = 2.0 ** np.arange(self.bits)

    def of(self, fps: np.ndarray) -> np.ndarray:
        """Rows x tables: the shard of each fingerprint in each table."""
        bits = np.unpackbits(fps.view(np.uint8), axis=1).astype(np.float64)
        return (bits @ self.weights).astype(np.int64) * self.count + np.arange(self.count)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets (sorted, without repeats) have a Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def linked(sets: list[np.ndarray], fps: np.ndarray, role: list[int], radius: int, least: float) -> list[int]:
    """The smallest place reachable from each, over similar pairs within ``radius``; pairs of a known (1) and a sought (2)."""
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    roles = np.array(role)
    known, asked = np.flatnonzero(roles & 1), np.flatnonzero(roles & 2)
    for i in asked.tolist():
        for j in known[differing(fps[known], fps[i]) <= radius].tolist():
            if (j < i or not (roles[i] & roles[j]) == 3) and top(i) != top(j) and similar(sets[i], sets[j], least):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return [top(i) for i in range(len(sets))]


def grouped(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    least: float = 0.8,
    radius: int = 64,
    missed: float = 1e-3,
    shard_rows: int = 512,
    block_rows: int = 256,
) -> DataFrame:
    """``(doc_id, text_hash, node, root)``: each document with a number of its shingle set and of its component.

    Equal sets are one node, and so are all texts without words. What the BK-trees connect is a group; only groups of two nodes
    or more move their texts, in blocks of ``block_rows`` of which every two meet in one task. ``missed`` is the share of
    pairs that no table may hold together, where more bits differ than in nearly all pairs of a similarity of ``least``.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    words = [f"w{i}" for i in range(WORDS)]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps = [], np.empty((batch.num_rows, WORDS), np.uint64)
            for i, t in enumerate(batch.column(2)):
                s = shingle_set(t.as_py(), width)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63))
                fps[i] = wide_fingerprint(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), *(pa.array(w.view(np.int64)) for w in fps.T.copy())],
                ["doc_id", "text_hash", "node", *words],
            )

    schema = ", ".join([f"doc_id {kind}, text_hash bigint, node bigint", *(f"{w} bigint" for w in words)])
    found = written(rows.mapInArrow(signed, schema), "shingles")
    sets = written(found.groupBy("node").agg(*(F.first(w).alias(w) for w in words)), "shingle-sets")
    # The share of bits that differ on average at ``least``, and 2.2 standard deviations of 256 bits' share.
    apart = math.acos(2 * least / (1 + least)) / math.pi
    apart += 2.2 * math.sqrt(apart * (1 - apart) / (64 * WORDS))
    tables = Tables(sets.count(), apart, missed)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *held = (c.to_numpy() for c in batch.columns)
            values = tables.of(np.stack(held, axis=1))
            parts = [np.repeat(x, tables.count) for x in (node, *held)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (values.ravel(), *parts)], ["value", "node", *words])

    entries = sets.mapInArrow(dealt, ", ".join(f"{c} bigint" for c in ("value", "node", *words)))
    large = written(entries.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows), "shingle-shards")
    near = met_in_shards(entries, large, radius=radius, shard_rows=shard_rows, node="node", words=tuple(words))
    groups = components(near)
    groups = groups.select("node", "root").union(groups.select(F.col("root").alias("node"), "root").distinct())
    # A text of each node; equal sets have equal fingerprints, so any will do.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = (
        found.groupBy("node")
        .agg(F.min(rank).alias("of"))
        .join(groups, "node")
        .select("node", F.col("root").alias("group"), F.col("of.doc_id").alias("_id"), F.col("of.text_hash").alias("_hash"))
    )
    chosen = written(chosen, "shingle-groups")
    sizes = chosen.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    placed = chosen.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))  # before texts come in
    texts = (
        rows.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "group",
            F.least("own", "other").alias("tree"),
            F.greatest("own", "other").alias("sought"),
            F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("role"),
            "node",
            "text",
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        first: dict[int, int] = {}  # rows that repeat are one node
        for i, n in enumerate(table.column("node").to_pylist()):
            first.setdefault(n, i)
        nodes, places = list(first), list(first.values())
        sets = [shingle_set(table.column("text")[i].as_py(), width) for i in places]
        roles = [table.column("role")[i].as_py() for i in places]
        fps = np.array([wide_fingerprint(s) for s in sets])
        root = linked(sets, fps, roles, radius, least)
        pairs = [(n, nodes[r]) for n, r in zip(nodes, root) if n != nodes[r]]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    links = texts.groupBy("group", "tree", "sought").applyInArrow(compare, "a bigint, b bigint")
    return (
        found.drop(*words).join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less all but one of each component of near-copies, chosen as in ``simhash.keep_one``."""
    return keep_best(docs, grouped(docs, doc_id=doc_id, text=text, **options), doc_id=doc_id, text=text)
