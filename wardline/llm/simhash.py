"""SimHash near-dedup with BK-trees.

Fingerprints that differ in at most ``radius`` of 64 bits agree in one of ``radius + 1`` segments of the bits. The
distinct fingerprints that share a segment's value form a shard, a shard too large for one task several. Each shard
gets a BK-tree, whose children hang on their Hamming distance to the parent, and the tree goes to all tasks that hold
fingerprints of the same segment value, which follow only edges within the radius of the distance they measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import free_name, prepare, written
from wardline.llm.components import components, local_roots

BITS = 64


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64 bits, each set if it is in over half the shingles' hashes."""
    hashes = np.array(shingle_hashes(text or b"", width), np.uint64)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``(doc_id, text_hash, fp)``, a row per document; whole texts, null as empty."""
    picked = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "text_hash", "fp"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(hashed, f"doc_id {kind}, text_hash bigint, fp bigint")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ, of one word each or of a row of words each."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees of many shards as arrays. ``shard`` is sorted; no shard holds a fingerprint twice."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray) -> None:
        self.bits = BITS * (fps.shape[1] if fps.ndim == 2 else 1)
        self.shards, first = np.unique(shard, return_index=True)
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(shard))))
        rest = np.ones(len(fps), bool)
        rest[first] = False
        items, at = np.flatnonzero(rest), node[rest]
        members, edges, count = [first], [], len(first)
        values = fps[first]
        while len(items):  # a level of all trees: the first item at a parent's edge becomes the child, the others go below it
            edge = at * (self.bits + 1) + differing(fps[items], values[at])
            keys, new, at = np.unique(edge, return_index=True, return_inverse=True)
            members.append(items[new])
            edges.append(keys)
            at = at + count
            count += len(keys)
            values = fps[np.concatenate(members)]
            rest = np.ones(len(items), bool)
            rest[new] = False
            items, at = items[rest], at[rest]
        self.values = values
        #: Where each node was in ``fps``.
        self.places = np.concatenate(members)
        #: Sorted, as a level's nodes come after those of the level above. Edge i leads to node i + number of shards.
        self.edges = np.concatenate(edges) if edges else np.empty(0, np.int64)

    def within(self, shard: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``fps``, place of the fingerprint found) of each fingerprint with its shard's within ``radius``."""
        found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        root = np.searchsorted(self.shards, shard)
        for begin in range(0, len(fps), 4096):
            who = np.arange(begin, min(begin + 4096, len(fps)))
            node = root[who]
            while len(who):
                d = differing(fps[who], self.values[node])
                hit = d <= radius
                found[0].append(who[hit])
                found[1].append(self.places[node[hit]])
                base = node * (self.bits + 1)
                low = np.searchsorted(self.edges, base + np.maximum(d - radius, 0), "left")
                width = np.searchsorted(self.edges, base + np.minimum(d + radius, self.bits), "right") - low
                who = np.repeat(who, width)
                step = np.arange(len(who)) - np.repeat(np.cumsum(width) - width, width)
                node = np.repeat(low, width) + step + len(self.shards)
        return np.concatenate(found[0]), np.concatenate(found[1])


def links(classes: DataFrame, *, radius: int = 4, shard_rows: int = 512) -> DataFrame:
    """Links ``(a, b)`` between the distinct ``fp`` of ``classes``, enough to connect all that are within ``radius``."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    keys = [
        F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) * F.lit(64) + F.lit(i)
        for i, (low, high) in enumerate(zip(cuts, cuts[1:]))
    ]
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("value"))
    large = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
    return met_in_shards(rows, large, radius=radius, shard_rows=shard_rows)


def met_in_shards(
    rows: DataFrame, large: DataFrame, *, radius: int, shard_rows: int, node: str = "fp", words: tuple[str, ...] = ("fp",)
) -> DataFrame:
    """Links ``(a, b)`` between the ``node`` of ``rows``, enough to connect all that share a ``value`` and whose fingerprints,
    of one or more ``words``, are within ``radius``.

    A task returns a spanning forest of the pairs it finds, never all pairs of a group. A value with more than ``shard_rows``
    rows (``large``: ``value``, ``n``) is cut into shards; every two shards meet in one task, as tree and as fingerprints sought.
    """
    fields = list(dict.fromkeys([node, *words]))
    split = (
        rows.join(large, "value", "left")
        .withColumn("shards", F.coalesce(F.ceil(F.col("n") / shard_rows), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(node), "shards").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select(
            "value",
            F.least("own", "other").alias("tree"),
            F.greatest("own", "other").alias("sought"),
            F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("role"),
            *fields,
        )
    )

    def search(columns: list[np.ndarray]) -> pa.RecordBatch:
        value, tree, sought, role, named = columns[:5]
        held = [columns[4 + fields.index(w)].view(np.uint64) for w in words]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (tree[1:] != tree[:-1]) | (sought[1:] != sought[:-1])
        shard = np.cumsum(fresh)
        a, b = [], []
        if len(held) == 1:
            fps = held[0]
        else:  # nodes of one shard can share a fingerprint: the first of each role stands for all
            order = np.lexsort((*held, role, shard))
            shard, role, named = shard[order], role[order], named[order]
            fps = np.stack([w[order] for w in held], axis=1)
            first = np.ones(len(order), bool)
            first[1:] = (shard[1:] != shard[:-1]) | (role[1:] != role[:-1]) | (fps[1:] != fps[:-1]).any(axis=1)
            stands = named[first][np.cumsum(first) - 1]
            a, b = [named[~first]], [stands[~first]]
            shard, role, named, fps = shard[first], role[first], named[first], fps[first]
        known, asked = role & 1 > 0, role & 2 > 0
        who, other = Forest(shard[known], fps[known]).within(shard[asked], fps[asked], radius)
        a, b = np.concatenate([*a, named[asked][who]]), np.concatenate([*b, named[known][other]])
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(nodes), index[: len(a)], index[len(a) :])
        linked = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= 1 << 16:
                columns = [np.concatenate(c) for c in zip(*held)]
                last = np.flatnonzero(
                    (columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1])
                )
                end = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
                if end:
                    yield search([c[:end] for c in columns])
                held, size = [[c[end:] for c in columns]], len(columns[0]) - end
        if size:
            yield search([np.concatenate(c) for c in zip(*held)])

    dealt = split.repartition("value", "tree", "sought").sortWithinPartitions("value", "tree", "sought")
    return dealt.mapInArrow(searched, "a bigint, b bigint")


def grouped(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """``(doc_id, text_hash, fp, root)``: each document with a fingerprint that stands for its component."""
    prepare(docs.sparkSession)
    fps = written(fingerprints(docs, doc_id=doc_id, text=text, width=width), "simhash")
    roots = components(links(fps.select("fp").distinct(), radius=radius)).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in at most ``radius`` bits. A null or
    empty text has fingerprint zero and is linked like any other. Rows that repeat, or share a doc_id, keep a row each;
    a null doc_id never is the smallest unless the component has no other. An empty table gives no rows. Only the named
    columns are read, so further columns may have any name.
    """
    rows = grouped(docs, **options)
    smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_best(docs: DataFrame, rows: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are the best of a ``root`` of ``rows`` (``doc_id``, ``text_hash``, ``root``)."""
    best = rows.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    )
    # One key, in which null ids are equal: rows that met in the join need not move again for the distinct ones.
    key = lambda i, h: F.struct(i.alias("id"), h.alias("hash"))
    stay = best.select(key(F.col("best.doc_id"), F.col("best.text_hash")).alias("_keep"))
    name = free_name(docs, "_key")
    found = docs.withColumn(name, key(F.col(doc_id), F.xxhash64(text)).cast(stay.schema["_keep"].dataType))
    return found.join(stay, F.col(name) == F.col("_keep"), "left_semi").dropDuplicates([name]).drop(name)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: that with the smallest doc_id (null last), then the
    smallest text hash; of rows equal in both, any one."""
    return keep_best(docs, grouped(docs, doc_id=doc_id, text=text, **options), doc_id=doc_id, text=text)
