"""Alignment of the tokens that two tokenizers give the same text, by diagonal run skipping.

The tokens of either side end at byte offsets. From a common end on, the two arrays of ends are compared at the current
index shift over spans that double while they agree; a stretch where token stands for token is jumped in a few comparisons.
Where the ends part, the irregular group is resolved by stepping whichever side ends first until both end together again,
and its difference in length is added to the shift.

Neither tokenizer joins what is around a single space between visible characters, so long texts are encoded and aligned in
spans that end there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import prepare, written

#: A space between two visible characters of Latin script. A's pattern matches up to such a space and starts anew with it,
#: whatever follows; B's pieces hold their blanks in front only.
CUT = re.compile(" (?<=[!-~À-ɏ] )(?=[!-~À-ɏ])")
#: Characters after which a text is cut at the next such space, to hold few tokens at a time.
SPAN = 1 << 20
#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts before their merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids of B are below this, so that a pair of ids is one integer.
IDS = 1 << 31

#: Ids of A and B, and the byte offsets where their tokens end.
Span = tuple[list[int], list[int], list[int], list[int]]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 is itself, the others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """A byte-level tokenizer (A) and one of pieces that puts a space in front (B), from their vocabulary files."""

    def __init__(self, folder: str, a: str, b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(f"{folder}/{a}", encoding="utf-8") as file:
            stated = json.load(file)
        special = {t["id"] for t in stated["added_tokens"]}  # their strings in a text are text
        byte_of = byte_letters()
        self.bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in stated["model"]["vocab"].items() if i not in special}
        # Ids are in the order of the merges, which makes them their ranks.
        self.a = Encoding(a, pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.bytes_a.items()}, special_tokens={})
        self.b = SentencePieceProcessor(model_file=f"{folder}/{b}")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{b} has pieces with a blank behind other characters, so long texts can't be encoded in spans")
        self.sizes_a = {i: len(t) for i, t in self.bytes_a.items()}
        self.names = [str(i) for i in range(max(*self.bytes_a, len(self.bytes_b)) + 1)]
        self.opened = [n + "|" for n in self.names]

    def span(self, text: str) -> Span | None:
        """" " + ``text`` in both; None if one doesn't give back its bytes."""
        whole = " " + text
        ids_a, ids_b = self.a.encode_ordinary(whole), self.b.encode(text)
        bytes_b = list(map(self.bytes_b.__getitem__, ids_b))
        if not self.a.decode_bytes(ids_a) == b"".join(bytes_b) == whole.encode():
            return None
        return ids_a, list(accumulate(map(self.sizes_a.__getitem__, ids_a))), ids_b, list(accumulate(map(len, bytes_b)))

    def spans(self, text: str) -> Iterator[Span] | None:
        """" " + ``text`` in both, a span at a time; None if one doesn't give back its bytes."""
        cuts, start = [], 0
        while len(text) - start > SPAN and (cut := CUT.search(text, start + SPAN)):
            cuts.append((start, cut.start()))
            start = cut.end()
        cuts.append((start, len(text)))
        first = self.span(text[slice(*cuts[0])])
        if first is not None and all(self.span(text[slice(*c)]) is not None for c in cuts[1:]):
            return chain([first], (self.span(text[slice(*c)]) for c in cuts[1:]))
        return None


@lru_cache(maxsize=4)
def loaded(folder: str, a: str, b: str) -> Pair:
    return Pair(folder, a, b)


def stretch(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many elements from ``a[i]`` and ``b[j]`` on agree one to one."""
    most = min(len(a) - i, len(b) - j)
    if not most or a[i] != b[j]:
        return 0
    good = 1
    while good < most:
        probe = min(good, most - good)
        if a[i + good : i + good + probe] == b[j + good : j + good + probe]:
            good += probe
            continue
        while probe > 1:  # the first difference is in this span
            half = probe // 2
            if a[i + good : i + good + half] == b[j + good : j + good + half]:
                good, probe = good + half, probe - half
            else:
                probe = half
        break
    return good


def align(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """``(i, j, n_a, n_b)`` in order: stretches (n_a = n_b) of groups of one token each, and irregular groups (n_a <> n_b, or
    both over one). Both lists rise strictly and end alike. Irregular groups of as many tokens on both sides, which look
    like a stretch, come with their counts negative."""
    i = j = 0
    while i < len(ends_a):
        n = stretch(ends_a, ends_b, i, j)
        if n:
            yield i, j, n, n
            i, j = i + n, j + n
            continue
        p, q = i, j
        while ends_a[p] != ends_b[q]:
            if ends_a[p] < ends_b[q]:
                p += 1
            else:
                q += 1
        n_a, n_b = p + 1 - i, q + 1 - j
        yield (i, j, -n_a, -n_b) if n_a == n_b else (i, j, n_a, n_b)
        i, j = p + 1, q + 1


def overlaps(ends_a: list[int], ends_b: list[int], i: int, j: int, stop_a: int) -> Iterator[tuple[int, int]]:
    """The pairs of places that overlap in the irregular group of ``ends_a[i:stop_a]`` and ``ends_b[j:]``."""
    while i < stop_a:
        yield i, j
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)


def aligned_text(pair: Pair, text: str | None):
    """``(n_a, n_b, n_groups, digest, keys, times)`` of a text; the keys are id pairs a * IDS + b, sorted, with how many links
    hold them. No tokens, an empty digest and no keys if the text is null, empty or not given back by both tokenizers."""
    spans = pair.spans(text) if text else None
    if spans is None:
        return 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
    n_a = n_b = n_groups = 0
    digest, found = hashlib.sha256(), []
    for ids_a, ends_a, ids_b, ends_b in spans:
        opened, names_b = list(map(pair.opened.__getitem__, ids_a)), list(map(pair.names.__getitem__, ids_b))
        left, right, groups = [], [], []
        for i, j, k_a, k_b in align(ends_a, ends_b):
            if k_a == k_b > 0:
                left += ids_a[i : i + k_a]
                right += ids_b[j : j + k_b]
                groups += map(add, opened[i : i + k_a], names_b[j : j + k_b])
            else:
                k_a, k_b = abs(k_a), abs(k_b)
                if k_a == 1:  # one token over all of the other side's
                    left += ids_a[i : i + 1] * k_b
                    right += ids_b[j : j + k_b]
                elif k_b == 1:
                    left += ids_a[i : i + k_a]
                    right += ids_b[j : j + 1] * k_a
                else:
                    for x, y in overlaps(ends_a, ends_b, i, j, i + k_a):
                        left.append(ids_a[x])
                        right.append(ids_b[y])
                groups.append(",".join(map(str, ids_a[i : i + k_a])) + "|" + ",".join(names_b[j : j + k_b]))
        digest.update(((";" if n_groups else "") + ";".join(groups)).encode())
        n_a, n_b, n_groups = n_a + len(ids_a), n_b + len(ids_b), n_groups + len(groups)
        found.append(np.unique(np.array(left, np.int64) * IDS + np.array(right, np.int64), return_counts=True))
    if len(found) == 1:
        keys, times = found[0]
    else:
        keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        times = np.bincount(place, np.concatenate([t for _, t in found])).astype(np.int64)
    return n_a, n_b, n_groups, digest.hexdigest(), keys, times


def aligned_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folder: str, a: str, b: str
) -> DataFrame:
    """``(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times)``, a row per row of ``docs``, written.

    ``keys`` are the distinct id pairs a * IDS + b of a text's links, ``times`` how many links hold each; ``row`` is unique.
    """
    prepare(docs.sparkSession)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = loaded(folder, a, b), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = [aligned_text(pair, t.as_py()) for t in batch.column(1)]
            n = len(rows)
            starts = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows], dtype=np.int64)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(starts, np.concatenate([r[c] for r in rows] or [np.empty(0, np.int64)])) for c in (4, 5)]
            counts = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
            links = pa.array([int(r[5].sum()) for r in rows], pa.int64())
            columns = [pa.array(range(number, number + n), pa.int64()), batch.column(0), *counts, links, pa.array([r[3] for r in rows], pa.string()), *lists]
            number += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    schema = (
        f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "keys array<bigint>, times array<bigint>"
    )
    return written(picked.mapInArrow(aligned, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(key, n, best)``, written: how many links of all documents hold each id pair, and whether no pair with the same B id
    has more."""
    links = aligned.select(F.explode(F.arrays_zip("keys", "times")).alias("x")).select("x.keys", "x.times")
    sums = written(links.groupBy(F.col("keys").alias("key")).agg(F.sum("times").alias("n")).withColumn("b", F.col("key") % IDS), "pairs")
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return written(sums.join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def token_alignments(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str = "/opt/tokenizers",
    a: str = "byte_bpe_50k.json",
    b: str = "piece_bpe_32k.model",
    frequent: int = 1 << 18,
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row per row of ``docs``.

    A encodes a space and the text, B the text (it adds the space). Groups lie between the byte offsets where tokens of both
    end, a link is a pair of tokens that overlap. ``n_best`` counts the links whose id pair is the B id's most frequent over
    all documents (or as frequent), ``count_sum`` adds their pairs' counts. Null and empty texts, and texts of which a
    tokenizer doesn't give back the bytes, have zeros and an empty digest. Rows that repeat count each; an empty table gives
    no rows; only the two named columns are read.

    Tasks get the counts of up to ``frequent`` id pairs, all those above some count; a text's other pairs are joined to theirs.
    """
    spark = prepare(docs.sparkSession)
    aligned = aligned_documents(docs, doc_id=doc_id, text=text, folder=folder, a=a, b=b)
    pairs = pair_counts(aligned)
    # Eight classes of counts for each power of two, so that a bounded number of rows tells the least count sent.
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.level, r.k, r.least) for r in pairs.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect()), reverse=True)
    least = None
    for (_, _, low), above in zip(sizes, accumulate(k for _, k, _ in sizes)):
        if above <= frequent:
            least = low
    top = pairs.filter(F.col("n") >= least).orderBy("key").toArrow() if least is not None else None
    known = [np.empty(0, np.int64)] * 3 if top is None else [top.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "best")]
    sent = spark.sparkContext.broadcast(known)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = sent.value
        for batch in batches:
            *kept, keys, times = batch.columns
            row = np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy(zero_copy_only=False))
            keys, times = keys.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.searchsorted(key, keys)
            hit = np.append(key, -1)[at] == keys
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[hit], n[at[hit]] * times[hit])
            np.add.at(bests, row[hit], best[at[hit]] * times[hit])
            starts = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(starts, x[~hit]) for x in (keys, times)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bests), pa.array(sums), *rest], [*batch.schema.names[:-2], "n_best", "count_sum", "keys", "times"])

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in aligned.columns[:-2]) + ", n_best bigint, count_sum bigint, keys array<bigint>, times array<bigint>"
    scored = written(aligned.mapInArrow(summed, schema), "alignment-sums")
    others = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), "x.times")
    rare = (
        others.join(pairs if least is None else pairs.filter(F.col("n") < least), "key")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    )
    return scored.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
