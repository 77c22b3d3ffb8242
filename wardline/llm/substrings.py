"""Substring dedup by hashing lines and their sentences.

A text falls into lines and these into sentences. Each sentence of enough words is normalised and hashed; equal digests meet
in one grouping over all documents, which keeps the earliest by (doc_id, position). Later ones go where they fill a line, or
where a run of them is long enough to be a passage; a passage inside a line is so found as well, which lines alone would
miss. What is removed is given as offsets into the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import free_name, prepare

#: From a visible character to the last of a row of full stops, exclamation or question marks before white space, or to the
#: end of the line.
SENTENCE = re.compile(r"\S(?:[^.!?\n]++|[.!?](?!\s|\Z))*+[.!?]*")
WORDS = re.compile(r"\S+")
#: A sentence above this many words is cut after each word whose hash is a multiple of 8, so that long ones are cut at the
#: same words wherever they are.
LONG = 24
UNIT = "idx int, start int, end int, words int, line int, line_end int, line_units int"


def pieces(line: str) -> Iterator[tuple[int, int, list[str]]]:
    """The sentences of a line: start, end, normalised words."""
    for m in SENTENCE.finditer(line):
        words = m[0].lower().split()
        if len(words) <= LONG:
            yield m.start(), m.end(), words
            continue
        begin, held = None, []
        for w in WORDS.finditer(line, m.start(), m.end()):
            begin = w.start() if begin is None else begin
            held.append(w[0].lower())
            if xxhash.xxh32_intdigest(held[-1]) % 8 == 0:
                yield begin, w.end(), held
                begin, held = None, []
        if held:
            yield begin, m.end(), held


def units(text: str, min_words: int) -> list[tuple[bytes, int, int, int, int, int, int, int]]:
    """``(digest, idx, start, end, words, line, line_end, line_units)`` of the hashed sentences, in order; ``line`` is where
    the line begins, ``line_end`` the offset after its line feed, ``line_units`` how many of its sentences are hashed."""
    found = []
    at = 0
    for line in text.split("\n"):
        here = [(a, b, words) for a, b, words in pieces(line) if len(words) >= min_words]
        after = min(at + len(line) + 1, len(text))
        for a, b, words in here:
            digest = xxhash.xxh3_128_digest(" ".join(words))
            found.append((digest, len(found), at + a, at + b, len(words), at, after, len(here)))
        at += len(line) + 1
    return found


def removed(repeats: list[tuple[int, ...]], run_words: int) -> list[tuple[int, int, int]]:
    """Spans ``(start, end, place of the first repeat)`` to remove, given the repeated units (as in ``UNIT``) in order."""
    in_line: dict[int, int] = {}
    for u in repeats:
        in_line[u[4]] = in_line.get(u[4], 0) + 1
    spans: list[list[int]] = []
    i = 0
    while i < len(repeats):
        j = i + 1
        while j < len(repeats) and repeats[j][0] == repeats[j - 1][0] + 1:
            j += 1
        run = sum(u[3] for u in repeats[i:j]) >= run_words
        for place in range(i, j):
            _, start, end, _, line, line_end, line_units = repeats[place]
            whole = in_line[line] == line_units
            if not run and not whole:
                continue
            start, end = (line, line_end) if whole else (start, end)
            if spans and (start <= spans[-1][1] or run and place > i):
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end, place])
        i = j
    return [tuple(s) for s in spans]


def repeated_spans(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 4, run_words: int = 20
) -> DataFrame:
    """``(doc_id, text_hash, spans)`` of the documents that lose something; a span is ``(start, end, kept_doc_id)``.

    Offsets count characters from 0, the end is exclusive. ``kept_doc_id`` is the document that keeps the first repeated
    sentence of the span. Sentences under ``min_words`` words are never hashed and go only inside a removed line or run.
    A sentence repeats if an earlier one has the same words but for case and white space; earlier: smaller doc_id (null
    last), then smaller text hash, then position. Rows with the same id and text are one document. Null and empty texts
    have no sentences.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            found: list[tuple] = []
            for i, t in enumerate(batch.column(2).to_pylist()):
                some = units(t, min_words) if t else []
                found += some
                owner += [i] * len(some)
            digest, *rest = zip(*found) if found else [()] * 8
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                + [pa.array(c, pa.int32()) for c in rest],
                ["doc_id", "text_hash", "d1", "d2", "idx", "start", "end", "words", "line", "line_end", "line_units"],
            )

    found = rows.mapInArrow(cut, f"doc_id {kind}, text_hash bigint, d1 bigint, d2 bigint, {UNIT}")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "idx")
    first = (
        found.groupBy("d1", "d2")
        .agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
        .filter("first <> last")
        .select("d1", "d2", "first")
    )
    later = (
        found.join(first, ["d1", "d2"])
        .withColumn("rank", rank)
        .filter("rank <> first")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.sort_array(
                F.collect_set(
                    F.struct("idx", "start", "end", "words", "line", "line_end", "line_units", F.col("first.doc_id").alias("kept"))
                )
            ).alias("units")
        )
    )

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for some in batch.column(2).to_pylist():
                plain = [(u["idx"], u["start"], u["end"], u["words"], u["line"], u["line_end"], u["line_units"]) for u in some]
                lists.append([{"start": a, "end": b, "kept_doc_id": some[k]["kept"]} for a, b, k in removed(plain, run_words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept_doc_id", batch.column(0).type)])))],
                ["doc_id", "text_hash", "spans"],
            )

    spans = later.mapInArrow(
        join_up, f"doc_id {kind}, text_hash bigint, spans array<struct<start: int, end: int, kept_doc_id: {kind}>>"
    )
    return spans.filter("size(spans) > 0")


def without_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", **options
) -> DataFrame:
    """``docs`` with the repeated spans taken out of ``text``, and ``length`` (if it is a column) set to what is left.

    No row is dropped; a text that is all repeats becomes empty. Other columns stay as they are.
    """
    spans = repeated_spans(docs, doc_id=doc_id, text=text, **options)
    own = [free_name(docs, n) for n in ("span_id", "span_hash", "spans")]
    spans = spans.toDF(*own)
    joined = docs.join(spans, F.col(doc_id).eqNullSafe(F.col(own[0])) & (F.xxhash64(text) == F.col(own[1])), "left")
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(own[2])),
        lambda i: F.substring(
            text,
            F.when(i == 0, 1).otherwise(F.get(own[2], i - 1)["end"] + 1),
            F.when(i == F.size(own[2]), F.lit(2**31 - 1)).otherwise(
                F.get(own[2], i)["start"] - F.when(i == 0, 0).otherwise(F.get(own[2], i - 1)["end"])
            ),
        ),
    )
    cut = joined.withColumn(text, F.when(F.col(own[2]).isNull(), F.col(text)).otherwise(F.concat_ws("", gaps)))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        cut = cut.withColumn(length, F.when(F.col(own[2]).isNull(), F.col(length)).otherwise(F.char_length(text).cast(kind)))
    return cut.select(*docs.columns)


def span_rows(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, span_start, span_end, kept_doc_id)``, a row per removed span; an empty table gives no rows."""
    return repeated_spans(docs, **options).select("doc_id", F.explode("spans").alias("s")).select(
        "doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.kept_doc_id").alias("kept_doc_id")
    )
