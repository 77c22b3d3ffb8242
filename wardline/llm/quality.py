"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors: one for each word and each character n-gram of its words, all hashed into
one table. A softmax over the average gives the label. Both are trained by stochastic gradient descent in numpy, in one
task, on a bounded sample of the labelled rows. Scoring reads every text whole, inside the tasks that scan it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import crc_share, prepare

#: Words a task remembers the features of; when full, it starts afresh.
CACHE = 400_000


def features(words: list[bytes], buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of ``words`` (``<word>`` itself and its character n-grams), and where each word's begin."""
    marked = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes to the end of the word
    # The word's hash: a polynomial of its bytes, wrapping at 64 bits.
    factor = np.uint64(0x100000001B3)
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), factor, np.uint64))
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    codes, owners = [np.add.reduceat((data + np.uint64(1)) * powers[place], starts)], [np.arange(len(words))]
    for n in grams:
        h = np.full(len(data) - n + 1 if len(data) >= n else 0, np.uint64(n), np.uint64)
        for i in range(n):
            h = h * factor + data[i : len(h) + i] + np.uint64(1)
        inside = left[: len(h)] >= n
        codes.append(h[inside])
        owners.append(owner[: len(h)][inside])
    code, of = np.concatenate(codes), np.concatenate(owners)
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(of, kind="stable")
    return ((code >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[order], np.searchsorted(of[order], np.arange(len(words)))


#: Stand-ins for "this word was here 1, 2-3, 4-7, ... words before", embedded like words: an average of words alone can't
#: tell a loop from prose. White space can't be part of a word, so no text holds them.
REPEATS = [b" %d" % k for k in range(7)]


def repeats(words: list[bytes]) -> list[int]:
    """How often a word comes again, by the bit length of the distance; distances from 64 words up don't count."""
    last: dict[bytes, int] = {}
    counts = [0] * 7
    for i, w in enumerate(words):
        d = i - last.get(w, -64)
        if d < 64:
            counts[d.bit_length()] += 1
        last[w] = i
    return counts


@dataclass
class Model:
    """What scoring needs: each bucket's share in the logit of label 1, and the bias. Its size is fixed by ``buckets``."""

    weight: np.ndarray
    bias: float
    grams: tuple[int, ...]

    def sums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The summed shares and the number of features of each word."""
        ids, starts = features(words, len(self.weight), self.grams)
        return np.add.reduceat(self.weight[ids], starts), np.diff(np.append(starts, len(ids)))

    def scores(self, texts: list[bytes | None], known: dict[bytes, tuple[float, int]]) -> np.ndarray:
        split = [(t or b"").split() for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if len(known) + len(new) > CACHE and known:
            known.clear()
            new = list({w for words in split for w in words})
        if new:
            share, count = self.sums(new)
            known.update(zip(new, zip(share.tolist(), count.tolist())))
        logit = np.full(len(texts), self.bias)
        again = list(zip(*(x.tolist() for x in self.sums(REPEATS))))
        for i, words in enumerate(split):
            if words:
                share, count = zip(*map(known.__getitem__, words))
                share, count = sum(share), sum(count)
                for n, (more, features_) in zip(repeats(words), again):
                    share += n * more
                    count += n * features_
                logit[i] += share / count
        return 1 / (1 + np.exp(-logit))


def train(
    texts: list[bytes], labels: np.ndarray, *, buckets: int, grams: tuple[int, ...], dim: int, epochs: int, rate: float, seed: int
) -> Model:
    """Embeddings and softmax by plain SGD, one document a step, in a seeded order, with a falling rate."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    bags = []
    for text in texts:
        words = text.split()
        if words:
            unique, counts = np.unique(np.array(words, object), return_counts=True)
            ids, starts = features(unique.tolist() + REPEATS, buckets, grams)
            counts = np.concatenate([counts, repeats(words)])
            weight = np.repeat(counts, np.diff(np.append(starts, len(ids))))
            ids, index = np.unique(ids, return_inverse=True)
            weight = np.bincount(index, weight)
            bags.append((ids, (weight / weight.sum()).astype(np.float32)))
        else:
            bags.append((np.empty(0, np.int64), np.empty(0, np.float32)))
    share = np.bincount(labels, minlength=2)
    balance = len(labels) / np.maximum(2 * share, 1)  # so that both labels weigh alike
    steps, done = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            lr = rate * (1 - done / steps)
            done += 1
            ids, weight = bags[i]
            mean = weight @ table[ids] if len(ids) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= balance[labels[i]]
            back = p @ out
            out -= lr * np.outer(p, mean)
            bias -= lr * 0.1 * p
            if len(ids):
                # Each feature takes the gradient by its share among the document's, scaled so that rare ones learn too.
                table[ids] -= lr * np.outer(weight * len(ids), back)
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]), grams)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_label: int = 1500,
    buckets: int = 1 << 18,
    grams: tuple[int, ...] = (3, 4),
    dim: int = 8,
    epochs: int = 4,
    rate: float = 0.15,
    seed: int = 7,
) -> Model:
    """Learn from at most ``per_label`` labelled rows of each label, those with the smallest hash of the id.

    The bound keeps the one training task, and the model of ``buckets`` numbers sent to all tasks, at a fixed size.
    Labels other than 0 and 1, and labels of documents that aren't there, count for nothing; an id labelled twice counts
    twice. Without labelled rows the model gives every text the score 0.5.
    """
    prepare(docs.sparkSession)
    asked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    present = docs.select(F.col(doc_id).alias("_i")).distinct()
    asked = asked.join(present, F.col("id") == F.col("_i"), "left_semi")
    some = [
        asked.filter(F.col("label") == which).orderBy(F.xxhash64("id"), "id").limit(per_label) for which in (0, 1)
    ]
    sample = some[0].union(some[1])
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")).join(sample, "id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(i, t or b"", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns))]
        held.sort()
        model = train(
            [t for _, t, _ in held], np.array([y for *_, y in held], np.int64), buckets=buckets, grams=grams, dim=dim, epochs=epochs, rate=rate, seed=seed
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"]
        )

    found = rows.select(F.col("id").cast("string"), "text", "label").repartition(1).mapInArrow(learn, "weight binary, bias double").collect()
    if not found:
        return Model(np.zeros(buckets, np.float32), 0.0, grams)
    return Model(np.frombuffer(found[0].weight, "<f4"), found[0].bias, grams)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1. Null and empty texts get that of no features at all."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spot = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("bytes", F.col(names[spot]).cast("binary"))
    kept = [n for i, n in enumerate(names) if i != spot]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, int]] = {}
        for batch in batches:
            found = shared.value.scores(batch.column(batch.schema.get_field_index("bytes")).to_pylist(), known)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in kept), batch.column(batch.schema.get_field_index("bytes")), pa.array(found)],
                [*kept, "bytes", "score"],
            )

    schema = ", ".join(f"{n} {plain.schema[n].dataType.simpleString()}" for n in kept)
    done = plain.mapInArrow(scored, f"{schema + ', ' if schema else ''}bytes binary, score double")
    columns = [F.col("bytes").cast("string").alias(c) if i == spot else F.col(names[i]).alias(c) for i, c in enumerate(docs.columns)]
    return done.select(*columns, F.col("score").alias(out))


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Learns from the labelled rows whose crc32 of the id modulo 4 isn't 2; the others are held out. ``predicted`` is 1 from
    ``threshold`` up. Rows that repeat are scored each, null ids count as an empty text for the crc. An empty table gives
    no rows. Only ``doc_id`` and ``text`` are read of the documents, ``doc_id`` and ``quality`` of the labels.
    """
    model = fit(docs, labels.filter(crc_share("doc_id", 4) != 2), **options)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (crc_share("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
