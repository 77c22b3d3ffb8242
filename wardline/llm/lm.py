"""Scoring whole documents with a gated recurrent language model.

Counts of all training words are gathered in one grouping that grows with the corpus. The most frequent words are the
model's own; each other word w has the probability P(rare word) * (c(w) + 1) / (sum of the rare ones' c + 1), the model's
share for rare words spread by their counts. The weights are learned by truncated backpropagation in a fixed number of
tasks on all training documents, dealt to the rounds, and averaged after each round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wardline.llm.common import crc_share, prepare, written
from wardline.llm.recurrent import NAMES, Net, Trainer, score

#: Stands for the end of a text among the words; white space can't be part of a word.
END = b"\n"
#: Words a task counts, or holds as ids, before it passes them on.
HELD = 1_000_000
LOG10 = float(np.log(10))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space


def count_words(texts: DataFrame) -> DataFrame:
    """``(token, c)`` of all words and ends of ``texts`` (one binary column); counted in the tasks before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.binary()), pa.array(sums.values(), pa.int64())], ["token", "c"])
            sums.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                sums.update(words(text.as_py()))
                sums[END] += 1
            if len(sums) > HELD:
                yield out()
        yield out()

    return texts.mapInArrow(counted, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Words of the ``frequent`` highest counts at most, falling; the first ``own`` of them are the model's."""

    tokens: list[bytes]
    counts: np.ndarray
    own: int
    n: int  # all training tokens
    v: int  # distinct ones

    def __post_init__(self) -> None:
        self.place = {t: i for i, t in enumerate(self.tokens)}
        self.rare_n = self.n - int(self.counts[: self.own].sum())
        self.rare_v = self.v - self.own
        # Ids are ranks by count, the rare words together being one word, and the end always one.
        ranked = [(int(c), t) for c, t in zip(self.counts[: self.own], self.tokens)] + [(self.rare_n, b" rare")]
        if END not in self.tokens[: self.own]:
            ranked.append((0, END))
        ranked.sort(key=lambda x: (-x[0], x[1]))
        ids = {t: i for i, (_, t) in enumerate(ranked)}
        self.model_counts = np.array([c for c, _ in ranked], np.float64)
        self.rare, self.end = ids[b" rare"], ids[END]
        self.id_of = np.array([ids.get(t, self.rare) for t in self.tokens], np.int32)
        self.id_of[self.own :] = self.rare
        self.id_of = np.append(self.id_of, np.int32(self.rare))  # the last for words outside

    def ids(self, split: list[bytes]) -> np.ndarray:
        get, none = self.place.get, len(self.tokens)
        at = np.array([get(w, none) for w in split], np.int64)
        return np.append(self.id_of[at], np.int32(self.end))


def vocabulary(counts: DataFrame, frequent: int, own: int) -> Vocabulary:
    """The bounded part of ``counts`` that goes to all tasks: the words above the lowest count of which there are no more
    than ``frequent``. The threshold comes from how many words have which count."""
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    least, n, v = (
        sizes.withColumn("above", F.sum("k").over(W.orderBy(F.col("c").desc()).rowsBetween(W.unboundedPreceding, 0)))
        .agg(F.min(F.when(F.col("above") <= frequent, F.col("c"))), F.sum(F.col("c") * F.col("k")), F.sum("k"))
        .first()
    )
    top = [] if least is None else [(r.c, bytes(r.token)) for r in counts.filter(F.col("c") >= least).collect()]
    top.sort(key=lambda x: (-x[0], x[1]))
    return Vocabulary([t for _, t in top], np.array([c for c, _ in top], np.int64), min(own, len(top)), n or 0, v or 0)


def train(
    texts: DataFrame, known: Vocabulary, *, chosen: Column, classes: int, hidden: int, rounds: int, trainers: int, rate: float, seed: int
) -> Net:
    """Weights after ``rounds`` of ``trainers`` tasks at most. ``chosen`` is the round of a document, null if it takes no
    part. The trainers, and so what comes to the driver after a round, don't grow with the corpus; each reads its documents
    as a stream."""
    spark = texts.sparkSession
    net = Net.new(known.model_counts, classes, hidden, seed)
    sent = spark.sparkContext.broadcast(known)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [sent.value.ids(words(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["round", "ids"])

    rows = texts.select(chosen.cast("int").alias("round"), "text").filter("round IS NOT NULL")
    sample = written(rows.mapInArrow(numbered, "round int, ids array<int>"), "lm-sample")
    for r in range(rounds):
        weights = spark.sparkContext.broadcast(net.pack())

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, held, size, seen = Trainer(Net.unpack(weights.value), rate), [], 0, 0
            for batch in batches:
                for ids in batch.column(0):
                    held.append(np.asarray(ids.values, np.int32))
                    size += len(held[-1])
                if size >= 2 * HELD:
                    trainer.learn(held, sent.value.end)
                    held, size, seen = [], 0, seen + size
            if held:
                trainer.learn(held, sent.value.end)
                seen += size
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([trainer.net.pack()], pa.binary())], ["seen", "net"])

        found = sample.filter(F.col("round") == r).select("ids").coalesce(trainers).mapInArrow(learn, "seen bigint, net binary").collect()
        if found:
            nets, seen = [Net.unpack(bytes(x.net)) for x in found], np.array([x.seen for x in found], np.float64)
            for name in NAMES:
                mean = sum(getattr(n, name) * w for n, w in zip(nets, seen / seen.sum()))
                setattr(net, name, mean.astype(np.float32))
    return net


def document_scores(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    frequent: int = 150_000,
    own: int = 4000,
    classes: int = 48,
    hidden: int = 24,
    share: int = 1,
    rounds: int = 2,
    trainers: int = 6,
    rate: float = 0.15,
    seed: int = 11,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per row of ``docs``.

    Held out are the ids whose crc32 modulo 7 is 2 (a null id counts as an empty text there). Words are lower-cased in A-Z; the
    end of a text is its last token, so that null and empty texts have one. ``base_score`` is the add-one unigram score over
    all training tokens and ``score`` the recurrent model's, both log10 of whole texts. All training texts are counted, and
    each trains the weights in one round, dealt by a hash of the id (with ``share`` above 1, one in ``share`` does). Without training
    texts the base is that of the formula with N = V = 0. Rows that repeat are scored each. Only the two named columns are read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    held_out = crc_share("doc_id", 7) == 2
    learned = rows.filter(~held_out)
    counts = written(count_words(learned.select("text")), "lm-counts")
    known = vocabulary(counts, frequent, own)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(share * rounds))
    net = train(
        learned, known, chosen=F.when(part < rounds, part), classes=classes, hidden=hidden, rounds=rounds, trainers=trainers, rate=rate, seed=seed
    )
    sent = spark.sparkContext.broadcast((known, net.pack()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = sent.value[0]
        model = Net.unpack(sent.value[1])
        number = TaskContext.get().partitionId() << 33
        base_log = np.append(np.log10(vocab.counts + 1.0), 0.0)
        rare_log = np.where(np.arange(len(base_log)) >= vocab.own, base_log, 0.0)
        get, none = vocab.place.get, len(vocab.tokens)
        end = vocab.place.get(END, none)

        def out(held: list) -> pa.RecordBatch:
            nonlocal number
            model_score = score(model, [h[1] for h in held], vocab.end) / LOG10
            ids, _, tokens, known_, base, rare, n_rare, odd = zip(*held)
            arrays = [
                pa.array(np.arange(number, number + len(held))), pa.array(ids, kind), pa.array(tokens, pa.int64()), pa.array(known_, pa.int64()),
                pa.array(base), pa.array(np.array(rare) + model_score), pa.array(n_rare, pa.int64()),
                pa.MapArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(o) for o in odd])]), pa.int32()),
                    pa.array([w for o in odd for w in o], pa.binary()), pa.array([n for o in odd for n in o.values()], pa.int32()),
                ),
            ]
            number += len(held)
            return pa.RecordBatch.from_arrays(arrays, NAMES_OUT)

        held, size, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                split = words(t.as_py())
                at = np.array([get(w, none) for w in split] + [end], np.int64)
                odd = Counter([split[j] for j in np.flatnonzero(at[:-1] == none).tolist()])
                if end == none and vocab.n:  # the end itself may be outside the frequent words
                    odd[END] += 1
                ids = vocab.id_of[at]
                ids[-1] = vocab.end
                frequent_ = at < none
                n_rare = int((ids == vocab.rare).sum())
                held.append((i, ids.astype(np.int32), len(at), int(frequent_.sum()), float(base_log[at].sum()), float(rare_log[at[:-1]].sum()), n_rare, odd))
                size += len(at)
            if size >= 4 * HELD:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    schema = f"row bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_known bigint, base double, score double, n_rare bigint, odd map<binary,int>"
    parts = written(rows.mapInArrow(scored, schema), "lm-parts")
    # Words outside the bounded list meet their counts in a join.
    met = (
        parts.select("row", F.explode("odd").alias("token", "times"))
        .join(counts, "token")
        .groupBy("row")
        .agg(
            F.sum("times").alias("more_known"),
            F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("more"),
            F.sum(F.when(F.col("token") != F.lit(END), F.col("times") * F.log10(F.col("c") + F.lit(1.0)))).alias("more_rare"),
        )
    )
    per_token = float(np.log10(known.n + known.v + 1))
    per_rare = float(np.log10(known.rare_n + known.rare_v + 1))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("odd").join(met, "row", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + more("more_known")).alias("n_known"),
        F.lit(known.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + more("more") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("score") + more("more_rare") - F.col("n_rare") * F.lit(per_rare)).alias("score"),
    )


NAMES_OUT = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "n_rare", "odd"]
