"""Language identification as a mixture of languages per document.

Each language has a model of byte n-grams, counted over all labelled training texts. A word's likelihood in a language is
the product of its n-grams'. Expectation-maximisation over the words gives the proportions of the languages in a document;
languages are dropped one at a time, and the set with the best likelihood less a penalty per language wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import crc_share, prepare

GRAM = 3
#: Words a task remembers the likelihoods of; when full, it starts afresh.
CACHE = 300_000
UNKNOWN = "und"


def gram_codes(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of each word between blanks (as many as it has bytes), and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1])) + 2 * np.repeat(np.arange(len(words)), sizes)
    code = (data[at] << 16) | (data[at + 1] << 8) | data[at + 2]
    code = (code * np.uint32(2654435761)) >> np.uint32(7)
    return (code % np.uint32(buckets)).astype(np.int64), ends - sizes


#: Keeps letters a-z and all bytes outside ASCII; the rest becomes a blank.
LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """The lower-cased words of letters; none if the text has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    return text.lower().encode().translate(LETTERS).split()


@dataclass
class Model:
    langs: list[str]
    #: log P(n-gram | language), languages in rows. Its size is fixed by the number of buckets and of languages.
    table: np.ndarray

    def words(self, words: list[bytes], floor: float) -> np.ndarray:
        """Each word's log-likelihood in each language against its best one, no less than ``floor``."""
        codes, starts = gram_codes(words, self.table.shape[1])
        found = np.stack([np.add.reduceat(row[codes], starts) for row in self.table], axis=1)
        return np.maximum(found - found.max(axis=1, keepdims=True), floor).astype(np.float32)


def mixture(loglik: np.ndarray, size: np.ndarray, penalty: float, rounds: int = 20) -> np.ndarray:
    """Proportions of the languages in each document, for the set of languages with the best penalised likelihood.

    ``loglik`` has the words of all documents in a row (words x languages), ``size`` the words of each, none 0. Sets are
    nested: the language with the least proportion goes first. Each language beyond the first costs ``penalty`` times the
    logarithm of the document's words.
    """
    ends = np.cumsum(size)
    alone = np.add.reduceat(loglik, ends - size, axis=0, dtype=np.float64)
    props = np.zeros(alone.shape)
    props[np.arange(len(size)), alone.argmax(axis=1)] = 1
    price = penalty * np.log(size + 1)
    # If each word had its best language, the likelihood would be 0: what a second language could gain at most.
    more = np.flatnonzero(-alone.max(axis=1) > price)
    if not len(more) or alone.shape[1] == 1:
        return props
    part = np.exp(loglik[np.concatenate([np.arange(ends[i] - size[i], ends[i]) for i in more])])
    size, price = size[more], price[more]
    doc = np.repeat(np.arange(len(more)), size)
    starts = np.cumsum(size) - size
    best_value, best = alone[more].max(axis=1) - price, props[more]
    p = np.full(best.shape, 1 / best.shape[1])
    alive = np.ones(p.shape, bool)
    for k in range(p.shape[1], 1, -1):
        for _ in range(rounds):
            total = np.maximum(np.einsum("nl,nl->n", part, p[doc].astype(np.float32)), 1e-30)
            new = p * np.add.reduceat(part / total[:, None], starts, axis=0) / size[:, None]
            moved, p = np.abs(new - p).max(), new
            if moved < 1e-3:
                break
        total = np.einsum("nl,nl->n", part, p[doc].astype(np.float32))
        value = np.add.reduceat(np.log(np.maximum(total, 1e-30)), starts, dtype=np.float64) - k * price
        better = value > best_value
        best_value[better], best[better] = value[better], p[better]
        alive[np.arange(len(p)), np.where(alive, p, np.inf).argmin(axis=1)] = False
        p = np.where(alive, np.maximum(p, 1e-6), 0)
        p /= p.sum(axis=1, keepdims=True)
    props[more] = best
    return props


def fit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", buckets: int = 1 << 16, smoothing: float = 0.3
) -> Model:
    """Count the n-grams of all texts with a language, in the tasks, one array of ``buckets`` counts a language and task;
    the sums, of fixed size for each language, make up the model."""
    prepare(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, list[bytes]] = {}
            for lang_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang_, []).extend(letter_words(text_))
            for lang_, some in words.items():
                if some:
                    found = np.bincount(gram_codes(some, buckets)[0], minlength=buckets)
                    sums[lang_] = sums[lang_] + found if lang_ in sums else found
        for lang_, found in sums.items():
            ids = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(ids)), pa.array(ids), pa.array(found[ids])], ["lang", "id", "n"])

    sums = rows.mapInArrow(counted, "lang string, id bigint, n bigint").groupBy("lang", "id").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    names = np.array(found.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    table = np.full((len(langs), buckets), smoothing)
    for i, lang_ in enumerate(langs):
        mine = names == lang_
        table[i, found.column("id").to_numpy()[mine]] += found.column("n").to_numpy()[mine]
    return Model(langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table)


def proportions(
    docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", penalty: float = 3.0, floor: float = -4.0
) -> DataFrame:
    """``(doc_id, lang_pred, score, langs, shares)`` for every row of ``docs``, from whole texts.

    ``floor``: no language makes a word less likely than that, in logs against its best one, so that a single odd word (a
    name, a code) doesn't decide. ``langs`` is the set of languages found, by falling ``shares`` of the words; ``lang_pred`` is the first
    and ``score`` its share. A text that is null or has no letter, and any text if no language was learned, is ``und`` with
    score 0 and no languages. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        known: dict[bytes, int] = {}
        table = np.empty((0, len(m.langs)), np.float32)
        for batch in batches:
            texts = [letter_words(t) if m.langs else [] for t in batch.column(1).to_pylist()]
            if len(known) > CACHE:
                known, table = {}, table[:0]
            new = list({w for words in texts for w in words if w not in known})
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
                table = np.concatenate([table, m.words(new, floor)])
            best, score, langs, shares = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts], [[] for _ in texts]
            some = [i for i, words in enumerate(texts) if words]
            if some:
                flat = np.array([known[w] for i in some for w in texts[i]], np.int64)
                props = mixture(table[flat], np.array([len(texts[i]) for i in some]), penalty)
                for i, p in zip(some, props):
                    order = np.argsort(-p, kind="stable")[: int((p > 1e-3).sum())]
                    langs[i] = [m.langs[l] for l in order]
                    shares[i] = p[order].tolist()
                    best[i], score[i] = langs[i][0], min(1.0, shares[i][0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "langs", "shares"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        inferred, f"doc_id {kind}, lang_pred string, score double, langs array<string>, shares array<double>"
    )


def language_of_documents(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, langs, shares)`` for every row of ``docs``.

    Learns from text and language of the rows with a language whose crc32 of the id modulo 5 isn't 0; the others are held
    out. Rows that repeat are predicted each; a null id counts as an empty text for the crc. Other columns are not read.
    """
    model = fit(docs.filter(crc_share("doc_id", 5) != 0))
    found = proportions(docs, model, **options)
    return found.select("doc_id", (crc_share("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "langs", "shares")
