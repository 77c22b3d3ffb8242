import random
import zlib

import numpy as np
import pytest

from wardline.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([p == y for p, y in held]) > 0.93
    assert np.mean([p for p, y in held if y]) > 0.95


def test_word_features_do_not_depend_on_their_neighbours():
    words = [b"a", "größe".encode(), b"x" * 300, b"loop", b"a"]
    ids, starts = quality.features(words, 1 << 12, (3, 4))
    ends = np.append(starts[1:], len(ids))
    for w, a, b in zip(words, starts, ends):
        alone, _ = quality.features([w], 1 << 12, (3, 4))
        assert sorted(ids[a:b]) == sorted(alone)
        n = len(w) + 2
        assert len(alone) == 1 + max(0, n - 2) + max(0, n - 3)


def test_score_is_softmax_of_the_mean():
    model = quality.Model(np.random.default_rng(1).normal(size=1 << 10).astype(np.float32), 0.3, (3,))
    text = b"to be or not to be that is"
    words = text.split()
    parts = [quality.features([w], 1 << 10, (3,))[0] for w in words]
    for k, n in enumerate(quality.repeats(words)):
        parts += [quality.features([quality.REPEATS[k]], 1 << 10, (3,))[0]] * n
    want = 1 / (1 + np.exp(-(0.3 + model.weight[np.concatenate(parts)].mean())))
    assert model.scores([text], {})[0] == pytest.approx(want, rel=1e-6)


def test_repeats_against_plain():
    rng = random.Random(2)
    words = [rng.choice([b"a", b"b", b"c", b"d" * rng.randint(1, 40)]) for _ in range(400)]
    want = [0] * 7
    for i, w in enumerate(words):
        d = next((d for d in range(1, 64) if i >= d and words[i - d] == w), None)
        if d:
            want[d.bit_length()] += 1
    assert quality.repeats(words) == want


def test_hard_rows(spark):
    docs = spark.createDataFrame(
        [(None, "good text"), (1, None), (2, ""), (2, ""), (3, "word " * 60_000), (4, "good text here"), (5, "bad $$$ bad"), (7, " \n")],
        "doc_id bigint, text string",
    ).selectExpr("*", "1 AS score", "'x' AS SOURCE", "2 AS bytes", "3 AS c0")
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (4, None), (99, 0), (5, 7)], "doc_id bigint, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 7)}) == 1
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    whole = quality.score(docs, quality.Model(np.zeros(64, np.float32), 0.0, (3,)), out="probability")
    assert whole.columns == [*docs.columns, "probability"]
    assert sorted(map(repr, whole.drop("probability").collect())) == sorted(map(repr, docs.collect()))
