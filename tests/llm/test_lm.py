import math
import zlib
from collections import Counter

import numpy as np
import pytest

from wardline.llm import lm
from wardline.llm.recurrent import NAMES, Net, score, windows

SMALL = dict(own=30, classes=4, hidden=6, share=1, rounds=2)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["\n"]


def plain_base(rows):
    c = Counter(w for d, t in rows if not held(d) for w in plain_words(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(plain_words(t)), sum(c[w] > 0 for w in plain_words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in plain_words(t))) for d, t in rows]


def check(got, rows):
    got, want = sorted(map(tuple, got), key=repr), sorted(plain_base(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)


@pytest.mark.parametrize("frequent", [40, 60_000])
def test_base_scores_on_given_tables_and_a_better_model(spark, frequent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 300")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.document_scores(docs, frequent=frequent, own=min(frequent, 1000), share=1).collect()
    check(got, rows)
    out = [r for r in got if r.held_out]
    if frequent > 40:
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_hard_rows(spark):
    rows = [(None, "a B c"), (1, None), (2, ""), (2, ""), (3, "é É a\x0bB"), (4, "long text " * 30_000), (5, "a"), (6, "unseen words"), (7, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS token", "3 AS row")
    check(lm.document_scores(docs, frequent=3, **(SMALL | {"own": 2})).collect(), rows)
    assert lm.document_scores(docs.limit(0), **SMALL).count() == 0
    alone = [(d, t) for d, t in [(i, "only held out") for i in range(100)] if held(d)]
    check_rows = lm.document_scores(spark.createDataFrame(alone, "doc_id bigint, text string"), **SMALL).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in check_rows} == {(0, 0, 0.0)}


def tiny(seed=0, size=11, hidden=5):
    net = Net.new(np.sort(np.random.default_rng(seed).integers(1, 50, size))[::-1].astype(float), 3, hidden, seed)
    for n in NAMES:  # so that no gradient is small by chance
        setattr(net, n, np.random.default_rng(seed + 1).normal(0, 0.5, getattr(net, n).shape))
    return net


def plain_score(net, ids, start):
    """One word at a time, over the whole vocabulary."""
    size, h, total, before = net.wh.shape[0], np.zeros(net.wh.shape[0]), 0.0, start
    sig = lambda a: 1 / (1 + np.exp(-a))
    for y in ids:
        g, o = net.wx[before], h @ net.wh
        z, r = sig(g[:size] + o[:size]), sig(g[size : 2 * size] + o[size : 2 * size])
        h = (1 - z) * np.tanh(g[2 * size :] + r * o[2 * size :]) + z * h
        probs = []
        pc = np.exp(net.wc @ h + net.bc)
        for c, p in enumerate(pc / pc.sum()):
            part = slice(net.bounds[c], net.bounds[c + 1])
            q = np.exp(net.wo[part] @ h + net.bo[part])
            probs += list(p * q / q.sum())
        assert sum(probs) == pytest.approx(1)
        total += math.log(probs[y])
        before = y
    return total


def test_lanes_and_windows_change_nothing():
    net, rng = tiny(), np.random.default_rng(5)
    docs = [rng.integers(0, 11, n).astype(np.int32) for n in (1, 90, 3, 17, 1, 40, 41)]
    want = [plain_score(net, d, 4) for d in docs]
    for most, steps in ((1, 7), (3, 16), (256, 1000)):
        assert score(net, docs, 4, most, steps) == pytest.approx(want, rel=1e-4)


def test_gradients_against_differences():
    net, rng = tiny(3), np.random.default_rng(6)
    docs = [rng.integers(0, 11, n).astype(np.int32) for n in (9, 5, 12)]
    ((x, y, fresh, owner),) = windows(docs, 2, 100, 0)
    real = owner >= 0

    def loss():
        states, _, _ = net.run(x, fresh, np.zeros((x.shape[1], 5)))
        return -net.emit(states[real].astype(float), y[real])[0].sum()

    states, _, tape = net.run(x, fresh, np.zeros((x.shape[1], 5)), keep=True)
    _, (dwc, dbc, words, dh) = net.emit(states[real].astype(float), y[real], learn=True)
    dstates = np.zeros(states.shape)
    dstates[real] = dh
    dwh, dgates = net.back(x, fresh, tape, dstates)
    dwx, dwo, dbo = np.zeros_like(net.wx), np.zeros_like(net.wo), np.zeros_like(net.bo)
    np.add.at(dwx, x.ravel(), dgates.reshape(-1, 15))
    for part, a, b in words:
        dwo[part], dbo[part] = a, b
    for name, grad in zip(NAMES, (dwx, dwh, dwc, dbc, dwo, dbo)):
        value = getattr(net, name)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old, e = value[at], 1e-2
            value[at] = old + e
            up = loss()
            value[at] = old - e
            down = loss()
            value[at] = old
            assert (up - down) / (2 * e) == pytest.approx(grad[at], rel=0.05, abs=5e-3)


def test_every_training_text_trains(spark, monkeypatch):
    kept = {}

    def seen(df, purpose, real=lm.written):
        kept[purpose] = real(df, purpose)
        return kept[purpose]

    monkeypatch.setattr(lm, "written", seen)
    rows = [(i, f"text {i} of many") for i in range(200)] + [(None, "no id")] * 3
    lm.document_scores(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert kept["lm-sample"].count() == sum(not held(d) for d, _ in rows)
    assert {r["round"] for r in kept["lm-sample"].select("round").distinct().collect()} == {0, 1}
