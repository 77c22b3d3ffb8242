import random
import time

import pytest

from wardline.llm import hamming


def plain(rows, queries, k):
    sign = lambda v: [x is not None and not x < 0 for x in v]
    whole = {(i, tuple(sign(v))) for i, v in rows if i is not None and v}
    out = []
    for q in {i for i, v in queries if i is not None and v}:
        best = {}
        for i, c in whole:
            for j, d in whole:
                if j == q and i != q and len(c) == len(d):
                    n = sum(x != y for x, y in zip(c, d))
                    best[i] = min(n, best.get(i, n))
        out += [(q, r + 1, i, n) for r, (n, i) in enumerate(sorted((n, i) for i, n in best.items())[:k])]
    return sorted(out)


@pytest.mark.parametrize("bits,segment_bits,k", [(24, 8, 5), (20, 8, 3), (8, 16, 50)])
def test_against_all_rows(spark, bits, segment_bits, k, monkeypatch):
    monkeypatch.setattr(hamming, "FEW", 6)
    rng = random.Random(bits)
    centre = [[rng.gauss(0, 1) for _ in range(bits)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(centre)]) for i in range(90)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # a very common code
    rows += [(None, rows[1][1]), (300, None), (301, []), (302, [None] * bits), (303, [1.0] * (bits + 1)), (304, [float("nan")] * bits)]
    rows += [rows[5], (5, rows[9][1])]  # a repeated row, an id with two vectors
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<float>, distance int, rank int")
    asked = [(i, v) for i, v in rows if i is None or i % 25 == 0 or i == 303]
    found = hamming.top_k(df, df.filter("vec_id % 25 = 0 OR vec_id = 303 OR vec_id IS NULL"), k=k, segment_bits=segment_bits)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, asked, k)


def test_few_rows_are_compared_at_once(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(5)] + [(7, [1.0, -1.0]), (3, [rng.gauss(0, 1) for _ in range(64)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    begin = time.time()
    assert sorted(tuple(r) for r in hamming.top_k(df, df).collect()) == plain(rows, rows, 10)
    assert time.time() - begin < 30


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert hamming.top_k(df, df).count() == 0
