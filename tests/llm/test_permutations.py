import math
import random

import numpy as np
import pytest

from wardline.llm import permutations
from wardline.llm.queries import QUERIES


def plain(rows, queries, k=10):
    """{query: [(distance, id), ...]} by comparing all."""
    out = {}
    for q, v in queries:
        near = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                d = math.sqrt(sum((a - b) * (a - b) for a, b in zip(v, x)))
                near[i] = min(d, near.get(i, d))
        out.setdefault(q, {})
        for i, d in near.items():
            out[q][i] = min(d, out[q].get(i, d))
    return {q: sorted((d, i) for i, d in found.items())[:k] for q, found in out.items() if found}


def gathered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_given_tables(spark, folder):
    data = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in data], float), np.array([r.vec_id for r in data])
    got = gathered(QUERIES["op13_permutation_search"](spark, f"/root/testdata/{folder}"))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 100 == 0)
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        hits += len({i for _, i in found} & set(ids[np.lexsort((ids, far))[:10]].tolist()))
        assert len(found) == 10 and found == sorted(found)
        assert np.allclose([d for d, _ in found], [far[ids == i][0] for _, i in found], rtol=1e-12)
    assert hits / (10 * len(got)) >= 0.95


def test_recall_over_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    rows = list(enumerate(x.tolist()))
    expected = plain(rows, rows[::100])
    found = gathered(permutations.top_k(table, table.filter("vec_id % 100 = 0"), pivots=64, prefix=32, candidates=60, shard_rows=300, block_rows=7))
    recall = sum(len({i for _, i in found[q]} & {i for _, i in best}) for q, best in expected.items()) / 300
    assert 0.9 <= recall


def test_footrule_by_inverted_files():
    rng = random.Random(1)
    near = np.array([rng.sample(range(20), 6) for _ in range(50)], np.int16)
    files = permutations.InvertedFiles(near)
    for _ in range(20):
        order = rng.sample(range(25), 6)
        place = lambda o, p: o.index(p) if p in o else 6
        footrule = [sum(abs(place(order, p) - place(list(x), p)) for p in range(25)) for x in near.tolist()]
        expected = sorted(range(50), key=lambda i: (footrule[i], i))[:8]
        assert sorted(files.nearest(np.array(order), 8).tolist()) == sorted(expected)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(100 + i, [5.0, 5.0]) for i in range(30)]
    rows += [(100, [5.0, 5.0]), (101, [-1.0, 0.0]), (300, [1.0, 2.0, 3.0]), (400, [3.0, 2.0, 1.0]), (500, [1e200, -1e200]), (600, [-0.0, 1.0])]
    odd = [(200, None), (201, []), (202, [0.0, 0.0]), (203, [None, 1.0]), (205, [nan, 1.0]), (206, [inf, 1.0]), (None, [1.0, 1.0]), (700, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows + odd], "vec_id bigint, embedding array<double>, score double, near string")
    for options in ({}, {"pivots": 3, "prefix": 2, "shard_rows": 4, "block_rows": 2}):
        got = gathered(permutations.top_k(table, table.filter("vec_id % 100 = 0 OR vec_id IS NULL"), **options))
        assert got == plain(rows, [(i, v) for i, v in rows if i % 100 == 0])
    assert got[300] == [(math.sqrt(8), 400)] and len(got[500]) == 10
    assert permutations.top_k(table.limit(0), table).collect() == [] == permutations.top_k(table, table.limit(0)).collect()
