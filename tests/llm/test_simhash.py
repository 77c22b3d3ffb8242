import random

import numpy as np
import pytest
import xxhash

from wardline.llm import simhash
from wardline.llm.components import components

SF = "/root/testdata/sf0.001/documents.parquet"


def plain_fingerprint(text):
    words, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") + " ":
        if c in " \t\n\v\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    """Smallest id reachable, comparing all pairs."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, f"{fp:016x}", least.get(top(i))) for i, (d, fp) in enumerate(rows)), key=repr)


def found(df):
    return sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)


def test_against_all_pairs(spark):
    docs = spark.read.parquet(SF)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert found(docs) == plain_components(rows)


def test_hard_rows(spark):
    long = "word " * 50_000
    data = [(3, "a b c d e", 1), (3, "a b c d e", 1), (None, "A  b\tc d e", 1), (1, None, 2), (2, "", 2), (9, " \n ", 2), (None, "x", 3), (5, long, 4), (4, long + "\n", 4)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, fp int")
    rows = [(d, plain_fingerprint(t)) for d, t, _ in data]
    assert found(docs) == plain_components(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]
    assert found(docs.limit(0)) == [] and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [4, 1000])
def test_links_of_clustered_fingerprints(spark, shard_rows):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.links(df, shard_rows=shard_rows)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    groups = {}
    for s, (_, _, c) in zip(range(len(fps)), sorted(plain_components(list(enumerate(fps))), key=lambda r: r[0])):
        groups.setdefault(c, set()).add(signed[s])
    mine = {}
    for s in signed:
        mine.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_long_chains_connect(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {501: 500}
