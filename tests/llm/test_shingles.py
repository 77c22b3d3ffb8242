import random

import numpy as np

from wardline.llm import shingles, simhash

SF = "/root/testdata/sf0.01/documents.parquet"


def plain_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_pairs(rows, least=0.8):
    """All pairs of places that are similar enough, by comparing all whose sets meet."""
    sets = [plain_set(t) for _, t in rows]
    meet, holders = set(), {}
    for i, s in enumerate(sets):
        for x in s:
            meet |= {(j, i) for j in holders.setdefault(x, [])}
            holders[x].append(i)
    return {(i, j) for i, j in meet if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def plain_kept(rows, pairs):
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[max(top(i), top(j))] = min(top(i), top(j))
    return sorted(min(rows[j][0] for j in range(len(rows)) if top(j) == r) for r in {top(i) for i in range(len(rows))})


def test_recall_on_given_tables(spark):
    docs = spark.read.parquet(SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = plain_pairs(rows)
    root = {r.doc_id: r.root for r in shingles.grouped(docs).collect()}
    assert len(pairs) > 50
    assert all(root[rows[i][0]] == root[rows[j][0]] for i, j in pairs)  # recall 1
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == plain_kept(rows, pairs)


def test_copies_with_replaced_words(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for d in range(60):
        words = [word() for _ in range(rng.randint(60, 400))]
        rows.append((10 * d, " ".join(words)))
        for k in range(1, 5):  # similarities from about 0.95 to 0.7
            copy = words[:]
            for _ in range(max(1, len(words) * k // 120)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((10 * d + k, " ".join(copy)))
    pairs = plain_pairs(rows)
    assert 100 < len(pairs) < 600
    for block_rows in (2, 256):
        got = shingles.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), block_rows=block_rows)
        assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows, pairs)


def test_hard_rows(spark):
    long = "word " * 50_000
    data = [(3, "a b c d e", 1), (3, "a b c d e", 1), (None, "A  b\tc d e", 1), (1, None, 2), (2, "", 2), (9, " \n ", 2), (None, "x", 3), (5, long, 4), (4, long + "\n", 4)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, node int")
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]
    assert shingles.keep_one(docs.limit(0)).count() == 0


def test_near_copies_come_from_bk_trees(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:i] + ["other"] + words[i + 1 :])) for i in range(1, 40)]  # several share their bits
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    measured = {shingles.wide_fingerprint(shingles.shingle_set(t.encode(), 5)).tobytes() for _, t in rows}
    kept = [r.doc_id for r in shingles.keep_one(docs, shard_rows=5, block_rows=7).collect()]
    assert kept == [1] and plain_kept(rows, plain_pairs(rows)) == [1]
    assert shingles.keep_one(docs, radius=0).count() >= len(measured) > 1  # what no tree finds is not linked


def test_trees_of_wide_fingerprints():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, (400, 2), np.uint64)
    fps[1::2] = fps[::2] ^ (rng.integers(0, 1 << 64, (200, 2), np.uint64) & rng.integers(0, 1 << 64, (200, 2), np.uint64) & rng.integers(0, 1 << 64, (200, 2), np.uint64))
    shard = np.sort(rng.integers(0, 5, 400))
    who, place = simhash.Forest(shard, fps).within(shard, fps, 20)
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=int)
    expected = np.argwhere((apart <= 20) & (shard[:, None] == shard[None]))
    assert sorted(zip(who.tolist(), place.tolist())) == sorted(map(tuple, expected.tolist())) and len(expected) > 420


def test_copies_at_the_limit_share_a_table():
    rng = np.random.default_rng(4)
    for size in (30, 300):
        pairs = []
        for _ in range(400):
            s = np.unique(rng.integers(0, 1 << 64, size * 10 // 9, np.uint64))
            s = rng.permutation(s)
            part = len(s) // 10
            pairs.append((shingles.wide_fingerprint(s[part:]), shingles.wide_fingerprint(s[: len(s) - part])))  # similarity 0.8
        a, b = (np.array(x) for x in zip(*pairs))
        apart = np.bitwise_count(a ^ b).sum(axis=1)
        tables = shingles.Tables(200_000, 0.2008, 1e-3)
        met = (tables.of(a) == tables.of(b)).any(axis=1)
        assert (apart <= 64).mean() > 0.995 and met.mean() > 0.995


def test_kept_rows_move_once(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (None, "a b", 2), (None, "c", 3), (None, "c", 4)], "doc_id bigint, text string, _key int")
    rows = spark.createDataFrame([(None, "c", 7), (1, "a b", 8)], "doc_id bigint, text string, root bigint")
    rows = rows.selectExpr("doc_id", "xxhash64(text) AS text_hash", "root")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_best(docs, rows, doc_id="doc_id", text="text")
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3  # by root, and either side of the join; the distinct rows stay
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "c"), (1, "a b")]
