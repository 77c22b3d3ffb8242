import random
from fractions import Fraction

import pytest

from wardline.llm import mixing


def plain_targets(sizes, cap=3):
    """Share by weight; stop at ``cap`` times the size and share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= cap * sizes[s]}
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: Fraction(cap * sizes[s]) for s in full}
        rest -= sum(target[s] for s in full)
        open_ -= full
    return {s: float(t) for s, t in target.items()}


def plain_sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_against_one_seat_at_a_time(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for g in range(12):
        votes = [rng.choice([0, rng.randint(1, 9), rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 30))]
        seats = rng.choice([0, 1, 7, 300])
        want += [(g, i, w) for i, w in enumerate(plain_sainte_lague(votes, seats))]
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, v bigint, seats bigint")
    got = mixing.sainte_lague(df, "v", "seats", ["g"], ["i"], "won")
    assert sorted((r.g, r.i, r.won) for r in got.collect()) == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS size", "2 AS bucket", "3 AS taken")


def check(rows, got, slack):
    words = lambda t: len((t or "").split())
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, words(t)) for d, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets = plain_targets(sizes)
    source = {d: s for d, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(targets[s], abs=slack)


@pytest.mark.parametrize("block,digits", [(8, 1), (32, 3)])
def test_mix_comes_near_the_targets(spark, block, digits):
    rng = random.Random(block)
    rows = [(i, "w " * rng.choice([0, 1, 30, 400]), rng.choice(["hot", "hot", "hot", "a", "b", "é", "Z", None])) for i in range(600)]
    rows += [(1000, "one", "tiny"), (1001, None, "nothing"), (1002, "x " * 30_000, "b"), (1003, "", None)]
    df = frame(spark, rows)
    got = mixing.mix(df, block_tokens=block, buckets_log16=digits).collect()
    check(rows, got, slack=4 * block)
    again = mixing.mix(df.repartition(5), block_tokens=block, buckets_log16=digits).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = mixing.mix(df, block_tokens=block, buckets_log16=digits, seed="other").collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))


def test_hard_rows(spark):
    rows = [(5, "a b c", "s"), (5, "a b c", "s"), (None, "x y", "t"), (7, None, None)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 4 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    assert {(r.size, r.target, r.taken) for r in mixing.mix(frame(spark, [(1, "", "s"), (2, None, None)])).collect()} == {(0, 0.0, 0)}
