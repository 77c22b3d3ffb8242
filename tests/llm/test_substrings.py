import random
import re

import pytest
import xxhash

from wardline.llm import substrings

SF = "/root/testdata/sf0.001/documents.parquet"


def plain_units(text, min_words):
    """Lines, sentences and offsets, character by character."""
    out, at = [], 0
    for line in text.split("\n"):
        here, begin = [], None
        for i, c in enumerate(line):
            if begin is None and not c.isspace():
                begin = i
            stop = i + 1 == len(line) or (c in ".!?" and line[i + 1].isspace())
            if begin is not None and stop and i >= begin and not (i == begin and c in ".!?" and i + 1 < len(line)):
                here.append((begin, i + 1))
                begin = None
        for a, b in here:
            parts = [(a, b, line[a:b].lower().split())]
            if len(parts[0][2]) > 24:  # long ones are cut behind words whose hash says so
                parts, held = [], []
                for w in re.finditer(r"\S+", line[a:b]):
                    held.append((a + w.start(), a + w.end(), w[0].lower()))
                    if xxhash.xxh32_intdigest(held[-1][2]) % 8 == 0 or w.end() == len(line[a:b].rstrip()):
                        parts.append((held[0][0], held[-1][1], [x for *_, x in held]))
                        held = []
            for start, end, words in parts:
                if len(words) >= min_words:
                    out.append([" ".join(words), at + start, at + end, len(words), at, min(at + len(line) + 1, len(text))])
        at += len(line) + 1
    return out


def plain_spans(rows, min_words=4, run_words=20):
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, spans = {}, []
    for d, text in docs:
        us = plain_units(text or "", min_words)
        rep = [u[0] in seen or u[0] in (o[0] for o in us[:k]) for k, u in enumerate(us)]
        kept = [seen.get(u[0]) for u in us]
        mark = [False] * len(text or "")
        run = [False] * len(us)
        i = 0
        while i < len(us):
            j = i
            while j < len(us) and rep[j]:
                j += 1
            if j > i and sum(u[3] for u in us[i:j]) >= run_words:
                run[i:j] = [True] * (j - i)
                mark[us[i][1] : us[j - 1][2]] = [True] * (us[j - 1][2] - us[i][1])
            i = max(j, i + 1)
        for k, u in enumerate(us):
            if all(r for r, o in zip(rep, us) if o[4] == u[4]) and rep[k]:
                mark[u[4] : u[5]] = [True] * (u[5] - u[4])
        for u in us:
            seen.setdefault(u[0], d)
        for m in re.finditer("1+", "".join("01"[x] for x in mark)):
            spans.append((d, m.start(), m.end()))
    return sorted(spans, key=repr)


def found(df, **options):
    return sorted(((r.doc_id, r.span_start, r.span_end) for r in substrings.span_rows(df, **options).collect()), key=repr)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(300)) for _ in range(n)) + rng.choice(".!?")


def test_against_plain(spark):
    rng = random.Random(4)
    pool = [sentence(rng, rng.randint(2, 9)) for _ in range(60)]
    rows = []
    for d in range(60):
        text = ""
        for _ in range(rng.randint(0, 14)):
            text += (rng.choice(pool) if rng.random() < 0.5 else sentence(rng, rng.randint(1, 9))) + rng.choice([" ", " ", "\n", "  ", "\n\n"])
        rows.append((d, text))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == plain_spans(rows)


def test_given_tables(spark):
    docs = spark.read.parquet(SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {}
    for d, a, b in found(docs):
        got.setdefault(d, []).append((a, b))
    want = {}
    for d, a, b in plain_spans([r for r in rows if max((len(x.split()) for x in re.split(r"[.!?]\s|\n", r[1])), default=0) <= 20]):
        want.setdefault(d, []).append((a, b))
    assert len(set(want) - set(got)) == 0  # leaving documents out can only lose repeats
    texts = dict(rows)
    for r in substrings.without_repeats(docs).collect():
        left = texts[r.doc_id]
        for a, b in sorted(got.get(r.doc_id, []), reverse=True):
            left = left[:a] + left[b:]
        assert (r.text, r.n_chars) == (left, len(left))


@pytest.mark.parametrize("joint", ["\n", " "])
def test_a_passage_of_over_50_words(spark, joint):
    rng = random.Random(9)
    passage = " ".join(sentence(rng, n) for n in (9, 6, 12, 8, 11, 7, 5))
    texts = [f"{sentence(rng, 30)[:-1]}{joint}{passage}{joint}{sentence(rng, 30)}" for _ in range(5)] + [sentence(rng, 60), passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = substrings.span_rows(df).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 6} and 0 in {r.kept_doc_id for r in rows}
    for r in rows:
        assert len(texts[r.doc_id][r.span_start : r.span_end].split()) >= len(passage.split()) - 18


def test_long_sentences_are_cut_at_the_same_words(spark):
    rng = random.Random(1)
    inner = sentence(rng, 120)[:-1]
    texts = [f"{sentence(rng, 15)[:-1]} {inner} {sentence(rng, 15)}" for _ in range(3)]
    rows = substrings.span_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in rows} == {1, 2}


def test_hard_rows(spark):
    line = "This line has enough words."
    rows = [(None, line), (1, None), (2, ""), (3, line + "\n" + "Was it? " * 3), (3, line + "\n" + "Was it? " * 3), (4, "  THIS  line has\tenough words. \nown words are here now"),
            (5, "x " * 50_000), (6, line), (6, "other " + line), (7, "\n\n.\n!? ...\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 AS spans", "1 AS span_id", "2 AS n_chars")
    assert found(df) == sorted([(None, 0, len(line)), (4, 0, 32), (6, 0, len(line))], key=repr)
    clean = substrings.without_repeats(df)
    assert clean.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in clean.collect()), key=repr) == sorted(
        ((d, {(None, line): "", (6, line): "", (4, rows[5][1]): "own words are here now"}.get((d, t), t), {(None, line): 0, (6, line): 0, (4, rows[5][1]): 22}.get((d, t), 2)) for d, t in rows), key=repr
    )
    assert substrings.without_repeats(df.limit(0)).count() == 0 and found(df.limit(0)) == []
